"""Grain: the smallest set of columns that identifies a row.

The search goes by size and is steered by difference sets. Two different rows that agree on a set of columns
refute it, and the columns in which they do differ are a set of which every grain must hold one. So only
hitting sets of the differences seen so far are looked at, and a few pairs of rows rule out most of
the others, however many columns there are and however large the grain is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions import columns as C
from tablewise.functions import names
from tablewise.functions.columns import col
from tablewise.operators.profile import ATTRIBUTE, DATE, FOREIGN_KEY, KEY, KEYS, Profile

# Rows per column set looked at by the screen; it refutes column sets, it accepts none.
SCREEN_ROWS = 100_000
# Column sets screened at once, and pairs of rows that each refuted one teaches from.
SCREENED, PAIRS = 32, 8


def grain_candidates(profile: Profile) -> list[str]:
    """Likely row identifiers first: keys, line numbers, foreign keys, labels, dates."""
    labels = [
        c["column"] for c in profile.by_role(ATTRIBUTE) if c["logical_type"] == C.INTEGER
    ]
    lines = [n for n in labels if re.search(names.SEQUENCE, n)]
    rest = [n for n in labels if n not in lines]
    return [
        *profile.names(KEY),
        *lines,
        *profile.names(FOREIGN_KEY),
        *rest,
        *profile.names(DATE),
    ]


def hitting_sets(width: int, size: int, differences: set[int], keys: int) -> Iterator[tuple[int, ...]]:
    """Sets of ``size`` of ``width`` columns in order that hold a key and meet every difference.

    Differences and ``keys`` are bit masks of columns.
    """

    def extend(chosen: tuple[int, ...], held: int) -> Iterator[tuple[int, ...]]:
        unmet = [d for d in differences if not d & held]
        if len(chosen) == size:
            if not unmet and held & keys:
                yield chosen
            return
        start = chosen[-1] + 1 if chosen else 0
        # What is still unmet needs a later column, and the last column has to meet all of it.
        if any(not d >> start for d in unmet):
            return
        last = len(chosen) + 1 == size
        for c in range(start, width - (size - len(chosen)) + 1):
            if not last or all(d >> c & 1 for d in unmet):
                yield from extend((*chosen, c), held | 1 << c)

    yield from extend((), 0)


def detect_grain(df: DataFrame, profile: Profile) -> tuple[list[str], bool]:
    """Grain columns in source order, and whether raw rows are unique too.

    Exact copies of a row can never be told apart, so a set identifies rows when it has as many
    values as there are distinct rows; that number is known from the profile. Of the smallest such
    sets the first in the order of the candidates is taken. Sets are refuted by counterexamples only,
    and the one taken is counted exactly.
    """
    distinct_rows = profile.rows - profile.duplicate_rows
    facts = {c["column"]: c for c in profile.columns}
    usable = [n for n in grain_candidates(profile) if facts[n]["null_count"] == 0]
    keys = sum(1 << i for i, n in enumerate(usable) if n in set(profile.names(*KEYS)))
    if not distinct_rows or not keys:
        return [], False
    sizes = [facts[n]["distinct_count"] for n in usable]

    def found(chosen: tuple[int, ...]) -> tuple[list[str], bool]:
        held = {usable[i] for i in chosen}
        return [n for n in df.columns if n in held], profile.duplicate_rows == 0

    # The profile's distinct counts are exact already.
    for chosen in hitting_sets(len(usable), 1, set(), keys):
        if sizes[chosen[0]] == distinct_rows:
            return found(chosen)
    if _distinct(df, usable) != distinct_rows:
        return [], False  # two rows differ in none of the candidates
    differences: set[int] = set()
    slices = max(1, profile.rows // SCREEN_ROWS)
    for size in range(2, len(usable) + 1):
        standing: set[tuple[int, ...]] = set()
        while True:
            # Refuted sets meet some difference set no more, so they are not among these again.
            open_ = hitting_sets(len(usable), size, differences, keys)
            batch = list(islice((c for c in open_ if prod(sizes[i] for i in c) >= distinct_rows), SCREENED))
            if not batch:
                break
            if batch[0] in standing:
                # The screen has nothing against the first set left: it is counted.
                if _distinct(df, [usable[i] for i in batch[0]]) == distinct_rows:
                    return found(batch[0])
                seen = _counterexamples(df, usable, batch[:1], 1)
            else:
                seen = _counterexamples(df, usable, batch, slices)
                standing |= {c for i, c in enumerate(batch) if i not in seen}
            differences |= {d for masks in seen.values() for d in masks}
            if 0 in differences:
                return [], False
            differences = {d for d in differences if not any(o != d and o & d == o for o in differences)}
    return [], False


def _distinct(df: DataFrame, chosen: list[str]) -> int:
    return df.select(*[col(n) for n in chosen]).distinct().count()


def _counterexamples(df: DataFrame, usable: list[str], batch: list[tuple[int, ...]], slices: int) -> dict[int, set[int]]:
    """For refuted sets, by place in ``batch``: masks of the columns in which colliding rows differ.

    A slice of a set holds all rows of the values in it, so two of its rows that share a value and are not
    equal are a true counterexample. Values and rows are compared by hashes; what hashing misses is
    left to the exact count. Slicing keeps the shuffle near constant as the table grows.
    """
    whole = F.xxhash64(*[col(n) for n in C.comparable(df).columns]).alias("row")
    rows = C.comparable(df).select(whole, *[F.xxhash64(col(n)).alias(f"c{i}") for i, n in enumerate(usable)])
    cells = []
    for i, chosen in enumerate(batch):
        first = F.xxhash64(*[F.col(f"c{c}") for c in chosen])
        second = F.xxhash64(F.lit(i + 1), *[F.col(f"c{c}") for c in reversed(chosen)])
        kept = F.pmod(first, F.lit(slices)) == 0
        cells += [F.lit(i), F.when(kept, first), F.when(kept, second)]
    groups = (
        rows.select("row", F.stack(F.lit(len(batch)), *cells).alias("i", "h", "g"))
        .filter("h IS NOT NULL")
        .groupBy("i", "h", "g")
        .agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
        .filter("lo <> hi")
    )
    rank = F.row_number().over(Window.partitionBy("i").orderBy("h", "g"))
    pairs = groups.withColumn("rn", rank).filter(F.col("rn") <= PAIRS).select("i", "lo", "hi").collect()
    if not pairs:
        return {}
    wanted = sorted({x for p in pairs for x in (p["lo"], p["hi"])})
    # At most SCREENED * PAIRS * 2 rows, fetched by their hashes.
    held = rows.filter(F.col("row").isin(wanted)).groupBy("row")
    values = held.agg(*[F.min(f"c{i}").alias(f"c{i}") for i in range(len(usable))]).collect()
    by_row = {r["row"]: r[1:] for r in values}
    result: dict[int, set[int]] = {}
    for p in pairs:
        both = zip(by_row[p["lo"]], by_row[p["hi"]], strict=True)
        result.setdefault(p["i"], set()).add(sum(1 << c for c, (x, y) in enumerate(both) if x != y))
    return result
