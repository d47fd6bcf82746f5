"""Near copies by MinHash lists against brute force over all pairs."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.llm import minhash
from tablewise.llm.minhash import bitmap, candidate_pairs, collisions, folded, near_copies, signatures
from tablewise.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def brute_force(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) of every row, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in holders[g] if j > i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[root(j)] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(root(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=str)


def results(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def copies(seed, families=6, members=25):
    """Families of texts with few to many changed words, in part linked only by way of others; and exact copies."""
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(5000)}"
    line = [word() for _ in range(12)]
    rows, doc = [], 0
    for _ in range(families):
        base = [word() for _ in range(pick.choice([40, 120, 400]))]
        for _ in range(members):
            text = list(base)
            for _ in range(pick.choice([0, 1, 1, 2, 4, 8])):
                text[pick.randrange(len(text))] = word()
            if pick.random() < 0.3:
                text += line
            rows.append((doc, " ".join(text)))
            doc += 1
    rows += [(doc + i, " ".join(line + [word() for _ in range(30)])) for i in range(30)]
    return rows


def table(spark, rows):
    clash = ("g", "h", "id", "n", "t", "token", "name", "label", "least", "tokens", "bits")
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in clash})


@pytest.mark.parametrize("tile", [1024, 6])
def test_components_are_those_of_all_pairs(spark, tile):
    rows = copies(11)
    rows += [(None, None), (None, rows[0][1]), (5, rows[5][1]), (900, ""), (901, " \t "), (902, "two words"), (903, "Two  Words"), (None, "alone " * 9)]
    assert results(near_copies(table(spark, rows), tile=tile)) == brute_force(rows)


def test_the_query_on_the_given_table(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert results(QUERIES["op12_minhash_join"](spark, sf)) == brute_force(rows)


def test_long_texts_and_a_third_of_copies(spark):
    long = " ".join(f"x{i % 7919}" for i in range(30_000))
    rows = [(1, long), (2, long + " tail"), (3, "y" * 60_000)] + [(10 + i, "the same few words again and again") for i in range(200)]
    rows += [(1000 + i, " ".join(f"z{i}_{j}" for j in range(20))) for i in range(400)]
    assert results(near_copies(table(spark, rows))) == brute_force(rows)


def test_a_table_without_rows_or_words(spark):
    assert near_copies(table(spark, [(1, "a")]).limit(0)).collect() == []
    assert results(near_copies(table(spark, [(1, None), (2, "")]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_coordinates_agree_as_sets_do():
    pick = np.random.default_rng(3)
    base = pick.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.5, 0.85, 1.0):
        hits = []
        for _ in range(30):
            x = pick.choice(base, 400, replace=False)
            keep = int(400 * 2 * share / (1 + share))
            y = np.concatenate([x[:keep], pick.integers(0, 1 << 63, 400 - keep, dtype=np.uint64)])
            s = signatures([np.unique(x), np.unique(y)])
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - share) < 0.04


def test_skipping_gives_up_only_hopeless_pairs():
    pick = np.random.default_rng(4)
    tokens = pick.integers(0, 3, (60, minhash.COORDINATES)).astype("<u2")
    tokens[30:] = np.where(pick.random((30, minhash.COORDINATES)) < 0.5, tokens[:30], tokens[30:])
    i, j = np.triu_indices(60, 1)
    place, counts = collisions(tokens, i, j)
    full = (tokens[i] == tokens[j]).sum(axis=1)
    assert place.tolist() == np.flatnonzero(full >= minhash.MATCHES).tolist()
    assert counts.tolist() == full[place].tolist()


def test_bitmaps_never_differ_in_more_bits_than_sets():
    pick = np.random.default_rng(5)
    for size in (3, 70, 500):
        x = pick.integers(0, 1 << 63, size, dtype=np.uint64)
        y = np.concatenate([x[: size // 2], pick.integers(0, 1 << 63, size, dtype=np.uint64)])
        a, b = bitmap(x), bitmap(y)
        least = min(len(a), len(b))
        apart = int(np.bitwise_count(folded(a, least) ^ folded(b, least)).sum())
        assert apart <= len(np.setxor1d(x, y))


def test_a_list_names_a_forest_and_not_all_pairs():
    sets = [np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(40)]
    tokens = (signatures(sets) >> np.uint64(48)).astype("<u2")
    args = (np.full(40, 100), tokens, [bitmap(s) for s in sets], np.arange(40), None)
    assert len(candidate_pairs(*args, set(), 85, 1)) == 39
    assert len(candidate_pairs(*args, set(), 85, 0)) == 40 * 39 // 2
    assert (0, 1) not in candidate_pairs(*args, {(0, 1)}, 85, 0)
