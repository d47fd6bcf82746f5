"""Repaired conversations against a search over all sequences of edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewise.llm.conversations import START, accepted, damaged, faults, parsed, repair_report, repaired
from tablewise.llm.queries import QUERIES

GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def first_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Edits in order of (cost, audit) until one gives a legal conversation."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, initials, made = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, made
        bound = 2 * len(rows)
        ways = []
        if cost + 5 <= bound:
            ways += [(5, "I", i, r[0], ((r, ""),)) for r in ("user", "assistant")]
        if i < len(rows):
            ways.append((2, "D", i + 1, "", ()))
            if kinds[i] in "t-":
                extra = 5 if kinds[i] == "t" else 0
                role, text = rows[i][2:]
                ways.append((extra, "K", i + 1, role[:1], ((role, text),)))
                ways += [(1 + extra, "R", i + 1, r[0], ((r, text),)) for r in ("user", "assistant")]
        for c, letter, to, initial, rows_made in ways:
            longer = initials + initial
            if cost + c <= bound and re.fullmatch(r"(s?(ua)*u?)?", longer) and len(initial) == len(rows_made):
                heapq.heappush(heap, (cost + c, audit + letter, to, longer, made + rows_made))


def brute_force(table):
    convs = {}
    for row in table:
        convs.setdefault(row[0], [])
    for row in damage(table):
        convs[row[0]].append(row)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = first_faults(rows)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, made = cheapest(rows, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, digest))
    return out


def random_rows(seed, convs=60):
    pick = random.Random(seed)
    texts = ["Fine.", "Is it?", "no end", " \t\n", "", None, "Ends here!  \n", " ", "a.b"]
    roles = ["user", "assistant", "system", "tool", None, "", "unknown"]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(pick.randint(1, 6)):
            turn = None if pick.random() < 0.1 else turn * pick.choice([1, 1, 3])
            role = pick.choice(roles[:3] if pick.random() < 0.8 else roles)
            rows.append((conv, turn, role, pick.choice(texts)))
    return rows


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("clash") for c in ("copy", "digest", "code", "kind", "place", "first", "audit", "c", "n")})


def test_matches_a_search_over_all_edits(spark):
    rows = random_rows(3)
    got = sorted((tuple(r) for r in repair_report(table(spark, rows)).collect()), key=str)
    assert got == sorted(brute_force(rows), key=str)


def test_the_query_on_the_given_table(spark, sf):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    got = sorted((tuple(r) for r in QUERIES["op13_conversation_repair"](spark, sf).collect()), key=str)
    assert got == sorted(brute_force(rows), key=str)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_of_any_size_give_the_same(spark, size):
    rows = damaged(table(spark, random_rows(5, 12) + [(100, t, pick, "Yes.") for t, pick in enumerate(["user", "assistant", "user", "user"] * 40)]))
    rows = rows.repartition(7)
    one = sorted((tuple(r) for r in faults(rows).collect()), key=str)
    assert sorted((tuple(r) for r in faults(rows, size).collect()), key=str) == one


def test_a_conversation_with_a_third_of_all_rows(spark):
    long = [(1, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(9000)]
    short = [(2 + t // 4, t % 4, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(18_000)]
    rows = table(spark, long + short)
    got = {r.conv_id: r for r in faults(rows).collect()}
    assert got[1].audit == "K" * 9000 and got[1].cost == 0 and got[1].gaps == 0
    kept = repaired(rows, faults(rows)).where("conv_id = 1").agg(F.count("*").alias("n"), F.max("place").alias("top")).first()
    assert (kept.n, kept.top) == (9000, 8999)


def test_repeated_rows_and_lost_conversations(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    same = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    rows = [(lost, 0, "user", "Hi."), *[(same, 0, "user", "Hi.")] * 3]
    got = {r.conv_id: r for r in repair_report(table(spark, rows)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[lost]) == (lost, 0, 0, 0, 0, 0, 0, "", empty)
    # Two repeated rows go; the first needs an answer (5) or goes as well (2).
    assert (got[same].duplicate, got[same].illegal, got[same].cost, got[same].audit) == (2, 2, 6, "DDD")


def test_ties_take_the_least_audit():
    assert accepted(parsed({START: (0, "")}, ("u-", "u-"))) == (1, "KR")
    assert accepted(parsed({START: (0, "")}, ("s-",))) == (2, "D")
    # Any of three rows may go for 2; with the first or second gone another needs a new role.
    assert accepted(parsed({START: (0, "")}, ("u-", "u-", "a-"))) == (2, "DKK")


def test_an_empty_table(spark):
    assert repair_report(table(spark, []).limit(0)).collect() == []
