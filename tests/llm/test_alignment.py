"""Aligned token ids against all pairs of byte ranges, and pair counts by both ways back to the documents."""

from __future__ import annotations

import collections
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tablewise.llm.alignment import ByteLevel, alignment_report, alignments, byte_level, grouped, linked
from tablewise.llm.queries import QUERIES, vocabulary

FIRST, SECOND = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
HARD = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\nlines\r\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "café \U0001f600\U0001f600",
    "中文字符", "the ▁ mark itself", "x\x00y", "é ﬁ Ａ", "the the the the", "a" * 5000, "word " * 3000, "​﻿",
]


def brute_force(rows):
    """The contract, pair by pair of byte ranges."""
    a_model, b_model = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    a_model.encode_special_tokens = True
    texts, counts = [], collections.Counter()
    for doc, text in rows:
        spans, ids = [], []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            a_bytes = [byte_level(a_model.id_to_token(i)) for i in a]
            b_bytes = [
                bytes([int(b_model.id_to_piece(i)[1:-1], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
                for i in b
            ]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ids = [a, b]
                for parts in (a_bytes, b_bytes):
                    at, own = 0, []
                    for p in parts:
                        own.append((at, at + len(p)))
                        at += len(p)
                    spans.append(own)
        links, groups = [], []
        if ids:
            shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            left = [collections.deque(zip(x, y, strict=True)) for x, y in zip(ids, spans, strict=True)]
            for end in shared:
                inside = []
                for tokens in left:
                    own = []
                    while tokens and tokens[0][1][1] <= end:
                        own.append(str(tokens.popleft()[0]))
                    inside.append(",".join(own))
                groups.append("|".join(inside))
            j0 = 0
            for i, (s, e) in zip(ids[0], spans[0], strict=True):
                while spans[1][j0][1] <= s:
                    j0 += 1
                j = j0
                while j < len(ids[1]) and spans[1][j][0] < e:
                    links.append((i, ids[1][j]))
                    j += 1
        counts.update(set(links))
        texts.append((doc, ids, groups, links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for doc, ids, groups, links in texts:
        n_best = sum(counts[p] == best[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids else ""
        sizes = [len(x) for x in ids] or [0, 0]
        out.append((doc, *sizes, len(groups), len(links), n_best, sum(counts[p] for p in links), digest))
    return out


@pytest.mark.parametrize("common", [1 << 20, 60, 0])
def test_matches_all_pairs_of_ranges(spark, sf, common):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY length(text) LIMIT 120").fetchall()
    rows = [*rows, *((10_000 + i, t) for i, t in enumerate(HARD)), (None, "no id"), (7, "same row"), (7, "same row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "pair", "n", "a", "groups")})
    got = alignment_report(docs, FIRST, SECOND, common)
    key = str
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute_force(rows), key=key)


def test_the_query_covers_the_table(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in QUERIES["op11_token_alignment"](spark, sf).collect()), key=str)
    assert got == sorted(brute_force(rows), key=str)


def test_groups_are_slices_of_both_lists(spark):
    docs = spark.createDataFrame([(1, "unbelievable \U0001f600 things")], "doc_id long, text string")
    row = alignments(docs, FIRST, SECOND).first()
    a = [i for g in row.groups.split(";") for i in g.split("|")[0].split(",")]
    b = [i for g in row.groups.split(";") for i in g.split("|")[1].split(",")]
    assert [int(i) for i in a] == Tokenizer.from_file(FIRST).encode(" " + docs.first().text).ids
    assert [int(i) for i in b] == SentencePieceProcessor(model_file=SECOND).encode(docs.first().text)
    assert sum(row.times) == row.n_links and row.pairs == sorted(row.pairs)


def test_links_of_crossing_tokens():
    ends_a, ends_b = np.array([2, 5, 9, 10, 11, 12]), np.array([3, 4, 9, 12])
    cuts = grouped(ends_a, ends_b)
    assert [c.tolist() for c in cuts] == [[3, 6], [3, 4]]
    i, j = linked(ends_a, ends_b, *cuts)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 2), (3, 3), (4, 3), (5, 3)]


def test_ranks_and_merges_give_the_same_ids():
    import random

    pick = random.Random(8)
    pool = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), *range(0x4E00, 0x4E20), 0x85, 0x3000, 0x1F600, 0x10FFFD, 0xFEFF)]
    texts = ["".join(pick.choices(pool, k=pick.randint(1, 60))) for _ in range(3000)] + ["x" * 50_000, *filter(None, HARD)]
    model = ByteLevel(FIRST)
    assert model.ranked is not None
    fast = model.encode(texts)
    model.ranked = None
    assert model.encode(texts) == fast


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment_report(docs, FIRST, SECOND).collect() == []
