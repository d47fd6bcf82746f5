"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewise.llm.attention import scores
from tablewise.llm.decontaminate import contamination, decontaminated
from tablewise.llm.jaccard_join import jaccard_components, one_of_each
from tablewise.llm.mixing import mixed_sources
from tablewise.llm.personal import personal_data
from tablewise.llm.queries import vocabulary
from tablewise.llm.resampling import resampled
from tablewise.llm.substrings import without_repeats
from tablewise.llm.syncmers import fingerprints
from tablewise.llm.token_store import token_store
from tablewise.llm.warc import derivatives, responses

#: Names that the operators use inside.
CLASH = "h k n t doc tag shard label copies first last ids start part counts own next d kind score ctx total held_out".split()
LONG = " ".join(f"w{i % 4001}" for i in range(30_000))
ROWS = [
    (None, None, None),
    (None, "only text", "a"),
    (1, "", "a"),
    (2, "one two three four five", "a"),
    (2, "one two three four five", "a"),
    (2, "another text of this id", None),
    (3, LONG, "b"),
    (4, "x" * 50_000, "b"),
    (5, "  \t\n ", "b"),
    (6, None, "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "three four"), (1, "three four"), (None, "another text"), (7, None), (8, ""), (9, " ".join(f"w{i}" for i in range(20)))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("h", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(2, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, None), (None, 1, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("kind", F.lit(9))


OPERATORS = {
    "token_store": lambda d, b, q: token_store(d, vocabulary("word_bpe_49k.json")),
    "contamination": lambda d, b, q: contamination(d, b),
    "fingerprints": lambda d, b, q: fingerprints(d),
    "scores": lambda d, b, q: scores(d, vocabulary("word_bpe_49k.json")),
    "without_repeats": lambda d, b, q: without_repeats(d),
    "jaccard_components": lambda d, b, q: jaccard_components(d),
    "personal_data": lambda d, b, q: personal_data(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_row(docs, benchmark, labels, name):
    got = OPERATORS[name](docs, benchmark, labels).collect()
    order = lambda v: (v is not None, v or 0)
    assert sorted((r.doc_id for r in got), key=order) == sorted((r[0] for r in ROWS), key=order)
    # Equal rows give equal results but for their place in a store.
    twice = [r.asDict() for r in got if r.doc_id == 2]
    keep = [tuple(v for k, v in r.items() if k != "start") for r in twice]
    assert len(set(keep)) < len(keep)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_none(docs, benchmark, labels, name):
    assert OPERATORS[name](docs.limit(0), benchmark.limit(0), labels.limit(0)).collect() == []


def test_words_of_blank_texts(docs, benchmark):
    got = {(r.doc_id, r.n_words, r.n_hit) for r in contamination(docs, benchmark).collect()}
    assert {(1, 0, 0), (5, 0, 0), (6, 0, 0), (2, 5, 2)} <= got
    # The item without an id is found as well.
    assert (2, 5, 2) in got and any(r.n_items == 1 for r in contamination(docs, benchmark).collect() if r.doc_id == 2)
    linked = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert {(1, 0, 1), (5, 0, 5), (6, 0, 6), (2, 3, 2), (4, 1, 4), (None, 0, None)} <= linked
    stays = {(r.doc_id, r.n_words, r.n_removed) for r in without_repeats(docs).collect()}
    assert {(1, 0, 0), (2, 5, 0), (4, 1, 0)} <= stays


def test_filters_keep_all_columns(docs, benchmark, labels):
    clean = decontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {None, 1, 3, 4, 5, 6}
    assert decontaminated(docs.limit(0), benchmark).collect() == []
    single = one_of_each(docs)
    assert single.columns == docs.columns
    assert sorted(r.text for r in single.collect() if r.doc_id == 2) == ["another text of this id", "one two three four five"]
    assert single.where("doc_id IN (1, 5, 6)").count() == 3
    kept = resampled(docs, labels)
    assert kept.columns == [*docs.columns, "log_weight", "gumbel", "key"]
    assert kept.count() >= 1
    # Without labels nothing is known, and all rows stay.
    assert resampled(docs, labels.limit(0)).count() == len(ROWS)
    assert resampled(docs.limit(0), labels).collect() == []


def test_mixing_edges(docs):
    got = mixed_sources(docs, {"a": 1.0, "b": 1.0, "": 1.0})
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert [r.mix_order for r in rows] == sorted(r.mix_order for r in rows)
    copies = {}
    for r in rows:
        copies.setdefault((r.doc_id, r.text, r.source), []).append(r.mix_copy)
    assert all(max(c) == len(set(c)) for c in copies.values())
    assert mixed_sources(docs.limit(0)).collect() == []
    assert mixed_sources(docs, {"zzz": 1.0}).where("source = 'b'").collect() == []


def test_warc_edges(spark):
    rows = [(1, "http://a/", None), (1, "http://a/", None), (None, None, ""), (2, "u", "<p>" * 20_000 + "end"), (3, "u", "no tags &amp; all")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    got = derivatives(responses(pages)).collect()
    assert len(got) == 2 * len(rows)
    assert {r.block for r in got if r.page_id == 2 and r.record_type == "conversion"} == {"end"}
    assert {r.block for r in got if r.page_id == 3 and r.record_type == "conversion"} == {"no tags & all"}
    assert {r.content_length for r in got if r.page_id == 1} == {0}
    assert derivatives(responses(pages.limit(0))).collect() == []
