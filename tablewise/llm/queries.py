"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewise.llm.common import table
from tablewise.llm.oracles import ORACLES  # noqa: F401  (registered with the queries)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Where the box keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_store(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.token_store import token_store

    return token_store(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


@query
def op3_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.decontaminate import contamination

    return contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("text_key")


@query
def op5_syncmers(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.syncmers import fingerprints

    return fingerprints(table(spark, d, "documents"))


@query
def op8_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.substrings import without_repeats

    return without_repeats(table(spark, d, "documents"))


@query
def op9_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, d, "documents"))


@query
def op10_personal_data(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.personal import personal_data

    return personal_data(table(spark, d, "documents"))


@query
def op6_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.resampling import resampled

    out = resampled(table(spark, d, "documents"), table(spark, d, "labels"))
    return out.select("doc_id", "source", "log_weight", "gumbel", "key")


@query
def op7_attention_scores(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.attention import scores

    return scores(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op4_poisson_mixing(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tablewise.llm.mixing import mixed_sources

    out = mixed_sources(table(spark, d, "documents"))
    return out.withColumn("mix_rate", F.round("mix_rate", 6))


@query
def op2_warc_derivatives(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.warc import derivatives, responses

    return derivatives(responses(table(spark, d, "pages")))


@query
def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.alignment import alignment_report

    return alignment_report(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op12_minhash_join(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.minhash import near_copies

    return near_copies(table(spark, d, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.llm.conversations import repair_report

    return repair_report(table(spark, d, "conversations"))
