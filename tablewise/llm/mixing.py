"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target share of the characters, over its share now. A
document's number of copies is Poisson with that mean, found by inverting the distribution at a
uniform number from a hash of seed and doc_id, so it depends on nothing but the document and
its source's rate. Rates above 16 are split into parts that are drawn one by one and added.
Copies are ordered by a hash of doc_id and copy number over the whole cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rates are inverted in parts of at most 16, over 64 terms: what lies beyond has less than 2^-52.
PART, TERMS = 16.0, 64


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of an md5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson(u: Column, rate: Column) -> Column:
    """The least k at which the cumulated probability reaches ``u``."""

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), (acc["n"] + F.when(acc["sum"] < u, 1).otherwise(0)).alias("n"))

    none = F.exp(-rate)
    start = F.struct(none.alias("p"), none.alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["n"])


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    """Poisson copies of a document."""
    parts = F.greatest(F.ceil(rate / PART).cast("int"), F.lit(1))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("none")))
    return F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda acc, part: acc + poisson(uniform(F.concat_ws(":", name, part.cast("string"))), rate / parts),
    )


def rates(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(mix_source, mix_rate): target share over present share, both in characters.

    Without ``weights`` a source's target is the square root of its characters, which
    evens sources out. Sources that ``weights`` leaves out get rate 0; sources without a character
    get rate 1. NULL is a source like others (its weight has the key "").
    """
    sizes = documents.groupBy(F.col("source").cast("string").alias("mix_source")).agg(
        F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))).alias("chars")
    )
    if weights is None:
        target = F.sqrt(F.col("chars").cast("double"))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        target = F.when(F.col("chars") > 0, F.coalesce(F.try_element_at(given, F.coalesce("mix_source", F.lit(""))).cast("double"), F.lit(0.0)))
    sizes = sizes.withColumn("target", F.coalesce(target, F.lit(0.0)))
    chars, target = sizes.agg(F.sum("chars"), F.sum("target")).first()  # one row per source is summed
    rate = F.col("target") / F.lit(float(target or 1)) * F.lit(float(chars or 0)) / F.col("chars")
    rate = F.when(F.col("chars") == 0, F.lit(1.0)).when(F.lit(not target), F.lit(0.0)).otherwise(rate)
    return sizes.select("mix_source", rate.alias("mix_rate"))


def mixed_sources(documents: DataFrame, weights: dict[str, float] | None = None, seed: int = 11) -> DataFrame:
    """Replicated and shuffled rows of ``documents`` with all their columns and mix_copy, mix_copies, mix_rate, mix_order.

    ``mix_copy`` counts a document's copies from 1; documents of 0 copies give no row. Rows that
    share a doc_id and source share their number of copies and order; a null doc_id counts as
    one id. Null texts have no characters but are copied like others of their source. An empty
    table gives no rows. Columns of the new names are replaced.
    """
    own = ["mix_source", "mix_rate", "mix_copies", "mix_copy", "mix_order"]
    docs = documents.drop(*own)
    by = rates(docs, weights)
    mixed = docs.join(by, docs["source"].cast("string").eqNullSafe(by["mix_source"])).drop("mix_source")
    mixed = mixed.withColumn("mix_copies", copies(F.col("doc_id"), F.col("mix_rate"), seed)).where("mix_copies > 0")
    mixed = mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_copies")))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("mix_copy").cast("string"))
    mixed = mixed.withColumn("mix_order", F.md5(name))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "mix_order").sortWithinPartitions("mix_order")
