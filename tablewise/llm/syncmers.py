"""Document fingerprints from closed syncmers, in built-in functions only.

A text is read as letters: pieces of at most eight characters, cut at white space. A k-mer is
five letters in a row, its inner substrings are the four pairs of neighbours. The k-mer is an
anchor (a closed syncmer) if its least pair, by hash, is the first or the last: this depends on
the k-mer alone, never on what surrounds it, so a passage has the same anchors in every text
that holds it. Four marks before and behind the text let short texts have anchors too.

An anchor is packed into one long: 39 bits of hash, 24 bits of position. The fingerprint of a
text is its 64 anchors of least hash (the first place of each); likeness is the share of the
64 least hashes of both that both have, an unbiased estimate of the anchor sets' Jaccard
similarity, and exact for texts of few anchors. Positions let two fingerprints be aligned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import columns_of, stored

SIZE = 64
POSITION_BITS, HASH_BITS = 24, 39
NONE = 0x7FFFFFFFFFFFFFFF


def letter_hashes(text: Column) -> Column:
    """Hash of each letter of the text."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,8}"), F.lit(0))
    return F.transform(pieces, lambda w: F.xxhash64(w))


def pair_hashes(letters: Column) -> Column:
    """Hash of each pair of neighbours, the text's ends included; pairs of marks come last in order."""
    marks = F.array_repeat(F.lit(NONE).cast("long"), 3)
    left = F.concat(F.array(F.lit(0).cast("long")), letters)
    right = F.concat(letters, F.array(F.lit(1).cast("long")))
    return F.concat(marks, F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)), marks)


def closed_syncmers(pairs: Column) -> Column:
    """Packed anchors (hash, position) of a text, in order of position."""
    mask = (1 << HASH_BITS) - 1

    def anchor(i: Column) -> Column:
        a, b, c, d = (F.get(pairs, i + j) for j in range(4))
        closed = F.least(a, d) <= F.least(b, c)
        packed = F.shiftleft(F.xxhash64(a, b, c, d).bitwiseAND(F.lit(mask)), POSITION_BITS).bitwiseOR(
            F.least(i, F.lit((1 << POSITION_BITS) - 1)).cast("long")
        )
        return F.when(closed, packed)

    # Texts without letters have the pairs of marks alone, and one pair of both ends: seven.
    places = F.when(F.size(pairs) > 7, F.sequence(F.lit(0), F.size(pairs) - 4)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, anchor), lambda x: x.isNotNull())


def least_anchors(anchors: Column, size: int = SIZE) -> Column:
    """The ``size`` anchors of least hash; of equal hashes the first place."""
    ordered = F.sort_array(anchors)
    return F.transform(
        F.array(ordered),
        lambda s: F.slice(
            F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, POSITION_BITS) != F.shiftright(F.get(s, i - 1), POSITION_BITS))),
            1,
            size,
        ),
    )[0]


def with_fingerprint(df: DataFrame, text: str, name: str, size: int = SIZE) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as packed anchors in column ``name``."""
    keep = [c for c in df.columns]
    # One projection per step: each array is made once, however often the next step names it.
    df = df.withColumn("__letters", letter_hashes(F.col(text)))
    df = df.withColumn("__pairs", pair_hashes(F.col("__letters")))
    df = df.withColumn(name, least_anchors(closed_syncmers(F.col("__pairs")), size))
    return df.select(*keep, name)


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of common hashes among the least ``size`` hashes of both; 1 where both are empty."""
    first = F.transform(a, lambda x: F.shiftright(x, POSITION_BITS))
    second = F.transform(b, lambda x: F.shiftright(x, POSITION_BITS))
    common = F.array_intersect(first, second)
    union = F.slice(F.sort_array(F.array_union(first, second)), 1, size)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, common)) / F.size(union))


def shown(a: Column) -> Column:
    """The fingerprint as text: 16 hexadecimal digits an anchor."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def successors(keys: DataFrame) -> DataFrame:
    """Each key (k1, k2 with doc_id, order, n_chars) with the next in order; after the last comes the first.

    The keys are sorted over the cluster and stored with the place in their partition. A place's
    successor is the next place, or the first of the next partition that has rows: only one row
    per partition is gathered for that.
    """
    ordered = keys.orderBy(F.col("doc_id").asc_nulls_first(), "k1", "k2")
    placed = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    edges = placed.groupBy(part.alias("p")).agg(F.max("at").alias("last"), F.min("at").alias("first"))
    by_part = Window.orderBy("p")
    least = F.min("first").over(Window.partitionBy())
    edges = edges.select("last", F.coalesce(F.lead("first").over(by_part), least).alias("then"))
    linked = placed.join(F.broadcast(edges), placed["at"] == edges["last"], "left")  # one row per partition
    linked = linked.withColumn("next_at", F.coalesce("then", F.col("at") + 1)).drop("last", "then")
    following = placed.select(F.col("at").alias("next_at"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    return linked.join(following, "next_at").drop("next_at", "at")


def fingerprints(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next one's are.

    One row per row of ``documents`` (doc_id, text). The edited text has its last quarter
    (rounded down, in code points) replaced by as many first code points of the next document,
    or all it has. Documents follow each other by doc_id, null first; those of one doc_id by a
    hash of their text. Rows equal in both count as one document, whose row is repeated. Null
    texts count as empty ones: no anchors, likeness 1 to an empty text and 0 to others. An empty
    table gives no rows; a single document is followed by itself. Other columns are ignored.
    """
    docs = columns_of(documents, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    null = F.col("doc_id").isNull()
    docs = docs.withColumn("k1", F.xxhash64(null, "doc_id", "text")).withColumn("k2", F.xxhash64("text", null, "doc_id"))
    keys = docs.select("doc_id", "k1", "k2", F.length("text").cast("long").alias("n_chars")).distinct()
    links = stored(successors(keys), "next")
    # The texts move once, by key; both joins read that exchange.
    texts = with_fingerprint(docs.select("k1", "k2", "text"), "text", "own", size)
    follow = texts.join(
        links.select(
            F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "n_chars"
        ).hint("shuffle_hash"),
        ["k1", "k2"],
    ).select(
        F.col("p1").alias("k1"),
        F.col("p2").alias("k2"),
        F.substring("text", F.lit(1), F.floor(F.col("n_chars") / 4).cast("int")).alias("tail"),
        F.col("own").alias("next"),
    )
    follow = follow.dropDuplicates(["k1", "k2"])
    own = texts.join(links.select("k1", "k2", "doc_id", "n_chars").hint("shuffle_hash"), ["k1", "k2"])
    both = own.join(follow.hint("shuffle_hash"), ["k1", "k2"])
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    both = both.select(
        "doc_id", "n_chars", "own", "next", F.concat(F.substring("text", F.lit(1), kept), "tail").alias("edited_text")
    )
    both = with_fingerprint(both, "edited_text", "edited", size)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), size).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), size).alias("near_next"),
    )
