"""Personal data: patterns of four kinds, and what their contexts give away.

Base spans come from one regular expression a kind. From them, contexts are learnt and used to find
identifiers that the expressions miss (a card number with a wrong check digit, a phone number
without its plus sign):

1. *Instances*: base spans (trusted), and other numbers of four digits or more (unknown): whole runs of
   digit groups, joined by spaces, hyphens, dots, strokes or brackets, or else words that hold digits.
2. *Patterns*: the two words in front of an instance. Patterns and instances form a graph;
   patterns of fewer than three distinct instances are left out.
3. *Scores*, in rounds: a pattern's confidence for a kind is the share of its instances that is
   trusted as that kind, times the share of its occurrences in the whole corpus that
   an instance follows, so a context of everyday words scores nothing. An instance's
   score is 1 - product of (1 - confidence) over its patterns; from 0.3 it is trusted in the
   next round, where it may lift other patterns.
4. Unknown words that end up trusted, where they follow a pattern of such confidence, are spans.

Everything is built-in functions and joins; matches are marked with two control characters
(which the text itself may not hold: they are replaced by a third, at equal length, as none of
the expressions knows control characters), so that a split gives texts and positions at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import columns_of, stored

#: Kinds in the order of the output, with their expressions. Possessive repeats and the tests of
#: what precedes change no match: they keep long runs of one class of characters linear.
_LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
SPACE = r"\x20\x09-\x0D"
#: A run of digit groups up to the end of a word, or a word with a digit. Both start with a word, and only
#: classes of characters repeat, so that time is linear and no depth is used however long a run is.
RUN = rf"[(+]{{0,2}}[0-9][0-9().+/\x20-]*(?<=[0-9)])(?![^{SPACE},;:!?\]\x22'.])"
WORD = rf"(?<![^{SPACE}])(?:{RUN}|[^{SPACE}0-9]*+[0-9][^{SPACE}]*+)"
#: The last two words of a text that ends with a space, whole.
LAST_TWO = rf"(?<![^{SPACE}])[^{SPACE}]++[{SPACE}]++[^{SPACE}]++[{SPACE}]++$"
MIN_DISTINCT, CONFIDENCE, ROUNDS, MIN_DIGITS = 3, 0.3, 3, 4
OPEN, SHUT, OTHER = "\x01", "\x02", "\x03"
_SPAN = "array<struct<start:int,end:int,text:string,left:string>>"


def found_spans(text: Column, expression: str) -> Column:
    """Matches from left to right, with code point positions and the two words before, if nothing else is between."""
    marked = F.regexp_replace(text, expression, f"{OPEN}$0{SHUT}")
    parts = F.split(marked, f"[{OPEN}{SHUT}]", -1)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(
            acc["at"].alias("start"), end.alias("end"), part.alias("text"), F.regexp_extract(acc["before"], LAST_TWO, 0).alias("left")
        )
        return F.struct(
            end.alias("at"),
            (~acc["inside"]).alias("inside"),
            F.when(acc["inside"], F.lit("")).otherwise(part).alias("before"),
            F.when(acc["inside"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(False).alias("inside"),
        F.lit("").alias("before"),
        F.array().cast(_SPAN).alias("found"),
    )
    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds: every second digit from the right is doubled."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["odd"], d).otherwise(twice)).alias("sum"), (~acc["odd"]).alias("odd"))

    # Splitting by nothing leaves no empty part at the end; the filter keeps that so.
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd"))
    return F.aggregate(each, start, step, lambda acc: acc["sum"] % 10 == 0)


def _valid(kind: str, text: Column) -> Column:
    digits = _digits(text)
    if kind == "ip":
        return F.forall(
            F.split(text, r"\."),
            lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
            & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255),
        )
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of a kind; texts without the character every match needs are not searched."""
    hold = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    spans = F.filter(found_spans(text, KINDS[kind]), lambda s: _valid(kind, s["text"]))
    return F.when(hold, spans).otherwise(F.array().cast(_SPAN))


def _searched(documents: DataFrame) -> DataFrame:
    """Per document row: its base spans by kind, its unknown words, and a key of its text."""
    docs = columns_of(documents, doc_id="long", text="string")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    docs = docs.withColumn("text", F.translate("text", OPEN + SHUT, OTHER + OTHER))
    for kind in KINDS:
        docs = docs.withColumn(kind, base_spans(F.col("text"), kind))
    words = F.when(F.col("text").rlike("[0-9]"), found_spans(F.col("text"), WORD)).otherwise(F.array().cast(_SPAN))

    def trimmed(s: Column) -> Column:
        front = F.length(F.regexp_extract(s["text"], r"^[^\p{L}0-9+]*+", 0))
        back = F.length(F.regexp_extract(s["text"], r"[^\p{L}0-9]*$", 0))
        return F.struct(
            (s["start"] + front).alias("start"),
            (s["end"] - back).alias("end"),
            F.substring(s["text"], front + 1, F.length(s["text"]) - front - back).alias("text"),
            s["left"].alias("left"),
        )

    docs = docs.withColumn("words", F.transform(words, trimmed))

    def apart(w: Column) -> Column:
        return ~F.exists(F.concat(*KINDS), lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))

    unknown = F.filter("words", lambda w: F.length(_digits(w["text"])) >= MIN_DIGITS)
    docs = docs.withColumn("words", unknown)
    return docs.withColumn("unknown", F.filter("words", apart)).select("doc_id", "t1", "t2", *KINDS, "unknown")


def _of_kind(kind: str | None, spans: str) -> Column:
    # Spark takes a lambda's second parameter for the position, so the kind is bound here.
    return F.transform(spans, lambda s: F.struct(F.lit(kind).cast("string").alias("kind"), s.alias("s")))


def _instances(searched: DataFrame) -> DataFrame:
    """One row per instance with a context: kind (NULL if unknown), text, ctx, place."""
    parts = [_of_kind(k, k) for k in KINDS] + [_of_kind(None, "unknown")]
    rows = searched.select("doc_id", "t1", "t2", F.explode(F.concat(*parts)).alias("i"))
    ctx = F.lower(F.array_join(F.filter(F.split("i.s.left", rf"[{SPACE}]+"), lambda w: w != ""), " "))
    rows = rows.select(
        "doc_id", "t1", "t2", "i.kind", F.lower("i.s.text").alias("inst"), "i.s.start", "i.s.end", ctx.alias("ctx")
    )
    # A context that holds digits is itself no pattern but another identifier.
    return rows.where((F.col("ctx") != "") & ~F.col("ctx").rlike("[0-9]"))


def _occurrences(documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often each context stands before a word in the whole corpus."""
    text = F.lower(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), OPEN + SHUT, OTHER + OTHER))
    words = F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")
    pairs = documents.select(words.alias("w")).select(
        F.explode(
            F.zip_with(
                F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
                F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))),
                lambda a, b: F.concat_ws(" ", a, b),
            )
        ).alias("ctx")
    )
    # The contexts are broadcast if Spark measures them as small, and shuffled if not.
    return pairs.join(contexts, "ctx", "left_semi").groupBy("ctx").agg(F.count(F.lit(1)).alias("total"))


def _bootstrapped(graph: DataFrame, shares: DataFrame) -> DataFrame:
    """(ctx, kind, conf): patterns of high confidence after the rounds; ``graph`` is (ctx, inst, kind)."""
    idents = graph.groupBy("ctx").agg(F.count_distinct("inst").alias("idents"))
    size = idents.join(shares, "ctx")
    edges = graph.select("ctx", "inst").distinct().join(size.select("ctx"), "ctx", "left_semi")
    trusted = graph.where("kind IS NOT NULL").select("inst", "kind").distinct()
    edges, size, trusted = stored(edges, "edges"), stored(size, "patterns"), stored(trusted, "trusted")
    patterns = None
    for _ in range(ROUNDS):
        hits = edges.join(trusted, "inst").groupBy("ctx", "kind").agg(F.count(F.lit(1)).alias("hits"))
        conf = F.col("hits") / F.col("idents") * F.col("share")
        patterns = hits.join(size, "ctx").select("ctx", "kind", "hits", conf.alias("conf"))
        patterns = stored(patterns.where((F.col("hits") >= MIN_DISTINCT) & (F.col("conf") >= CONFIDENCE)), "patterns")
        scored = edges.join(patterns, "ctx").groupBy("inst", "kind")
        scored = scored.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))).alias("score"))
        found = scored.where(F.col("score") >= CONFIDENCE).select("inst", "kind")
        trusted = stored(trusted.union(found).distinct(), "trusted")
    return patterns.select("ctx", "kind", "conf")


def _joined(spans: Column) -> Column:
    return F.array_join(spans, ",")


def _listed(kind: str, spans: Column) -> Column:
    """``kind:start:end`` of spans in order of start."""
    return F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")),
    )


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _new(kind: str) -> Column:
    return F.filter("new", lambda s: s["kind"] == kind)


def personal_data(documents: DataFrame) -> DataFrame:
    """Spans of personal data per row of ``documents`` (doc_id, text).

    doc_id; n_email, n_ip, n_card, n_phone (base spans); base_sha256 of their list; spans (base and
    discovered, by kind, then start); n_found (discovered ones). Positions are code points, the
    end is exclusive. A discovered span has the kind of its most confident pattern and never
    overlaps a base span. Null and empty texts have no spans. Repeated rows each give their row;
    contexts are counted in all of them. An empty table gives no rows. Other columns are
    ignored.
    """
    searched = stored(_searched(documents), "searched")
    rows = stored(_instances(searched), "instances")
    graph = rows.select("ctx", "inst", "kind").distinct()
    wide = rows.groupBy("ctx").agg(F.count_distinct("inst").alias("n"), F.count(F.lit(1)).alias("followed"))
    wide = stored(wide.where(F.col("n") >= MIN_DISTINCT).select("ctx", "followed"), "contexts")
    # Everyday contexts are most of the corpus. Counts only grow, so a context that is too common
    # in a sixteenth of the texts is rejected there already; the others are counted in all.
    early = _occurrences(documents.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0), wide.select("ctx"))
    rare = F.col("followed") >= CONFIDENCE * F.coalesce("total", F.lit(0))
    wide = stored(wide.join(early, "ctx", "left").where(rare).select("ctx", "followed"), "contexts")
    totals = _occurrences(documents, wide.select("ctx"))
    shares = wide.join(totals, "ctx").select("ctx", F.least(F.col("followed") / F.col("total"), F.lit(1.0)).alias("share"))
    patterns = _bootstrapped(graph, stored(shares, "shares"))
    new = rows.where("kind IS NULL").drop("kind").join(patterns, "ctx")
    new = new.groupBy("doc_id", "t1", "t2", "start", "end").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
    new = new.groupBy(F.col("doc_id").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2")).agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("new")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2"))
    all_rows = searched.join(new, same, "left").withColumn(
        "new", F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    )
    base = F.concat(*[_listed(k, _places(F.col(k))) for k in KINDS])
    every = F.concat(
        *[_listed(k, F.concat(_places(F.col(k)), _places(_new(k)))) for k in KINDS]
    )
    return all_rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size("new").cast("long").alias("n_found"),
    )
