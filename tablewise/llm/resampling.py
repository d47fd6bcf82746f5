"""Quality filter by importance resampling: hashed n-gram models and Gumbel top-k.

Features of a text are its distinct words, first six letters of words, and word pairs, hashed to 2^18
cells, and whether many words repeat the one before. Every model is generative: the cells' frequencies over the whole corpus (background),
bent by what a bounded sample of labelled rows shows. With E the count to be expected in a
model's rows and c the count found, every cell's frequency is multiplied by its posterior mean
under a prior that all cells of the model share: most cells are alike in all models (counts are
negative binomial around E, of shape ALIKE, as copies make them), a share of them has a ratio of its own
(gamma distributed, of shape APART). The share is fitted to the counts. So no cell is left out:
a rare word bends its cell by as much as its few rows attest, and more labels bend it further.

E is summed over the backgrounds of the languages (column ``lang``, where there is one) that the class's
rows are in, so that a class's languages bend nothing. A text is scored without its own counts,
in the background and in the class of its label: else labelled texts would look unlike others.

Three models are fitted: target (quality 1, not toxic), junk (quality 0) and toxic (the rest). Raw text is a
mixture of documents of the three, each with its share of the sample, so its likelihood is the
mixture's. The importance weight p_target / p_raw is then at most 1 / share of the target,
whatever the length of the text, and falls to zero for junk and toxic texts.

Gumbel noise from a hash of doc_id is added to the log weight, and the k largest are taken, which
samples k rows without replacement in proportion to the weights. The default k is the number of
documents whose weight is at least that of 97 % of the target's labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import columns_of, distinct, mixed, ngram_hashes, slices, split_words, stored, texts_of

CELLS, PREFIX, ALIKE, APART = 1 << 18, 6, 10.0, 0.3
#: Languages with a background of their own, the most frequent; all others share one.
LANGUAGES = 7
#: Share of the target's labelled rows that the default k leaves room for.
KEPT = 0.97
#: Labelled rows that the models are fitted on, the first by a hash of doc_id.
FIT_ROWS = 20_000
CLASSES = ("target", "junk", "toxic")


class Models(NamedTuple):
    """Log ratios to the background per language, class and cell, and the classes' shares.

    ``own`` are the ratios for texts that are themselves counted in the class.
    """

    ratios: np.ndarray
    own: np.ndarray
    shares: np.ndarray
    languages: list[str]


def features(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature cells of each text, and where each text's begin."""
    words = split_words(texts)
    own = words.hashes()
    starts = pc.utf8_slice_codeunits(words.dictionary, 0, PREFIX).to_pylist()
    front = np.fromiter((xxhash.xxh3_64_intdigest(s, seed=1) for s in starts), np.uint64, len(starts))
    pairs = ngram_hashes(own, 2)
    count = np.diff(words.bounds)
    row = np.repeat(np.arange(len(count)), count)
    inside = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    again = np.flatnonzero(inside & (own[:-1] == own[1:])) if len(own) else row
    often = np.bincount(row[again], minlength=len(count))
    # Whether a tenth of the words or more repeat the one before: one cell for all such pairs.
    stutter = mixed(np.uint64(1) + (10 * often > count).astype(np.uint64))
    kinds = [
        (mixed(own), row),
        (mixed(front)[words.codes] if len(front) else own, row),
        (pairs[inside], row[:-1][inside] if len(row) else row),
        (stutter, np.arange(len(count))),
    ]
    low = np.uint64(CELLS - 1)
    packed = distinct(np.concatenate([(r.astype(np.uint64) << np.uint64(18)) | (c & low) for c, r in kinds]))
    found = (packed >> np.uint64(18)).astype(np.int64)
    return (packed & np.uint64(CELLS - 1)).astype(np.int64), np.searchsorted(found, np.arange(len(count) + 1))


def _binomial(found: np.ndarray, expected: np.ndarray, shape: float) -> np.ndarray:
    """Log probability of counts that are Poisson with a gamma distributed mean around ``expected``."""
    steps = np.arange(int(found.max(initial=0)))
    ways = np.concatenate([[0.0], np.cumsum(np.log((shape + steps) / (1 + steps)))])[found.astype(np.int64)]
    return ways + found * np.log(expected / (expected + shape)) + shape * np.log(shape / (expected + shape))


def _bent(found: np.ndarray, expected: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Log of the posterior mean ratio of each cell, and the probability that it has one of its own."""
    expected = np.maximum(expected, 1e-3)
    apart = _binomial(found, expected, ALIKE) - _binomial(found, expected, APART)
    sure = share / (share + (1 - share) * np.exp(np.clip(apart, -60, 60)))
    return np.log1p(sure * ((found + APART) / (expected + APART) - 1)), sure


def fit_models(
    background: np.ndarray, counts: np.ndarray, rows: np.ndarray, inside: np.ndarray, languages: list[str]
) -> Models:
    """Models from cell counts of each language and class, the classes' rows, and their features by language."""
    share_of = inside / np.maximum(background.sum(axis=1), 1.0)  # class by language
    ratios = np.zeros((len(background), len(CLASSES), CELLS), np.float32)
    own = np.zeros_like(ratios)
    for i in np.flatnonzero(rows):
        expected, share = share_of[i] @ background, 0.01
        seen = (expected > 0) | (counts[i] > 0)
        for _ in range(20):
            share = float(np.clip(_bent(counts[i][seen], expected[seen], share)[1].mean(), 1e-5, 0.5))
        for g in range(len(background)):
            ratios[g, i] = _bent(counts[i], expected - share_of[i, g], share)[0]
            own[g, i] = _bent(np.maximum(counts[i] - 1, 0), expected - share_of[i, g], share)[0]
    # Without labels of a class nothing is known of it: it has no share.
    shares = rows / rows.sum() if rows.sum() else np.array([1.0, 0.0, 0.0])
    return Models(ratios, own, shares, languages)


def log_weights(texts: pa.StringArray, models: Models, group: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of each text; 0 for all if no row of the target was labelled.

    ``group`` is the number of each text's language, ``kind`` the class it is counted in, or -1.
    """
    n = len(texts)
    known = models.shares > 0
    if not known[0]:
        return np.zeros(n)
    cells, bounds = features(texts)
    row = np.repeat(np.arange(n), np.diff(bounds))
    language, loglik = group[row], []
    for i in np.flatnonzero(known):
        bent = models.ratios[language, i, cells]
        counted = np.flatnonzero(kind[row] == i)
        bent[counted] = models.own[language[counted], i, cells[counted]]
        loglik.append(np.bincount(row, bent, minlength=n))
    joint = np.stack(loglik) + np.log(models.shares[known])[:, None]
    top = joint.max(axis=0)
    return loglik[0] - (top + np.log(np.exp(joint - top).sum(axis=0)))


def _labelled(labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, class) of the sample; junk if its quality is 0, else toxic if it is that."""
    known = columns_of(labels, doc_id="long", quality="int", toxic="int")
    kind = F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0)
    known = known.select(F.col("doc_id").alias("labelled"), kind.alias("kind")).where("kind IS NOT NULL AND labelled IS NOT NULL")
    # The worst label of a document counts, so repeated labels are one row.
    known = known.groupBy("labelled").agg(F.max("kind").alias("kind"))
    return known.orderBy(F.xxhash64("labelled"), "labelled").limit(fit_rows)


def _languages(docs: DataFrame) -> list[str]:
    if "lang" not in docs.columns:
        return []
    own = docs.where("lang IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return [r["lang"] for r in own.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]


def _marked(docs: DataFrame, sample: DataFrame, languages: list[str]) -> DataFrame:
    """``docs`` with the number of their language and the class of their label (-1: none); the sample is bounded."""
    group = F.lit(0)
    if languages:
        at = F.array_position(F.array(*map(F.lit, languages)), F.col("lang").cast("string"))
        group = F.coalesce(at, F.lit(0))
    known = sample.select("labelled", F.col("kind").alias("__kind"))
    out = docs.join(F.broadcast(known), F.col("doc_id").cast("long") == F.col("labelled"), "left").drop("labelled")
    return out.withColumn("__group", group.cast("int")).withColumn("__kind", F.coalesce("__kind", F.lit(-1)))


def train(docs: DataFrame, sample: DataFrame) -> Models:
    """Count all documents once, by language and by class of their label."""
    languages = _languages(docs)
    marked = _marked(docs, sample, languages).select("text", "__group", "__kind")
    groups = len(languages) + 1
    tables_of = groups + len(CLASSES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((tables_of, CELLS), np.int64)
        rows = np.zeros(tables_of, np.int64)
        inside = np.zeros((tables_of, groups), np.int64)
        for whole in batches:
            for batch in slices(whole):
                cells, bounds = features(texts_of(batch.column("text")))
                each = np.diff(bounds)
                group, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__group", "__kind"))
                for chosen in (group, np.where(kind >= 0, groups + kind, -1)):
                    for i in np.unique(chosen[chosen >= 0]).tolist():
                        own = chosen == i
                        counts[i] += np.bincount(cells[np.repeat(own, each)], minlength=CELLS)
                        rows[i] += int(own.sum())
                        inside[i] += np.bincount(group[own], each[own], minlength=groups).astype(np.int64)
        # A part of a table per row, so that the sums are spread over tasks.
        for i in np.flatnonzero(rows).tolist():
            parts = counts[i].astype(np.uint32).reshape(16, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(16, i, np.int32)),
                    pa.array(np.arange(16, dtype=np.int32)),
                    pa.array([rows[i]] * 16, pa.int64()),
                    pa.array([inside[i].tobytes()] * 16, pa.binary()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                ["model", "part", "rows", "inside", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for model, part, rows, inside, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = total.setdefault((model, part), [0, np.zeros(groups, np.int64), np.zeros(CELLS // 16, np.int64)])
                own[0] += rows
                own[1] += np.frombuffer(inside, np.int64)
                own[2] += np.frombuffer(counts, np.uint32)
        cols = list(zip(*((m, p, r, i.tobytes(), c.tobytes()) for (m, p), (r, i, c) in total.items()), strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["model", "part", "rows", "inside", "counts"]
        )

    fields = "model int, part int, rows long, inside binary, counts binary"
    tables = np.zeros((tables_of, 16, CELLS // 16))
    rows, inside = np.zeros(tables_of), np.zeros((tables_of, groups))
    added = marked.mapInArrow(count, fields).repartition("model", "part").mapInArrow(add, fields)
    for model, part, n, own, counts in added.collect():
        tables[model, part] = np.frombuffer(counts, np.int64)
        rows[model], inside[model] = n, np.frombuffer(own, np.int64)
    tables = tables.reshape(tables_of, CELLS)
    return fit_models(tables[:groups], tables[groups:], rows[groups:], inside[groups:], languages)


def with_log_weight(docs: DataFrame, models: Models, sample: DataFrame) -> DataFrame:
    """``docs`` with a column ``log_weight``; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(models)
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                group, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__group", "__kind"))
                weights = log_weights(texts_of(batch.column("text")), held.value, group, kind)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in names), pa.array(weights)], [*names, "log_weight"]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _marked(docs, sample, models.languages).mapInArrow(score, f"{kinds}, log_weight double")


def with_gumbel(df: DataFrame, seed: int) -> DataFrame:
    """Adds ``gumbel`` from a hash of doc_id, and ``key``, the log weight with it."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id"), 12).cast("double")
    uniform = (bits + 0.5) / F.lit(float(1 << 52))
    df = df.withColumn("gumbel", -F.log(-F.log(uniform)))
    return df.withColumn("key", F.col("log_weight") + F.col("gumbel"))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest ``key``: a bracket around it is narrowed by counting 1024 steps at a time."""
    if k <= 0:
        return None
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n <= k:
        return low
    above = 0  # keys above the bracket
    while low < high:
        step = (high - low) / 1024
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        at = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(1023)) if step > 0 else F.lit(0)
        found = inside.groupBy(at.alias("b")).agg(F.count("key"), F.min("key"), F.max("key")).collect()
        for _, c, least, most in sorted(found, reverse=True):
            if above + c >= k:
                low, high = least, most
                break
            above += c
        if len(found) == 1 and (low, high) == (found[0][2], found[0][3]) and step == 0:
            break
    return low


def resampled(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The sampled rows of ``documents`` with all their columns, and log_weight, gumbel and key.

    Columns of those names are replaced. Null and empty texts have no words: their weight is
    about that of the background, log 1. Rows that share a doc_id share their noise; rows whose
    key equals the k-th stay, so ties may add to k. Labels that are null or name no document are
    ignored, of several for one document the worst counts; without any label for the target all
    weights are 1 and all rows stay. An empty table gives no rows.
    """
    docs = documents.drop("log_weight", "gumbel", "key")
    sample = stored(_labelled(labels, fit_rows), "sample")
    kinds = {"doc_id": "long", "text": "string"} | ({"lang": "string"} if "lang" in docs.columns else {})
    models = train(columns_of(docs, **kinds), sample)
    # Scoring is most of the work: it is done once, and what follows reads the keys or the rows taken.
    scored = stored(with_gumbel(with_log_weight(docs, models, sample), seed), "scored")
    keys = scored.select(F.col("doc_id").cast("long").alias("doc_id"), "log_weight", "key")
    if k is None:
        known = keys.join(F.broadcast(sample.where("kind = 0")), F.col("doc_id") == F.col("labelled"))
        cut = known.agg(F.percentile("log_weight", 1 - KEPT)).first()[0]  # of a bounded sample
        k = keys.where(F.col("log_weight") >= F.lit(cut)).count() if cut is not None else keys.count()
    least = kth_largest(keys, k)
    return scored.where(F.col("key") >= F.lit(least)) if least is not None else scored.where("false")
