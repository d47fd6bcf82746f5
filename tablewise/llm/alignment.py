"""Token ids of two tokenizers aligned by the bytes that they cover.

Both id lists of a text cut the same bytes. A dictionary maps each cumulative end to its index; the ends
that both lists share, sorted, slice the lists into groups, and inside a group every pair of ids whose byte
ranges overlap is a link. Texts of a batch stand one behind the other, so one pair of dictionaries serves
them all: the end of a text is always shared.

How often two ids are linked is counted over all documents. The pair counts go back to the documents in two
ways that give the same sums: the commonest pairs, a bounded number of them chosen by a histogram of
counts, are broadcast, since every task needs them; the rest, which are rare and so have no hot key, are joined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import columns_of, slices, stored, texts_of

#: A pair of ids in one number: a * SPAN + b.
SPAN = 1 << 20
#: Pairs that are broadcast at most (16 bytes each).
COMMON_PAIRS = 1 << 20
#: Steps of the histogram of counts for each doubling.
STEPS = 8


# ---------------------------------------------------------------- tokenizers


def byte_level(chars: str) -> bytes:
    """The bytes that an entry of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, are the characters from U+0100 on.
    """
    return bytes(_BYTE_OF[c] for c in chars)


def _byte_table() -> dict[str, int]:
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_BYTE_OF = _byte_table()


#: Fixed value: how a byte-level tokenizer of this kind cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level tokenizer file; texts are encoded behind a space, special tokens are plain text.

    Where the ids of its vocabulary follow the order of its merges, as they do in the usual files, ids are
    ranks and the ranked encoder gives the same ids in a quarter of the time. Other files are left to
    their own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        entries = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, i in entries.items():
            if all(c in _BYTE_OF for c in entry):
                self.bytes_of[i] = byte_level(entry)
        self.ranked = self._ranked(path, entries)

    def _ranked(self, path: str, entries: dict[str, int]):  # noqa: ANN202
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"].get("merges", [])]
        ordered = all(entries.get(x + y) == 256 + i for i, (x, y) in enumerate(merges))
        cut = whole.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if not (ordered and plain) or whole.get("normalizer"):
            return None
        ranks = {t: i for i, t in enumerate(self.bytes_of[: 256 + len(merges)]) if t}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A model of pieces; it puts a space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            whole = piece.replace("▁", " ").encode()
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else whole)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# ---------------------------------------------------------------- one batch


def grouped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end in both lists: indexes behind the tokens that end at a shared byte.

    The dictionary of one list is asked for every end of the other; what both have comes out in order.
    """
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    found = np.fromiter(map(at_b.get, ends_a.tolist(), repeat(0)), np.int64, len(ends_a))
    cut_a = np.flatnonzero(found)
    return cut_a + 1, found[cut_a]


def _crossing(i: int, x: int, j: int, y: int, ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int]]:
    """Overlapping tokens of a group with several on both sides.

    No inner ends are shared, so the token that ends first makes way for the next of its list.
    """
    while i < x and j < y:
        yield i, j
        if ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1


def linked(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of every pair of tokens whose bytes overlap, slice by slice."""
    from_a, from_b = np.concatenate([[0], cut_a[:-1]]), np.concatenate([[0], cut_b[:-1]])
    size_a, size_b = cut_a - from_a, cut_b - from_b
    many = (size_a > 1) & (size_b > 1)
    plain = np.flatnonzero(~many)
    # One token on a side covers all of the other side.
    width = np.maximum(size_a, size_b)[plain]
    step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    i = np.repeat(from_a[plain], width) + np.where(np.repeat(size_a[plain] > 1, width), step, 0)
    j = np.repeat(from_b[plain], width) + np.where(np.repeat(size_b[plain] > 1, width), step, 0)
    several = np.flatnonzero(many).tolist()
    if several:
        ends = ends_a.tolist(), ends_b.tolist()
        more = [p for g in several for p in _crossing(int(from_a[g]), int(cut_a[g]), int(from_b[g]), int(cut_b[g]), *ends)]
        extra = np.array(more, np.int64)
        i, j = np.concatenate([i, extra[:, 0]]), np.concatenate([j, extra[:, 1]])
    return i, j


def shown(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, names_a: np.ndarray, names_b: np.ndarray) -> list[str]:
    """Both lists group by group as strings: ids of the first closed by ``,`` or ``|``, of the second by ``,`` or ``;``."""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[cut_a - 1] = last_b[cut_b - 1] = 1
    group_a = np.cumsum(last_a) - last_a
    group_b = np.cumsum(last_b) - last_b
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.concatenate([[0], cut_b])[group_a]] = names_a[last_a, a]
    out[np.arange(len(b)) + cut_a[group_b]] = names_b[last_b, b]
    return out.tolist()


def _closed(size: int, inside: str, end: str) -> np.ndarray:
    """Two rows of all ids as strings, closed by either mark."""
    return np.array([[f"{i}{mark}" for i in range(size)] for mark in (inside, end)], object)


# ---------------------------------------------------------------- tables

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def alignments(documents: DataFrame, first: str, second: str) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text), aligned over a byte-level and a piece tokenizer's file.

    ``groups`` lists the ids of each group, ``pairs`` the distinct linked pairs (a * SPAN + b, ascending) and ``times``
    how often each is linked. Null and empty texts, and those that a tokenizer does not give back byte
    for byte, have no tokens: zeros, an empty string and empty lists. Other columns are ignored, an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        left, right = ByteLevel(first), Pieces(second)
        size_a, size_b = (np.array([len(t) for t in model.bytes_of], np.int64) for model in (left, right))
        names_a, names_b = _closed(len(size_a), ",", "|"), _closed(len(size_b), ",", ";")
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                texts = texts_of(batch.column("text")).to_pylist()
                held_a, held_b = [], []
                for text, a, b in zip(texts, left.encode(texts), right.encode(texts), strict=True):
                    raw = b" " + text.encode()
                    same = text and all(b"".join(map(m.bytes_of.__getitem__, ids)) == raw for m, ids in ((left, a), (right, b)))
                    held_a.append(a if same else [])
                    held_b.append(b if same else [])
                n_a, n_b = (np.array([len(x) for x in held], np.int64) for held in (held_a, held_b))
                a, b = (np.fromiter(chain.from_iterable(held), np.int64, n.sum()) for held, n in ((held_a, n_a), (held_b, n_b)))
                ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
                cut_a, cut_b = grouped(ends_a, ends_b)
                i, j = linked(ends_a, ends_b, cut_a, cut_b) if len(cut_a) else (a, b)
                text_of = np.repeat(np.arange(len(texts)), n_a)
                bounds_a, bounds_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
                words = shown(a, b, cut_a, cut_b, names_a, names_b) if len(cut_a) else []
                groups = ["".join(words[s:e])[:-1] for s, e in pairwise((bounds_a + bounds_b).tolist())]
                key = text_of[i] << 40 | a[i] * SPAN + b[j]
                distinct, times = np.unique(key, return_counts=True)
                offsets = pa.array(np.searchsorted(distinct, np.arange(len(texts) + 1) << 40).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(n_a),
                        pa.array(n_b),
                        pa.array(np.bincount(text_of[cut_a - 1], minlength=len(texts))),
                        pa.array(np.bincount(text_of[i], minlength=len(texts))),
                        pa.array(groups, pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(distinct & ((1 << 40) - 1))),
                        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )

    return columns_of(documents, doc_id="long", text="string").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many documents a pair of ids is linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _least_common(counts: DataFrame, limit: int) -> tuple[int, bool]:
    """The least count of pairs to broadcast, so that they are at most ``limit``; and whether any pair is below it."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect()
    least, room = None, limit
    for row in sorted(histogram, key=lambda r: -r.step):
        if row.pairs > room:
            return (least if least is not None else (1 << 62)), True
        least, room = row.least, room - row.pairs
    return least or 0, False


def with_scores(aligned: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """Adds n_best and count_sum to rows of :func:`alignments`, dropping pairs and times.

    ``count_sum`` adds up the documents of each link's pair; ``n_best`` counts links whose pair is in as many
    documents as any pair of the same first id. At most ``common_pairs`` pairs are broadcast, and one
    number for each id of the first vocabulary.
    """
    spark = aligned.sparkSession
    rows = stored(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(rows), "pair_counts")
    first = F.shiftright("pair", 20)
    best = {r.a: r.n for r in counts.groupBy(first.alias("a")).agg(F.max("n").alias("n")).collect()}
    least, rare_left = _least_common(counts, common_pairs)
    common = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    best_of = np.zeros(max(best, default=0) + 1, np.int64)
    best_of[list(best)] = list(best.values())
    held = spark.sparkContext.broadcast((common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64), best_of))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, numbers, most = held.value
        for batch in batches:
            lists = batch.column("pairs")
            offsets = lists.offsets.to_numpy()
            pair = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.minimum(np.searchsorted(codes, pair), max(len(codes) - 1, 0))
            known = codes[at] == pair if len(codes) else np.zeros(len(pair), bool)
            n = np.where(known, numbers[at] if len(codes) else 0, 0)
            is_best = known & (n == most[pair >> 20])
            totals = []
            for part in (np.where(is_best, times, 0), n * times):
                running = np.concatenate([[0], np.cumsum(part)])
                ends = offsets - offsets[0]
                totals.append(pa.array(running[ends[1:]] - running[ends[:-1]]))
            rest = np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=batch.num_rows))])
            rest = pa.array(rest.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    *totals,
                    pa.ListArray.from_arrays(rest, pa.array(pair[~known])),
                    pa.ListArray.from_arrays(rest, pa.array(times[~known])),
                ],
                [*kept, "n_best", "count_sum", "rare", "rare_times"],
            )

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    out = rows.mapInArrow(run, f"{types}, n_best long, count_sum long, rare array<long>, rare_times array<long>")
    if not rare_left:
        return out.drop("rare", "rare_times", "row")
    out = stored(out, "common_links")
    each = out.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select("row", "r.rare", "r.rare_times")
    rare = counts.where(F.col("n") < least).withColumn("a", first)
    tops = counts.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    rare = rare.join(tops, "a").select(F.col("pair").alias("rare"), "n", (F.col("n") == F.col("top")).alias("best"))
    sums = each.join(rare, "rare").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("rare_times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("rare_times")).alias("more_count"),
    )
    out = out.join(sums, "row", "left")
    for total, more in (("n_best", "more_best"), ("count_sum", "more_count")):
        out = out.withColumn(total, F.col(total) + F.coalesce(more, F.lit(0)))
    return out.select(*[c for c in kept if c != "row"], "n_best", "count_sum")


def alignment_report(documents: DataFrame, first: str, second: str, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (empty without tokens) for every row."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    # The groups are read once for their digest, and not stored.
    aligned = alignments(documents, first, second).select("*", digest).drop("groups")
    out = with_scores(aligned, common_pairs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
