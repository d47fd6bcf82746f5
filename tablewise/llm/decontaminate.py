"""Benchmark passages in documents: a prefix-filtered join of shingles over item-sized windows.

A window is 13 words of an item (the whole item if it is shorter). As a set of 5-word shingles
it is contained in a stretch of a document only if all of its shingles are there, so one shingle
is a sufficient prefix: the rarest one. Two passes over the documents:

1. occurrences of every shingle of the benchmark are counted over all documents (this orders
   shingles by rarity);
2. documents are joined with the rarest shingle of every window. A match fixes where the window
   would begin; positions that would leave the document are dropped (length and positional
   bound), and the rest are compared word by word.

The benchmark is taken in blocks of a bounded number of words. Only a block is ever broadcast or
on the driver; a larger benchmark means more passes over the documents, not more memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import (
    columns_of,
    mapped_bytes,
    ngram_hashes,
    run_starts,
    slices,
    split_words,
    texts_of,
)

WINDOW, SHINGLE = 13, 5
#: Letters, digits and everything beyond ASCII stay; A-Z become a-z; the rest parts words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def item_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin."""
    words = split_words(mapped_bytes(texts, WORD_BYTES), lower=False)
    return words.hashes(), words.bounds


class Windows:
    """Distinct windows of a block of items, and the items each stands for."""

    def __init__(self, ids: list[str], texts: list[str], window: int, shingle: int):
        words, bounds = item_words(pa.array(texts, pa.string()))
        self.shingle = shingle
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # words, item bounds, items
        self.ids = np.array(ids, object)
        count = np.diff(bounds)
        lengths = np.minimum(count, window)
        for size in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == size)
            starts = np.concatenate([np.arange(bounds[r], bounds[r + 1] - size + 1) for r in rows])
            item = np.repeat(rows, count[rows] - size + 1)
            grams = words[starts[:, None] + np.arange(size)]
            unique, which = np.unique(grams, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0)
            first = np.searchsorted(pairs[:, 0], np.arange(len(unique) + 1))
            self.by_length[size] = (unique, first, pairs[:, 1])

    def shingles(self) -> dict[int, np.ndarray]:
        """Distinct shingle hashes by shingle size."""
        out: dict[int, list[np.ndarray]] = {}
        for size, (grams, _, _) in self.by_length.items():
            q = min(size, self.shingle)
            out.setdefault(q, []).append(self._of(grams, q).ravel())
        return {q: np.unique(np.concatenate(parts)) for q, parts in out.items()}

    @staticmethod
    def _of(grams: np.ndarray, q: int) -> np.ndarray:
        n, size = grams.shape
        return np.stack([ngram_hashes(grams[:, i : i + q].ravel(), q)[::q] for i in range(size - q + 1)], 1)

    def choose_prefixes(self, seen: dict[tuple[int, int], int]) -> None:
        """For each window its rarest shingle; ``seen`` has (size, hash) -> occurrences."""
        self.prefixes: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for size, (grams, _, _) in self.by_length.items():
            q = min(size, self.shingle)
            hashes = self._of(grams, q)
            flat, inverse = np.unique(hashes, return_inverse=True)
            often = np.array([seen.get((q, int(h)), 0) for h in flat], np.int64)[inverse.reshape(hashes.shape)]
            offset = np.argmin(often, axis=1)
            key = hashes[np.arange(len(hashes)), offset]
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self.prefixes.setdefault(q, []).append((size, keys, np.append(first, len(key)), order, offset))

    def occurrences(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, start positions, window numbers) of all windows found in ragged texts."""
        end_of = np.repeat(bounds[1:], np.diff(bounds))
        begin_of = np.repeat(bounds[:-1], np.diff(bounds))
        for q, groups in self.prefixes.items():
            starts = run_starts(bounds, q)
            found = ngram_hashes(words, q)
            found = found[starts] if len(found) else found
            for size, keys, first, order, offset in groups:
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == found) if len(found) else np.zeros(0, np.int64)
                if not len(hit):
                    continue
                each = np.diff(first)[at[hit]]
                shift = np.cumsum(each) - each
                window = order[np.arange(each.sum()) + np.repeat(first[at[hit]] - shift, each)]
                place = np.repeat(starts[hit], each)
                start = place - offset[window]
                ok = (start >= begin_of[place]) & (start + size <= end_of[place])
                start, window = start[ok], window[ok]
                grams = self.by_length[size][0]
                for a in range(0, len(start), 200_000):
                    s, w = start[a : a + 200_000], window[a : a + 200_000]
                    same = (words[s[:, None] + np.arange(size)] == grams[w]).all(axis=1)
                    if same.any():
                        yield size, s[same], w[same]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list[str], list[str]]]:
    """Items in blocks of about ``block_words`` words; the driver holds one block at a time."""
    items = columns_of(benchmark, item_id="string", text="string").where("text IS NOT NULL").distinct()
    # A word takes two bytes at least, with what parts it from the next.
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))
    for b in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = own.collect()
        if rows:
            yield [r[0] if r[0] is not None else "" for r in rows], [r[1] for r in rows]


def _rarity(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each benchmark shingle occurs in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(shingles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {q: np.zeros(len(keys), np.int64) for q, keys in held.value.items()}
        for whole in batches:
            for batch in slices(whole):
                words, bounds = item_words(texts_of(batch.column("text")))
                for q, keys in held.value.items():
                    grams = ngram_hashes(words, q)
                    if len(grams):
                        grams = grams[run_starts(bounds, q)]
                        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                        totals[q] += np.bincount(at[keys[at] == grams], minlength=len(keys))
        for q, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(seen), q, np.int32)),
                    pa.array(held.value[q][seen].view(np.int64)),
                    pa.array(total[seen]),
                ],
                ["q", "h", "n"],
            )

    counted = docs.select("text").mapInArrow(count, "q int, h long, n long").groupBy("q", "h").agg(F.sum("n"))
    return {(q, h & 0xFFFFFFFFFFFFFFFF): n for q, h, n in counted.collect()}


def _hits(docs: DataFrame, windows: Windows, first: bool) -> DataFrame:
    """Per document row: hit spans and items. Rows without hits are given for the first block only."""
    held = docs.sparkSession.sparkContext.broadcast(windows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = held.value
        for whole in batches:
            for batch in slices(whole):
                words, bounds = item_words(texts_of(batch.column("text")))
                n = batch.num_rows
                row_of = np.repeat(np.arange(n), np.diff(bounds))
                spans: dict[int, list[np.ndarray]] = {}
                items: dict[int, set[str]] = {}
                for size, start, window in win.occurrences(words, bounds):
                    _, at, item = win.by_length[size]
                    rows = row_of[start]
                    order = np.argsort(rows, kind="stable")
                    edge = np.flatnonzero(np.diff(rows[order])) + 1
                    for part in np.split(order, edge):
                        r = int(rows[part[0]])
                        s = np.unique(start[part]) - bounds[r]
                        spans.setdefault(r, []).append(np.stack([s, s + size], 1))
                        own = items.setdefault(r, set())
                        for w in np.unique(window[part]):
                            own.update(win.ids[item[at[w] : at[w + 1]]])
                keep = np.arange(n) if first else np.array(sorted(spans), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(keep)),
                        batch.column("text_key").take(pa.array(keep)),
                        pa.array(np.diff(bounds)[keep]),
                        pa.array(np.full(len(keep), int(first), np.int64)),
                        pa.array(
                            [np.concatenate(spans[r]).astype("<i4").tobytes() if r in spans else b"" for r in keep],
                            pa.binary(),
                        ),
                        pa.array([sorted(items.get(r, ())) for r in keep], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text_key", "n_words", "rows", "spans", "items"],
                )

    return docs.mapInArrow(
        find, "doc_id long, text_key string, n_words long, rows long, spans binary, items array<string>"
    )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_words: int = 200_000,
) -> DataFrame:
    """Words of each document that lie in an occurrence of a window of a benchmark item.

    One row per row of ``documents`` (doc_id, text): doc_id, text_key (md5 of the text), n_words, n_hit, n_items,
    items_sha256 (of the sorted, comma-joined item_ids), contaminated (hits are at least a
    twentieth of the words). Null and empty texts have no words and no hits; items without words
    have no windows; an item_id that is null counts as the empty text, repeated items as one.
    Repeated documents each give their row. Other columns are ignored.
    """
    docs = columns_of(documents, doc_id="long", text="string")
    docs = docs.withColumn("text_key", F.md5(F.coalesce("text", F.lit("")))).select("doc_id", "text_key", "text")
    found = None
    for ids, texts in _blocks(benchmark, block_words):
        windows = Windows(ids, texts, window, shingle)
        if windows.by_length:
            windows.choose_prefixes(_rarity(docs, windows.shingles()))
            part = _hits(docs, windows, found is None)
            found = part if found is None else found.union(part)
    if found is None:
        empty = Windows([], [], window, shingle)
        empty.choose_prefixes({})
        found = _hits(docs, empty, True)
    grouped = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum("rows").alias("rows"),
        F.array_join(F.transform(F.array_agg("spans"), lambda s: F.hex(s)), "").alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = batch.column("n_words").to_numpy()
            hit, count, digest = [], [], []
            for n, spans, items in zip(
                n_words.tolist(), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True
            ):
                pairs = np.frombuffer(bytes.fromhex(spans), "<i4").reshape(-1, 2)
                change = np.bincount(pairs[:, 0], minlength=n + 1) - np.bincount(pairs[:, 1], minlength=n + 1)
                hit.append(int((np.cumsum(change) > 0).sum()) if len(pairs) else 0)
                count.append(len(items))
                digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            hits = np.array(hit, np.int64)
            reps = batch.column("rows").to_numpy()
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(n_words),
                    pa.array(hits),
                    pa.array(np.array(count, np.int64)),
                    pa.array(digest, pa.string()),
                    pa.array((hits > 0) & (20 * hits >= n_words)),
                ],
                ["doc_id", "text_key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )
            yield out.take(pa.array(np.repeat(np.arange(len(reps)), reps)))

    return grouped.select("doc_id", "text_key", "n_words", "rows", "spans", "items").mapInArrow(
        judge,
        "doc_id long, text_key string, n_words long, n_hit long, n_items long, items_sha256 string,"
        " contaminated boolean",
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones; all columns stay, and so do null texts.

    Only the keys of contaminated documents are joined with the texts.
    """
    bad = contamination(documents, benchmark).where("contaminated").select("doc_id", "text_key").distinct()
    key = F.md5(F.coalesce(documents["text"].cast("string"), F.lit("")))
    bad = bad.select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key"))
    same = documents["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (key == bad["__bad_key"])
    return documents.join(bad, same, "left_anti")
