"""Removal of passages that occur more than once, by suffix automata of reference shards.

Which windows of 35 words repeat is found in four steps, each linear in the input.

1. *Anchors.* Every window is represented by the least of its 12-word runs, by hash; equal
   windows choose the same run. Runs are counted over the corpus, and the first place of each
   run that occurs twice becomes its owner. Owners and the rest are joined by run, so a run that
   a third of all documents share is split like any skewed join.
2. *Reference.* The windows around owned runs are the reference: each shared passage about once.
   It is dealt to shards of a bounded size by owner, and each shard's suffix automaton is written
   to the shared folder. A shard is loaded by the tasks that need it (broadcasting all of them
   would grow with the corpus).
3. *Matching statistics.* The stretches of documents around shared runs are streamed through the
   automaton of their owner's shard. Where the match is 35 words or longer, the automaton also
   gives the first place of that window in the reference: if it is another place than the one
   streamed, both repeat. Work is dealt by ranges of (shard, document), so that a popular shard
   is spread over tasks.
4. *Rest.* Windows that share a run with the owner but not the whole window (the edges of
   passages) are counted by hash among themselves.

Exact copies of a text need none of this: all their windows repeat. Only one of them takes part
above, on behalf of the other documents.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import (
    Words,
    columns_of,
    filesystem,
    ngram_hashes,
    run_starts,
    shared_folder,
    slices,
    split_words,
    stored,
    texts_of,
)

WINDOW, RUN = 35, 12
#: Characters of corpus per reference shard; repeated text is a fraction of it.
SHARD_CHARS = 2_500_000
NO_ID = -(1 << 63)


# ---------------------------------------------------------------- suffix automaton


class SuffixAutomaton:
    """All substrings of a shard's passages, over words.

    ``end[v]`` is the position of the last word of the first occurrence of state v's substrings;
    ``top[v]`` is the state of the suffix of ``window`` words.
    """

    def __init__(self, passages: list[np.ndarray], window: int):
        words = np.concatenate(passages) if passages else np.zeros(0, np.uint64)
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        self.window = window
        length, link, self.next, self.end = [0], [-1], [{}], [-1]
        last, at, mark = 0, 0, -1
        self.starts = []
        step, end = self.next, self.end
        for passage in passages:
            self.starts.append(len(self.starts) + at)
            # A mark of its own ends each passage, so that no match runs over two.
            own = codes[at : at + len(passage)].tolist()
            at += len(passage)
            own.append(mark)
            mark -= 1
            for c in own:
                cur = len(length)
                length.append(length[last] + 1)
                link.append(0)
                step.append({})
                end.append(length[last])
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    if length[p] + 1 == length[q]:
                        link[cur] = q
                    else:
                        clone = len(length)
                        length.append(length[p] + 1)
                        link.append(link[q])
                        step.append(dict(step[q]))
                        end.append(end[q])
                        while p >= 0 and step[p].get(c) == q:
                            step[p][c] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
                last = cur
        self.link, self.length = link, length
        self.top = list(range(len(length)))
        for v in np.argsort(length, kind="stable").tolist():
            if v and length[link[v]] >= window:
                self.top[v] = self.top[link[v]]
        self.starts = np.array(self.starts, np.int64)

    def codes(self, words: np.ndarray) -> list[int]:
        if not len(self.vocabulary):
            return [-(1 << 40)] * len(words)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -(1 << 40)).tolist()

    def first_places(self, words: np.ndarray) -> np.ndarray:
        """For each window of ``words``, where it first begins in the reference, or -1."""
        window, step, link, length, top, end = self.window, self.next, self.link, self.length, self.top, self.end
        v = matched = 0
        out = []
        for c in self.codes(words):
            to = step[v].get(c)
            while to is None and v:
                v = link[v]
                matched = length[v]
                to = step[v].get(c)
            if to is None:
                matched = 0
            else:
                v = to
                matched += 1
            out.append(end[top[v]] - window + 1 if matched >= window else -1)
        return np.array(out[window - 1 :], np.int64)


# ---------------------------------------------------------------- windows


def anchors_of(words: np.ndarray, bounds: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts of a ragged batch, the run each window chooses, and all runs' hashes."""
    starts = run_starts(bounds, window)
    grams = ngram_hashes(words, run)
    if not len(starts):
        return starts, starts, grams
    place = np.arange(len(grams))
    least, size, wide = grams, 1, window - run + 1
    while size < wide:
        step = min(size, wide - size)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        size += step
    return starts, place[starts], grams


def _runs(places: np.ndarray, step: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index ranges in which places (and what ``step`` holds) go up by one."""
    if not len(places):
        return []
    gap = np.diff(places) != 1
    if step is not None:
        gap |= np.diff(step) != 1
    edge = np.flatnonzero(gap) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(places)], strict=True))


def _tagged(documents: DataFrame) -> DataFrame:
    """(doc, tag, text): doc_id without nulls, and 32 bits of the text to tell rows of one doc_id apart."""
    docs = columns_of(documents, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
        F.shiftright(F.xxhash64("text"), 32).cast("int").alias("tag"),
        "text",
    )


def _copies(docs: DataFrame) -> DataFrame:
    """(doc, tag, copies, one): rows whose text occurs more than once, and whether it is the one to take part."""
    keys = docs.select("doc", "tag", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    groups = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("first"))
    many = groups.where("copies > 1")
    return keys.join(many, ["k1", "k2"]).select("doc", "tag", "copies", (F.col("doc") == F.col("first")).alias("one")).distinct()


def _anchor_rows(docs: DataFrame, window: int, run: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = split_words(texts_of(batch.column("text")), lower=False)
                _, chosen, grams = anchors_of(words.hashes(), words.bounds, window, run)
                place = np.unique(chosen)
                row = np.searchsorted(words.bounds, place, side="right") - 1
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[place].view(np.int64) if len(place) else np.zeros(0, np.int64)),
                        batch.column("doc").take(rows),
                        batch.column("tag").take(rows),
                        pa.array((place - words.bounds[row]).astype(np.int32)),
                    ],
                    ["h", "doc", "tag", "pos"],
                )

    return docs.select("doc", "tag", "text").mapInArrow(emit, "h long, doc long, tag int, pos int")


def _joined(words: Words, spans: list[tuple[int, int]]) -> pa.Array:
    """The text of word ranges."""
    size = np.array([b - a for a, b in spans], np.int64)
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.array([a for a, _ in spans], np.int64) - (ends - size), size)
    flat = words.dictionary.take(pa.array(words.codes[index]))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, flat), " ")


def _segments(docs: DataFrame, window: int, run: int) -> DataFrame:
    """Stretches of windows that chose a shared run, by the shard of the run's owner.

    ``docs`` has ``marks``: (pos, shard, own) of the shared runs of each text.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = split_words(texts_of(batch.column("text")), lower=False)
                starts, chosen, _ = anchors_of(words.hashes(), words.bounds, window, run)
                row = np.searchsorted(words.bounds, starts, side="right") - 1
                first = np.searchsorted(row, np.arange(batch.num_rows + 1))
                spans, keys = [], []
                for r, marks in enumerate(batch.column("marks").to_pylist()):
                    own = slice(first[r], first[r + 1])
                    begin = words.bounds[r]
                    pos = np.array([m["pos"] for m in marks], np.int64)
                    shard = np.array([m["shard"] for m in marks], np.int64)
                    kept = np.array([m["own"] for m in marks], bool)
                    order = np.argsort(pos, kind="stable")
                    pos, shard, kept = pos[order], shard[order], kept[order]
                    choice = chosen[own] - begin
                    at = np.minimum(np.searchsorted(pos, choice), len(pos) - 1)
                    found = pos[at] == choice
                    here = starts[own]
                    for s in np.unique(shard).tolist():
                        for ref in (False, True):
                            use = np.flatnonzero(found & (shard[at] == s) & (kept[at] if ref else True))
                            for a, b in _runs(here[use]):
                                spans.append((int(here[use[a]]), int(here[use[b - 1]]) + window))
                                keys.append((s, r, int(here[use[a]] - begin), ref))
                cols = list(zip(*keys, strict=True)) or [[]] * 4
                rows = pa.array(cols[1], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[0], pa.int64()),
                        batch.column("doc").take(rows),
                        batch.column("tag").take(rows),
                        pa.array(cols[2], pa.int64()),
                        pa.array(cols[3], pa.bool_()),
                        _joined(words, spans),
                    ],
                    ["shard", "doc", "tag", "start", "ref", "text"],
                )

    return docs.select("doc", "tag", "text", "marks").mapInArrow(
        emit, "shard long, doc long, tag int, start long, ref boolean, text string"
    )


def _write_automata(segments: DataFrame, path: str, window: int) -> None:
    """One file per shard: the automaton of its passages, and where they come from."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        held, passages, places = None, [], []

        def finish() -> None:
            own = f"{folder}/.{held}-{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as out:
                out.write(pickle.dumps((SuffixAutomaton(passages, window), np.array(places, np.int64)), protocol=5))
            fs.move(own, f"{folder}/{held}")

        for batch in batches:
            words = split_words(texts_of(batch.column("text")), lower=False)
            hashes = words.hashes()
            for r, (shard, doc, tag, start) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("shard", "doc", "tag", "start")), strict=True)
            ):
                if shard != held:
                    if passages:
                        finish()
                    held, passages, places = shard, [], []
                passages.append(hashes[words.bounds[r] : words.bounds[r + 1]])
                places.append((doc, tag, start))
        if passages:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["done"])

    own = segments.where("ref").repartition(F.col("shard")).sortWithinPartitions("shard", "doc", "tag", "start")
    own.mapInArrow(build, "done long").agg(F.sum("done")).collect()


def _matches(segments: DataFrame, path: str, window: int) -> DataFrame:
    """Repeated windows as ranges of starts, and the windows that are not in the reference.

    ``h`` is NULL for ranges; for the others it is the window's hash.
    """
    fields = "doc long, tag int, first long, last long, h long"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        held, automaton, places, seen = None, None, None, None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "tag", "first", "last", "h"]
            )

        def back() -> pa.RecordBatch:
            """Places of the reference that other places of the corpus matched."""
            found = []
            covered = np.flatnonzero(np.cumsum(seen[:-1]) > 0)
            for a, b in _runs(covered):
                p = int(np.searchsorted(automaton.starts, covered[a], side="right")) - 1
                doc, tag, start = places[p].tolist()
                shift = start - int(automaton.starts[p])
                found.append((doc, tag, int(covered[a]) + shift, int(covered[b - 1]) + shift + 1, None))
            return rows(found)

        for batch in batches:
            words = split_words(texts_of(batch.column("text")), lower=False)
            hashes = words.hashes()
            found = []
            for r, (shard, doc, tag, start) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("shard", "doc", "tag", "start")), strict=True)
            ):
                if shard != held:
                    if held is not None:
                        yield back()
                    with fs.open_input_stream(f"{folder}/{shard}") as data:
                        automaton, places = pickle.loads(data.read())  # noqa: S301  (written above)
                    held = shard
                    seen = np.zeros(int(automaton.starts[-1]) + len(automaton.end) + 2, np.int32)
                own = hashes[words.bounds[r] : words.bounds[r + 1]]
                place = automaton.first_places(own)
                p = np.searchsorted(automaton.starts, place, side="right") - 1
                same = (
                    (place >= 0)
                    & (places[p, 0] == doc)
                    & (places[p, 1] == tag)
                    & (places[p, 2] + place - automaton.starts[p] == start + np.arange(len(place)))
                )
                hit = np.flatnonzero((place >= 0) & ~same)
                for a, b in _runs(hit, place[hit]):
                    found.append((doc, tag, start + int(hit[a]), start + int(hit[b - 1]) + 1, None))
                    seen[place[hit[a]]] += 1
                    seen[place[hit[b - 1]] + 1] -= 1
                rest = np.flatnonzero(place < 0)
                if len(rest):
                    grams = ngram_hashes(own, window).view(np.int64)
                    found += [(doc, tag, start + i, start + i + 1, h) for i, h in zip(rest.tolist(), grams[rest].tolist(), strict=True)]
            yield rows(found)
        if held is not None:
            yield back()

    dealt = segments.where("NOT ref").select("shard", "doc", "tag", "start", "text")
    n = max(1, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionByRange(n, "shard", "doc", "start").sortWithinPartitions("shard", "doc", "start")
    return dealt.mapInArrow(stream, fields)


def repeated_windows(docs: DataFrame, copies: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc, tag, first, last): starts of windows that begin elsewhere too, exact copies left out."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    rows = _anchor_rows(docs, window, run)
    shared = (
        rows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tag", "pos")).alias("owner"))
        .where("n > 1")
    )
    here = rows.join(shared.select("h", "owner"), "h").select(
        "doc",
        "tag",
        F.struct(
            "pos",
            F.pmod(F.xxhash64("owner.doc", "owner.tag"), F.lit(shards)).alias("shard"),
            (F.struct("doc", "tag", "pos") == F.col("owner")).alias("own"),
        ).alias("mark"),
    )
    # Both need the rows by document: one exchange. The least copy is the one that takes part, so
    # it is also the owner of what the copies share.
    here = here.join(copies.where("NOT one").select("doc", "tag"), ["doc", "tag"], "left_anti")
    marked = here.groupBy("doc", "tag").agg(F.collect_list("mark").alias("marks"))
    segments = stored(_segments(docs.join(marked, ["doc", "tag"]), window, run), "segments")
    path = shared_folder(spark, "automata")
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    _write_automata(segments, path, window)
    found = stored(_matches(segments, path, window), "matches")
    rest = found.where("h IS NOT NULL")
    twice = rest.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    more = rest.join(twice, "h", "left_semi")
    return found.where("h IS NULL").unionByName(more).select("doc", "tag", "first", "last")


def without_repeats(documents: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Documents without the words of windows that occur more than once.

    One row per row of ``documents`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if asked
    for, ``kept`` (words joined by one space). A word goes if any window that covers it begins elsewhere as well,
    in the same document or another; windows are those of the input. Null and empty texts have
    no words; texts of fewer words than a window lose none. Equal rows, and rows that share a
    doc_id, are documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    docs = _tagged(documents)
    copies = stored(_copies(docs), "copies")
    repeats = repeated_windows(docs, copies, window)
    ranges = repeats.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    flags = ranges.join(copies.select("doc", "tag", "copies"), ["doc", "tag"], "full_outer")
    whole = docs.join(flags, ["doc", "tag"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big):
                words = split_words(texts_of(batch.column("text")), lower=False)
                count = words.counts()
                gone = np.zeros(len(words.codes), bool)
                copied = batch.column("copies").is_valid().to_numpy(zero_copy_only=False)
                gone[np.repeat(copied & (count >= window), count)] = True
                for r, ranges in enumerate(batch.column("ranges").to_pylist()):
                    for span in ranges or ():
                        gone[words.bounds[r] + span["first"] : words.bounds[r] + span["last"] - 1 + window] = True
                kept = np.concatenate([[0], np.cumsum(~gone)])[words.bounds]
                flat = words.dictionary.take(pa.array(words.codes[~gone]))
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), flat), " ")
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in text.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(count.astype(np.int64)),
                        pa.array(count - np.diff(kept)),
                        pa.array(digests, pa.string()),
                        text if with_text else pa.nulls(len(text), pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    out = whole.select("doc_id", "text", "copies", "ranges").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
    return out if with_text else out.drop("kept")
