"""Token ids in binary shards, found by key through a minimal perfect hash index.

Files of a store (any folder that pyarrow's file systems can open):

* ``shard-N.ids``: the ids of one range of keys, little-endian, no header. Two bytes an id
  if the vocabulary allows, else four.
* ``shard-N.len``: ids of each record, unsigned 32-bit, in the order of the payload.
* ``index-N.mph``: one part of the index. A key's hash chooses part, block and bucket; the
  bucket's pilot sends each of its keys to a slot of its own, and every slot is used. The slot
  holds a 32-bit fingerprint, the shard, the offset in ids, the first record and the number of
  records. A key costs one probe; a key that is not stored fails its fingerprint (all but one
  in 2^32).

Keys are ``doc_id``. Records of one key lie side by side, so repeated keys and the null key
are single slots with several records. Tasks write to a name of their own and rename it, and
what they write depends only on their rows, so a task that runs again gives the same file.

A store may also be written in an order of its own (of a shuffled corpus). Then each record has a slot:
a key's first record is found by the key, its n-th by key and n, and the first slot holds how many there are.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.common import (
    MIX_A,
    columns_of,
    filesystem,
    mixed,
    remove,
    shared_folder,
    slices,
    split_words,
    stored,
    texts_of,
)

# ---------------------------------------------------------------- encoding


class WordEncoder:
    """Ids of whole texts, with every distinct word encoded once.

    For tokenizers that drop white space before they merge: the ids of a text are then the ids
    of its words, one after another. Words are cut further where an ASCII letter meets ASCII
    punctuation (apostrophes excepted), which the pattern of these vocabularies cuts as well.
    """

    #: Words kept between batches; beyond it the memory starts anew (the ids stay the same).
    REMEMBERED = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        kind = np.zeros(256, np.uint8)
        for c in range(33, 127):
            kind[c] = 1 if chr(c).isalpha() else 0 if chr(c).isdigit() or chr(c) == "'" else 2
        self.kind = kind
        # Byte-level vocabularies write a byte as a printable character: itself, or 256 and up.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: 256 + i for i, b in enumerate(hidden)}

    def pieces(self, texts: pa.StringArray):  # noqa: ANN201
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        if b"<|" in raw.tobytes():  # special tokens are taken out of whole words
            return split_words(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
        kind = self.kind[raw]
        cuts = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1
        spaced = np.insert(raw, cuts, 32)
        moved = (offsets + np.searchsorted(cuts, offsets)).astype(np.int32)
        return split_words(
            pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved.tobytes()), pa.py_buffer(spaced.tobytes()))
        )

    def _learn(self, words: list[str]) -> None:
        plain, rest, model = [], [], self.tokenizer.model
        for w in words:
            if w.isalpha() and (w.isascii() or (w == w.lower() and unicodedata.is_normalized("NFC", w))):
                plain.append(w)
            else:
                rest.append(w)
        for w in plain:
            shown = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
            self.known[w] = np.array([t.id for t in model.tokenize(shown)], self.dtype).tobytes()
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: pa.StringArray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more bound than texts)."""
        words = self.pieces(texts)
        names = words.dictionary.to_pylist()
        if len(self.known) + len(names) > self.REMEMBERED:
            self.known = {}
        self._learn([w for w in names if w not in self.known])
        parts = [self.known[w] for w in names]
        flat = np.frombuffer(b"".join(parts), self.dtype)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        each = size[words.codes]
        after = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(after[-1]) + np.repeat(first[words.codes] - after[:-1], each)]
        bounds = after[words.bounds]
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; reused by its later tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(df: DataFrame, tokenizer: str, end_id: int | None, key: str = "shard int, doc_id long") -> DataFrame:
    """``df``'s key columns with ``ids`` (little-endian bytes) in place of ``text``."""
    names = [part.split()[0] for part in key.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole):
                ids, bounds = enc.encode(texts_of(batch.column("text")), end_id)
                cut = pa.array(bounds * enc.dtype.itemsize, pa.int64()).cast(pa.int32())
                binary = pa.BinaryArray.from_buffers(
                    pa.binary(), len(bounds) - 1, [None, cut.buffers()[1], pa.py_buffer(ids.tobytes())]
                )
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), binary], [*names, "ids"])

    return df.select(*names, "text").mapInArrow(run, f"{key}, ids binary")


# ---------------------------------------------------------------- writing


def _put(path: str, name: str, parts: list[bytes]) -> None:
    fs, folder = filesystem(path)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    fs.move(own, f"{folder}/{name}")


def _get(path: str, name: str) -> bytes:
    fs, folder = filesystem(path)
    with fs.open_input_stream(f"{folder}/{name}") as stream:
        return stream.read()


def _key_ranges(docs: DataFrame, shards: int) -> list[int]:
    """Values of ``by`` at which shards begin: quantiles of the keys, found without moving texts."""
    if shards < 2:
        return []
    at = [i / shards for i in range(1, shards)]
    found = docs.select(F.col("by").cast("double").alias("k")).approxQuantile("k", at, 0.1 / shards)
    return sorted({int(x) for x in found})


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    chars_per_shard: int = 32 << 20,
    keys_per_index: int = 250_000,
    order: str | None = None,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into a store at ``path``; returns one row per key.

    Shards hold ascending ranges of ``doc_id`` (null first; records of one key by their ids).
    The driver sees one number per shard and per index part, and no key. With ``order``, the name
    of a column of whole numbers, shards hold ascending ranges of that instead.
    """
    docs = columns_of(docs, doc_id="long", text="string", **({order: "long"} if order else {}))
    by = order or "doc_id"
    docs = docs.withColumn("by", F.col(by)).select("doc_id", "text", "by")
    rows, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    shards = max(1, -(-(chars or 0) // chars_per_shard))
    starts = _key_ranges(docs, shards)
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    shard = F.lit(0)
    if starts:
        edges = F.array(*[F.lit(s).cast("long") for s in starts])
        shard = F.when(F.col("by").isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("by"))))
    dealt = encoded(docs.withColumn("shard", shard.cast("int")), tokenizer, end_id, "shard int, doc_id long, by long")
    dealt = dealt.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", "by", "doc_id", "ids")
    width = encoder(tokenizer).dtype.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        now, out, own, lengths, keys = None, None, "", [], []

        def finish() -> pa.RecordBatch:
            out.close()
            fs.move(own, f"{folder}/shard-{now}.ids")
            each = np.concatenate(lengths)
            _put(path, f"shard-{now}.len", [each.astype("<u4").tobytes()])
            doc = pa.concat_arrays(keys)
            value, null = doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])])
            first = np.arange(len(new)) if order else np.flatnonzero(new)
            count = np.diff(np.append(first, len(new)))
            offset = np.cumsum(each) - each
            return pa.RecordBatch.from_arrays(
                [
                    doc.take(pa.array(first)),
                    pa.array(np.full(len(first), now, np.int32)),
                    pa.array(first.astype(np.int64)),
                    pa.array(count.astype(np.int64)),
                    pa.array(offset[first].astype(np.int64)),
                    pa.array(np.add.reduceat(each, first).astype(np.int64)),
                ],
                ["doc_id", "shard", "record", "records", "offset", "n_tokens"],
            )

        for batch in batches:
            part = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if part[a] != now:
                    if out is not None:
                        yield finish()
                    now, lengths, keys = int(part[a]), [], []
                    own = f"{folder}/.shard-{now}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(own)
                ids = pa.concat_arrays([batch.column("ids").slice(a, b - a)])
                bounds = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1].astype(np.int64)
                data = ids.buffers()[2]
                if data is not None:
                    out.write(memoryview(data)[bounds[0] : bounds[-1]])
                lengths.append(np.diff(bounds) // width)
                keys.append(pa.concat_arrays([batch.column("doc_id").slice(a, b - a)]))
        if out is not None:
            yield finish()

    fields = "doc_id long, shard int, record long, records long, offset long, n_tokens long"
    entries = stored(dealt.mapInArrow(write, fields), "entries")
    if order:
        own = Window.partitionBy("doc_id")
        entries = entries.withColumn("records", F.count(F.lit(1)).over(own))
        entries = entries.withColumn("nth", F.row_number().over(own.orderBy("shard", "record")) - 1)
    sizes = dict(entries.groupBy("shard").agg(F.sum("n_tokens")).collect())
    base, total = {}, 0
    for s in sorted(sizes):
        base[s], total = total, total + sizes[s]
    parts = max(1, -(-rows // keys_per_index))
    _put(
        path,
        "store.json",
        [json.dumps({"shards": {str(s): b for s, b in base.items()}, "parts": parts, "width": width, "scattered": bool(order)}).encode()],
    )
    _write_index(entries, path, parts)
    return entries.where("nth = 0").drop("nth") if order else entries


# ---------------------------------------------------------------- minimal perfect hash

BLOCK, BUCKET = 64, 3
SLOT = np.dtype(
    [("fp", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("record", "<u4"), ("records", "<u4"), ("tokens", "<u8")]
)


def _salted(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(h ^ (np.asarray(salt, np.uint64) * MIX_A + np.uint64(0x5851F42D4C957F2D)))


def _placed(h: np.ndarray, pilot: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    return (_salted(h, np.asarray(pilot, np.uint64) + np.uint64(3)) % np.asarray(m, np.uint64)).astype(np.int64)


def build_mph(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first slot of each block, pilot of each bucket, slot of each key) for distinct hashes.

    Blocks hold about 64 keys whatever the number of keys, so building takes linear time.
    """
    n = len(h)
    blocks = max(1, -(-n // BLOCK))
    block = (_salted(h, 1) % np.uint64(blocks)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
    order = np.argsort(block, kind="stable")
    pilots, slots = [], np.zeros(n, np.int64)
    tries = np.arange(128, dtype=np.uint64)
    for b in range(blocks):
        own = order[first[b] : first[b + 1]]
        m = len(own)
        k = -(-m // BUCKET)
        found = np.zeros(k, np.uint16)
        if m:
            bucket = (_salted(h[own], 2) % np.uint64(k)).astype(np.int64)
            used = np.zeros(m, bool)
            size = np.bincount(bucket, minlength=k)
            for c in np.argsort(-size, kind="stable"):
                members = own[bucket == c]
                if not len(members):
                    break
                for start in range(0, 1 << 16, 128):
                    at = _placed(h[members][:, None], tries[None, :] + np.uint64(start), m)
                    good = ~used[at].any(axis=0)
                    if len(members) > 1:
                        ordered = np.sort(at, axis=0)
                        good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                    if good.any():
                        p = int(np.argmax(good))
                        break
                else:
                    raise ValueError("two keys have one hash")
                used[at[:, p]] = True
                slots[members] = first[b] + at[:, p]
                found[c] = start + p
        pilots.append(found)
    return first, np.concatenate(pilots), slots


def find_slots(first: np.ndarray, pilots: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The slot of each hash; a hash that was never stored gets some slot, or -1."""
    blocks = len(first) - 1
    block = (_salted(h, 1) % np.uint64(blocks)).astype(np.int64)
    m = np.diff(first)
    k = -(-m // BUCKET)
    bucket_at = np.cumsum(k) - k
    full = m[block] > 0
    out = np.full(len(h), -1, np.int64)
    hit, b = h[full], block[full]
    bucket = (_salted(hit, 2) % k[b].astype(np.uint64)).astype(np.int64)
    out[full] = first[b] + _placed(hit, pilots[bucket_at[b] + bucket].astype(np.uint64), m[b])
    return out


def _hashed(df: DataFrame, parts: int) -> DataFrame:
    """Key hash, its index part, and a fingerprint from a second hash."""
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("no key"))).otherwise(F.xxhash64("doc_id"))
    if "nth" in df.columns:
        h = F.when(F.col("nth") == 0, h).otherwise(F.xxhash64(h, F.lit("nth"), "nth"))
    df = df.withColumn("h", h).withColumn("fp", F.xxhash64("h", F.lit(7)))
    return df.withColumn("part", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(parts)).cast("int"))


def _write_index(entries: DataFrame, path: str, parts: int) -> None:
    fields = ["h", "fp", "part", "shard", "offset", "record", "records", "n_tokens"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        got = {n: t[n].to_numpy() for n in fields}
        for part in np.unique(got["part"]):
            own = got["part"] == part
            h = got["h"][own].view(np.uint64)
            first, pilots, slots = build_mph(h)
            body = np.zeros(len(h), SLOT)
            body["fp"][slots] = got["fp"][own].view(np.uint64).astype(np.uint32)
            for name, source in (("shard", "shard"), ("offset", "offset"), ("record", "record"),
                                 ("records", "records"), ("tokens", "n_tokens")):
                body[name][slots] = got[source][own]
            head = np.array([len(h), len(first), len(pilots)], "<u8")
            _put(
                path,
                f"index-{part}.mph",
                [head.tobytes(), first.astype("<u8").tobytes(), pilots.astype("<u2").tobytes(), body.tobytes()],
            )
            yield pa.RecordBatch.from_arrays([pa.array([int(part)]), pa.array([len(h)])], ["part", "keys"])

    keyed = _hashed(entries, parts).select(*fields).repartitionById(parts, F.col("part"))
    keyed.mapInArrow(write, "part long, keys long").agg(F.sum("keys")).collect()


def load_index(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, blocks, buckets = (int(x) for x in np.frombuffer(data, "<u8", 3))
    at = 24
    first = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    pilots = np.frombuffer(data, "<u2", buckets, at + 8 * blocks)
    return first, pilots, np.frombuffer(data, SLOT, n, at + 8 * blocks + 2 * buckets)


# ---------------------------------------------------------------- reading


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Slots of ``keys`` (doc_id): shard, offset, first record, records. Unknown keys give no row.

    A key of a store in an order of its own gives a row per record.
    """
    meta = json.loads(_get(path, "store.json"))
    parts = meta["parts"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            part = batch.column("part").to_numpy()
            for p in np.unique(part):
                if p != held:
                    try:
                        held, index = p, load_index(_get(path, f"index-{p}.mph"))
                    except FileNotFoundError:  # no key hashes there
                        held, index = p, None
                if index is None:
                    continue
                rows = np.flatnonzero(part == p)
                first, pilots, body = index
                slot = find_slots(first, pilots, batch.column("h").to_numpy()[rows].view(np.uint64))
                fp = batch.column("fp").to_numpy()[rows].view(np.uint64).astype(np.uint32)
                ok = (slot >= 0) & (body["fp"][np.maximum(slot, 0)] == fp)
                got = body[slot[ok]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows[ok])),
                        pa.array(got["shard"].astype(np.int32)),
                        pa.array(got["offset"].astype(np.int64)),
                        pa.array(got["record"].astype(np.int64)),
                        pa.array(got["records"].astype(np.int64)),
                    ],
                    ["doc_id", "shard", "offset", "record", "records"],
                )

    def probed(keyed: DataFrame) -> DataFrame:
        return (
            _hashed(keyed, parts)
            .repartitionById(parts, F.col("part"))
            .sortWithinPartitions("part")
            .mapInArrow(probe, "doc_id long, shard int, offset long, record long, records long")
        )

    first = probed(columns_of(keys, doc_id="long"))
    if not meta.get("scattered"):
        return first
    first = stored(first, "first")
    nth = F.explode(F.sequence(F.lit(1), F.col("records").cast("int") - 1))
    more = probed(first.where("records > 1").select("doc_id", nth.alias("nth")))
    return first.union(more).withColumn("records", F.lit(1).cast("long"))


def read_records(spark: SparkSession, path: str, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per stored record of ``keys``: its start over the whole store, length and CRC.

    The index gives each key's place; places are then dealt to tasks by shard, so that each
    shard is read once and in order, and a task holds one key's ids at a time.
    """
    meta = json.loads(_get(path, "store.json"))
    base, width = {int(s): b for s, b in meta["shards"].items()}, meta["width"]
    dtype = np.dtype("<u2" if width == 2 else "<u4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        held, lengths, payload = None, None, None
        for batch in batches:
            rows = []
            for doc, shard, offset, record, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != held:
                    held, lengths = shard, np.frombuffer(_get(path, f"shard-{shard}.len"), "<u4")
                    if payload is not None:
                        payload.close()
                    payload = fs.open_input_file(f"{folder}/shard-{shard}.ids")
                for n in lengths[record : record + records].tolist():
                    payload.seek(offset * width)
                    ids = np.frombuffer(payload.read(n * width), dtype).astype("<u4")
                    raw = ids.tobytes()
                    rows.append((doc, base[shard] + offset, n, zlib.crc32(raw), raw if with_ids else None))
                    offset += n
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
            )

    found = lookup(spark, path, keys).repartitionById(max(base, default=0) + 1, F.col("shard"))
    found = found.sortWithinPartitions("shard", "offset").select("doc_id", "shard", "offset", "record", "records")
    out = found.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def token_store(docs: DataFrame, tokenizer: str, end_id: int | None = 2, order: str | None = None) -> DataFrame:
    """Write ``docs`` to a store in the shared folder and read every key back from its files.

    Null and empty texts are a record of the end id alone. Rows with equal ``doc_id`` are each
    a record, ordered by their ids, and so are rows without ``doc_id``, which come first. An empty table
    gives a store without shards and no rows. Other columns are ignored. With ``order``, records lie in
    the order of that column instead.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    entries = write_store(docs, path, tokenizer, end_id, order=order)
    return read_records(spark, path, entries.select("doc_id"))
