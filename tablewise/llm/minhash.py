"""Near duplicates by an inverted join over the coordinates of MinHash signatures.

A signature has ``COORDINATES`` values, the least of as many hash functions over a set's shingles; two sets agree
in a coordinate with the probability of their Jaccard similarity. Linked sets agree in at least half of them but for
9 in 10**12 pairs at 0.85, so a pair is a candidate if it has ``MATCHES`` equal coordinates. A set is posted under its
coordinate-value pairs, and the T-occurrence problem is solved on the posting lists:

* *prefix*: in one order of all values, rarest first by a sketch of the corpus, two signatures with ``MATCHES``
  equal values share one of their first ``COORDINATES - MATCHES + 1``. Only these are posted; the lists of common
  values, which would be long, are skipped and looked into for pairs that have met.
* *skip*: inside a list collisions are counted a few coordinates at a time, and a pair is given up as soon as the
  coordinates left cannot bring it to ``MATCHES``.

Candidates whose bitmaps differ in more bits than linked sets may are dropped: a shingle sets one bit, so no more
bits differ than shingles do. The rest are confirmed on the full sets of both texts.

A group of near copies shares its lists, and its pairs are as many as the square of its size. So a list names only the
pairs that a forest over its components needs, the nearest first; what is confirmed joins components, and lists go on
only if a pair of theirs failed, then with all pairs between components. Lists of more sets than one task
takes are joined to a few of their sets first, and then tile by tile, where only sets outside the list's
commonest component ask. Equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import MIX_A, columns_of, mixed, remove, shared_folder, slices, texts_of, tidy
from tablewise.llm.jaccard_join import components, shingle_sets

SHINGLE, PERCENT = 5, 85
COORDINATES, MATCHES = 64, 32
#: Coordinates merged at a time; sets that a task joins at once; sets that a longer list is joined to first.
STEP, TILE, HUBS = 16, 1024, 4
#: Counters of the sketch, kept in rows so that it is added up in parallel (4 MB, whatever the corpus).
CELLS, SKETCH_ROWS = 1 << 20, 64
#: Pairs named between two components of a list, by round; 0 names all.
ROUNDS = (1, 0)

_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * MIX_A)
_ODD = mixed(_SEEDS ^ MIX_A) | np.uint64(1)


# ---------------------------------------------------------------- one batch


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``COORDINATES`` values for each non-empty set."""
    bounds = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint64)
    with np.errstate(over="ignore"):
        for c in range(COORDINATES):
            out[:, c] = np.minimum.reduceat((flat ^ _SEEDS[c]) * _ODD[c], bounds)
    # Values of different coordinates are different tokens.
    return mixed(out ^ _SEEDS[None, :])


def bitmap(s: np.ndarray) -> bytes:
    """A set's shingles in a power of two of bits, four to eight for each."""
    bits = 1 << max(6, (4 * len(s)).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mixed(s) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap in fewer bytes: what was set stays set."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def set_name(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(24) & np.uint64(CELLS - 1)).astype(np.int64)


def prefixes(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest tokens of each signature, as many as linked ones must share one of."""
    order = np.lexsort((tokens, counts[_cell(tokens)]), axis=1)[:, : COORDINATES - MATCHES + 1]
    return np.take_along_axis(tokens, order, axis=1)


# ---------------------------------------------------------------- tables


class _Folder:
    """Tables of one run; those that nothing reads any more are deleted."""

    def __init__(self, spark, name: str):
        self.spark, self.path, self.made = spark, shared_folder(spark, name), 0

    def store(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_in = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "stored_in", None):
                remove(self.spark, t.stored_in)
        tidy(self.spark)


def _scanned(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t (a hash of the text), n, name, tokens, bits for every row; name is NULL for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(texts_of(batch.column("text")), size)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full).astype("<u8") if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("t"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_name(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                        pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "t", "n", "name", "tokens", "bits"],
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return keyed.mapInArrow(run, "doc_id long, t long, n long, name binary, tokens binary, bits binary")


def _token_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, COORDINATES)


def _sketch(sets: DataFrame) -> np.ndarray:
    """How many sets hold the tokens of each cell, added up over all sets."""
    width = CELLS // SKETCH_ROWS
    schema = "part int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            total += np.bincount(_cell(_token_rows(batch.column("tokens")).ravel()), minlength=CELLS).astype(np.uint32)
        held = [i for i in range(SKETCH_ROWS) if total[i * width : (i + 1) * width].any()]
        parts = [total[i * width : (i + 1) * width].astype("<u8").tobytes() for i in held]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, "<u8")
        parts = [t.astype("<u8").tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    out = np.zeros((SKETCH_ROWS, width), np.uint64)
    for part, counts in sets.select("tokens").mapInArrow(count, schema).repartition(F.col("part")).mapInArrow(add, schema).collect():
        out[part] = np.frombuffer(counts, "<u8")
    return out.ravel()


def _postings(sets: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(token, id): each set under the tokens of its prefix."""
    held = sets.sparkSession.sparkContext.broadcast(sketch.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = prefixes(_token_rows(batch.column("tokens")), held.value) if batch.num_rows else np.zeros((0, 1), np.uint64)
            ids = np.repeat(batch.column("id").to_numpy(), found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(ids)], ["token", "id"])

    return sets.select("id", "tokens").mapInArrow(run, "token long, id long")


# ---------------------------------------------------------------- lists


def _few_bits_differ(n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be linked by their bitmaps: at most (1 - s) / (1 + s) of all shingles are in one set alone."""
    sizes = np.array([len(b) for b in bits])
    least = np.minimum(sizes[i], sizes[j])
    out = np.zeros(len(i), bool)
    for size in np.unique(least).tolist():
        own = np.flatnonzero(least == size)
        rows = np.unique(np.concatenate([i[own], j[own]]))
        table = np.stack([folded(bits[r], size) for r in rows.tolist()])
        for part in np.array_split(own, (len(own) * size >> 24) + 1):
            x, y = (table[np.searchsorted(rows, ends[part])] for ends in (i, j))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            out[part] = (100 + percent) * apart <= (100 - percent) * (n[i[part]] + n[j[part]])
    return out


def collisions(tokens: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of pairs with at least ``MATCHES`` equal coordinates; hopeless pairs are skipped early."""
    place, counts = np.arange(len(i)), np.zeros(len(i), np.int64)
    for start in range(0, COORDINATES, STEP):
        x, y = (tokens[side[place], start : start + STEP] for side in (i, j))
        counts = counts + (x == y).sum(axis=1)
        alive = counts + COORDINATES - min(start + STEP, COORDINATES) >= MATCHES
        place, counts = place[alive], counts[alive]
    return place, counts


def candidate_pairs(
    n: np.ndarray, tokens: np.ndarray, bits: list[bytes], label: np.ndarray, side: np.ndarray | None,
    failed: set[tuple[int, int]], percent: int, per_pair: int,
) -> list[tuple[int, int]]:
    """Pairs (i, j) of a list to be confirmed: in different components, near enough, not tried before.

    ``per_pair`` pairs at most between two components, the nearest first, and only if a forest needs them; 0: all.
    With sides only pairs of both sides count.
    """
    found = []
    block = max(1, (1 << 20) // max(1, len(n)))
    for start in range(0, len(n), block):
        rows = np.arange(start, min(start + block, len(n)))
        near = (label[rows, None] != label[None, :]) & (rows[:, None] < np.arange(len(n))[None, :])
        if side is not None:
            near &= side[rows, None] != side[None, :]
        near &= 100 * np.minimum(n[rows, None], n[None, :]) >= percent * np.maximum(n[rows, None], n[None, :])
        i, j = np.nonzero(near)
        i = i + start
        place, counts = collisions(tokens, i, j)
        i, j = i[place], j[place]
        ok = _few_bits_differ(n, bits, i, j, percent) if len(i) else np.zeros(0, bool)
        found.append(np.stack([counts[ok], i[ok], j[ok]]))
    counts, i, j = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    pairs = list(zip(i.tolist(), j.tolist(), strict=True))
    if not per_pair:
        return [p for p in pairs if p not in failed]
    parent = {int(c): int(c) for c in np.unique(label)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out, used = [], {}
    for at in np.lexsort((j, i, -counts)).tolist():
        pair = pairs[at]
        if pair in failed:
            continue
        a, b = sorted((int(label[pair[0]]), int(label[pair[1]])))
        if (a, b) in used or root(a) != root(b):
            used[a, b] = used.get((a, b), 0) + 1
            if used[a, b] <= per_pair:
                parent[root(a)] = root(b)
                out.append(pair)
    return out


def _named_pairs(members: DataFrame, failed: DataFrame | None, percent: int, per_pair: int) -> DataFrame:
    """(g, h, a, b): pairs to be confirmed in lists (g, h) of members (id, n, tokens, bits, label, side).

    ``failed`` (g, h, a, b) are pairs of these lists that are no links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, tried, out = None, [], [], []

        def finish() -> None:
            ids, n, tokens, bits, label, side = zip(*rows, strict=True)
            if len(set(label)) > 1:
                place = {x: i for i, x in enumerate(ids)}
                failed = {(min(p), max(p)) for p in ((place.get(a, -1), place.get(b, -1)) for a, b in tried)}
                pairs = candidate_pairs(
                    np.array(n), np.frombuffer(b"".join(tokens), "<u2").reshape(-1, COORDINATES), list(bits), np.array(label),
                    np.array(side) if side[0] is not None else None, failed, percent, per_pair,
                )
                out.extend((*held, min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in pairs)

        def done() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["g", "h", "a", "b"])

        for batch in batches:
            for g, h, a, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, h) != held:
                    if rows:
                        finish()
                    held, rows, tried = (g, h), [], []
                if a is None:
                    rows.append(row)
                else:
                    tried.append((a, b))
            yield done()
        if rows:
            finish()
            yield done()

    none = F.lit(None).cast("long")
    own = members.select("g", "h", none.alias("a"), none.alias("b"), "id", "n", "tokens", "bits", "label", "side")
    if failed is not None:
        empty = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("id", "n", "tokens", "bits", "label", "side")]
        own = own.unionByName(failed.select("g", "h", "a", "b", *empty))
    dealt = own.repartition("g", "h").sortWithinPartitions("g", "h", "a", "b", "id")
    return dealt.mapInArrow(run, "g long, h long, a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked) by the full sets of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "left"):
                sides = [shingle_sets(texts_of(batch.column(c)), size) for c in ("left", "right")]
                linked = []
                for x, y in zip(*sides, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * common >= percent * (len(x) + len(y) - common))
                columns = [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "linked"])

    both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, linked boolean")


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, of which every task makes stars around their least ends.

    Long chains of links would take a round of :func:`components` for each doubling of their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        ends = [(v, root(v)) for v in parent]
        ends = [p for p in ends if p[0] != p[1]]
        columns = list(zip(*ends, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


class _Linking:
    """Confirmed pairs and the components that they make, as rounds go on."""

    def __init__(self, docs: DataFrame, sets: DataFrame, folder: _Folder, size: int, percent: int):
        self.docs, self.sets, self.folder, self.size, self.percent = docs, sets, folder, size, percent
        spark = docs.sparkSession
        self.none = spark.createDataFrame([], "v long, label long")
        # Each is None until there is something in it: joins with nothing are left out.
        self.tested: DataFrame | None = None
        self.label: DataFrame | None = None
        self.texts: DataFrame | None = None

    def _fetch(self, pairs: DataFrame) -> None:
        """Texts of the sets in ``pairs``, each once; texts of the corpus that no pair names stay where they are."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if self.texts is not None:
            wanted = wanted.join(self.texts.select("id"), "id", "left_anti")
        wanted = self.folder.store(wanted.join(self.sets.select("id", F.col("doc_id").alias("d"), F.col("t").alias("u")), "id"), "wanted")
        if wanted.isEmpty():
            return
        own = self.docs.withColumn("t", F.xxhash64("text"))
        near = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))
        found = self.folder.store(near.groupBy("id").agg(F.first("text").alias("text")), "texts")
        self.texts = found if self.texts is None else self.texts.unionByName(found)

    def confirm(self, named: DataFrame) -> DataFrame | None:
        """(g, h, a, b, linked) of pairs (g, h, a, b) named in lists; None without any.

        Pairs that were confirmed or refuted before are not looked at again. What is linked joins components.
        """
        pairs = named.select("a", "b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
        new = self.folder.store(pairs, "pairs")
        if not new.isEmpty():
            self._fetch(new)
            found = self.folder.store(_confirmed(new, self.texts, self.size, self.percent), "tested")
            self.tested = found if self.tested is None else self.tested.unionByName(found)
        self.folder.drop(new)
        if self.tested is None:
            return None
        out = self.folder.store(named.join(self.tested, ["a", "b"]).select("g", "h", "a", "b", "linked"), "outcome")
        # Lists side by side in a task, each of which names a forest, come out as stars.
        self._merge(out.where("linked").select("g", "a", "b").repartition("g").select("a", "b"))
        return out

    def _merge(self, links: DataFrame) -> None:
        old = self.label
        if old is None:
            self.label = self.folder.store(components(_stars(links)), "labels")
            return
        for end in ("a", "b"):
            links = links.join(old.select(F.col("v").alias(end), F.col("label").alias("to")), end, "left")
            links = links.withColumn(end, F.coalesce("to", end)).drop("to")
        links = self.folder.store(links.where("a != b").select("a", "b").distinct(), "links")
        if links.isEmpty():
            return
        new = self.folder.store(components(_stars(links)), "merged")
        moved = old.join(new.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left")
        moved = moved.select("v", F.coalesce("to", "label").alias("label"))
        self.label = self.folder.store(moved.union(new.join(old, "v", "left_anti").select("v", "label")), "labels")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id ...) with the label of each set."""
        if self.label is None:
            return rows.withColumn("label", F.col("id"))
        names = self.label.select(F.col("v").alias("id"), F.col("label").alias("own"))
        return rows.join(names, "id", "left").withColumn("label", F.coalesce("own", "id")).drop("own")

    def settle(self, members: DataFrame) -> None:
        """Confirm pairs of lists (g, h, id, n, tokens, bits, side) until none between components is left."""
        failed = None
        for per_pair in ROUNDS:
            named = self.folder.store(_named_pairs(self.labelled(members), failed, self.percent, per_pair), "named")
            found = self.confirm(named)
            if found is None:
                return
            # A list whose pairs were all linked is one component as far as its candidates go.
            late = self.folder.store(found.where("NOT linked").select("g", "h", "a", "b"), "failed")
            self.folder.drop(named, found)
            if late.isEmpty():
                return
            failed = late if failed is None else failed.unionByName(late)
            if per_pair:
                going = self.folder.store(members.join(late.select("g", "h").distinct(), ["g", "h"], "left_semi"), "lists")
                self.folder.drop(members)
                members = going


def _tiles(lists: DataFrame, sets: DataFrame, linking: _Linking, tile: int) -> DataFrame:
    """Lists (g, id) of many sets as tiles (g, h, id, side), after joining each to a few of its sets.

    The sets of a list's commonest component only answer; all others meet every set of the list in one tile.
    """
    for seed in range(HUBS):
        spot = F.struct(F.xxhash64("id", F.lit(seed)).alias("s"), "id")
        hub = lists.groupBy("g").agg(F.min(spot).alias("hub")).select("g", F.col("hub.id").alias("hub"))
        stars = lists.join(hub, "g").where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        own = linking.labelled(stars.distinct().withColumnRenamed("a", "id")).withColumnsRenamed({"id": "a", "label": "la", "b": "id"})
        own = linking.labelled(own).withColumnsRenamed({"id": "b", "label": "lb"}).where("la != lb").select("a", "b")
        both = own.join(sets.select(F.col("id").alias("a"), "n", "tokens", "bits"), "a")
        both = both.join(sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("s"), F.col("bits").alias("c")), "b")
        near = both.mapInArrow(_near(linking.percent), "a long, b long")
        named = near.select(F.col("a").alias("g"), F.lit(0).cast("long").alias("h"), "a", "b")
        linking.confirm(linking.folder.store(named, "stars"))
    own = linking.labelled(lists)
    most = own.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
    most = most.groupBy("g").agg(F.max(F.struct("c", "label")).alias("m")).select("g", F.col("m.label").alias("main"))
    own = own.join(most, "g").select("g", "id", (F.col("label") != F.col("main")).alias("asks"))
    sizes = own.groupBy("g").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("asks").cast("long")).alias("asking")).where("asking > 0")
    own = own.join(sizes, "g").withColumn("rows", F.ceil(F.col("asking") / tile)).withColumn("cols", F.ceil(F.col("all") / tile))
    spot, zero = F.xxhash64("id", F.lit(HUBS)), F.lit(0).cast("long")
    asks = own.where("asks").select(
        "g", "id", F.lit(0).alias("side"), F.pmod(spot, F.col("rows")).alias("i"), F.explode(F.sequence(zero, F.col("cols") - 1)).alias("j")
    )
    answers = own.select(
        "g", "id", F.lit(1).alias("side"), F.explode(F.sequence(zero, F.col("rows") - 1)).alias("i"), F.pmod(spot, F.col("cols")).alias("j")
    )
    return asks.unionByName(answers).select("g", F.xxhash64("i", "j").alias("h"), "id", "side")


def _near(percent: int):
    """Keeps pairs (a, b) of rows with both sets' n, tokens and bits that are candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            rows = len(a)
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n", "m")])
            tokens = np.frombuffer(b"".join(x for c in ("tokens", "s") for x in batch.column(c).to_pylist()), "<u2")
            bits = batch.column("bits").to_pylist() + batch.column("c").to_pylist()
            place, _ = collisions(tokens.reshape(-1, COORDINATES), np.arange(rows), np.arange(rows, 2 * rows))
            ok = 100 * np.minimum(n[place], n[place + rows]) >= percent * np.maximum(n[place], n[place + rows])
            place = place[ok]
            place = place[_few_bits_differ(n, bits, place, place + rows, percent)] if len(place) else place
            yield pa.RecordBatch.from_arrays([pa.array(a[place]), pa.array(b[place])], ["a", "b"])

    return run


def _short(sets: DataFrame) -> DataFrame:
    """Sets with 16 bits of each token: equal tokens stay equal, and few others become so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (_token_rows(batch.column("tokens")) >> np.uint64(48)).astype("<u2") if batch.num_rows else ()
            at = batch.schema.get_field_index("tokens")
            yield batch.set_column(at, "tokens", pa.array([r.tobytes() for r in rows], pa.binary()))

    return sets.mapInArrow(run, sets.schema)


# ---------------------------------------------------------------- results


def near_copies(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct ``size``-word shingles (A-Z
    lower-cased; a shorter text is one shingle as a whole). ``component_id`` is the least doc_id reachable and ``kept``
    whether that is the document's own. Null and blank texts have the empty set and link with nothing. A row without
    doc_id has the least id of its component, NULL if there is none, and is kept only then. Repeated rows each give
    their row. An empty table gives no rows; other columns are ignored. Signatures find a link of exactly 0.85 but
    for 9 times in 10**12, so ``percent`` should not be lower.
    """
    docs = columns_of(documents, doc_id="long", text="string")
    folder = _Folder(docs.sparkSession, "near-copies")
    rows = folder.store(_scanned(docs, size), "rows")
    first = F.min(F.struct("doc_id", "t")).alias("d")
    # A null doc_id is the least of all, so the least one that is known is kept beside it.
    made = rows.where("name IS NOT NULL").groupBy("name").agg(
        first, F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "tokens", "bits")]
    )
    made = made.select("name", F.col("d.doc_id").alias("doc_id"), F.col("d.t").alias("t"), "least", "n", "tokens", "bits")
    sets = folder.store(made.withColumn("id", F.monotonically_increasing_id()), "sets")
    posted = _postings(sets, _sketch(sets))
    sizes = posted.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = folder.store(posted.join(sizes, "token").select(F.col("token").alias("g"), "id", "c"), "lists")
    short = folder.store(_short(sets.join(lists.select("id").distinct(), "id", "left_semi").select("id", "n", "tokens", "bits")), "short")
    linking = _Linking(docs, sets, folder, size, percent)
    few = lists.where(F.col("c") <= tile).select("g", F.lit(0).cast("long").alias("h"), "id", F.lit(None).cast("int").alias("side"))
    linking.settle(folder.store(few.join(short, "id"), "few"))
    many = lists.where(F.col("c") > tile).select("g", "id")
    if not many.isEmpty():
        linking.settle(folder.store(_tiles(many, short, linking, tile).join(short, "id"), "tiles"))
    folder.drop(lists, short)
    named = linking.labelled(sets.select("id", "name", "least"))
    shared = named.join((linking.none if linking.label is None else linking.label).select(F.col("v").alias("id")), "id", "left_semi")
    shared = shared.join(shared.groupBy("label").agg(F.min("least").alias("all")), "label").select("id", "all")
    named = named.join(shared, "id", "left").select(F.col("name").alias("of"), F.coalesce("all", "least").alias("all"))
    out = rows.join(named, F.col("name") == F.col("of"), "left")
    component = F.coalesce("all", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
