"""Documents linked by Jaccard similarity, as a metric-space join with pivots.

The Jaccard distance is a metric. Pivots part the space into regions, and a document takes part
in every region in which a partner may live; three kinds of pivot are used, coarse to fine:

1. *One shingle as pivot.* Its distance to a set is below 1 only if the set holds it; texts of a
   corpus are nearly all at distance 1 from any document, so documents are useless as pivots here.
   Partners share all but a tenth of their shingles, so a set is replicated to the regions of a
   tenth of its shingles (plus one), the rarest by a corpus-wide sketch: every linked pair
   meets in one of these regions.
2. *Sets as pivots*, inside regions of more than 256 sets. Whoever is linked to a pivot is done, and
   pairs that are linked already, even by way of others, need no test. The rest are joined within
   Voronoi cells: a set belongs to the cell of its nearest pivot, and to another one too if it is
   farther from that pivot by at most twice the radius. By the triangle inequality a linked
   pair shares a cell. Cells that are still large are regions again, with pivots of their own, as
   long as they shrink; what no pivot splits is joined tile by tile.
3. *Parts of the universe as pivots*, for pairs of a region: a set's counts of shingles in n/8
   hash buckets are its distances to the buckets, and the sum of two sets' differences is at
   most the size of their symmetric difference. Pairs beyond the radius are out; this is also
   the distance that 2. uses, as it needs a hundredth of a set's bytes.

What is left are nearly links alone. They are verified on the texts, first a forest that would
join each region's sets, then more pairs between sets that are still apart (1, 8, 64, all), so
that a group of copies costs about one test a member. A cluster of a region goes on to the next
round only while a pair of its forest is still in two components, and of its sets only those
with an untested partner; clusters that are alike by then are one. Equal sets are one set from
the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm import common
from tablewise.llm.common import MIX_A, columns_of, dropped, mixed, ngram_hashes, slices, split_words, texts_of, tidy

#: Cells and groups repeat their keys so often that their files say little of their size.
stored = partial(common.stored, measured=True)

SHINGLE, PERCENT = 3, 90
#: Sets a task joins at once; document pivots of a larger region; counters of the sketch.
TILE, PIVOTS, CELLS = 256, 8, 1 << 20
#: Levels of cells within cells; a cell is a region again if it holds at most this share of its region.
LEVELS, SHRINK = 6, 0.75
SKETCH_ROWS = 64


# ---------------------------------------------------------------- sets


def shingle_sets(texts: pa.StringArray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words = split_words(texts)
    hashes, bounds = words.hashes(), words.bounds
    grams = ngram_hashes(hashes, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            # A shorter sequence is one shingle; its length keeps it apart from others.
            out.append(mixed(ngram_hashes(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else grams[:0])
    return out


def set_key(s: np.ndarray) -> int:
    """64 bits that equal sets share; kept with the size of the set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        place = np.arange(1, len(s) + 1, dtype=np.uint64)
        return int(np.bitwise_xor.reduce(mixed(s + place * MIX_A)).view(np.int64))


def signature(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in a power of two of buckets, about an eighth of its size."""
    buckets = 1 << max(3, (len(s) >> 3).bit_length() - 1)
    counts = np.bincount((mixed(s) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(sig: bytes, buckets: int) -> np.ndarray:
    """A signature in fewer buckets."""
    return np.frombuffer(sig, np.uint8).reshape(-1, buckets).sum(axis=0, dtype=np.int32)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(CELLS - 1)).astype(np.int64)


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """One row per document (doc_id, t, n, k, sig), and the parts of each task's sketch of shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, np.uint32)
        names = ["doc_id", "t", "n", "k", "sig", "part", "counts"]
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(texts_of(batch.column("text")), size)
                sketch += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS).astype(np.uint32)
                m = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("t"),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([set_key(s) for s in sets], pa.int64()),
                        pa.array([signature(s) for s in sets], pa.binary()),
                        pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.binary()),
                    ],
                    names,
                )
        parts = sketch.reshape(SKETCH_ROWS, -1)
        for i in range(SKETCH_ROWS):
            if parts[i].any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(1, pa.int64()),
                        pa.nulls(1, pa.int64()),
                        pa.nulls(1, pa.int32()),
                        pa.nulls(1, pa.int64()),
                        pa.nulls(1, pa.binary()),
                        pa.array([i], pa.int32()),
                        pa.array([parts[i].tobytes()], pa.binary()),
                    ],
                    names,
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return keyed.mapInArrow(run, "doc_id long, t long, n int, k long, sig binary, part int, counts binary")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """Counts of all shingles of the corpus in a fixed number of cells (4 MB, whatever the input)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(counts, np.uint32).astype(np.uint64)
                total[part] = total[part] + own if part in total else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
            ["part", "counts"],
        )

    parts = scanned.where("part IS NOT NULL").select("part", "counts").repartition(F.col("part"))
    out = np.zeros((SKETCH_ROWS, CELLS // SKETCH_ROWS), np.uint64)
    for part, counts in parts.mapInArrow(add, "part int, counts binary").collect():
        out[part] = np.frombuffer(counts, np.uint64)
    return out.ravel()


def _memberships(docs: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """(pivot, k, n): the regions of each set, by its rarest shingles."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for whole in batches:
            for batch in slices(whole):
                pivots, keys = [np.zeros(0, np.uint64)], []
                for s in shingle_sets(texts_of(batch.column("text")), size):
                    n = len(s)
                    if n:
                        m = n - -(-percent * n // 100) + 1
                        # Equal counts are ordered by hash, alike in every set.
                        pivots.append(s[np.lexsort((s, counts[_cell(s)]))[:m]])
                        keys.append((set_key(s), n, m))
                k, n, m = (np.array(c, np.int64) for c in (zip(*keys, strict=True) if keys else ([], [], [])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(pivots).view(np.int64)),
                        pa.array(np.repeat(k, m)),
                        pa.array(np.repeat(n, m).astype(np.int32)),
                    ],
                    ["pivot", "k", "n"],
                )

    return docs.select("text").mapInArrow(run, "pivot long, k long, n int")


# ---------------------------------------------------------------- pairs


def _within(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether a symmetric difference of at least ``apart`` allows a link of sets of that total size."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def candidate_pairs(
    k: list[int],
    n: np.ndarray,
    sigs: list[bytes],
    label: np.ndarray,
    failed: list[set[int]],
    side: np.ndarray | None,
    percent: int,
    per_pair: int,
) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """Pairs of a group worth a test: near by signature, in different components, not tested before.

    Of each two components up to ``per_pair`` pairs, the nearest first, and only as many component
    pairs as a forest needs, unless ``per_pair`` is 0, which gives all. Pairs come with the cluster
    they hold together (near sets and components in one), and beside them the clusters of all
    members (by position) that have a pair which was not taken.
    """
    levels = np.array([len(s) for s in sigs])
    found = []
    if len(k) <= 4:  # most groups: two or three sets
        for y, x in combinations(range(len(k)), 2):
            total = int(n[x] + n[y])
            if label[x] == label[y] or (side is not None and side[x] == side[y]):
                continue
            if 100 * min(n[x], n[y]) < percent * max(n[x], n[y]) or k[x] in failed[y] or k[y] in failed[x]:
                continue
            b = min(levels[x], levels[y])
            apart = int(np.abs(folded(sigs[x], b) - folded(sigs[y], b)).sum())
            if _within(apart, total, percent):
                found.append((apart / total, y, x))
        levels = levels[:0]
    for level in np.unique(levels):
        rows = np.flatnonzero((levels == level) | (levels == 2 * level))
        table = np.stack([folded(sigs[i], level) for i in rows])
        for at, y in enumerate(rows):
            if levels[y] != level:
                continue
            # Pairs of one level once; pairs with the next level from the smaller one.
            others = np.flatnonzero(((rows > y) | (levels[rows] != level)) & (label[rows] != label[y]))
            if side is not None:
                others = others[side[rows[others]] != side[y]]
            if not len(others):
                continue
            x = rows[others]
            ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            apart = np.abs(table[others[ok]] - table[at]).sum(axis=1)
            near = _within(apart, n[x[ok]] + n[y], percent)
            for i, d in zip(x[ok][near].tolist(), apart[near].tolist(), strict=True):
                if k[i] not in failed[y] and k[y] not in failed[i]:
                    found.append((d / (n[i] + n[y]), y, i))
    if not per_pair:
        return [(k[y], k[x], 0) for _, y, x in found], {}
    found.sort()
    parent = {int(c): int(c) for c in np.unique(label)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out, used, left = [], {}, set()
    for _, y, x in found:
        a, b = int(label[y]), int(label[x])
        pair = (min(a, b), max(a, b))
        if pair in used or root(a) != root(b):
            used[pair] = used.get(pair, 0) + 1
            if used[pair] <= per_pair:
                parent[root(a)] = root(b)
                out.append((y, x))
                continue
        left.update((y, x))
    return [(k[y], k[x], root(int(label[y]))) for y, x in out], {i: root(int(label[i])) for i in sorted(left)}


def _proposed(groups: DataFrame, sets: DataFrame, label: DataFrame, failed: DataFrame, percent: int, per_pair: int) -> DataFrame:
    """Pairs to be tested (g1, g2, g3, c, a, b) in groups of a bounded number of sets (g1, g2, g3, k, side).

    Rows without ``b`` name the sets ``a`` of cluster ``c``, with their side, that have more pairs than those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, out = None, [], []

        def finish() -> None:
            k, n, sigs, labels, fails, side = zip(*rows, strict=True)
            if len(set(labels)) > 1:
                sides = np.array(side) if side[0] is not None else None
                pairs, left = candidate_pairs(
                    list(k), np.array(n, np.int64), list(sigs), np.array(labels, np.int64),
                    [set(f or ()) for f in fails], sides, percent, per_pair,
                )
                out.extend((*held, c, min(a, b), max(a, b), None) for a, b, c in pairs)
                out.extend((*held, c, k[i], None, side[i]) for i, c in left.items())

        def done() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            kinds = [pa.int64()] * 6 + [pa.int32()]
            arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["g1", "g2", "g3", "c", "a", "b", "side"])

        for batch in batches:
            for g1, g2, g3, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g1, g2, g3) != held:
                    if rows:
                        finish()
                    held, rows = (g1, g2, g3), []
                rows.append(row)
            yield done()
        if rows:
            finish()
            yield done()

    fails = failed.select("a", "b").union(failed.select("b", "a")).toDF("k", "f").groupBy("k").agg(F.collect_set("f").alias("fails")).hint("merge")
    full = groups.join(sets.select("k", "n", "sig"), "k").join(label.withColumnRenamed("v", "k"), "k", "left")
    full = full.join(fails, "k", "left").withColumn("label", F.coalesce("label", "k"))
    full = full.select("g1", "g2", "g3", "k", "n", "sig", "label", "fails", "side")
    dealt = full.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3")
    return dealt.mapInArrow(run, "g1 long, g2 long, g3 long, c long, a long, b long, side int")


def _tested(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked) from the whole texts of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "left"):
                left = shingle_sets(texts_of(batch.column("left")), size)
                right = shingle_sets(texts_of(batch.column("right")), size)
                linked = []
                for x, y in zip(left, right, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
                )

    joined = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, linked boolean")


def _texts_of(docs: DataFrame, keys: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(k, text) of the wanted sets (k): the texts of the corpus move once, and only these go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                keys = batch.column("k").to_pylist()
                same = [set_key(s) == keys[i] for i, s in enumerate(shingle_sets(texts_of(batch.column("text")), size))]
                yield batch.filter(pa.array(same, pa.bool_()))

    wanted = keys.distinct().join(sets.select("k", "doc_id"), "k")
    near = docs.join(wanted.select("k", F.col("doc_id").alias("d")), F.col("doc_id").eqNullSafe(F.col("d")))
    # Rows that share a doc_id and a set give it several times, which tests tolerate.
    return near.select("k", "text").mapInArrow(run, "k long, text string")


class _Links:
    """Verified pairs, and the components they make, as rounds go on.

    ``texts`` (k, text) holds every set that a pair may name.
    """

    def __init__(self, texts: DataFrame, sets: DataFrame, size: int, percent: int):
        spark = texts.sparkSession
        self.texts, self.sets, self.size, self.percent = texts, sets, size, percent
        self.tested = spark.createDataFrame([], "a long, b long, linked boolean")
        self.label = spark.createDataFrame([], "v long, label long")

    def test(self, pairs: DataFrame) -> int:
        pairs = stored(pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        n = pairs.count()
        if n:
            found = stored(_tested(pairs, self.texts, self.size, self.percent).distinct(), "tested")
            # A hint on a table does not reach the joins of a union.
            self.tested = self.tested.unionByName(found).hint("merge")
            self._merge(found.where("linked").select("a", "b"))
        return n

    def _merge(self, links: DataFrame) -> None:
        """Join components by new links: the links are followed between components, not between sets."""
        if links.isEmpty():
            return
        old = self.label
        for end in ("a", "b"):
            links = links.join(old.select(F.col("v").alias(end), F.col("label").alias("to")), end, "left")
            links = links.withColumn(end, F.coalesce("to", end)).drop("to")
        new = stored(components(links.select("a", "b")), "merged")
        moved = old.join(new.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left")
        moved = moved.select("v", F.coalesce("to", "label").alias("label"))
        self.label = stored(moved.union(new.join(old, "v", "left_anti").select("v", "label")), "labels")
        dropped(old, new)

    def propose(self, groups: DataFrame, per_pair: int) -> DataFrame:
        failed = self.tested.where("NOT linked")
        return _proposed(groups, self.sets, self.label, failed, self.percent, per_pair)

    def apart(self) -> DataFrame:
        """(a, b): tested pairs that are in two components, also by way of others."""
        pairs = self.tested.where("NOT linked").select("a", "b")
        for end in ("a", "b"):
            of = self.label.select(F.col("v").alias(end), F.col("label").alias(f"label_{end}"))
            pairs = pairs.join(of, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
        return pairs.where("label_a != label_b").select("a", "b")

    def settle(self, groups: DataFrame, first: DataFrame | None = None) -> None:
        """Test pairs of ``groups`` until none between different components is left.

        The pairs of a cluster span it: where they all are in one component by now, so is whatever is
        near in it, and it is done. Of the others go on the sets that have untested pairs, and
        clusters of the very same sets, which groups share, go on as one.
        """
        for per_pair in (1, 8, 64, 0):
            proposed = first if first is not None else stored(self.propose(groups, per_pair), "proposed")
            first = None
            pairs = proposed.where("b IS NOT NULL")
            if not self.test(pairs.select("a", "b").distinct()) or not per_pair:
                dropped(groups, proposed)
                return
            cluster = ["g1", "g2", "g3", "c"]
            unsettled = pairs.join(self.apart(), ["a", "b"], "left_semi").select(*cluster).distinct()
            rest = proposed.where("b IS NULL").join(unsettled, cluster, "left_semi")
            alike = rest.groupBy(*cluster).agg(F.sort_array(F.collect_list(F.struct("a", "side"))).alias("ks")).select("ks").distinct()
            named = alike.select(
                F.xxhash64("ks").alias("g1"), F.hash("ks").cast("long").alias("g2"), F.lit(0).cast("long").alias("g3"), F.explode("ks").alias("s")
            )
            former = groups
            groups = stored(named.select("g1", "g2", "g3", F.col("s.a").alias("k"), F.col("s.side").alias("side")), "groups")
            dropped(former, proposed)


def _far(members: DataFrame, percent: int) -> DataFrame:
    """(pivot, k, p, apart, near): distance by signature of a region's sets to its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = []
            for x, y in zip(batch.column("sig").to_pylist(), batch.column("pivot_sig").to_pylist(), strict=True):
                b = min(len(x), len(y))
                apart.append(int(np.abs(folded(x, b) - folded(y, b)).sum()))
            far = np.array(apart, np.int64)
            near = _within(far, batch.column("n").to_numpy() + batch.column("pivot_n").to_numpy(), percent)
            # Windows compare distances in one number of buckets: the least any set has.
            least = [
                int(np.abs(folded(x, 8) - folded(y, 8)).sum())
                for x, y in zip(batch.column("sig").to_pylist(), batch.column("pivot_sig").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("pivot", "k", "p")), pa.array(least, pa.int64()), pa.array(near, pa.bool_())],
                ["pivot", "k", "p", "apart", "near"],
            )

    return members.select("pivot", "k", "p", "n", "sig", "pivot_n", "pivot_sig").mapInArrow(
        run, "pivot long, k long, p long, apart long, near boolean"
    )


def _cells(members: DataFrame, sets: DataFrame, links: _Links, percent: int, level: int) -> DataFrame:
    """(pivot, p, k, asks): Voronoi cells p of regions (pivot, k), and which sets look for partners there."""
    # The first sets by hash; equal regions choose equal pivots, so their pairs are tested once.
    # Cells of a region take other pivots than the region did.
    # Spark drops all but a task's first few before a region's window.
    rank = Window.partitionBy("pivot").orderBy("order")
    chosen = members.select("pivot", F.struct(F.xxhash64("k", F.lit(level)).alias("h"), "k").alias("order"))
    chosen = chosen.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= PIVOTS).select("pivot", F.col("order.k").alias("p"))
    of = sets.select(F.col("k").alias("p"), F.col("n").alias("pivot_n"), F.col("sig").alias("pivot_sig"))
    pairs = members.join(sets.select("k", "n", "sig"), "k").join(chosen.join(of, "p"), "pivot")
    far = stored(_far(pairs, percent), "far")
    stars = far.where("near AND k != p").select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b"))
    links.test(stars.distinct())
    own = members.join(links.label.withColumnRenamed("v", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    # Members of a region's commonest component need no test among themselves: they only answer.
    most = own.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("c"))
    most = most.groupBy("pivot").agg(F.max(F.struct("c", "label")).alias("m")).select("pivot", F.col("m.label").alias("main"))
    own = own.join(most, "pivot").select("pivot", "k", (F.col("label") != F.col("main")).alias("loose"))
    home = far.groupBy("pivot", "k").agg(F.min(F.struct("apart", "p")).alias("home"))
    radius = F.col("n") * (1 + 100 / percent) * (100 - percent) / (100 + percent)
    placed = far.join(home, ["pivot", "k"]).join(own, ["pivot", "k"]).join(sets.select("k", "n"), "k")
    placed = placed.where(F.col("apart") <= F.col("home.apart") + 2 * radius + 1e-6)
    cells = stored(placed.select("pivot", "p", "k", (F.col("loose") & (F.col("p") == F.col("home.p"))).alias("asks")), "cells")
    dropped(far)
    return cells


def _grouped_cells(regions: DataFrame, sets: DataFrame, links: _Links, percent: int) -> list[DataFrame]:
    """Groups of bounded size for regions (pivot, k) of more sets than one task joins, cells within cells."""
    groups = []
    for level in range(LEVELS):
        cells = _cells(regions, sets, links, percent, level)
        sizes = cells.groupBy("pivot", "p").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("asks").cast("long")).alias("asking"))
        whole = regions.groupBy("pivot").agg(F.count(F.lit(1)).alias("whole"))
        again = (F.col("all") > TILE) & (F.col("all") <= SHRINK * F.col("whole")) & F.lit(level < LEVELS - 1)
        sizes = sizes.where("asking > 0").join(whole, "pivot").withColumn("again", again).drop("whole")
        placed = cells.join(sizes, ["pivot", "p"])
        groups.append(stored(_tiles(placed.where("NOT again")), "tiles"))
        former = regions
        regions = stored(placed.where("again").select(F.xxhash64("pivot", "p").alias("pivot"), "k").distinct(), "regions")
        dropped(cells, former)
        if regions.isEmpty():
            break
    return groups


def _tiles(tiles: DataFrame) -> DataFrame:
    """(g1, g2, g3, k, side): every asking set of a cell (pivot, p) meets every set of it in one group."""
    tiles = tiles.withColumn("rows", F.ceil(F.col("asking") / TILE)).withColumn("cols", F.ceil(F.col("all") / TILE))
    spot, zero = F.xxhash64("k", F.lit(3)), F.lit(0).cast("long")
    asks = tiles.where("asks").select(
        "pivot", "p", "k", F.lit(0).alias("side"),
        F.pmod(spot, F.col("rows")).alias("i"), F.explode(F.sequence(zero, F.col("cols") - 1)).alias("j"),
    )
    answers = tiles.select(
        "pivot", "p", "k", F.lit(1).alias("side"),
        F.explode(F.sequence(zero, F.col("rows") - 1)).alias("i"), F.pmod(spot, F.col("cols")).alias("j"),
    )
    both = asks.unionByName(answers)
    return both.select(F.col("pivot").alias("g1"), F.col("p").alias("g2"), F.xxhash64("i", "j").alias("g3"), "k", "side")


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(v, label) for all ends of ``links`` (a, b): the least end of their component.

    Every round points each end to the least of its neighbours, then shortens the paths; the
    rounds grow with the logarithm of the longest path. Links are never gathered by component.
    """
    edges = stored(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # Larger neighbours go to the least, then each end keeps one link to the least of its smaller ones.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u != v")
        former, edges = edges, stored(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(former)
        # Done when every end has one link, and to an end that has none itself: stars around the least.
        out = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        loose = out.where("n > 1").select("u").union(edges.select(F.col("v").alias("u")).join(out.select("u"), "u", "left_semi"))
        if loose.isEmpty():
            break
    roots = edges.select("v").distinct().select("v", F.col("v").alias("label"))
    return edges.select(F.col("u").alias("v"), F.col("v").alias("label")).union(roots).distinct()


def _named(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, t, n, k, label) per document row; ``label`` names its component unless n is 0."""
    docs = columns_of(documents, doc_id="long", text="string")
    scanned = stored(_scan(docs, size), "sets")
    rows = scanned.where("part IS NULL").select("doc_id", "t", "n", "k")
    held = stored(_memberships(docs, _sketch(scanned), size, percent), "regions")
    # Regions of one set are most of them; they leave before anything is joined.
    shared = held.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("pivot")
    former, held = held, stored(held.join(shared, "pivot", "left_semi").select("pivot", "k").distinct(), "shared")
    dropped(former)
    tidy(docs.sparkSession)
    counts = held.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # Regions of the same sets are one region; those of few sets may be gathered.
    few = held.join(counts.where(F.col("c") <= TILE), "pivot").groupBy("pivot").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    few = few.select("ks").distinct().select(
        F.xxhash64("ks").alias("g1"), F.hash("ks").cast("long").alias("g2"), F.lit(0).cast("long").alias("g3"),
        F.explode("ks").alias("k"), F.lit(None).cast("int").alias("side"),
    )
    many = stored(held.join(counts.where(F.col("c") > TILE), "pivot").select("pivot", "k"), "large")
    sets = scanned.where("part IS NULL AND n > 0").join(held.select("k").distinct(), "k", "left_semi")
    sets = stored(sets.groupBy("k", "n", "sig").agg(F.min("doc_id").alias("doc_id")), "signed")
    groups = stored(few, "groups")
    links = _Links(docs.limit(0).select(F.lit(0).cast("long").alias("k"), "text"), sets, size, percent)
    first = stored(links.propose(groups, 1), "pairs")
    # A forest of a region's near pairs names every set that has one, so later rounds name no other.
    wanted = first.select(F.explode(F.array("a", "b")).alias("k")).union(many.select("k"))
    links.texts = stored(_texts_of(docs, wanted, sets, size), "texts")
    tidy(docs.sparkSession)
    links.settle(groups, first)
    if not many.isEmpty():
        for tiles in _grouped_cells(many, sets, links, percent):
            links.settle(tiles)
    dropped(held, many, sets, links.texts)
    return rows.join(links.label.withColumnRenamed("v", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))

def jaccard_components(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct
    ``size``-word shingles (A-Z lower-cased; a shorter text is one shingle as a whole).
    ``component_id`` is the least doc_id reachable. Null and blank texts have the empty set and
    link with nothing. A row without doc_id has the least id of its component, NULL if
    there is none. Equal sets are linked; repeated rows each give their row. An empty table gives
    no rows. Other columns are ignored.
    """
    named = _named(documents, size, percent)
    # The empty set (n = 0) has no component; rows of one component share their least id.
    least = named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "label", "left")
    own = F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``documents``, all columns, of which one stays for each component: that of least doc_id.

    A row without doc_id comes after all others; of rows that share a doc_id the least hash of the text
    stays, of equal rows one. Texts without words are linked with nothing and all stay. Columns
    named ``__id``, ``__t``, ``__stays`` or ``__turn`` are dropped.
    """
    docs = documents.drop("__id", "__t", "__stays", "__turn")
    named = _named(docs, size, percent).withColumn("__id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    own = F.struct("__id", "t")
    first = named.where("n > 0").groupBy("label").agg(F.min(own).alias("first"))
    flags = named.join(first, "label", "left").select(
        "__id", F.coalesce("t", F.lit(0)).alias("__t"), F.when(F.col("n") == 0, 2).when(own == F.col("first"), 1).otherwise(0).alias("__stays")
    ).distinct()
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    keyed = keyed.withColumn("__t", F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)))
    out = keyed.join(flags.where("__stays > 0"), ["__id", "__t"])
    # The join has brought equal rows together.
    turn = F.row_number().over(Window.partitionBy("__id", "__t").orderBy("__id"))
    out = out.withColumn("__turn", turn).where((F.col("__stays") == 2) | (F.col("__turn") == 1))
    return out.select(*docs.columns)
