"""Links between vectors with a cosine of at least LEAST, found through an inverted multi-index.

Equal vectors are one class, which one of them stands for.  The halves of the unit vectors have
codebooks of K centroids of their own, so that K + K centroids make a grid of K x K cells; K follows
the square root of the number of classes.  Every class is in the cell of its nearest centroids.

A class visits cells in the order of the sum of its halves' squared distances from their centroids,
as the multi-sequence algorithm takes them from two sorted lists: a cell that is a-th in one list and b-th in
the other has a * b - 1 cells before it, so the first T are all among those with a * b <= T, and one sort of these
gives a batch of vectors their sequences.  How many cells to visit is measured: for pairs of a
sampled vector and a random one at the threshold itself, the hardest to find, the places of their cells in each
other's sequence are counted, and T is the least number that finds the share TARGET of them from
either side.  Pairs closer than the threshold are found more often.

Visitors meet the residents of a cell in groups by first centroid and a block of second ones.  Groups are
counted before, and those with more than CHUNK residents or visitors are dealt to several units, each part of the
ones to each part of the others.  A unit multiplies matrices and sends, for each vector, the number of
its links and one edge to the least vector of its component in the unit, never pairs.  A pair
that both sides can find is counted where the smaller visits.

Bounds: the codebooks and T are fitted on SAMPLE vectors at most, taken by a hash; K is at most
MOST_CENTROIDS.  Every vector is indexed, visits and is verified in double precision.

Defined results: a vector that is null, empty, zero or has a null or non-finite component links with
nothing, and neither do vectors of different dimensions, each of which has an index of its own.  Rows with
equal vectors link with each other; so do rows with equal vec_id and different vectors, if they are similar.  A null vec_id comes
after all others (and 2^63 - 1 counts as one).  An empty table gives an empty result.  Columns besides vec_id and embedding are not
read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import checkpoint, written
from storyloom.operators.graph import components

LEAST = 0.95
TARGET = 0.99
SAMPLE = 20_000
PROBED = 1500
MOST_CENTROIDS = 4096
#: Classes in a cell on average.
OCCUPANCY = 16
CHUNK = 8192
ROUNDS = 8
#: Visitors that meet a cell in one matrix product.
SLICE = 1024
LAST = (1 << 63) - 1


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, without overflow."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points from all centroids."""
    return np.maximum((points * points).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * points @ centroids.T, 0)


def codebook(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds; all differ."""
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centroids = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        own = squared(points, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        count = np.bincount(own, minlength=k)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return np.unique(centroids, axis=0)


class Grid:
    """Two codebooks and the number of cells that a vector visits."""

    def __init__(self, left: np.ndarray, right: np.ndarray, visits: int = 1):
        self.left, self.right, self.half = left, right, left.shape[1]
        self.visits = visits

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(vectors[:, : self.half], self.left), squared(vectors[:, self.half :], self.right)

    def sequence(self, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first centroids, second centroids, sums) of the nearest cells of each vector, nearest first, and the sum up to which it visits.

        That bound is in the widest gap of the last few visits, so rounding does not decide who visits.
        """
        most = min(self.visits + 1, d1.shape[1] * d2.shape[1])
        a = np.arange(min(most, d1.shape[1]))
        width = np.minimum(most // (a + 1), d2.shape[1])
        first = np.repeat(a, width)
        second = np.arange(len(first)) - np.repeat(np.cumsum(width) - width, width)
        by1, by2 = np.argsort(d1, axis=1)[:, : len(a)], np.argsort(d2, axis=1)[:, : int(width.max())]
        sums = np.take_along_axis(d1, by1, 1)[:, first] + np.take_along_axis(d2, by2, 1)[:, second]
        order = np.argsort(sums, axis=1, kind="stable")[:, :most]
        sums = np.take_along_axis(sums, order, 1)
        c1, c2 = by1[np.arange(len(d1))[:, None], first[order]], by2[np.arange(len(d1))[:, None], second[order]]
        if most <= self.visits:  # every cell
            return c1, c2, sums, np.full(len(d1), np.inf)
        few = min(8, most - 1)
        gaps = np.diff(sums[:, -few - 1 :], axis=1)
        at = gaps.argmax(axis=1) + most - few - 1
        rows = np.arange(len(d1))
        return c1, c2, sums, (sums[rows, at] + sums[rows, at + 1]) / 2

    def ranks(self, d1: np.ndarray, d2: np.ndarray, cells: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How many cells come before this one in each vector's sequence."""
        rows = np.arange(len(d1))
        own = d1[rows, cells[0]] + d2[rows, cells[1]]
        second = np.sort(d2, axis=1)
        return np.array([int(np.searchsorted(second[i], own[i] - d1[i], "left").sum()) for i in rows])


def fitted(sample: np.ndarray, count: int, least: float = LEAST, target: float = TARGET, seed: int = 0) -> Grid:
    """A grid for so many classes, from some of them (unit vectors)."""
    rng = np.random.default_rng(seed)
    k = min(MOST_CENTROIDS, max(1, math.ceil(math.sqrt(count / OCCUPANCY))))
    half = sample.shape[1] // 2
    grid = Grid(codebook(sample[:, :half], k, rng), codebook(sample[:, half:], k, rng))
    some = sample[rng.choice(len(sample), min(PROBED, len(sample)), replace=False)]
    away = rng.standard_normal(some.shape)
    away -= (away * some).sum(axis=1, keepdims=True) * some
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    away = np.divide(away, length, out=np.zeros_like(away), where=length > 1e-9)
    other = least * some + math.sqrt(1 - least * least) * away
    mine, theirs = grid.distances(some), grid.distances(other)
    cell = lambda d: (d[0].argmin(axis=1), d[1].argmin(axis=1))
    ranks = np.minimum(grid.ranks(*mine, cell(theirs)), grid.ranks(*theirs, cell(mine)))
    grid.visits = int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) + 1 + 8
    return grid


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _placed(classes: DataFrame, grid: Grid, dim: int) -> DataFrame:
    """Classes with their cell and the sum up to which they visit."""
    spark = classes.sparkSession
    told = spark.sparkContext.broadcast(grid)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                unit = units(matrix(part.column(3), dim))
                c1, c2, _, bound = told.value.sequence(*told.value.distances(unit))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(c1[:, 0], pa.int32()), pa.array(c2[:, 0], pa.int32()), pa.array(bound), pa.array([u.tobytes() for u in unit], pa.binary())], ["id", "key", "copies", "c1", "c2", "bound", "unit"])

    return classes.select("id", "key", "copies", "embedding").mapInArrow(run, "id long, key long, copies long, c1 int, c2 int, bound double, unit binary")


def _visitors(placed: DataFrame, grid: Grid, blocks: np.ndarray) -> DataFrame:
    """(id, key, c1, block) of the groups of cells that each class visits."""
    told = placed.sparkSession.sparkContext.broadcast((grid, blocks))

    def run(batches):
        grid, blocks = told.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                unit = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(part.num_rows, -1)
                c1, c2, sums, _ = grid.sequence(*grid.distances(unit))
                row, place = np.nonzero(sums <= part.column(2).to_numpy()[:, None])
                first = c1[row, place]
                block = c2[row, place] % blocks[first]
                found = np.unique(np.stack([row, first, block], axis=1), axis=0)
                take = pa.array(found[:, 0])
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(found[:, 1], pa.int32()), pa.array(found[:, 2], pa.int32())], ["id", "key", "group1", "block"])

    return placed.select("id", "key", "bound", "unit").mapInArrow(run, "id long, key long, group1 int, block int")


def linked(visitor: dict[str, np.ndarray], resident: dict[str, np.ndarray], grid: Grid, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, its links, least node of its component) of those that have links; nodes are numbers in the order of the vectors.

    visitor and resident: node, copies, c1, c2, bound, unit; all residents have one c1.
    """
    v1, v2 = grid.distances(visitor["unit"])
    own = resident["c1"][0]
    out = []
    for c2 in np.unique(resident["c2"]):
        r = np.flatnonzero(resident["c2"] == c2)
        comes = np.flatnonzero(v1[:, own] + v2[:, c2] <= visitor["bound"])
        if not len(comes):
            continue
        r1, r2 = grid.distances(resident["unit"][r])
        for at in range(0, len(comes), SLICE):
            v = comes[at : at + SLICE]
            near = visitor["unit"][v] @ resident["unit"][r].T >= least
            if not near.any():
                continue
            # Whether the resident visits the visitor, too: then the smaller of the two counts the pair.
            back = r1[:, visitor["c1"][v]].T + r2[:, visitor["c2"][v]].T <= resident["bound"][r]
            mine, theirs = visitor["node"][v], resident["node"][r]
            near &= np.where(back, mine[:, None] < theirs, mine[:, None] != theirs)
            rows, columns = near.any(axis=1), near.any(axis=0)
            near, v_, r_ = near[np.ix_(rows, columns)], v[rows], r[columns]
            if not near.size:
                continue
            mine, theirs = mine[rows], theirs[columns]
            label, before = theirs.copy(), None
            while before is None or (label != before).any():
                before = label
                seen = np.minimum(mine, np.where(near, label, LAST).min(axis=1))
                label = np.minimum(label, np.where(near, seen[:, None], LAST).min(axis=0))
            seen = np.minimum(mine, np.where(near, label, LAST).min(axis=1))
            out.append((mine, near @ resident["copies"][r_], seen))
            out.append((theirs, visitor["copies"][v_] @ near, label))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _met(dealt: DataFrame, grid: Grid, least: float) -> DataFrame:
    """What the units find: a class, its links there, and the least class that it reaches there."""
    told = dealt.sparkSession.sparkContext.broadcast(grid)

    def run(table):
        visits = table.column("visits").to_numpy(zero_copy_only=False)
        ids, keys = table.column("id").to_numpy(), table.column("key").to_numpy()
        order = np.lexsort([keys, ids])
        new = np.ones(len(order), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        place = order[new]
        columns = {n: table.column(n).to_numpy() for n in ("copies", "c1", "c2", "bound")} | {"node": node}
        columns["unit"] = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(table.num_rows, -1)
        visitor, resident = ({n: c[side] for n, c in columns.items()} for side in (visits, ~visits))
        empty = not len(visitor["node"]) or not len(resident["node"])
        found, n, label = (np.zeros(0, np.int64),) * 3 if empty else linked(visitor, resident, told.value, least)
        pair, index = np.unique(np.stack([found, label], axis=1), axis=0, return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, index.ravel(), n)
        a, b = place[pair[:, 0]], place[pair[:, 1]]
        return pa.table({"id": pa.array(ids[a]), "key": pa.array(keys[a]), "n": pa.array(total), "to_id": pa.array(ids[b]), "to_key": pa.array(keys[b])})

    return dealt.groupBy("group1", "block", "part", "vpart").applyInArrow(run, "id long, key long, n long, to_id long, to_key long")


def _found(classes: DataFrame, dim: int, least: float, target: float) -> DataFrame:
    """_met() of the classes of one dimension."""
    count = classes.count()
    sample = classes.select("embedding").orderBy(F.xxhash64("key", F.lit(1)), "key").limit(SAMPLE).toArrow()
    grid = fitted(units(matrix(sample.column(0).combine_chunks(), dim)), count, least, target)
    placed = written(_placed(classes, grid, dim), "multi-index")
    residents = np.zeros(len(grid.left), np.int64)
    for c1, n in placed.groupBy("c1").count().collect():  # MOST_CENTROIDS rows at most
        residents[c1] = n
    blocks = np.maximum(1, -(-residents // CHUNK))
    blocks_of = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("c1") + 1) if len(set(blocks.tolist())) > 1 else F.lit(int(blocks[0]))
    homes = placed.withColumn("group1", F.col("c1")).withColumn("block", (F.col("c2") % blocks_of).cast("int"))
    visits = checkpoint(_visitors(placed, grid, blocks))
    sizes = homes.groupBy("group1", "block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    sizes = checkpoint(sizes.join(visits.groupBy("group1", "block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("vparts")), ["group1", "block"]))
    group = ["group1", "block"]
    cut = lambda n: F.pmod(F.xxhash64("id", "key", F.lit(2)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    columns = [*group, "part", "vpart", "visits", "id", "key", "copies", "c1", "c2", "bound", "unit"]
    mine = homes.join(sizes, group).withColumn("part", cut("parts")).withColumn("vpart", every("vparts")).withColumn("visits", F.lit(False))
    theirs = visits.join(placed, ["id", "key"]).join(sizes, group).withColumn("vpart", cut("vparts")).withColumn("part", every("parts")).withColumn("visits", F.lit(True))
    return written(_met(mine.select(*columns).unionByName(theirs.select(*columns)), grid, least), "multi-index-links")


def links(vectors: DataFrame, least: float = LEAST, target: float = TARGET) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    item = F.col("embedding")
    fits = item.isNotNull() & (F.size(item) > 0) & F.forall(item, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(item, lambda x: x != 0)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("id"), "embedding", F.coalesce(fits, F.lit(False)).alias("fits"))
    rows = rows.withColumn("key", F.xxhash64("embedding")).withColumn("check", F.xxhash64(F.lit(1), "embedding"))
    classes = written(rows.where("fits").groupBy("embedding", "key", "check").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding")), "vector-classes")
    found = None
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():
        got = _found(classes.where(F.col("dim") == dim), dim, least, target)
        found = got if found is None else found.unionByName(got)
    node = lambda i, k: F.struct(F.col(i).alias("id"), F.col(k).alias("key"))
    real = F.when(F.col("id") != LAST, F.col("id")).alias("vec_id")
    alone = rows.where(~F.col("fits")).select(real, F.lit(0).cast("long").alias("n_links"), real.alias("component_id"))
    if found is not None:
        counts = found.groupBy("id", "key").agg(F.sum("n").alias("n"))
        labels = components(found.select(node("id", "key").alias("a"), node("to_id", "to_key").alias("b")).where("a <> b").distinct())
        labels = labels.select(F.col("node.id").alias("id"), F.col("node.key").alias("key"), F.col("label.id").alias("least"))
        known = classes.select("id", "key", "check", "copies").join(counts, ["id", "key"], "left").join(labels, ["id", "key"], "left")
        known = known.select("key", "check", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "id").alias("least"))
        full = rows.where("fits").select("id", "key", "check").join(known, ["key", "check"])
        alone = alone.unionByName(full.select(real, "n_links", F.when(F.col("least") != LAST, F.col("least")).alias("component_id")))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
