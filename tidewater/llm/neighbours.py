"""Approximate nearest neighbours by stable projections and a kd-tree.

Inner products become distances by one more component per vector, sqrt(M^2 - |v|^2) with M the longest length (0 for
queries); distances are then projected with DIMENSIONS Gaussian (2-stable) directions. For a pair at distance d the
squared projected distance over d^2 is chi-square distributed with as many degrees of freedom, so once a query's k-th
best distance is d_k, points whose squared projected distance exceeds d_k^2 times the chi-square quantile of CONFIDENCE
can be left out: each true neighbour is then found with at least that probability.

A kd-tree fitted to a sample of at most SAMPLE projections cuts the points into cells; every point is indexed in one.
The sample also gives each query a first d_k. A query visits cells in the order of their distance, in rounds: the nearest
first, then ever more of the next, each round with the d_k that the rounds before have found, until the next cell lies
beyond its radius. In a cell, a task splits the points further, visits each query's leaves in order of distance, verifies
points within the radius on the original vectors, tightens d_k after each leaf and stops when the next leaf lies beyond the
radius. A cell's points are copied only for every BLOCK queries that visit it. Equal vectors are one point with their
k + 1 smallest ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import Scratch, read_table

DIMENSIONS = 8
CONFIDENCE = 0.97
#: Projections that the tree is fitted to, and those of them whose vectors give the first d_k.
SAMPLE, PROBES = 65_536, 2048
#: Points in a cell and in a leaf, queries in a block.
CELL, LEAF, BLOCK = 4096, 256, 8192
#: Cells that a query visits in its first round, and how many times more in each round after it.
VISITS, GROWTH = 1, 8


def chi_square_quantile(p: float, m: int) -> float:
    """For an even number of degrees of freedom, where the distribution function is a finite sum."""
    if m % 2:
        raise ValueError("the number of projections must be even")

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def split(points: np.ndarray, size: int) -> list[tuple]:
    """A kd-tree over points: nodes (axis, cut, left, right), leaves (-1, leaf number, 0, 0); the widest axis is cut at
    its median until a leaf has at most `size` points or they can't be parted."""
    nodes, leaves = [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        own = len(nodes)
        nodes.append(None)
        if len(rows) > size:
            spread = points[rows].max(axis=0) - points[rows].min(axis=0)
            axis = int(spread.argmax())
            values = points[rows, axis]
            cut = float(np.median(values))
            right = values >= cut
            if spread[axis] > 0 and right.any() and not right.all():
                nodes[own] = (axis, cut, grow(rows[~right]), grow(rows[right]))
                return own
        nodes[own] = (-1, leaves, 0, 0)
        leaves += 1
        return own

    grow(np.arange(len(points)))
    return nodes


def place(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    """Leaf number of each point."""
    out, todo = np.empty(len(points), np.int64), [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        axis, cut, left, right = nodes[at]
        if axis < 0:
            out[rows] = cut
        elif len(rows):
            high = points[rows, axis] >= cut
            todo += [(left, rows[~high]), (right, rows[high])]
    return out


def leaf_distances(nodes: list[tuple], points: np.ndarray, leaves: int) -> np.ndarray:
    """Squared distance from each point to each leaf's box (bounded by the cuts only)."""
    out = np.zeros((len(points), leaves))

    def walk(at: int, gap: np.ndarray) -> None:
        axis, cut, left, right = nodes[at]
        if axis < 0:
            out[:, cut] = (gap**2).sum(axis=1)
            return
        over = points[:, axis] - cut
        for child, distance in ((left, np.maximum(over, 0)), (right, np.maximum(-over, 0))):
            own = gap.copy()
            own[:, axis] = np.maximum(own[:, axis], distance)
            walk(child, own)

    walk(0, np.zeros(points.shape))
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest of each row, in no order (all, if there are fewer)."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


class Space:
    """The projection and what it needs: dimension, M and the directions."""

    def __init__(self, dim: int, longest: float, m: int, seed: int = 11):
        self.dim, self.longest = dim, longest
        self.directions = np.random.default_rng(seed).normal(size=(dim + 1, m))

    def points(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (v**2).sum(axis=1), 0))
        return v @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def queries(self, v: np.ndarray) -> np.ndarray:
        return v @ self.directions[:-1]

    def squared(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Squared distances of queries with squared lengths to points with inner products."""
        return np.maximum(lengths + self.longest**2 - 2 * scores, 0)


def search_cell(space: Space, vectors, q, bound, k: int, reach: float):
    """(query, point, score) arrays: each query's k best points of a cell among those within its radius; and the number of
    points verified, over all queries."""
    points, own = space.points(vectors), space.queries(q)
    lengths = (q**2).sum(axis=1)
    tree = split(points, LEAF)
    leaf = place(tree, points)
    n = int(leaf.max()) + 1
    members = [np.flatnonzero(leaf == i) for i in range(n)]
    gap = leaf_distances(tree, own, n)
    order = np.argsort(gap, axis=1)
    top = np.full((len(q), k), -np.inf)
    at = np.full((len(q), k), -1)
    alive, verified = np.arange(len(q)), 0
    for turn in range(n):
        radius = space.squared(np.maximum(top.min(axis=1), bound), lengths) * reach
        alive = alive[gap[alive, order[alive, turn]] <= radius[alive]]
        if not len(alive):
            break
        now = order[alive, turn]
        for i in np.unique(now):
            rows, ps = alive[now == i], members[i]
            # The projected distances say which points to verify on the original vectors.
            near = ((own[rows] ** 2).sum(axis=1)[:, None] + (points[ps] ** 2).sum(axis=1)[None, :] - 2 * own[rows] @ points[ps].T) <= radius[rows][:, None]
            verified += int(near.sum())
            scores = np.where(near, q[rows] @ vectors[ps].T, -np.inf)
            scores = np.concatenate([top[rows], scores], axis=1)
            where = np.concatenate([at[rows], np.broadcast_to(ps, (len(rows), len(ps)))], axis=1)
            keep = best(scores, k)
            top[rows], at[rows] = np.take_along_axis(scores, keep, 1), np.take_along_axis(where, keep, 1)
    row, column = np.nonzero((at >= 0) & (top >= bound[:, None] - 1e-9))
    point = at[row, column]
    return row, point, (q[row] * vectors[point]).sum(axis=1), verified


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: F.coalesce(x == x, F.lit(False)) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine).select(F.col(id_col).alias("id"), v.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", m: int = DIMENSIONS,
            confidence: float = CONFIDENCE, stats: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of base with the largest inner products found for each row of queries,
    in double precision, without the row of the query's own id.

    Ids are whole numbers, and unique in each table (a repeated id competes with its repeats). Vectors that are null,
    all zero or hold null or non-finite components take no part, nor do rows with a null id or vectors of another
    length than most of base have. stats: gets the number of rounds and the share of all pairs of a query and a point that
    were verified. Ties go to the smaller id. A query gets fewer rows if there are fewer candidates; an empty side gives an empty
    result. Other columns are ignored."""
    spark = base.sparkSession
    scratch = Scratch(spark, "neighbours")
    base, queries = _valid(base, id_col, vector_col), _valid(queries, id_col, vector_col)
    common = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dim = common.n
    # Equal vectors meet in groups of k + 1 ids at most; tasks keep no more of a group before it is shuffled.
    ranked = base.where(F.size("v") == dim).withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    points = scratch.keep(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("point", F.xxhash64("ids")), "points")
    asked = scratch.keep(queries.where(F.size("v") == dim), "asked")
    one = scratch.keep(asked.groupBy("v").agg(F.min("id").alias("query")), "queries")
    n, longest2 = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    n_queries = one.count()
    if not n_queries:
        return empty
    space, reach = Space(dim, math.sqrt(longest2) * (1 + 1e-12), m), chi_square_quantile(confidence, m)
    sample = points.select("v", "point", F.size("ids").alias("c")).orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    vectors = _matrix(sample["v"].combine_chunks(), dim)
    cells = split(space.points(vectors), max(1, int(CELL * len(vectors) / max(n, len(vectors)))))
    n_cells = sum(x[0] < 0 for x in cells)
    sent = spark.sparkContext.broadcast((space, cells, n_cells, vectors[:PROBES], sample["c"].to_numpy()[:PROBES], sample["point"].to_numpy()[:PROBES]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, cells = sent.value[:2]
        for batch in batches:
            if batch.num_rows:
                cell = place(cells, space.points(_matrix(batch["v"], dim)))
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch["point"], batch["v"]], names=["cell", "key", "v"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's first d_k, and the cells within its radius in order of distance."""
        space, cells, n_cells, probes, copies, _ = sent.value
        step = max(1, min(1024, (1 << 22) // n_cells))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            q = _matrix(batch["v"], dim)
            scores = q @ probes.T
            # The k-th best of the sample, copies counted, with one to spare for the query itself.
            order = np.argsort(-scores, axis=1)
            enough = np.argmax(np.cumsum(copies[order], axis=1) >= k + 1, axis=1)
            bound = np.where(copies.sum() >= k + 1, scores[np.arange(len(q)), order[np.arange(len(q)), enough]], -np.inf)
            lengths = (q**2).sum(axis=1)
            gap = leaf_distances(cells, space.queries(q), n_cells)
            near = np.argsort(gap, axis=1, kind="stable")
            gap = np.take_along_axis(gap, near, 1)
            inside = (gap <= (space.squared(bound, lengths) * reach)[:, None]).sum(axis=1)
            pick = np.arange(n_cells)[None, :] < inside[:, None]
            ends = pa.array(np.concatenate(([0], np.cumsum(inside))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["query"], batch["v"], pa.array(lengths), pa.array(bound), pa.ListArray.from_arrays(ends, pa.array(near[pick])), pa.ListArray.from_arrays(ends, pa.array(gap[pick]))],
                                             names=["query", "v", "length", "bound", "cells", "gaps"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, _, names = sent.value[3:]
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            q = _matrix(batch["v"], dim)
            at = best(q @ probes.T, k + 1)
            row = np.repeat(np.arange(len(q)), at.shape[1])
            yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(row)), pa.array(names[at.ravel()]), pa.array((q[row] * probes[at.ravel()]).sum(axis=1))],
                                             names=["query", "point", "score"])

    def search(key: tuple, group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        keys, v, bound = group["key"].to_numpy(), _matrix(group["v"].combine_chunks(), dim), group["bound"].to_numpy()
        p, q = side == 0, side == 1
        if not p.any() or not q.any():
            return pa.table({"query": pa.array([], pa.int64()), "point": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "verified": pa.array([], pa.int64())})
        row, point, score, verified = search_cell(sent.value[0], v[p], v[q], bound[q], k + 1, reach)
        # One row more counts the points verified.
        return pa.table({"query": pa.array([*keys[q][row], None], pa.int64()), "point": pa.array([*keys[p][point], None], pa.int64()), "score": pa.array([*score, None], pa.float64()),
                         "verified": pa.array([None] * len(row) + [verified], pa.int64())})

    indexed = scratch.keep(points.mapInArrow(index, "cell long, key long, v array<double>"), "indexed")
    waiting = scratch.keep(one.mapInArrow(route, "query long, v array<double>, length double, bound double, cells array<long>, gaps array<double>").withColumn("at", F.lit(0)), "waiting")
    # The sample's best are verified too, so that a query has k rows if there are k candidates at all.
    top = scratch.keep(one.mapInArrow(probe, "query long, point long, score double"), "top")
    ranked = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "point"))
    visits, verified, rounds = VISITS, 0, 0
    while True:
        radius = F.greatest(F.col("length") + F.lit(space.longest**2) - 2 * F.col("bound"), F.lit(0.0)) * F.lit(reach)
        waiting = waiting.withColumn("now", F.filter(F.slice("cells", F.col("at") + 1, F.lit(visits)), lambda c, i: F.get("gaps", F.col("at") + i) <= radius)).where(F.size("now") > 0)
        asked_now = scratch.keep(waiting, "asking")
        going = asked_now.select(F.explode("now").alias("cell"), F.col("query").alias("key"), "v", "bound")
        # As many copies of a cell's points as blocks of queries visit it; there are at most SAMPLE cells.
        blocks = scratch.keep(going.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
        if blocks.isEmpty():
            break
        side = indexed.join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "key", "v", F.lit(0.0).alias("bound"))
        going = going.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), "key", "v", "bound")
        # A group is a cell's points, about CELL of them, and a block of queries.
        found = scratch.keep(side.unionByName(going).groupBy("cell", "block").applyInArrow(search, "query long, point long, score double, verified long"), "found")
        if stats is not None:
            verified += found.agg(F.sum("verified")).first()[0] or 0
        both = top.unionByName(found.where("query is not null").drop("verified")).groupBy("query", "point").agg(F.max("score").alias("score"))
        new = scratch.keep(both.withColumn("r", ranked).where(F.col("r") <= k + 1).drop("r"), "top")
        tight = new.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("d"))
        left = asked_now.withColumn("at", F.col("at") + visits).where(F.size("cells") > F.col("at")).join(tight, "query", "left")
        waiting_now = scratch.keep(left.select("query", "v", "length", F.greatest("bound", F.coalesce("d", "bound")).alias("bound"), "cells", "gaps", "at"), "waiting")
        scratch.drop(asked_now, blocks, found, top)
        waiting, top, visits, rounds = waiting_now, new, visits * GROWTH, rounds + 1
    if stats is not None:
        stats |= {"rounds": rounds, "verified": verified / max(1, n * n_queries)}
    pairs = top.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = pairs.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = scratch.keep(pairs.groupBy("query").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found")), "found")
    of = asked.join(one, "v").select(F.col("id").alias("query_id"), "query").join(lists, "query")
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return of.select("query_id", F.posexplode(own).alias("i", "x")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
