"""Approximate nearest neighbours: few stable projections, a kd-tree over them, and a chi-square stopping test.

The squared projected distance of two vectors, divided by their squared distance, is chi-square distributed
with one degree of freedom per projection. Neighbours are verified by growing projected distance until the next
one is so far that a nearer vector would hide behind it with a chance of ``1 - certainty`` only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechcurate.session import materialise, ship_package

DIMS = 32
LEAF_ROWS = 1024
FIRST_STEP = 32  # rows that are verified before the bound is looked at again; doubled every time
CERTAINTY = 0.92  # recall and share of verified rows at this value: README
CELL_ROWS = 8192
MAX_DEPTH = 12
SAMPLE_ROWS = 65_536


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square <= x) = p for an even number of degrees of freedom, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term = total = 1.0
        for k in range(1, dims // 2):
            term *= x / 2 / k
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return low


@dataclass
class Tree:
    """A kd-tree with ``2 ** depth`` leaves and the boxes of its leaves; the outer boxes reach to infinity."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int
    low: np.ndarray
    high: np.ndarray

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.axis[at]] >= self.cut[at])
        return at - (2**self.depth - 1)

    def box_distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to every leaf's box."""
        gap = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        return np.einsum("ij,ij->i", gap, gap)


def build_tree(points: np.ndarray, depth: int) -> Tree:
    """Split at the median of the widest axis, ``depth`` times."""
    inner = 2**depth - 1
    axis, cut = np.zeros(inner, np.int64), np.zeros(inner)
    low, high = np.full((2 * inner + 1, points.shape[1]), -np.inf), np.full((2 * inner + 1, points.shape[1]), np.inf)
    members = {0: np.arange(len(points))}
    for node in range(inner):
        rows = members.pop(node)
        own = points[rows]
        if len(own):
            axis[node] = int(np.argmax(own.max(0) - own.min(0)))
            cut[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] >= cut[node]
        for child, part in ((2 * node + 1, rows[~right]), (2 * node + 2, rows[right])):
            members[child] = part
            low[child], high[child] = low[node], high[node]
        high[2 * node + 1][axis[node]] = low[2 * node + 2][axis[node]] = cut[node]
    return Tree(axis, cut, depth, low[inner:], high[inner:])


def project(vectors: np.ndarray, seed: int, dims: int = DIMS) -> np.ndarray:
    """Gaussian projections of the vectors, scaled to length 1."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    return unit @ np.random.default_rng(seed).standard_normal((vectors.shape[1], dims))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * math.sqrt((query * query).sum()))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(np.float64).reshape(-1, dims)


def _search(vectors: np.ndarray, ids: list[list[int]], points: np.ndarray, query: np.ndarray, point: np.ndarray, bound: float, k: int,
            limit: float, tree: Tree, order: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[float, int]], int]:
    """The ``k`` best (score, id) of one cell and how many rows were verified.

    Leaves come by the distance of their boxes, the rows of a leaf by their own projected distance, in steps
    of growing size; the stopping test ends a leaf, and the cell when the next box fails it.
    """
    best: list[tuple[float, int]] = []
    verified = 0
    away = tree.box_distances(point)
    for leaf in np.argsort(away, kind="stable"):
        if away[leaf] > limit * bound:
            break
        members = order[starts[leaf] : starts[leaf + 1]]
        gap = points[members] - point
        distance = np.einsum("ij,ij->i", gap, gap)
        near = np.flatnonzero(distance <= limit * bound)
        near = near[np.argsort(distance[near], kind="stable")]
        at, step = 0, FIRST_STEP
        while at < len(near) and distance[near[at]] <= limit * bound:
            stop = at + int(np.searchsorted(distance[near[at : at + step]], limit * bound, "right"))
            rows = members[near[at:stop]]
            at, step, verified = stop, 2 * step, verified + len(rows)
            score = cosines(vectors[rows], query)
            if len(best) >= k:
                better = score >= best[-1][0]
                rows, score = rows[better], score[better]
            best = sorted(best + [(float(s), i) for s, r in zip(score, rows) for i in ids[r]], key=lambda x: (-x[0], x[1]))[:k]
            if len(best) >= k:
                bound = min(bound, max(2 - 2 * best[-1][0], 0.0))
    return best, verified


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
                       certainty: float = CERTAINTY, cell_rows: int = CELL_ROWS, seed: int = 42) -> DataFrame:
    """``query_id, rank, vec_id, score, verified``: the ``k`` nearest found by cosine for every row of ``is_query``.

    ``verified`` is the number of vectors that its own was compared with.

    The projected space is cut into cells by a kd-tree that is fitted on at most ``SAMPLE_ROWS`` rows
    (those of the smallest hashed ids); every row is indexed. A cell with too many rows is dealt into parts. A query
    first searches a part of its own cell, which bounds the distance of its k-th neighbour, then every cell that the
    stopping test doesn't rule out. Equal vectors are searched once, with their ``k + 1`` smallest ids:
    no further copy can be among the nearest.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    without id. Of several rows with the same id the smallest vector counts. Vectors of different
    lengths are no neighbours. Ties go to the smaller id. A query without candidates has no row.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _valid(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = materialise(rows, "vectors")
    lowest = rows.select("v", "vec_id").withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    distinct = lowest.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def projected(batches):
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            out = np.zeros((len(sizes), DIMS))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                out[at] = project(_matrix(batch.column(0).take(pa.array(at)), int(size)), seed)
            points = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * DIMS), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), points], ["v", "ids", "p"])

    data = materialise(distinct.mapInArrow(projected, "v array<double>, ids array<long>, p array<double>"), "projected")
    count = data.count()
    sample = data.select("p", F.element_at("ids", 1).alias("i")).orderBy(F.xxhash64("i"), "i").limit(SAMPLE_ROWS).select("p").toArrow()
    depth = min(max(math.ceil(math.log2(max(count, 1) / cell_rows)), 0), MAX_DEPTH)
    tree = build_tree(_matrix(sample["p"], DIMS), depth)
    limit = chi_square_quantile(certainty, DIMS)

    def cell_of(points):
        return pa.array(tree.leaf_of(_matrix(points, DIMS)).astype(np.int32))

    cell_of.__annotations__ = {"points": pa.Array, "return": pa.Array}
    data = data.withColumn("cell", F.arrow_udf(cell_of, "int")("p"))
    sizes = {r["cell"]: r["n"] for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most 2 ** MAX_DEPTH rows
    parts = F.array(*[F.lit(max(1, round(sizes.get(c, 0) / cell_rows))) for c in range(2**depth)])
    own_part = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.element_at(parts, F.col("cell") + 1)).cast("int")
    data = materialise(data.withColumn("part", own_part), "cells")

    asked = rows.filter("q").select(F.col("vec_id").alias("query_id"), "v")
    # A distinct query vector is named by the smallest id that has it.
    vectors = data.join(asked.groupBy("v").agg(F.count("*").alias("n")), "v").select(F.element_at("ids", 1).alias("name"), "v", "p", "cell", "part")
    vectors = materialise(vectors.withColumn("block", F.shiftright("cell", 8).cast("long") * 1_000_003 + F.col("part")), "queries")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names, found, scores, compared = [], [], [], []
        for size in set(pa.compute.list_value_length(right["v"]).to_pylist()):
            own = left.filter(pa.compute.equal(pa.compute.list_value_length(left["v"]), size))
            if not own.num_rows:
                continue
            vectors, points = _matrix(own["v"], size), _matrix(own["p"], DIMS)
            ids = own["ids"].to_pylist()
            local = build_tree(points, max(math.ceil(math.log2(len(points) / LEAF_ROWS)), 0))
            leaf = local.leaf_of(points)
            order = np.argsort(leaf, kind="stable")
            starts = np.searchsorted(leaf[order], np.arange(2**local.depth + 1))
            some = right.filter(pa.compute.equal(pa.compute.list_value_length(right["v"]), size))
            queries, at = _matrix(some["v"], size), _matrix(some["p"], DIMS)
            for name, q, p, bound in zip(some["name"].to_pylist(), queries, at, some["bound"].to_pylist()):
                best, verified = _search(vectors, ids, points, q, p, bound, k + 1, limit, local, order, starts)
                # One more row without a neighbour holds the count.
                for score, i, n in [(None, None, verified), *((*b, 0) for b in best)]:
                    names.append(name), found.append(i), scores.append(score), compared.append(n)
        return pa.table({"name": pa.array(names, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64()), "verified": pa.array(compared, pa.int64())})

    # Annotations are strings here, and Spark reads them to tell the forms of a function apart.
    search.__annotations__ = {"left": pa.Table, "right": pa.Table, "return": pa.Table}
    out = "name long, vec_id long, score double, verified long"

    def meet(routed: DataFrame) -> DataFrame:
        """Search the parts of cells with the queries routed to them, a block of queries at a time."""
        routed = materialise(routed, "routes")
        pairs = routed.select("cell", "part", F.col("block").alias("to")).distinct()
        sent = data.join(pairs, ["cell", "part"]).select("v", "ids", "p", "cell", "part", F.col("to").alias("block"))
        keys = ["cell", "part", "block"]
        return sent.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(search, out)

    best = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    first = meet(vectors.withColumn("bound", F.lit(float("inf"))).select("name", "v", "p", "cell", "part", "block", "bound"))
    first = first.filter("vec_id IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    bounds = first.select("name", F.when(F.col("n") > k, F.greatest(2 - 2 * F.col("worst"), F.lit(0.0))).otherwise(float("inf")).alias("bound"))
    bounded = vectors.drop("cell", "part").join(bounds, "name", "left").fillna(float("inf"), ["bound"])

    def reached(points, bound):
        b = bound.to_numpy(zero_copy_only=False)
        return pa.array([np.flatnonzero(tree.box_distances(p) <= limit * x).astype(np.int32) for p, x in zip(_matrix(points, DIMS), b)], pa.list_(pa.int32()))

    reached.__annotations__ = {"points": pa.Array, "bound": pa.Array, "return": pa.Array}
    routed = bounded.withColumn("cell", F.explode(F.arrow_udf(reached, "array<int>")("p", "bound")))
    routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("cell") + 1) - 1)))
    nearest = meet(routed.select("name", "v", "p", "cell", "part", "block", "bound"))
    nearest = nearest.withColumn("verified", F.sum("verified").over(Window.partitionBy("name"))).filter("vec_id IS NOT NULL")
    nearest = nearest.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    # Each query takes its vector's list without itself; a vector has k + 1 entries, so the side that repeats is small per name.
    named = asked.join(vectors.select("v", "name"), "v").select("query_id", "name")
    pairs = named.join(nearest, "name").filter("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
