"""Exact density clustering on blocks of bounded size behind a spatial index.

Rows are projected on the leading principal components of a sample, numbered by the leaves of a
kd-tree and cut into blocks. A projection never enlarges a distance, so only blocks whose boxes lie within eps
can hold a pair; a grid of several levels finds them by equality of cells, without a table of
all pairs of blocks. A meeting counts neighbours in a first pass and, once core points are known, gives a
spanning forest of its core points in a second one. The forests of a task are merged before they are written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from speechcurate.functions.text import sample_digest
from speechcurate.operators.blocks import BLOCK_ROWS, block_size, flat_numbers, matrix, packed_type, squared_slices, task_width
from speechcurate.operators.components import connected_components
from speechcurate.operators.ordering import dense_numbers, with_row_idx
from speechcurate.session import join_on, materialise, ship_package

AXES = 8  # leading components whose boxes bound the distance of two blocks
SAMPLE = 8_192  # rows that the components and the tree are fitted on; every row is placed
MERGED = 1_000_000  # edges that a task gathers before it merges them
SQUARE_BYTES = 32 << 20  # vectors, as doubles, of the blocks on one side of a square of meetings
# Pairs this close to eps, relative to their norms, are measured again by difference.
RECHECK = 1e-9


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of a lie within eps of which rows of b."""
    near = np.empty((len(a), len(b)), dtype=bool)
    for start, squared, norms in squared_slices(a, b):
        hit = squared <= eps * eps
        rows, cols = np.nonzero(np.abs(squared - eps * eps) <= RECHECK * norms)
        if len(rows):
            gap = a[start + rows] - b[cols]
            hit[rows, cols] = np.sqrt(np.einsum("ij,ij->i", gap, gap)) <= eps
        near[start:start + len(squared)] = hit
    return near


def _met_blocks(square: pa.Table) -> Iterator[tuple[tuple, tuple, bool]]:
    """The pairs of blocks of a square that meet, each block as (number, ids, core, vectors), and whether it meets itself.

    Only the vectors of the two blocks are spread to doubles at a time. A block whose rows have all gone is absent.
    """
    at = {block: k for k, block in enumerate(square["_block"].to_pylist())}

    def block(k: int) -> tuple:
        ids, core, vectors = (square[c][k].values.to_numpy(zero_copy_only=False) for c in ("ids", "core", "vec"))
        return square["_block"][k].as_py(), ids, core, vectors.astype(np.float64).reshape(len(ids), -1)

    for i, partners in zip(list(at), square["_with"].to_pylist()):
        left = block(at[i]) if partners else None
        for j in partners:
            if j in at:
                yield left, left if i == j else block(at[j]), i == j


def _count_neighbours(eps: float) -> Callable[[pa.Table], pa.Table]:
    """Neighbours of every row that the meetings of a square give it, summed."""
    def count(square: pa.Table) -> pa.Table:
        ids: dict[int, np.ndarray] = {}
        totals: dict[int, np.ndarray] = {}
        for left, right, same in _met_blocks(square):
            near = _within(left[3], right[3], eps)
            for (number, own, _, _), found in [(left, near.sum(axis=1))] + ([] if same else [(right, near.sum(axis=0))]):
                ids[number] = own
                totals[number] = totals.get(number, 0) + found
        none = np.zeros(0, np.int64)
        return pa.table({"id": np.concatenate([none, *ids.values()]), "near": np.concatenate([none, *(totals[b] for b in ids)])})

    return count


def _local_roots(ids: np.ndarray, others: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of the component of each row and each column of a bipartite adjacency.

    Breadth first, from both sides in turn; every row and column is expanded once.
    """
    back = np.ascontiguousarray(near.T)
    roots, other_roots = np.full(len(ids), -1, dtype=np.int64), others.astype(np.int64)
    for seed in range(len(ids)):
        if roots[seed] >= 0:
            continue
        mine, theirs = np.zeros(len(ids), dtype=bool), np.zeros(len(others), dtype=bool)
        mine[seed] = True
        front = np.array([seed])
        while len(front):
            across = near[front].any(axis=0) & ~theirs
            theirs |= across
            home = back[np.flatnonzero(across)].any(axis=0) & ~mine
            mine |= home
            front = np.flatnonzero(home)
        root = min(ids[mine].min(), others[theirs].min() if theirs.any() else ids[seed])
        roots[mine], other_roots[theirs] = root, root
    return roots, other_roots


def _touching(ids: np.ndarray, roots: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Distinct (id, root) of border points and the components their core neighbours belong to."""
    border, core = np.nonzero(near)
    return np.unique(np.stack([ids[border], roots[core]], axis=1), axis=0)


def _forest(eps: float) -> Callable[[pa.Table], pa.Table]:
    """Edges (u, v): core to the root of its component in the square, border to the roots it touches."""

    def edges(left: tuple, right: tuple, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (_, a, core_a, x), (_, b, core_b, y) = left, right
        near = _within(x, y, eps)
        roots_a, roots_b = _local_roots(a[core_a], b[core_b], near[np.ix_(core_a, core_b)])
        core = np.stack([a[core_a], roots_a], axis=1)
        border = [_touching(a[~core_a], roots_b, near[np.ix_(~core_a, core_b)])]
        if not same:
            core = np.concatenate([core, np.stack([b[core_b], roots_b], axis=1)])
            core = core[core[:, 0] != core[:, 1]]
            border.append(_touching(b[~core_b], roots_a, near[np.ix_(core_a, ~core_b)].T))
        out = np.concatenate([core, *border]).astype("int64")
        return out[:, 0], out[:, 1], np.arange(len(out)) < len(core)

    def grow(square: pa.Table) -> pa.Table:
        held = _Forest()
        for met in _met_blocks(square):
            held.add(*edges(*met))
        return pa.table(dict(zip(("u", "v", "core"), held.edges())))

    return grow


def _merged(u: np.ndarray, v: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One forest of all core edges, as (node, root), and the distinct border edges."""
    nodes, at = np.unique(np.r_[u[core], v[core]], return_inverse=True)
    a, b = at[: core.sum()], at[core.sum():]
    root = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    border = np.unique(np.stack([u[~core], v[~core]], axis=1), axis=0)
    out = np.concatenate([np.stack([nodes, nodes[root]], axis=1), border])
    return out[:, 0], out[:, 1], np.arange(len(out)) < len(nodes)


class _Forest:
    """Edges that are merged whenever ``MERGED`` of them have come together."""

    def __init__(self) -> None:
        self.waiting, self.size, self.done = [], 0, None

    def add(self, *edges: np.ndarray) -> None:
        self.waiting.append(edges)
        self.size += len(edges[0])
        if self.size >= MERGED:
            self.merge()

    def merge(self) -> None:
        self.done = _merged(*(np.concatenate(c) for c in zip(*self.waiting, *([self.done] if self.done else []))))
        self.waiting, self.size = [], 0

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.waiting:
            self.merge()
        return self.done or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def _merge_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forests of a task's squares as one."""
    held = _Forest()
    for batch in batches:
        held.add(*(batch[c].to_numpy(zero_copy_only=False) for c in ("u", "v", "core")))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.edges()], ["u", "v", "core"])


def _tree(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree as (axis, threshold, left, right): children are nodes, or leaves as -1 - number, counted from left to right."""
    nodes: list[tuple[int, float, int, int]] = []
    numbers = iter(range(2 * leaves + 2))

    def grow(rows: np.ndarray, share: int) -> int:
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        axis = int(spread.argmax())
        if share < 2 or spread[axis] <= 0:
            return -1 - next(numbers)
        threshold = float(np.median(rows[:, axis]))
        below = rows[:, axis] < threshold
        if not below.any():
            return -1 - next(numbers)
        at = len(nodes)
        nodes.append((axis, threshold, 0, 0))
        nodes[at] = (axis, threshold, grow(rows[below], share // 2), grow(rows[~below], share - share // 2))
        return at

    grow(points, leaves)
    return nodes


def _placing(basis: np.ndarray, tree: list[tuple[int, float, int, int]]) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    """(leaf, coordinates) of each vector."""
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            if not len(vectors):
                yield pd.DataFrame({"leaf": pd.Series([], dtype="int32"), "p": pd.Series([], dtype=object)})
                continue
            p = matrix(vectors) @ basis
            at = np.zeros(len(p), dtype=np.int64) if tree else np.full(len(p), -1)
            while (inner := np.flatnonzero(at >= 0)).size:
                axis, threshold, left, right = (np.array(c)[at[inner]] for c in zip(*tree))
                at[inner] = np.where(p[inner, axis] < threshold, left, right)
            yield pd.DataFrame({"leaf": (-1 - at).astype("int32"), "p": list(p)})

    return place


def _candidate_pairs(boxes: DataFrame, eps: float, axes: int) -> DataFrame:
    """Pairs of blocks ``(_i, _j)`` whose boxes share a cell of the grid on the first two axes, once or more.

    Takes ``_block, lo, hi``. Cells of level 0 are as wide as a usual box; the next level's are twice as wide. A box belongs to
    the level at which it covers few cells and is looked up there by all boxes of this level and those below.
    """
    reach = [F.get("hi", F.lit(k)) - F.get("lo", F.lit(k)) + eps for k in range(min(axes, 2))]
    usual = boxes.agg(*[F.avg(r).alias(f"w{k}") for k, r in enumerate(reach)]).first()
    width = [max(float(w or 0.0), 1e-300) for w in usual]
    level = F.greatest(F.lit(0), *[F.ceil(F.log2(F.greatest(r / w, F.lit(1.0)))) for r, w in zip(reach, width)]).cast("int")
    placed = boxes.withColumn("level", level)
    highest = placed.agg(F.max("level")).first()[0] or 0

    def cells(rows: DataFrame, at: Column) -> DataFrame:
        rows = rows.withColumn("at", at)
        for k, w in enumerate(width):
            side = F.lit(w) * F.pow(F.lit(2.0), F.col("at"))
            ends = [F.floor((F.get(c, F.lit(k)) + s * eps / 2) / side) for c, s in (("lo", -1), ("hi", 1))]
            rows = rows.withColumn(f"c{k}", F.explode(F.sequence(*ends)))
        return rows

    keys = ["at", *[f"c{k}" for k in range(len(width))]]
    hosts = cells(placed, F.col("level")).select(F.col("_block").alias("_h"), *keys)
    guests = cells(placed, F.explode(F.sequence("level", F.lit(highest)))).select(F.col("_block").alias("_g"), *keys)
    return hosts.join(guests, keys).select(F.least("_h", "_g").alias("_i"), F.greatest("_h", "_g").alias("_j")).distinct()


def _boxes(placed: DataFrame, axes: int) -> DataFrame:
    ends = [F.array(*[f(F.get("_to", F.lit(k))) for k in range(axes)]).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return placed.groupBy("_block").agg(*ends)


def _block_pairs(placed: DataFrame, eps: float, axes: int) -> DataFrame:
    """Pairs of blocks whose boxes lie within eps."""
    boxes = materialise(_boxes(placed, axes), "blocks")
    slack = eps * (1 + RECHECK) + RECHECK
    pairs = materialise(_candidate_pairs(boxes, slack, axes), "candidates")
    sides = [boxes.select(F.col("_block").alias(n), F.col("lo").alias(f"lo{n}"), F.col("hi").alias(f"hi{n}")) for n in ("_i", "_j")]
    met = pairs.join(sides[0], "_i").join(sides[1], "_j")
    squared = F.lit(0.0)
    for k in range(axes):
        gap = F.greatest(*[F.get(f"lo{n}", F.lit(k)) for n in ("_i", "_j")]) - F.least(*[F.get(f"hi{n}", F.lit(k)) for n in ("_i", "_j")])
        squared = squared + F.pow(F.greatest(gap, F.lit(0.0)), F.lit(2.0))
    return met.filter(squared <= slack * slack).select("_i", "_j")


def _packed(points: DataFrame) -> DataFrame:
    """One row per block: ``_block, ids, core, vec``, and ``numbers``, how many its vectors hold."""
    number = packed_type(points, "_vec")

    def pack(block: pa.Table) -> pa.Table:
        vectors = flat_numbers(block["_vec"], number)
        return pa.table({"_block": [block["_block"][0].as_py()], "ids": [block["id"].to_numpy()], "core": [block["core"].to_numpy()],
                         "vec": [vectors], "numbers": [len(vectors)]})

    rows = points.select("_block", "id", "core", "_vec").groupBy("_block")
    return rows.applyInArrow(pack, f"_block long, ids array<long>, core array<boolean>, vec array<{number}>, numbers long")


def _meetings(points: DataFrame, pairs: DataFrame, square_bytes: int = SQUARE_BYTES) -> GroupedData:
    """Every block once for each square of neighbouring blocks in which it meets others, and ``_with``, those it meets there as the first of a pair.

    A block is in the squares of a row and of a column, however many others it meets, so the shuffle grows with the points times the
    root of the number of tasks. Blocks on a side of a square hold ``square_bytes`` at most, or there are as many squares as pairs.
    """
    packed = materialise(_packed(points), "packed-blocks")
    last, numbers = pairs.agg(F.max("_j")).first()[0] or 0, packed.agg(F.sum("numbers")).first()[0] or 0
    side = max(min(max(math.ceil(math.sqrt(2 * task_width(points.sparkSession))), math.ceil(numbers * 8 / square_bytes)), last + 1), 1)
    square = [F.floor(F.col(c) * side / (last + 1)).alias(f"_s{c}") for c in ("_i", "_j")]
    sides = pairs.select(*square, F.col("_i").alias("_block"), F.col("_j").alias("_with")).unionByName(
        pairs.select(*square, F.col("_j").alias("_block"), F.lit(None).cast("long").alias("_with")))
    of_block = materialise(sides.groupBy("_s_i", "_s_j", "_block").agg(F.collect_list("_with").alias("_with")), "squares")
    squares = of_block.select("_s_i", "_s_j").distinct().count()
    joined = packed.drop("numbers").join(of_block, "_block").repartition(max(1, min(squares, 4 * task_width(points.sparkSession))), "_s_i", "_s_j")
    return joined.groupBy("_s_i", "_s_j")


def _place(embeddings: DataFrame, eps: float, order: str | None, block_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """Points ``(id, filename, _vec, _block)`` in blocks, and the pairs of blocks to compare; None without points."""
    ship_package(embeddings.sparkSession)
    points = embeddings.select(
        "filename", F.col("embedding").alias("_vec"), *([F.col(order).cast("long").alias("id")] if order else [])
    )
    points = materialise(points, "points") if order else with_row_idx(points, ["filename"], "id")
    heads = points.orderBy(sample_digest("filename"), "filename").limit(SAMPLE).select("_vec").toPandas()
    if not len(heads):
        return None
    sample = matrix(heads["_vec"])
    centred = sample - sample.mean(axis=0)
    axes = min(AXES, sample.shape[1])
    basis = np.ascontiguousarray(np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :axes])
    total = points.count()
    rows = block_size(total, points.sparkSession.sparkContext.defaultParallelism, block_rows)
    tree = _tree(sample @ basis, min(-(-total // rows), len(sample) // 4))
    placing = F.pandas_udf(_placing(basis, tree), "leaf int, p array<double>")
    measured = points.withColumn("_out", placing(F.col("_vec"))).withColumns({"_leaf": F.col("_out.leaf"), "_to": F.col("_out.p")}).drop("_out")
    placed = with_row_idx(measured, [F.col("_leaf"), F.get("_to", F.lit(0)), F.col("filename")], "_at").withColumn("_block", F.floor(F.col("_at") / rows))
    return placed, materialise(_block_pairs(placed, eps, axes), "block-pairs")


def _degrees(placed: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    near = _meetings(placed.select("id", "_vec", "_block", F.lit(False).alias("core")), pairs).applyInArrow(
        _count_neighbours(eps), "id long, near long"
    )
    return near.groupBy("id").agg(F.sum("near").alias("degree"))


def _grown(alive: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    schema = "u long, v long, core boolean"
    return _meetings(alive, pairs).applyInArrow(_forest(eps), schema).mapInArrow(_merge_forests, schema)


def neighbour_counts(embeddings: DataFrame, eps: float, order: str | None = "row_idx",
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(filename, neighbours)``: points within eps, the point itself included."""
    found = _place(embeddings, eps, order, block_rows)
    if found is None:
        return embeddings.select("filename", F.lit(0).cast("long").alias("neighbours"))
    placed, pairs = found
    return placed.join(_degrees(placed, pairs, eps), "id").select("filename", F.col("degree").alias("neighbours"))


def dbscan(embeddings: DataFrame, eps: float = 63.0, min_samples: int = 50, order: str | None = "row_idx",
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(filename, cluster)`` with -1 for noise, Euclidean distance at most eps.

    A neighbourhood includes the point itself. Clusters are numbered by their
    earliest core point in ``order`` (by file name if None); a border point joins
    the lowest-numbered cluster around it.
    """
    found = _place(embeddings, eps, order, block_rows)
    if found is None:
        return embeddings.select("filename", F.lit(-1).alias("cluster"))
    placed, pairs = found
    degree = _degrees(placed, pairs, eps)
    # A point with no neighbour but itself, and not core, is noise.
    core = (F.col("degree") >= min_samples).alias("core")
    alive = materialise(
        placed.join(degree, "id").filter((F.col("degree") > 1) | (F.col("degree") >= min_samples)).select(
            "id", "_vec", "_block", core
        ),
        "alive",
    )

    grown = materialise(_grown(alive, pairs, eps), "forest")
    component = connected_components(grown.filter("core").select("u", "v"))
    number = dense_numbers(component.select("component").distinct(), "component", "cluster")
    of_core = join_on(component, number, ["component"]).select(F.col("node").alias("v"), "cluster")
    of_border = grown.filter("not core").join(of_core, "v").groupBy(F.col("u").alias("id")).agg(
        F.min("cluster").alias("cluster")
    )
    known = of_core.select(F.col("v").alias("id"), "cluster").union(of_border)
    return placed.select("id", "filename").join(known, "id", "left").select(
        "filename", F.coalesce(F.col("cluster").cast("int"), F.lit(-1)).alias("cluster")
    )
