"""Exact Euclidean silhouette from blocked distance sums, and the linear squared one from cluster moments."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.operators.blocks import BLOCK_ROWS, block_size, flat_numbers, packed_type, squared_slices, task_width
from speechcurate.operators.ordering import with_row_idx
from speechcurate.session import materialise, ship_package, small_table

# Vectors of a group of blocks, of which a task holds two.
GROUP_BYTES = 64 << 20
# Moments of clusters that are sent to every task at once.
MOMENT_BYTES = 16 << 20
SUMS = "_part long, _id long, _label long, _other long, _sum double"


def _sums_one_way(a: dict, b: dict, root: bool) -> tuple[np.ndarray, np.ndarray]:
    """(labels of ``b``, rows of ``a`` x these labels: sums of distances)."""
    labels, first = np.unique(b["labels"], return_index=True)
    sums = np.empty((len(a["ids"]), len(labels)))
    for start, squared, _ in squared_slices(a["vec"].astype(np.float64, copy=False), b["vec"].astype(np.float64, copy=False)):
        distance = np.maximum(squared, 0.0)
        if root:
            distance = np.sqrt(distance)
        distance[a["ids"][start:start + len(distance), None] == b["ids"][None, :]] = 0.0
        sums[start:start + len(distance)] = np.add.reduceat(distance, first, axis=1)
    return labels, sums


def _needed(a: dict, b: dict, hub: int | None) -> bool:
    """Whether two blocks hold a label in common, or the hub; without a hub all meet. Rows of a block go by label."""
    if hub is None or hub in (a["labels"][0], b["labels"][0]):
        return True
    return a["labels"][0] <= b["labels"][-1] and b["labels"][0] <= a["labels"][-1]


def _block(ids, labels, vectors) -> dict:
    ids = np.asarray(ids)
    return {"ids": ids, "labels": np.asarray(labels), "vec": np.asarray(vectors).reshape(len(ids), -1)}


def _rows(part: int, a: dict, labels: np.ndarray, sums: np.ndarray, hub: int | None) -> pa.Table:
    wanted = np.ones(sums.shape, dtype=bool)
    if hub is not None:
        wanted = (a["labels"][:, None] == labels[None, :]) | (a["labels"][:, None] == hub) | (labels[None, :] == hub)
    row, label = np.nonzero(wanted)
    return pa.table({"_part": np.full(len(row), part), "_id": a["ids"][row], "_label": a["labels"][row], "_other": labels[label], "_sum": sums[wanted]})


def _cell_sums(hub: int | None, root: bool) -> Callable[[pa.Table], pa.Table]:
    """The blocks of the left group keep their sums while those of the right one go by in the order of labels. Two blocks at a time are doubles."""
    def compute(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("_block")
        blocks = [(side, _block(i.values.to_numpy(), n.values.to_numpy(), v.values.to_numpy()))
                  for side, i, n, v in zip(cell["_side"].to_pylist(), cell["ids"], cell["labels"], cell["vec"])]
        part, out = cell["_part"][0].as_py(), []
        right = [b for side, b in blocks if side]
        for a in (b for side, b in blocks if not side):
            open_labels, open_sums = np.zeros(0, np.int64), np.zeros((len(a["ids"]), 0))
            for b in right:
                if not _needed(a, b, hub):
                    continue
                labels, sums = _sums_one_way(a, b, root)
                if len(open_labels) and open_labels[-1] == labels[0]:
                    sums[:, 0] += open_sums[:, -1]
                    open_labels, open_sums = open_labels[:-1], open_sums[:, :-1]
                if len(open_labels):
                    out.append(_rows(part, a, open_labels, open_sums, hub))
                open_labels, open_sums = labels, sums
            if len(open_labels):
                out.append(_rows(part, a, open_labels, open_sums, hub))
        schema = pa.schema([("_part", pa.int64()), ("_id", pa.int64()), ("_label", pa.int64()), ("_other", pa.int64()), ("_sum", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return compute


@dataclass
class DistanceSums:
    """``sums``: (part, id, label, other, sum_d); ``points``: (part, id, label, name); ``sizes``: (part, label, n)."""

    sums: DataFrame
    points: DataFrame
    sizes: DataFrame


def distance_sums(points: DataFrame, block_rows: int = BLOCK_ROWS, hub: int | None = None,
                  root: bool = True, group_bytes: int = GROUP_BYTES) -> DistanceSums:
    """Sum of distances from every point to all points of every label of its part.

    Takes ``(part, name, label, vec)``. Points are numbered by part, label and
    name and cut into blocks of that order, so a block holds few labels and never
    grows with a hot one. Blocks are packed, one row each, and dealt to a grid of cells: a cell keeps its left group of blocks and
    goes through the right one. Each block is sent to the cells of its row and its column, so the shuffle grows with the
    points times the root of the number of tasks; only a group beyond ``GROUP_BYTES`` adds cells. The result has points x labels rows, no pairs. The work
    is quadratic in the points of a part, as the exact statistic is. ``hub`` is the
    one label that others are compared with, if not all with all; it is the least one. Without ``root``
    the sums are of squared distances.
    """
    spark = points.sparkSession
    ship_package(spark)
    numbered = with_row_idx(points, ["part", "label", "name"], "id")
    sizes, _ = small_table(numbered.groupBy("part", "label").agg(F.count("*").alias("n")), "label-sizes")
    stats = numbered.groupBy("part").agg(F.count("*").alias("_n"), F.min("id").alias("_lo"), F.max(F.size("vec")).alias("_d"))
    parts, _ = small_table(stats, "parts")
    largest, n_parts = parts.agg(F.max("_n"), F.count("*")).first()
    rows = block_size(largest or 0, spark.sparkContext.defaultParallelism, block_rows)
    wide = task_width(spark)
    root_of_tasks = max(math.ceil(math.sqrt(wide / max(n_parts, 1))), 1)
    blocks = F.ceil(F.col("_n") / rows)
    groups = F.least(blocks, F.greatest(F.lit(root_of_tasks).cast("long"), F.ceil(F.col("_n") * F.col("_d") * 8 / group_bytes)))
    placed = numbered.join(parts, "part").withColumns({"_block": F.floor((F.col("id") - F.col("_lo")) / rows), "_groups": groups, "_blocks": blocks})
    placed = placed.withColumn("_group", F.floor(F.col("_block") * F.col("_groups") / F.col("_blocks")))

    number = packed_type(points, "vec")

    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by("id")
        one = {c: [block[c][0].as_py()] for c in ("part", "_block", "_group", "_groups")}
        return pa.table({"_part": one["part"], **{c: one[c] for c in ("_block", "_group", "_groups")}, "ids": [block["id"].to_numpy()],
                         "labels": [block["label"].to_numpy()], "vec": [flat_numbers(block["vec"], number)]})

    packed = placed.select("part", "id", "label", "vec", "_block", "_group", "_groups").groupBy("part", "_block").applyInArrow(
        pack, f"_part long, _block long, _group long, _groups long, ids array<long>, labels array<long>, vec array<{number}>")
    packed = materialise(packed, "packed-blocks")
    # With a hub, cells whose groups share no label and do not hold it are never dealt.
    ends = packed.groupBy("_part", "_group").agg(F.min(F.array_min("labels")).alias("lo"), F.max(F.array_max("labels")).alias("hi"))
    left, right = (ends.select("_part", F.col("_group").alias(f"_g{s}"), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}")) for s in "lr")
    cells = left.join(right, "_part")
    if hub is not None:
        cells = cells.filter((F.col("lol") == hub) | (F.col("lor") == hub) | ((F.col("lol") <= F.col("hir")) & (F.col("lor") <= F.col("hil"))))
    cells = materialise(cells.select("_part", "_gl", "_gr"), "cells")
    dealt = packed.join(cells.withColumn("_group", F.col("_gl")), ["_part", "_group"]).withColumn("_side", F.lit(0)).unionByName(
        packed.join(cells.withColumn("_group", F.col("_gr")), ["_part", "_group"]).withColumn("_side", F.lit(1)))
    tasks = max(1, min(cells.count(), 4 * wide))
    partial = dealt.select("_part", "_gl", "_gr", "_side", "_block", "ids", "labels", "vec").repartition(tasks, "_part", "_gl", "_gr").groupBy(
        "_part", "_gl", "_gr").applyInArrow(_cell_sums(hub, root), SUMS)
    # One shuffle by point serves this sum and the aggregation per point after it.
    sums = partial.repartition("_part", "_id").groupBy("_part", "_id", "_label", "_other").agg(F.sum("_sum"))
    return DistanceSums(
        sums.toDF("part", "id", "label", "other", "sum_d"), numbered.select("part", "id", "label", "name"), sizes
    )


def _require_labels(sizes: DataFrame) -> None:
    per_part = sizes.groupBy("part").agg(F.count("*").alias("labels"), F.sum("n").alias("n"))
    bad = per_part.filter("labels < 2 or labels >= n").limit(5).collect()
    if bad or sizes.isEmpty():
        raise ValueError(f"silhouette needs 2 to n - 1 labels: {bad}")


def samples_from_sums(d: DistanceSums) -> DataFrame:
    """(part, id, label, silhouette) per point; the only member of a label scores 0."""
    sized = d.sums.join(d.sizes.select("part", F.col("label").alias("other"), "n"), ["part", "other"])
    own = F.col("label") == F.col("other")
    per_point = sized.groupBy("part", "id", "label").agg(
        F.max(F.when(own, F.col("sum_d"))).alias("_own"),
        F.max(F.when(own, F.col("n"))).alias("_n"),
        F.min(F.when(~own, F.col("sum_d") / F.col("n"))).alias("_b"),
    )
    a = F.col("_own") / F.when(F.col("_n") > 1, F.col("_n") - 1)
    widest = F.greatest(a, F.col("_b"))
    value = F.when((F.col("_n") == 1) | (widest == 0), F.lit(0.0)).otherwise((F.col("_b") - a) / widest)
    return per_point.select("part", "id", "label", value.alias("silhouette"))


def _points(embeddings: DataFrame, clusters: DataFrame, part: str | None) -> DataFrame:
    labels = clusters.select("filename", F.col("cluster").cast("long").alias("label"))
    return embeddings.join(labels, "filename").select(
        (F.col(part).cast("long") if part else F.lit(0).cast("long")).alias("part"),
        F.col("filename").alias("name"),
        "label",
        F.col("embedding").alias("vec"),
    )


def silhouette_samples(embeddings: DataFrame, clusters: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Silhouette of every clip; noise is a label like any other."""
    d = distance_sums(_points(embeddings, clusters, None), block_rows)
    _require_labels(d.sizes)
    return samples_from_sums(d).join(d.points.select("id", "name"), "id").select(
        F.col("name").alias("filename"), F.col("label").cast("int").alias("cluster"), "silhouette"
    )


def silhouette_by(embeddings: DataFrame, clusters: DataFrame, part: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean silhouette for every value of a whole-number column of the embeddings."""
    d = distance_sums(_points(embeddings, clusters, part), block_rows)
    _require_labels(d.sizes)
    return samples_from_sums(d).groupBy(F.col("part").alias(part)).agg(F.avg("silhouette").alias("score"))


def silhouette_score(embeddings: DataFrame, clusters: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean silhouette of all clips."""
    d = distance_sums(_points(embeddings, clusters, None), block_rows)
    _require_labels(d.sizes)
    return samples_from_sums(d).agg(F.avg("silhouette").alias("score"))


def silhouette_profile(embeddings: DataFrame, clusters: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Silhouettes of labels 0 to k - 1 in rising order, with their place in the label.

    The order is one range-partitioned sort; a place is the row number less the
    number of the label's first row.
    """
    chosen = silhouette_samples(embeddings, clusters, block_rows).filter((F.col("cluster") >= 0) & (F.col("cluster") < k))
    numbered = with_row_idx(chosen, ["cluster", "silhouette", "filename"], "_row")
    starts, _ = small_table(numbered.groupBy("cluster").agg(F.min("_row").alias("_first")), "starts")
    return numbered.join(starts, "cluster").withColumn("place", F.col("_row") - F.col("_first")).drop("_row", "_first")


def _mean_squares(centre: np.ndarray, labels: np.ndarray, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Callable:
    """(own: sum of squared distances to the own cluster, size: its rows, other: least mean to another one), as far as these clusters tell."""
    by_label = np.argsort(labels)
    ordered = labels[by_label]
    rows = max((4 << 20) // max(len(labels), 1), 1)

    def measure(vectors, own):
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1) - centre
        mine = own.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ordered, mine), len(labels) - 1)
        place, known = by_label[at], ordered[at] == mine
        total, size, other = (np.full(len(x), np.nan) for _ in range(3))
        for i in range(0, len(x), rows):
            part, here = slice(i, i + rows), np.flatnonzero(known[i : i + rows])
            norm = np.einsum("ij,ij->i", x[part], x[part])[:, None]
            distance = np.maximum(n * norm - 2.0 * (x[part] @ sums.T) + squares, 0.0)
            total[i + here], size[i + here] = distance[here, place[i + here]], n[place[i + here]]
            mean = distance / n
            mean[here, place[i + here]] = np.inf
            other[part] = mean.min(axis=1)
        columns = [pa.array(total, from_pandas=True), pa.array(size, from_pandas=True), pa.array(other)]
        return pa.StructArray.from_arrays(columns, ["own", "size", "other"])

    measure.__annotations__ = {"vectors": pa.Array, "own": pa.Array, "return": pa.Array}
    return F.arrow_udf(measure, "struct<own:double,size:double,other:double>")


def silhouette_squared(embeddings: DataFrame, clusters: DataFrame, moment_bytes: int = MOMENT_BYTES) -> DataFrame:
    """Silhouette on squared distances, linear in the number of clips for any number of clusters.

    Another statistic than ``silhouette_score``; the choice for large tables. Clips without a cluster don't count. A cluster is known by its moments: rows, sum
    and sum of squares. They are summed before the shuffle, and go to the tasks in chunks of ``moment_bytes``; every
    chunk is a pass over the vectors that lowers the least mean distance found so far.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    labelled = embeddings.join(clusters.select("filename", F.col("cluster").cast("long").alias("label")).filter("label is not null"), "filename")
    points = materialise(labelled.select("label", F.col("embedding").cast("array<double>").alias("vec")), "points")
    vector = array_to_vector("vec")
    mean = points.agg(Summarizer.mean(vector).alias("m"), F.count("*").alias("n")).first()
    if not mean["n"]:
        raise ValueError("silhouette needs 2 to n - 1 labels: no points")
    centre = mean["m"].toArray()
    shifted = F.zip_with("vec", F.lit(centre.tolist()), lambda a, b: a - b)
    moments = points.withColumn("vec", shifted).groupBy("label").agg(
        F.count("*").alias("n"), vector_to_array(Summarizer.sum(vector)).alias("sums"),
        F.sum(F.aggregate("vec", F.lit(0.0), lambda s, a: s + a * a)).alias("squares"))
    moments = with_row_idx(moments, ["label"], "at")
    per_chunk = max(moment_bytes // (8 * (len(centre) + 3)), 1)
    k = moments.count()
    if k < 2 or k >= mean["n"]:
        raise ValueError(f"silhouette needs 2 to n - 1 labels: {k} of {mean['n']} points")
    state = points.withColumns({"own": F.lit(None).cast("double"), "size": F.lit(None).cast("double"), "other": F.lit(float("inf"))})
    for first in range(0, k, per_chunk):
        chunk = moments.filter(F.col("at").between(first, first + per_chunk - 1)).orderBy("at").toArrow()
        sums = chunk["sums"].combine_chunks().flatten().to_numpy().reshape(chunk.num_rows, -1)
        found = _mean_squares(centre, *(chunk[c].to_numpy() for c in ("label", "n")), sums, chunk["squares"].to_numpy())
        state = state.withColumn("f", found("vec", "label")).select(
            "label", "vec", F.coalesce("own", "f.own").alias("own"), F.coalesce("size", "f.size").alias("size"), F.least("other", "f.other").alias("other"))
        if first + per_chunk < k:
            state = materialise(state, "squares")
    a = F.col("own") / F.when(F.col("size") > 1, F.col("size") - 1)
    widest = F.greatest(a, F.col("other"))
    value = F.when((F.col("size") == 1) | (widest == 0), 0.0).otherwise((F.col("other") - a) / widest)
    return state.agg(F.avg(value).alias("score"))
