"""Joins and audits between manifests, clusters and uncertainties.

No side carries a broadcast hint but a Bloom filter of bounded size: manifests, cluster tables and uncertainty
tables grow together, and adaptive execution picks the strategy from measured
sizes and splits skewed partitions. Look-ups by path use plain equality, so they
keep the layout of bucketed tables; where null has to match null, an audit says so.
Audits that would pair all copies of a key
count the copies first and multiply the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechcurate.functions.text import basename
from speechcurate.operators.manifest import partition_by_split, require_not_null
from speechcurate.operators.ordering import first_per_key
from speechcurate.session import join_on, small_table

# Blocks of 64 bits of a Bloom filter, and the most rows of a batch that one is made of.
BLOOM_BLOCKS = 1 << 18
BLOOM_KEYS = 1_000_000


def join_clusters_inner(manifest: DataFrame, clusters: DataFrame, path: str = "path") -> DataFrame:
    """Rows of the manifest that have a cluster."""
    table = clusters.select(F.col("filename").alias(path), F.col("cluster").cast("int").alias("cluster"))
    return manifest.join(table, path)


def join_uncertainty(manifest: DataFrame, uncertainties: DataFrame, path: str = "file_name") -> DataFrame:
    """Attach the uncertainty of every clip; a clip without one is an error."""
    table = uncertainties.select(path, "uncertainty")
    return require_not_null(manifest.drop("uncertainty").join(table, path, "left"), "uncertainty")


def assign_cluster(manifest: DataFrame, clusters: DataFrame, path: str = "file_name", strict: bool = True,
                   order: str | None = "row_idx") -> DataFrame:
    """Look up the cluster of every clip by the base name of its path.

    Of several entries for one name the last by ``order`` counts, or the greatest cluster where there is no such column. With ``strict``
    a clip without an entry is an error. ``order=None`` says names are unique.
    """
    table = first_per_key(clusters, "filename", order, last=True) if order else clusters
    table = table.select(F.col("filename").alias("_base"), F.col("cluster").cast("int").alias("cluster"))
    joined = manifest.drop("cluster").withColumn("_base", basename(path)).join(table, "_base", "left").drop("_base")
    if not strict:
        return joined
    error = F.raise_error(F.concat(F.lit("no cluster for "), F.coalesce(F.col(path), F.lit("null path"))))
    return joined.filter(F.when(F.col("cluster").isNull(), error.cast("boolean")).otherwise(F.lit(True)))


def common_columns(a: DataFrame, b: DataFrame, but: tuple[str, ...] = ("row_idx",)) -> list[str]:
    return [c for c in a.columns if c in b.columns and c not in but]


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables, equal in all common columns (null equals null).

    One row per distinct value: ``copies_a``, ``copies_b`` and their product
    ``matches``, the number of rows a plain merge would give. One grouping of both
    tables takes the place of the join.
    """
    keys = common_columns(a, b)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tagged = a.select(*keys, one.alias("_a"), zero.alias("_b")).union(b.select(*keys, zero.alias("_a"), one.alias("_b")))
    counted = tagged.groupBy(*keys).agg(F.sum("_a").alias("copies_a"), F.sum("_b").alias("copies_b"))
    return counted.filter("copies_a > 0 and copies_b > 0").withColumn("matches", F.col("copies_a") * F.col("copies_b"))


def overlap_size(a: DataFrame, b: DataFrame) -> DataFrame:
    return overlap(a, b).agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"))


def subtract_subset(pool: DataFrame, chosen: DataFrame, path: str = "file_name", order: str = "row_idx") -> DataFrame:
    """Pool without the chosen training rows.

    Each path of the pool is represented by its first row; it goes when the
    chosen train rows (one per path) hold a row equal in all common columns,
    where null equals null.
    """
    chosen_train, _ = partition_by_split(chosen, "train", path)
    if "split" not in pool.columns:
        chosen_train = chosen_train.drop("split")
    same = F.struct(*common_columns(pool, chosen_train, (order,)))
    # Both sides are grouped and joined by the same two columns, so each is shuffled and sorted once.
    key = {"_key": F.coalesce(path, F.lit("")), "_null": F.col(path).isNull()}
    first = first_per_key(pool.withColumns(key), list(key), order)
    gone = first_per_key(chosen_train.withColumns(key), list(key), order).select(*key, same.alias("_chosen"))
    kept = F.col("_chosen").isNull() | ~same.eqNullSafe(F.col("_chosen"))
    return first.join(gone, list(key), "left").filter(kept).drop(*key, "_chosen")


def _bloom_bits(path: str) -> Column:
    """Four of 64 bits, from digits of the path's hash that don't choose the block."""
    digits = [F.shiftrightunsigned(F.xxhash64(path, F.lit(1)), 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(4)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), d) for d in digits]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def may_match(pool: DataFrame, batch: DataFrame, path: str = "file_name", max_keys: int = BLOOM_KEYS) -> DataFrame:
    """Rows of a large pool whose path may occur in a small batch; none that does is lost, null included.

    A blocked Bloom filter of the batch's paths, at most ``BLOOM_BLOCKS`` rows of 16 bytes, is broadcast,
    so that a join behind it shuffles little but matches of the pool. A batch of more than ``max_keys``
    rows, or one whose path has another type, gives the whole pool.
    """
    if pool.schema[path].dataType != batch.schema[path].dataType or batch.select(path).limit(max_keys + 1).count() > max_keys:
        return pool
    block = F.pmod(F.xxhash64(path), F.lit(BLOOM_BLOCKS))
    filled = batch.select(block.alias("_block"), _bloom_bits(path).alias("_set")).groupBy("_block").agg(F.bit_or("_set").alias("_set"))
    tested = pool.withColumns({"_at": block, "_bits": _bloom_bits(path)})
    inside = (F.col("_at") == F.col("_block")) & (F.col("_set").bitwiseAND(F.col("_bits")) == F.col("_bits"))
    return tested.join(F.broadcast(filled), inside, "left_semi").drop("_at", "_bits")


def subset_violations(a: DataFrame, b: DataFrame, path: str = "file_name") -> DataFrame:
    """Rows of ``b`` whose path does not occur in ``a``, which may be far larger than ``b``."""
    return join_on(b, may_match(a.select(path), b, path), [path], "left_anti")


def _copies(df: DataFrame, path: str, side: str) -> DataFrame:
    """Rows and distinct rows per path."""
    distinct = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    per_path = distinct.groupBy(path).agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    zero = F.lit(0).cast("long")
    other = "b" if side == "a" else "a"
    return per_path.select(
        path, F.col("n").alias(f"n_{side}"), F.col("d").alias(f"d_{side}"),
        zero.alias(f"n_{other}"), zero.alias(f"d_{other}"),
    )


def path_counts(a: DataFrame, b: DataFrame, path: str = "file_name") -> DataFrame:
    """Rows (n) and distinct rows (d) of both tables per path, from one grouping."""
    both = _copies(a, path, "a").unionByName(_copies(b, path, "b"))
    return both.groupBy(path).agg(*[F.sum(c).alias(c) for c in ("n_a", "d_a", "n_b", "d_b")])


def outer_audit(a: DataFrame, b: DataFrame, path: str = "file_name") -> DataFrame:
    """Shape of the outer merge of two tables on path, before and after removing equal rows."""
    per_path = path_counts(a, b, path)

    def rows(x: Column, y: Column) -> Column:
        return F.greatest(x, F.lit(1)) * F.greatest(y, F.lit(1))

    merged, distinct = rows(F.col("n_a"), F.col("n_b")), rows(F.col("d_a"), F.col("d_b"))
    left, right = F.col("n_b") == 0, F.col("n_a") == 0

    def total(value: Column, condition: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if condition is None else F.when(condition, value)), F.lit(0))

    return per_path.agg(
        total(F.col("n_a")).alias("rows_a"),
        total(F.col("n_b")).alias("rows_b"),
        total(merged).alias("rows_outer"),
        total(merged - distinct).alias("duplicated"),
        total(distinct, left).alias("left_only"),
        total(distinct, ~left & ~right).alias("both"),
        total(distinct, right).alias("right_only"),
    )


def inner_audit(a: DataFrame, b: DataFrame, path: str = "file_name") -> DataFrame:
    """Rows of the inner merge on path next to the rows of ``b``."""
    return path_counts(a, b, path).agg(
        F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("rows_inner"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"),
    ).withColumn("equal", F.col("rows_inner") == F.col("rows_b"))


def matching_rows(a: DataFrame, b: DataFrame, path: str = "file_name") -> DataFrame:
    """Rows of ``a``, which may be far larger than ``b``, whose path also occurs in ``b``."""
    return join_on(may_match(a, b, path), b.select(path), [path], "left_semi")


def assert_disjoint(a: DataFrame, b: DataFrame, path: str = "file_name") -> None:
    offenders = matching_rows(a, b, path).select(path).limit(10).collect()
    if offenders:
        raise ValueError(f"tables should be disjoint, but share {[r[0] for r in offenders]}")


def align(embeddings: DataFrame, table: DataFrame, key: str = "filename") -> DataFrame:
    """Put labels or coordinates next to the vectors, by name."""
    return embeddings.join(table.drop("row_idx"), key)


def with_speaker_count(df: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Number of clips of the speaker next to every clip.

    Counts are combined before the shuffle and joined back, so that no speaker's
    clips have to meet in one task; a small table of counts is not even shuffled.
    """
    counts, _ = small_table(df.groupBy(speaker).agg(F.count("*").alias("count")), "counts")
    return join_on(df, counts, [speaker], "left")


