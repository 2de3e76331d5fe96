"""Row numbers and first-per-key without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechcurate.functions.text import change_basename
from speechcurate.session import join_on, materialise, small_table

# Rows that one task numbers when a run of clients is scanned in order.
RUN_BLOCK = 500_000


def with_row_idx(df: DataFrame, order: list[str | Column], name: str = "row_idx") -> DataFrame:
    """Number rows 0, 1, 2 ... in the given order, which has to be unique.

    A range-partitioned sort is written out with each row's place in its
    partition; adding the sizes of the earlier partitions gives the number. There is
    one offset per partition, so they are few. The result reads what was written:
    using it several times repeats neither the sort nor what came before it.
    """
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(
        df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_pos", in_partition), "ordered"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets, _ = small_table(
        sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets"
    )
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )


def first_per_key(df: DataFrame, key: str | list[str], order: str, last: bool = False) -> DataFrame:
    """First (or last) row of every key.

    ``row_number() = 1`` is planned with a partial limit in front of the shuffle,
    so a hot key sends one row per task. A table without the column ``order`` is ordered by its
    columns from left to right.
    """
    keys = [key] if isinstance(key, str) else list(key)
    place = F.col(order) if order in df.columns else F.struct(*[F.col(f"`{c}`") for c in df.columns])
    by = place.desc() if last else place.asc()
    w = Window.partitionBy(*keys).orderBy(by)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dense_numbers(values: DataFrame, column: str, name: str) -> DataFrame:
    """Number distinct values 0, 1, 2 ... in order; a small table needs no range sort."""
    table, few = small_table(values.select(column), "values")
    if few is None:
        return with_row_idx(table, [column], name)
    return table.withColumn(name, F.row_number().over(Window.orderBy(column)).cast("long") - 1)


def number_clients(df: DataFrame, client: str = "client_id", name: str = "client_no") -> DataFrame:
    """1-based rank of the client id in string order; only distinct ids are sorted."""
    ids = df.select(F.col(client).cast("string").alias(client)).distinct()
    ranked = dense_numbers(ids, client, "_idx").select(client, (F.col("_idx") + 1).alias(name))
    return join_on(df.withColumn(client, F.col(client).cast("string")), ranked, [client], "left")


def number_runs(
    df: DataFrame,
    client: str = "client_id",
    order: str = "row_idx",
    name: str = "file_no",
    dense: bool = False,
    block_rows: int = RUN_BLOCK,
) -> DataFrame:
    """Position of a row inside the current run of rows of the same client.

    Rows are cut into blocks of consecutive positions. Inside a block a window
    finds where runs start; a table with one row per block carries the open run
    into the next block. ``dense`` says that ``order`` already counts 0, 1, 2 ...
    """
    placed = df.withColumn("_i", F.col(order)) if dense else with_row_idx(df, [order], "_i")
    placed = placed.withColumn("_block", F.floor(F.col("_i") / block_rows))
    w = Window.partitionBy("_block").orderBy("_i")
    changed = ~F.lag(client).over(w).eqNullSafe(F.col(client))
    marked = placed.withColumn("_first", F.row_number().over(w) == 1).withColumn(
        "_start", F.when(F.col("_first") | changed, F.col("_i"))
    )

    # Per block: first and last client, and the start of its last run.
    edges = marked.groupBy("_block").agg(
        F.min_by(F.struct(F.col(client).alias("c")), "_i").alias("_head"),
        F.max_by(F.struct(F.col(client).alias("c")), "_i").alias("_tail"),
        F.max("_start").alias("_last_start"),
        F.min("_i").alias("_lo"),
    )
    by_block = Window.orderBy("_block")
    continues = F.lag("_tail").over(by_block).eqNullSafe(F.col("_head"))
    edges = edges.withColumn("_continues", F.coalesce(continues, F.lit(False)))
    # A block that is one continued run opens nothing; its rows look further back.
    own_open = F.when(~F.col("_continues") | (F.col("_last_start") > F.col("_lo")), F.col("_last_start"))
    carry = F.last(own_open, ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("_carry", carry).select("_block", "_continues", "_carry")

    stitched = marked.join(edges, "_block")
    start = F.when(F.col("_first") & F.col("_continues"), F.col("_carry")).otherwise(F.col("_start"))
    open_run = F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stitched.withColumn(name, F.col("_i") - open_run + 1).drop(
        "_i", "_block", "_first", "_start", "_continues", "_carry"
    )


def renumber_clips(
    df: DataFrame, path: str = "file_name", client: str = "client_id", order: str = "row_idx", dense: bool = False
) -> DataFrame:
    """New file name ``<client number>_<file number>``, old base name kept beside it."""
    numbered = number_clients(number_runs(df, client, order, dense=dense), client)
    new = F.concat_ws("_", F.col("client_no").cast("string"), F.col("file_no").cast("string"))
    return numbered.withColumn("new_name", change_basename(path, new))
