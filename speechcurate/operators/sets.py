"""Unions and comparisons of whole manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.functions.text import append_extension, prefix_path
from speechcurate.operators.manifest import with_label
from speechcurate.session import join_on


def union_manifests(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables, columns by name, missing ones null."""
    return a.unionByName(b, allowMissingColumns=True)


def reattach(train: DataFrame, others: DataFrame) -> DataFrame:
    """Put the splits that were set aside back behind the train rows."""
    return train.unionByName(others, allowMissingColumns=True)


def build_metadata(train: DataFrame, test: DataFrame, dev: DataFrame, clip: int = 1) -> DataFrame:
    """One table of three, columns by position, with the clip's new path in front.

    ``clip`` is the position of the column that names the clip without extension.
    """
    def placed(df: DataFrame, split: str) -> DataFrame:
        path = prefix_path(append_extension(F.col(f"`{df.columns[clip]}`"), ".mp3"), "data", split)
        return df.select(path.alias("file_name"), *[F.col(f"`{c}`") for c in df.columns])

    return reduce(DataFrame.union, [placed(train, "train"), placed(test, "test"), placed(dev, "dev")])


def merge_embeddings(a: DataFrame, b: DataFrame, name: str = "cluster") -> DataFrame:
    """Embeddings of two sources, labelled 0 and 1."""
    return with_label(a, 0, name).unionByName(with_label(b, 1, name))


def value_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values that only one of the tables has, null included."""
    tagged = [
        t.select(F.col(column), F.lit(x).alias("_a"), F.lit(not x).alias("_b")) for t, x in ((a, True), (b, False))
    ]
    seen = tagged[0].union(tagged[1]).groupBy(column).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))
    return seen.filter("_a <> _b").select(column, F.when(F.col("_a"), "a").otherwise("b").alias("only_in"))


def compare_manifests(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = ("file_name", "sentence")) -> DataFrame:
    """Per check: is it equal in both tables? Shape, set of columns, set of values per column."""
    names = F.lit(sorted(set(a.columns)) == sorted(set(b.columns)))
    widths = F.lit(len(a.columns) == len(b.columns))
    # One scan per table: everything else is counted over tagged values.
    rows = a.select(F.lit(1).alias("n")).union(b.select(F.lit(-1).alias("n"))).agg(
        (F.coalesce(F.sum("n"), F.lit(0)) == 0).alias("same")
    )
    checks = [rows.select(F.lit("shape").alias("check"), (F.col("same") & widths).alias("equal"))]
    checks.append(rows.select(F.lit("columns").alias("check"), names.alias("equal")))
    for c in columns:
        diff = value_diff(a, b, c).agg(F.count("*").alias("n"))
        checks.append(diff.select(F.lit(c).alias("check"), (F.col("n") == 0).alias("equal")))
    return reduce(DataFrame.union, checks)


def aligned_diff(a: DataFrame, b: DataFrame, column: str, order: str = "row_idx") -> DataFrame:
    """Rows that differ in a column from the row at the same position."""
    right = b.select(order, F.col(column).alias(f"{column}_b"))
    return join_on(a.select(order, F.col(column).alias(f"{column}_a")), right, [order]).filter(
        ~F.col(f"{column}_a").eqNullSafe(F.col(f"{column}_b"))
    )
