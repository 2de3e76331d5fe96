"""Readers and writers of manifests and small report tables."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechcurate.operators.manifest import limit_samples, normalise_columns
from speechcurate.operators.selection import cluster_sizes, inverse_quota

MANIFEST = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("sentence", T.StringType()),
    T.StructField("speaker_id", T.StringType()),
])


INVALID = ("fail", "null", "report")


def _files_by_header(spark: SparkSession, path: str) -> tuple[list[list[str]], bool]:
    """Files of each distinct header line, and whether any line has an odd number of quotes; one scan of the lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # The first line that isn't blank, of the split that starts its file: within a task ids rise with the lines.
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("id"), (quotes % 2 == 1).alias("odd"))
    first = F.when((F.col("start") == 0) & (F.length(F.trim("value")) > 0), F.col("id"))
    files = lines.groupBy("file").agg(F.min_by("value", first).alias("header"), F.max("odd").alias("odd"))
    headers = files.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"), F.max("odd").alias("odd")).collect()
    groups = [r["files"] for r in sorted(headers, key=lambda r: r["files"]) if r["header"] is not None]
    return groups, any(r["odd"] for r in headers)


def _literal_path(file: str) -> str:
    """A listed file as a path for a reader: its escapes undone, characters of patterns quoted."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str = MANIFEST, sep: str = ",",
                  multi_line: bool | None = None, invalid: str = "fail", mixed_headers: bool | None = None) -> DataFrame:
    """Comma or tab separated manifest, read by the names in its header.

    Columns of ``schema`` come first, in its order and types; a missing one is an error. Further columns follow
    as text. Quotes are doubled inside quoted fields. ``multi_line`` lets a quoted sentence hold a line break; such a
    file cannot be split. Unless given, it is on only if some line has an odd number of quotes, which a scan
    of the lines tells.

    A value that doesn't fit its type, as ``x`` in an integer column, fails the read where the column is used. With
    ``invalid="null"`` it is null, with ``invalid="report"`` null and listed in a last column ``invalid``, an array of
    ``(column, value)``; an empty field is null and fits.

    With ``mixed_headers`` each file of a folder is read by its own header: columns may stand in
    another order, and a further column that a file lacks is null in its rows. A scan of the lines finds the headers;
    the plan has one read per distinct header, however many files there are. It is on unless ``multi_line`` is given, which
    saves the scan; then a file with another header fails the read.
    """
    if invalid not in INVALID:
        raise ValueError(f"invalid must be one of {INVALID}")
    groups = [path]
    mixed_headers = multi_line is None if mixed_headers is None else mixed_headers
    if multi_line is None or mixed_headers:
        found, odd = _files_by_header(spark, path)
        multi_line = odd if multi_line is None else multi_line
        if mixed_headers and len(found) > 1:
            groups = [[_literal_path(f) for f in files] for files in found]
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    rows: DataFrame | None = None
    for group in groups:
        part = reader.csv(group)
        if missing := [f.name for f in wanted if f.name not in part.columns]:
            raise ValueError(f"{group if isinstance(group, str) else group[0]} has no column {', '.join(missing)}; it has {', '.join(part.columns)}")
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if invalid == "report" and "invalid" in rows.columns:
        raise ValueError(f"{path} has a column named invalid itself")
    typed, problems = [], []
    for f in wanted:
        given = F.col(f"`{f.name}`")
        value = given.try_cast(f.dataType)
        bad = given.isNotNull() & value.isNull()
        if invalid == "fail" and not isinstance(f.dataType, T.StringType):
            told = F.concat(F.lit(f"{f.name} of {path} is no {f.dataType.simpleString()}: "), given)
            value = F.when(bad, F.raise_error(told).cast(f.dataType)).otherwise(value)
        problems.append(F.when(bad, F.struct(F.lit(f.name).alias("column"), given.alias("value"))))
        typed.append(value.alias(f.name))
    listed = [F.filter(F.array(*problems), lambda x: x.isNotNull()).alias("invalid")] if invalid == "report" else []
    return rows.select(*typed, *[F.col(f"`{c}`") for c in rows.columns if c not in wanted.names], *listed)


def write_manifest(df: DataFrame, path: str, sep: str = ",", partition_by: str | None = None,
                   fmt: str = "csv") -> None:
    """Replace ``path``; ``partition_by='split'`` makes one folder per split."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "parquet":
        writer.parquet(path)
        return
    writer.options(
        header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def derived_path(path: str, suffix: str) -> str:
    """``x.tsv`` with suffix ``_output`` gives ``x_output.tsv``; the name has exactly one dot."""
    stem, extension = path.split(".")
    return f"{stem}{suffix}.{extension}"


def ingest_corpus(df: DataFrame, corpus: str, max_index: int = -1, order: str = "row_idx", **columns) -> DataFrame:
    """A downloaded corpus table as a clip manifest: common names, optional cap by position."""
    return normalise_columns(limit_samples(df, max_index, order), corpus, **columns)


def append_metric(df: DataFrame, path: str, run: str | None = None) -> None:
    """Add score rows to a metrics table.

    With ``run`` the rows are those of that run, in a partition of its own: a job that is repeated, or
    stopped and started again, replaces its rows and adds none twice. A table is written with runs or without.
    """
    if run is None:
        df.write.mode("append").parquet(path)
    else:
        keyed = df.withColumn("run", F.lit(run))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def write_with_counts(df: DataFrame, path: str, key: str, **options) -> DataFrame:
    """Write a set to ``<path>/metadata`` and its quota table per ``key`` to ``<path>/value_counts``.

    The table has what the next round reads: count, share, affine part and number of samples.
    """
    write_manifest(df, f"{path}/metadata", **options)
    counts = inverse_quota(cluster_sizes(df, key))
    write_manifest(counts, f"{path}/value_counts", **options)
    return counts
