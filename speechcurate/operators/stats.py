"""Counts, durations and audits."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.functions.moments import moments
from speechcurate.functions.text import corpus_of
from speechcurate.operators.selection import cluster_sizes
from speechcurate.session import join_on


def _top(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    ordered = df.orderBy(F.col(by).desc(), F.col(key).asc())
    return ordered if n < 0 else ordered.limit(n)


def _sizes(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"))


def speaker_counts(df: DataFrame, n: int = -1, speaker: str = "speaker_id") -> DataFrame:
    """Clips per speaker, largest first; n >= 0 keeps the first n."""
    return _top(_sizes(df, speaker), "count", speaker, n)


def number_of_speakers(df: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    return df.agg(F.countDistinct(speaker).alias("speakers"))


def speaker_count_stats(df: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Mean, variance, skew, kurtosis of clips per speaker, and speakers with one clip."""
    c = F.col("count")
    return _sizes(df, speaker).agg(*moments(c.cast("double")), F.count_if(c == 1).alias("ones"))


def total_duration(df: DataFrame, duration: str = "duration") -> DataFrame:
    return df.agg(F.sum(duration).alias("total_seconds"))


def duration_per_speaker(df: DataFrame, n: int = -1, speaker: str = "speaker_id",
                         duration: str = "duration", digits: int | None = None) -> DataFrame:
    """Seconds per speaker, longest first; ``digits`` rounds the sums before they are ordered."""
    total = F.sum(duration) if digits is None else F.round(F.sum(duration), digits)
    return _top(df.groupBy(speaker).agg(total.alias("seconds")), "seconds", speaker, n)


def duration_stats(df: DataFrame, duration: str = "duration") -> DataFrame:
    return df.agg(*moments(F.col(duration)))


def cluster_overlap(clusters: DataFrame) -> DataFrame:
    """How many clips of each corpus a cluster holds, and the smaller of both numbers."""
    corpus = corpus_of("filename")
    per_cluster = clusters.groupBy("cluster").agg(
        F.count_if(corpus == "librispeech").alias("librispeech"),
        F.count_if(corpus == "common_voice").alias("common_voice"),
    )
    return per_cluster.withColumn("overlap", F.least("librispeech", "common_voice"))


def cluster_total(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count("cluster").alias("elements"))


def min_cluster_size(df: DataFrame, n: int | None = None) -> DataFrame:
    """Size of the smallest cluster; warns when ``n`` is larger."""
    smallest = cluster_sizes(df).agg(F.min("count").alias("smallest"))
    if n is not None:
        size = smallest.first()[0]
        if size is not None and n > size:
            warnings.warn(f"{n} is more than the smallest cluster holds ({size})", stacklevel=2)
    return smallest


def duplicate_count(df: DataFrame, path: str = "file_name") -> DataFrame:
    """Rows whose path occurred before; null counts as one path."""
    return df.groupBy(path).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")
    )


def duplicated_rows(df: DataFrame) -> DataFrame:
    """All copies of rows that occur more than once, equal in every column."""
    keys = df.columns
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return join_on(df, repeated, keys, "left_semi")


def unassigned_count(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.agg(F.count_if(F.col(cluster).isNull()).alias("unassigned"))


def quota_audit(previous: DataFrame, quota: DataFrame, current: DataFrame) -> DataFrame:
    """Previous size - quota - current size per cluster; 0 everywhere when a round added up."""
    sign = [
        previous.select("cluster", F.col("count").alias("v")),
        quota.select("cluster", (-F.col("num_samples")).alias("v")),
        current.select("cluster", (-F.col("count")).alias("v")),
    ]
    return sign[0].unionByName(sign[1]).unionByName(sign[2]).groupBy("cluster").agg(F.sum("v").alias("diff"))


def assert_quota(previous: DataFrame, quota: DataFrame, current: DataFrame) -> None:
    bad = quota_audit(previous, quota, current).filter("diff <> 0").limit(10).collect()
    if bad:
        raise ValueError(f"cluster sizes do not add up: {bad}")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))
