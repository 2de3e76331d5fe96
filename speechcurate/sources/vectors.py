"""Embedding and cluster tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMBEDDINGS = "filename string, embedding array<float>"
CLUSTERS = "filename string, cluster int"


def read_embeddings(spark: SparkSession, path: str, schema: str = EMBEDDINGS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    df.select("filename", vector, *[c for c in df.columns if c not in ("filename", "embedding")]).write.mode(
        "overwrite"
    ).parquet(path)


def read_clusters(spark: SparkSession, path: str, schema: str = CLUSTERS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_clusters(df: DataFrame, path: str) -> None:
    cluster = F.col("cluster").cast("int").alias("cluster")
    df.select("filename", cluster, *[c for c in df.columns if c not in ("filename", "cluster")]).write.mode(
        "overwrite"
    ).parquet(path)


def import_ivectors(df: DataFrame, name: str = "pic_path", features: str = "features") -> DataFrame:
    """Externally made vectors: file name with extension, features as 32 bit floats."""
    return df.select(
        F.concat(name, F.lit(".wav")).alias("filename"), F.col(features).cast("array<float>").alias("embedding")
    )


def read_text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text archive with one ``name  [ v1 v2 ... ]`` per line."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\S+\s+\["))
    inside = F.trim(F.regexp_extract("value", r"\[(.*)\]", 1))
    return lines.select(
        F.regexp_extract("value", r"^\s*(\S+)", 1).alias("pic_path"),
        F.split(inside, r"\s+").cast("array<double>").alias("features"),
    )


def write_text_vectors(df: DataFrame, path: str, name: str = "pic_path", features: str = "features") -> None:
    numbers = F.array_join(F.col(features).cast("array<string>"), " ")
    df.select(F.concat(name, F.lit("  [ "), numbers, F.lit(" ]")).alias("value")).write.mode("overwrite").text(path)
