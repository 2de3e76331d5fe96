"""The driver's tables seen as clips, transcripts, embeddings, clusters and hypotheses.

Each stand-in exists as a DataFrame here and as SQL text for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _split_path(number: str) -> Column:
    n = F.col(number)
    part = F.when(n % 10 < 8, "train").when(n % 10 == 8, "dev").otherwise("test")
    return F.concat(F.lit("clips/"), part, F.lit("/"), n.cast("string"), F.lit(".wav"))


def _name(number: str) -> Column:
    return F.concat(F.col(number).cast("string"), F.lit(".wav"))


def clips(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        _split_path("event_id").alias("file_name"),
        F.col("user_id").cast("string").alias("speaker_id"),
        F.col("value").alias("duration"),
        F.col("event_id").alias("row_idx"),
    )


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        _split_path("doc_id").alias("file_name"),
        F.col("text").alias("sentence"),
        F.col("source").alias("speaker_id"),
        "lang",
        F.col("doc_id").alias("row_idx"),
    )


def emb(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        _name("vec_id").alias("filename"), "embedding", F.col("label").alias("cluster"), F.col("vec_id").alias("row_idx")
    )


def skewed_clusters(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        _name("event_id").alias("filename"),
        F.when(F.floor(e / 10) % 10 < 9, F.lit(-1)).otherwise(e % 13).cast("int").alias("cluster"),
        e.alias("row_idx"),
    )


def uncertainties(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        _split_path("event_id").alias("file_name"), F.col("value").alias("uncertainty")
    )


def hypotheses(spark: SparkSession, folder: str, passes: int = 20) -> DataFrame:
    item = table(spark, folder, "benchmark").select(
        _name("item_id").alias("file_name"), F.split("text", " ").alias("w"),
        F.explode(F.sequence(F.lit(0), F.lit(passes))).alias("pass_no"),
    )
    kept = F.filter("w", lambda x, i: (F.col("pass_no") == 0) | ((i + F.col("pass_no")) % 7 != 0))
    return item.select("file_name", "pass_no", F.array_join(kept, " ").alias("text"))


def audio(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a short waveform at 16 kHz."""
    return emb(spark, folder).select(
        F.col("filename").alias("file_name"),
        F.lit(16_000).alias("sample_rate"),
        F.lit(1).alias("channels"),
        F.col("embedding").alias("samples"),
    )


def _sql_path(n: str) -> str:
    return (
        f"'clips/' || CASE WHEN {n} % 10 < 8 THEN 'train' WHEN {n} % 10 = 8 THEN 'dev' ELSE 'test' END "
        f"|| '/' || {n} || '.wav'"
    )


VIEWS = {
    "clips": f"SELECT {_sql_path('event_id')} AS file_name, CAST(user_id AS VARCHAR) AS speaker_id, "
             "value AS duration, event_id AS row_idx FROM events",
    "transcripts": f"SELECT {_sql_path('doc_id')} AS file_name, text AS sentence, source AS speaker_id, lang, "
                   "doc_id AS row_idx FROM documents",
    "emb": "SELECT vec_id || '.wav' AS filename, CAST(embedding AS DOUBLE[]) AS embedding, label AS cluster, "
           "vec_id AS row_idx FROM embeddings",
    "skewed_clusters": "SELECT event_id || '.wav' AS filename, CAST(CASE WHEN event_id // 10 % 10 < 9 THEN -1 "
                       "ELSE event_id % 13 END AS INTEGER) AS cluster, event_id AS row_idx FROM events",
    "uncertainties": f"SELECT {_sql_path('event_id')} AS file_name, value AS uncertainty FROM events",
    "hypotheses": "SELECT item_id || '.wav' AS file_name, p AS pass_no, CASE WHEN p = 0 THEN text ELSE "
                  "array_to_string(list_filter(string_split(text, ' '), lambda x, i: (i - 1 + p) % 7 <> 0), ' ') END "
                  "AS text FROM benchmark, range(0, 21) r(p)",
}


def sql(views: str, body: str) -> str:
    """``body`` behind the named stand-ins; it starts with SELECT or with further common tables."""
    named = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("RECURSIVE", "", 1)
    glue = " " if body.lstrip().upper().startswith("SELECT") else ", "
    return f"WITH {recursive}{named}{glue}{body}" if named else body
