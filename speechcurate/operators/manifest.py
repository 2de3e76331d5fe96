"""Projections and filters on clip manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.functions.text import append_extension, basename, clean_transcript, prefix_path, split_of, swap_extension

SPLITS = ("train", "dev", "test")

# Column names of each source corpus, by role.
CORPUS_COLUMNS = {
    "librispeech": {"text": "label", "file": "path", "speaker_id": "speaker"},
    "common_voice": {"sentence": "label", "path": "path", "client_id": "speaker"},
    "voxpopuli": {},
}


def with_split(df: DataFrame, path: str = "file_name") -> DataFrame:
    return df.withColumn("split", split_of(path))


def partition_by_split(df: DataFrame, split: str = "train", path: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(rows of the split, all other rows); a path without a split is among the others.

    ``none`` puts every row into the first frame.
    """
    if split == "none":
        return df, df.filter(F.lit(False))
    tagged = with_split(df, path)
    chosen = F.coalesce(F.col("split") == split, F.lit(False))
    return tagged.filter(chosen), tagged.filter(~chosen)


def clean_manifest(df: DataFrame, variant: str = "sampler", label: str = "sentence") -> DataFrame:
    return df.withColumn(label, clean_transcript(label, variant))


def normalise_columns(df: DataFrame, corpus: str, label: str = "sentence", path: str = "path",
                      speaker: str = "speaker_id", extension: str = ".wav") -> DataFrame:
    """One set of column names and file names for every source corpus.

    ``file_name`` repeats the path column.
    """
    if corpus not in CORPUS_COLUMNS:
        raise ValueError(f"corpus must be one of {tuple(CORPUS_COLUMNS)}")
    roles = {"label": label, "path": path, "speaker": speaker}
    out = df.withColumnsRenamed({old: roles[role] for old, role in CORPUS_COLUMNS[corpus].items()})
    if corpus == "voxpopuli":
        out = out.withColumn(path, F.translate(basename(path), ":", "_"))
    elif corpus == "common_voice":
        out = out.withColumn(path, swap_extension(basename(path), extension))
    else:
        out = out.withColumn(path, swap_extension(path, extension))
    return out.withColumn("file_name", F.col(path))


def limit_samples(df: DataFrame, n: int = -1, order: str = "row_idx") -> DataFrame:
    """Rows 0 to n by position, so n + 1 of them; -1 keeps all."""
    return df if n < 0 else df.filter(F.col(order) <= n)


def filter_speaker(df: DataFrame, speaker_id: str, speaker: str = "speaker_id") -> DataFrame:
    return df.withColumn(speaker, F.col(speaker).cast("string")).filter(F.col(speaker) == str(speaker_id))


def select_speakers(df: DataFrame, first: str, second: str, speaker: str = "speaker_id") -> DataFrame:
    """Rows of two speakers; ``speaker_order`` is 1 for the first and 2 for the second."""
    wanted = F.array(F.lit(str(first)), F.lit(str(second)))
    as_text = F.col(speaker).cast("string")
    return df.filter(as_text.isin(str(first), str(second))).withColumn(
        "speaker_order", F.array_position(wanted, as_text).cast("int")
    )


def require_not_null(df: DataFrame, column: str) -> DataFrame:
    """Fail while running if ``column`` is null or NaN anywhere."""
    value = F.col(column)
    missing = value.isNull()
    if df.schema[column].dataType.typeName() in ("double", "float"):
        missing = missing | F.isnan(value)
    # In a filter, which column pruning cannot drop.
    error = F.raise_error(F.lit(f"missing values in column {column}")).cast("boolean")
    return df.filter(F.when(missing, error).otherwise(F.lit(True)))


def with_path_prefix(df: DataFrame, split: str, folder: str = "clips", path: str = "file_name") -> DataFrame:
    """Move all clips of a table below ``<folder>/<split>/``."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return df.withColumn(path, prefix_path(path, folder, split))


def drop_working_columns(df: DataFrame) -> DataFrame:
    """Drop split, cluster and uncertainty where they exist."""
    return df.drop("split", "cluster", "uncertainty")


def explode_embedding(df: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """One column per dimension: column0, column1, ..."""
    rest = [c for c in df.columns if c != embedding]
    return df.select(*rest, *[F.get(embedding, F.lit(i)).alias(f"column{i}") for i in range(dim)])


def embedding_long(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row per dimension."""
    rest = [c for c in df.columns if c != embedding]
    return df.select(*rest, F.posexplode(embedding).alias("dim", "value"))


def with_mp3(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn(path, append_extension(path, ".mp3"))


def with_label(df: DataFrame, label: int, name: str = "cluster") -> DataFrame:
    return df.withColumn(name, F.lit(label))


def cluster_to_int(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.withColumn(cluster, F.col(cluster).cast("int"))
