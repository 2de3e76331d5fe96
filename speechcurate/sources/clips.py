"""Folders of clips: scan, write, copy."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechcurate.functions.text import basename
from speechcurate.operators.manifest import SPLITS
from speechcurate.session import file_system, materialise, ship_package

# Bytes of a file that are held while it is copied.
COPY_BYTES = 8 << 20
MODES = ("keep", "same", "split", *SPLITS)


def scan_clips(spark: SparkSession, folder: str, extension: str = ".wav") -> DataFrame:
    """``(file_name, path, length, content)`` of the clips right in a folder; content is read only if used.

    Spark lists no files of zero bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder)
    return files.select(basename("path").alias("file_name"), "path", "length", "content")


def put_parts(system: fs.FileSystem, target: str, parts: Iterable[bytes]) -> None:
    """Write beside the target and move into place, so that retries and copies of a task do no harm."""
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as out:
            for content in parts:
                out.write(content)
        system.move(part, target)
    except Exception:
        if system.get_file_info(part).type == fs.FileType.File:
            system.delete_file(part)
        raise


def report(df: DataFrame, act, columns: str) -> DataFrame:
    """Run ``act`` per row in tasks; the written report says which rows failed and why."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for row in pdf.itertuples(index=False):
                try:
                    act(row)
                    errors.append(None)
                except Exception as problem:  # reported per file
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pdf[names].assign(error=errors)

    ship_package(df.sparkSession)
    return materialise(df.mapInPandas(run, f"{columns}, error string"), "files")


def write_clips(encoded: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` of every row to ``<folder>/<base name>``; gives ``(file_name, error)``."""
    def act(row) -> None:
        system, root = file_system(folder)
        put_parts(system, f"{root.rstrip('/')}/{row.file_name.rsplit('/', 1)[-1]}", [row.content])

    return report(encoded.select("file_name", "content"), act, "file_name string")


def clip_copy_plan(df: DataFrame, source: str, target: str, path: str = "file_name", mode: str = "keep",
                   relative: bool = True, part: str = "") -> DataFrame:
    """Add ``src`` and ``dst`` of every clip of a manifest.

    ``keep`` keeps the relative path. ``train``, ``dev`` and ``test`` put the clip
    under ``clips/<split>/`` and change the manifest's path too. ``same`` keeps the
    path, ``split`` keeps it below ``<target><part>``; both put bare names under
    ``clips/``. ``relative=False`` says that source paths lack their ``clips/``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    name = F.col(path)
    src = F.concat(F.lit(f"{source}/" if relative else f"{source}/clips/"), name)
    if mode in SPLITS:
        moved = F.concat(F.lit(f"clips/{mode}/"), name)
        return df.withColumns({"src": src, "dst": F.concat(F.lit(f"{target}/"), moved), path: moved})
    root = target + (part if mode == "split" else "")
    bare = F.lit(mode != "keep") & (name == basename(path))
    dst = F.concat(F.lit(f"{root}/"), F.when(bare, F.lit("clips/")).otherwise(F.lit("")), name)
    return df.withColumns({"src": src, "dst": dst})


def speaker_copy_plan(df: DataFrame, source: str, target: str, first: str, path: str = "file_name",
                      speaker: str = "speaker_id") -> DataFrame:
    """Clips of the first speaker go to ``speaker1/``, all others to ``speaker2/``."""
    folder: Column = F.when(F.col(speaker).cast("string") == first, F.lit("speaker1")).otherwise(F.lit("speaker2"))
    return df.withColumns({
        "src": F.concat(F.lit(f"{source}/"), F.col(path)),
        "dst": F.concat_ws("/", F.lit(target), folder, basename(path)),
    })


def copy_clips(plan: DataFrame) -> DataFrame:
    """Copy ``src`` to ``dst`` in tasks; gives ``(src, dst, error)``. Repeating it changes nothing."""
    def act(row) -> None:
        reader, source = file_system(row.src)
        writer, target = file_system(row.dst)
        with reader.open_input_stream(source) as stream:
            put_parts(writer, target, iter(lambda: stream.read(COPY_BYTES), b""))

    return report(plan.select("src", "dst").distinct(), act, "src string, dst string")


