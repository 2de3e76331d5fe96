"""Session helpers: shared scratch space, stable intermediates, small tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables up to this many rows are turned into a local relation, whose exact size
# Catalyst knows; larger ones are written out and joined by shuffle.
SMALL_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediates: the session's own, else one for local tests."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="speechcurate-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path below it, in a task; names are taken as they are, not as URI escapes."""
    return fs.FileSystem.from_uri(path if path.startswith("/") else quote(path, safe="/:@"))


def _hadoop(spark: SparkSession, path: str):
    """Spark's own view of a path, for the driver: (file system, path)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    home, application = Path(__file__).parent, spark.sparkContext.applicationId
    if application in _shipped or not home.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for module in sorted(home.rglob("*.py")):
            archive.write(module, module.relative_to(home.parent))
    path = f"{scratch_path(spark, 'package')}.zip"
    system, target = _hadoop(spark, path)
    out = system.create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables this process has made; results not yet computed from them are lost."""
    while _scratch:
        system, target = _hadoop(spark, _scratch.pop())
        system.delete(target, True)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and keeps column pruning,
    filter pushdown and size statistics for whatever reads the result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, name: str = "small", limit: int | None = None) -> tuple[DataFrame, pa.Table | None]:
    """Evaluate an aggregate once; return it, and its rows too if they are few.

    At most ``limit + 1`` rows reach the driver (100,000 by default). Up to ``limit`` rows come back as
    a local relation, so Catalyst can broadcast it by its true size. A larger
    table is written to the shared folder instead and no rows are returned.
    """
    limit = SMALL_ROWS if limit is None else limit
    head = df.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        return df.sparkSession.createDataFrame(head, schema=df.schema), head
    return materialise(df, name), None


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match each other; the right key columns are dropped."""
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    cond = F.lit(True)
    for i, k in enumerate(keys):
        test = left[f"`{k}`"].eqNullSafe(renamed[f"__r_{k}"])
        cond = test if i == 0 else cond & test
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])
