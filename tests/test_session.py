"""Tables beyond the small bound take another way and give the same rows; workers find the package."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from speechcurate import session
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
WITH_SMALL_TABLES = [
    "W1_number_clients", "W4_top_per_cluster", "R2_sample_per_cluster", "R4_sample_stratified", "R5_inverse_quota",
    "R6_sample_inverse", "R7_train_test_split", "R11_update_pool", "J12_speaker_count", "V1_dbscan", "T4_silhouette_profile",
    "V10_separation_by_speaker",
]


@pytest.mark.parametrize("name", WITH_SMALL_TABLES)
def test_beyond_the_bound(spark, monkeypatch, name):
    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    problem, _ = compare(spark, connect(FOLDER), entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert problem is None


def test_small_table(spark):
    df = spark.range(5)
    assert session.small_table(df, limit=5)[1].num_rows == 5
    table, rows = session.small_table(df, limit=4)
    assert rows is None and table.count() == 5
    empty, rows = session.small_table(df.limit(0))
    assert rows.num_rows == 0 and empty.schema == df.schema


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, w int")
    assert [tuple(r) for r in session.join_on(a, b, ["k"]).collect()] == [(None, 1, 3)]
    assert session.join_on(a, b, ["k"], "left_anti").count() == 1


SCRIPT = """
import sys
sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
from speechcurate.catalog.standins import audio
from speechcurate.operators.audio import clip_durations, encode_clips
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
n = clip_durations(encode_clips(audio(spark, {folder!r}))).filter("error is null").count()
from speechcurate.session import clear_scratch
clear_scratch(spark)
print("clips", n)
"""


def test_workers_import_the_package_from_anywhere(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(home=home, folder=FOLDER)], cwd=tmp_path, env=env,
        capture_output=True, text=True, timeout=240,
    )
    assert "clips 500" in done.stdout, done.stderr[-2_000:]
