"""Repeated windows against a brute-force version, odd rows and long texts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speechcurate.llm import repeats
from speechcurate.llm.text import Words, buffers

SCHEMA = "doc_id long, text string, kept int"


def brute(rows, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = [float("inf") if i is None else i for i, _ in rows]
    owner = {}
    for k, w in zip(key, words):
        for i in range(len(w) - n + 1):
            run = tuple(w[i : i + n])
            owner[run] = min(owner.get(run, k), k)
    out = []
    for (doc, _), k, w in zip(rows, key, words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if owner[tuple(w[i : i + n])] < k:
                gone[i : i + n] = True
        out.append((doc, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def made(seed, docs=60):
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"p{i}w{j}" for j in range(rng.integers(3, 30))) for i in range(4)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.integers(0, 6)):
            parts.append(passages[rng.integers(4)] if rng.random() < 0.5 else " ".join(f"é{x}" for x in rng.integers(0, 3, rng.integers(0, 12))))
        rows.append((int(rng.integers(0, docs)) if rng.random() < 0.9 else None, "\n\t ".join(parts) if rng.random() < 0.95 else None))
    return rows + rows[:7]


@pytest.mark.parametrize("n", [1, 3, 13])
def test_against_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    for seed in range(2):
        rows = made(seed)
        out = repeats.drop_repeated_windows(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), n)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=repr)
        assert got == brute(rows, n)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "x " + long), (5, long), (None, long), (None, "a b"), (4, long)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).withColumn("removed", F.lit("clash"))
    out = repeats.drop_repeated_windows(df).select("doc_id", "n_words", "n_removed", F.length("kept").alias("chars"), F.size("removed").alias("runs")).collect()
    n, chars = 300_000, len(long)
    assert sorted(map(tuple, out), key=repr) == sorted(
        [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, n, 0, chars, 0), (4, n, 0, chars, 0), (5, n + 1, n, 1, 1), (5, n, n, 0, 1), (None, n, n, 0, 1), (None, 2, 0, 3, 0)], key=repr)
    assert repeats.drop_repeated_windows(df.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = made(5)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    monkeypatch.setattr(repeats.window_filter, "__defaults__", (1,))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.drop_repeated_windows(df, 5).collect()), key=repr)
    assert got == brute(rows, 5)


def test_rolled_hash_is_that_of_each_window():
    words = Words(*buffers(pa.array(["a b c a b c d"])))
    key, off = repeats.rolling_windows(words, 3)
    assert off.tolist() == [0, 5] and key[0] == key[3] and len(set(key.tolist())) == 4


def test_packed_values_come_back():
    for values in ([5], [0, 1], [1, 2**40, 2**40 + 3, 2**63 - 1], list(range(0, 10**6, 997))):
        x = np.array(values, np.uint64)
        assert repeats.unpack(int(x[0]), len(x), repeats.pack(x)).tolist() == values


def test_small_runs_and_unique_ids(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SENT", 40)
    rows = [(i, t) for i, (_, t) in enumerate(made(9, 200))]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(7)
    for hot in (32, 1, 0):  # the last two send nearly all windows the way of hot ones
        monkeypatch.setattr(repeats.removal_intervals, "__defaults__", (repeats.WORDS, hot))
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.drop_repeated_windows(df, 4).collect()), key=repr) == brute(rows, 4)
