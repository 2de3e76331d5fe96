"""Ranked selection against a plain sort: ties, hot groups, many levels, any partitioning."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from speechcurate.operators import selection as S

GOLDEN = [
    (-1, 11555, 0.897964, 0.045610, 527), (1, 288, 0.022381, 0.093749, 26), (3, 182, 0.014144, 0.094202, 17),
    (6, 100, 0.007771, 0.094553, 9), (9, 93, 0.007227, 0.094583, 8), (5, 86, 0.006683, 0.094613, 8),
    (2, 82, 0.006372, 0.094630, 7), (11, 81, 0.006295, 0.094634, 7), (8, 80, 0.006217, 0.094638, 7),
    (7, 77, 0.005984, 0.094651, 7), (0, 72, 0.005595, 0.094672, 6), (10, 69, 0.005362, 0.094685, 6),
    (12, 52, 0.004041, 0.094758, 4), (4, 51, 0.003963, 0.094762, 4),
]


def test_quota_golden(spark):
    sizes = spark.createDataFrame([(c, n) for c, n, *_ in GOLDEN], "cluster int, count long")
    rows = {r.cluster: r for r in S.inverse_quota(sizes, 0.04, 0.09498, 1).collect()}
    for c, _, share, affine, num in GOLDEN:
        r = rows[c]
        assert (round(r.sample_percentage, 6), round(r.affine_linear, 6), r.num_samples) == (share, affine, num)
    assert sum(r.num_samples for r in rows.values()) == 643
    now = {r.cluster: r.num_samples for r in S.inverse_quota(sizes).collect()}
    assert [now[c] for c, *_ in GOLDEN] == [2092, 108, 68, 36, 32, 32, 28, 28, 28, 28, 24, 24, 16, 16]


def rows_with_ties(n: int = 4_000) -> list[tuple]:
    """A third of all rows in one cluster, a third of those with one score, some scores missing."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        cluster = 0 if i % 3 else rng.randint(1, 30)
        score = 0.5 if rng.random() < 0.4 else rng.choice([None, math.nan, 0.0, -0.0, rng.random(), rng.randint(0, 3) / 4])
        rows.append((f"c{i}.wav", cluster, score, i))
    rng.shuffle(rows)
    return rows


SCHEMA = "file_name string, cluster int, uncertainty double, row_idx long"


def best(rows, n):
    def key(r):
        missing = r[2] is None or math.isnan(r[2])
        return missing, 0.0 if missing else -r[2], r[3]
    return {r[0] for r in sorted(rows, key=key)[:n]}


@pytest.mark.parametrize("rows_per_task", [3, 100, 10_000])
@pytest.mark.parametrize("parts", [1, 7])
def test_top_per_cluster(spark, rows_per_task, parts):
    rows = rows_with_ties()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    need = {c: (n * 7) % 50 for n, c in enumerate(range(31))} | {0: 1_234, 5: 10_000}
    quota = spark.createDataFrame(list(need.items()), "cluster int, num_samples long")
    got = S.take_ranked(df, S.ScoreOrder(), quota, "cluster", rows_per_task)
    assert got.columns == df.columns
    want = set()
    for c, n in need.items():
        want |= best([r for r in rows if r[1] == c], n)
    names = [r.file_name for r in got.collect()]
    assert len(names) == len(set(names)) and set(names) == want


@pytest.mark.parametrize("n", [0, 1, 1_777, 4_000, 9_999])
@pytest.mark.parametrize("rows_per_task", [5, 10_000])
def test_top_of_all(spark, n, rows_per_task):
    rows = rows_with_ties()
    got = S.take_ranked(spark.createDataFrame(rows, SCHEMA), S.ScoreOrder(), n, rows_per_task=rows_per_task)
    assert {r.file_name for r in got.collect()} == best(rows, n)


def by_digest(names, n, seed=42):
    return set(sorted(names, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))[:n])


@pytest.mark.parametrize("rows_per_task", [2, 10_000])
def test_digest_order(spark, rows_per_task):
    rows = rows_with_ties()
    df = spark.createDataFrame(rows, SCHEMA)
    kept, rest = S.split_ranked(df, S.DigestOrder(), 700, rows_per_task=rows_per_task)
    kept, rest = ({r.file_name for r in x.collect()} for x in (kept, rest))
    assert kept == by_digest([r[0] for r in rows], 700)
    assert kept | rest == {r[0] for r in rows} and not kept & rest


def test_split_by_group_keeps_rows_without_quota(spark):
    rows = rows_with_ties(600)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.when(F.col("cluster") != 3, F.col("cluster")))
    quota = spark.createDataFrame([(0, 100)], "cluster int, num_samples long")
    kept, rest = S.split_ranked(df, S.DigestOrder(), quota, "cluster")
    assert (kept.count(), rest.count()) == (100, 500)


def test_sample_sizes(spark):
    rows = rows_with_ties()
    df = spark.createDataFrame(rows, SCHEMA)
    size = {c: sum(r[1] == c for r in rows) for c in range(31)}
    got = {r.cluster: r["count"] for r in S.sample_stratified(df, 0.05).groupBy("cluster").count().collect()}
    assert got == {c: round(0.05 * n) for c, n in size.items() if round(0.05 * n)}
    assert S.sample_frac(df, 0.05).count() == 200
    assert S.sample_n(df, 17).count() == 17
    with pytest.raises(ValueError):
        S.sample_n(df, 4_001)
    train, test = S.train_test_split(df, 0.3)
    assert (train.count(), test.count()) == (2_800, 1_200)
    with pytest.warns(UserWarning):
        few = S.sample_n_per_cluster(df, 500).groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in few} == {c: min(500, n) for c, n in size.items()}
    with pytest.warns(UserWarning):
        many = S.sample_n_per_cluster(df, 1_500).groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in many} == {c: min(1_500, n) for c, n in size.items()}


def test_inverse_needs_a_quota_for_every_cluster(spark):
    df = spark.createDataFrame(rows_with_ties(300), SCHEMA)
    with pytest.raises(ValueError):
        S.sample_inverse(df, spark.createDataFrame([(0, 5)], "cluster int, num_samples long"))
    with pytest.raises(ValueError):
        S.sample_inverse(df, ymin=0.9, ymax=0.9, mult=4)


def test_select_batch(spark):
    rows = rows_with_ties(900)
    df = spark.createDataFrame(rows, SCHEMA)
    quota = S.inverse_quota(S.cluster_sizes(df))
    n = quota.agg(F.sum("num_samples")).first()[0]
    for algorithm in S.ALGORITHMS:
        assert S.select_batch(df, quota, algorithm).count() == n
    with pytest.raises(ValueError):
        S.select_batch(df, quota, "best")


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.top_uncertain(df, 5).count() == 0
    assert S.sample_frac(df).count() == 0
    assert S.top_uncertain_per_cluster(df, spark.createDataFrame([(0, 3)], "cluster int, num_samples long")).count() == 0


@pytest.mark.parametrize("rows_per_task", [4, 10_000])
def test_exact_sizes_for_repeated_and_null_keys(spark, rows_per_task):
    rows = [(f"f{i % 5}" if i % 4 else None, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "file_name string, cluster int")
    kept, rest = S.split_ranked(df, S.DigestOrder(), 37, rows_per_task=rows_per_task)
    assert (kept.count(), rest.count()) == (37, 63)
    assert sorted(kept.union(rest).collect(), key=repr) == sorted(df.collect(), key=repr)
    train, test = S.train_test_split(df)
    assert (train.count(), test.count()) == (70, 30)
    for n in (5, 1_200):
        sizes = {r.cluster: r["count"] for r in S.sample_n_per_cluster(df, n).groupBy("cluster").count().collect()}
        assert sizes == {0: min(n, 50), 1: min(n, 50)}


@pytest.mark.parametrize("rows_per_task", [4, 10_000])
def test_ties_and_infinite_scores(spark, rows_per_task):
    inf = float("inf")
    scores = [inf, -inf, None, 1.0, 1.0, 2.0, -0.0, 0.0, 1e308, -1e308, 5e-324]
    rows = [(scores[i % 11], i % 3, f"f{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "uncertainty double, row_idx long, file_name string")
    want = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0], r[1], r[2]))
    for n in (1, 7, 150, 399, 400):
        got = S.take_ranked(df, S.ScoreOrder(), n, rows_per_task=rows_per_task).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want[:n], key=repr)
    assert S.top_uncertain(df.drop("row_idx"), 9).count() == 9


@pytest.mark.parametrize("rows_per_task", [50, 10_000])
def test_a_cut_inside_a_hot_key(spark, rows_per_task):
    """A third of the rows have no key, and quotas end among them: the rows are told by hashes, equal ones by their number."""
    rows = [(None if i % 3 == 0 else f"f{i}", i % 2, i % 400) for i in range(1_800)]
    df = spark.createDataFrame(rows, "file_name string, cluster int, n int")
    order = S.ScoreOrder(score="none", tie="none", path="file_name")
    flat = df.withColumn("none", F.lit(1.0))
    kept, rest = S.split_ranked(flat, order, 130, rows_per_task=rows_per_task)
    assert (kept.count(), rest.count()) == (130, 1_670) and kept.filter("file_name is not null").isEmpty()
    assert sorted(kept.union(rest).collect(), key=repr) == sorted(flat.collect(), key=repr)
    again = S.split_ranked(flat.repartition(13), order, 130, rows_per_task=rows_per_task)[0]
    assert sorted(again.collect(), key=repr) == sorted(kept.collect(), key=repr)
    assert "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()
    quota = spark.createDataFrame([(0, 77), (1, 211)], "cluster int, num_samples long")
    first, second = S.split_ranked(flat, order, quota, "cluster", rows_per_task=rows_per_task)
    assert {r.cluster: r["count"] for r in first.groupBy("cluster").count().collect()} == {0: 77, 1: 211}
    assert sorted(first.union(second).collect(), key=repr) == sorted(flat.collect(), key=repr)
