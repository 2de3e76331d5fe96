"""Two rounds of active learning: the batches and the pool add up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from speechcurate.catalog import standins as D
from speechcurate.operators.joins import assert_disjoint, assign_cluster
from speechcurate.operators.manifest import partition_by_split
from speechcurate.operators.selection import cluster_sizes, inverse_quota
from speechcurate.operators.stats import assert_quota
from speechcurate.plans import rounds as R

FOLDER = "/root/testdata/sf0.01"


def test_two_rounds(spark):
    pool = D.clips(spark, FOLDER)
    scores, clusters = D.uncertainties(spark, FOLDER), D.skewed_clusters(spark, FOLDER)
    seen = []
    for _ in range(2):
        before = pool
        train = assign_cluster(partition_by_split(pool, "train")[0], clusters)
        sizes = cluster_sizes(train)
        quota = inverse_quota(sizes)
        batch = R.active_round(pool, scores, clusters, quota)
        assert batch.count() == quota.agg(F.sum("num_samples")).first()[0] > 0
        pool = R.update_pool(pool, batch.drop("uncertainty", "split"))
        assert_disjoint(batch, pool)
        assert pool.count() + batch.count() == before.count()
        assert pool.columns == before.columns
        now = cluster_sizes(assign_cluster(partition_by_split(pool, "train")[0], clusters))
        assert_quota(sizes, quota, now)
        for other in seen:
            assert_disjoint(batch, other)
        seen.append(batch)


def test_same_batch_for_any_partitioning(spark):
    pool, scores, clusters = (f(spark, FOLDER) for f in (D.clips, D.uncertainties, D.skewed_clusters))
    quota = inverse_quota(cluster_sizes(clusters))
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            batch = R.active_round(pool.repartition(int(n)), scores, clusters, quota)
            found.append({r.file_name for r in batch.select("file_name").collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("method", list(R.SAMPLERS))
def test_cluster_sample_keeps_other_splits(spark, method):
    rows = D.transcripts(spark, FOLDER)
    got = R.cluster_sample(rows, D.skewed_clusters(spark, FOLDER), method)
    others = rows.filter("split(file_name, '/')[1] <> 'train'").count()
    assert got.filter("split <> 'train'").count() == others
    assert 0 < got.filter("split = 'train'").count() < rows.count() - others


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        R.cluster_sample(D.transcripts(spark, FOLDER), D.skewed_clusters(spark, FOLDER), "other")


def test_files_of_a_round_keep_the_order_of_equal_scores(spark, tmp_path):
    """All scores are equal and the batch ends within them: the order of the rows decides, not that of their paths."""
    import __spark_entry__ as entry
    from tests.oracle import compare, connect

    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("value", F.lit(0.5)).toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    name = "R11_files_to_files"
    problem, rows = compare(spark, connect(str(tmp_path)), entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert problem is None and 0 < rows < events.count()
