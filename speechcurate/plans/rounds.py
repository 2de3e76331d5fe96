"""The jobs of active learning: training set, first sample, round, pool update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.operators.joins import assign_cluster, join_uncertainty, subset_violations, subtract_subset
from speechcurate.operators.manifest import clean_manifest, partition_by_split, with_path_prefix
from speechcurate.operators.selection import (
    sample_frac, sample_inverse, sample_stratified, select_batch, train_test_split,
)
from speechcurate.operators.sets import reattach, union_manifests
from speechcurate.session import materialise

SAMPLERS = {"stratified": sample_stratified, "random": sample_frac, "inverse": sample_inverse}


def active_round(manifest: DataFrame, uncertainties: DataFrame | None, clusters: DataFrame, quota: DataFrame,
                 algorithm: str = "inverse", path: str = "file_name", order: str = "row_idx",
                 cluster_order: str | None = None) -> DataFrame:
    """Next batch of training clips; other splits are not part of it.

    The joined train rows are written once, as the selection reads narrow columns
    of them several times.
    """
    train, _ = partition_by_split(manifest, "train", path)
    if algorithm != "random":
        train = join_uncertainty(train, uncertainties, path)
    train = materialise(assign_cluster(train, clusters, path, order=cluster_order), "train")
    return select_batch(train, quota, algorithm, key=path, tie=order)


def cluster_sample(manifest: DataFrame, clusters: DataFrame, method: str = "stratified", split: str = "train",
                   path: str = "file_name", label: str = "sentence", cluster_order: str | None = None,
                   **options) -> DataFrame:
    """First training set: clean, set other splits aside, sample by cluster, put them back."""
    if method not in SAMPLERS:
        raise ValueError(f"method must be one of {tuple(SAMPLERS)}")
    train, others = partition_by_split(clean_manifest(manifest, "sampler", label), split, path)
    train = materialise(assign_cluster(train, clusters, path, order=cluster_order), "train")
    sampled = SAMPLERS[method](train, key=path, **options)
    return reattach(sampled, others).withColumn("file_name", F.col(path))


def update_pool(pool: DataFrame, chosen: DataFrame, path: str = "file_name", order: str = "row_idx") -> DataFrame:
    """Pool for the next round: train rows less the chosen ones, other splits unchanged.

    Chosen train rows whose path isn't in the pool are an error: they would go unnoticed.
    """
    train, others = partition_by_split(pool, "train", path)
    strangers = subset_violations(train, partition_by_split(chosen, "train", path)[0], path).select(path).limit(5).collect()
    if strangers:
        raise ValueError(f"chosen rows that are not in the pool: {[r[0] for r in strangers]}")
    left = subtract_subset(train, chosen.drop("cluster"), path, order)
    return reattach(left, others).drop("split")


def build_training_set(first: DataFrame, second: DataFrame, test_size: float = 0.3, key: str = "file_name",
                       seed: int | str = 42, label: str = "sentence") -> DataFrame:
    """Train and dev manifest: 1 - test_size of the first corpus and all of the second train, the rest is dev."""
    kept, held_out = train_test_split(first, test_size, key, seed)
    train = with_path_prefix(union_manifests(kept, second), "train", path=key)
    dev = with_path_prefix(held_out, "dev", path=key)
    return clean_manifest(union_manifests(train, dev), "creator", label)
