"""Separation studies: how well do embeddings tell two sources apart."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechcurate.operators.audio import embed_noise_levels
from speechcurate.operators.manifest import select_speakers
from speechcurate.operators.ordering import dense_numbers
from speechcurate.operators.projection import fit_pca
from speechcurate.operators.joins import align
from speechcurate.operators.sets import merge_embeddings
from speechcurate.operators.silhouette import BLOCK_ROWS, distance_sums, silhouette_by
from speechcurate.session import materialise


def separation_by_snr(first: DataFrame, second: DataFrame, level: str = "snr",
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Silhouette of two corpora for every noise level, all levels in one job.

    File names repeat between levels, so the level is part of the key.
    """
    merged = merge_embeddings(first, second).withColumn(
        "filename", F.concat_ws("@", "filename", "cluster", F.col(level).cast("string"))
    )
    clusters = merged.select("filename", "cluster")
    return silhouette_by(merged.drop("cluster"), clusters, level, block_rows)


def separation_from_audio(first: DataFrame, second: DataFrame, noise: np.ndarray, levels: list[float],
                          encoder: Callable, tasks: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(snr, score)``: silhouette of two corpora of clips for every noise level, from audio, as one plan.

    Each clip is decoded once and mixed and embedded for all levels in its task;
    only the vectors are written, once, before the distances are taken.
    """
    def vectors(audio: DataFrame, name: str) -> DataFrame:
        return materialise(embed_noise_levels(audio, noise, levels, encoder, tasks).drop("snr"), name)

    # Levels need not be whole numbers, their places are.
    scores = separation_by_snr(vectors(first, "first-vectors"), vectors(second, "second-vectors"), "level_no", block_rows)
    level = F.element_at(F.array(*[F.lit(float(v)) for v in levels]), (F.col("level_no") + 1).cast("int"))
    return scores.select(level.alias("snr"), "score")


def separation_by_speaker(reference: DataFrame, speakers: DataFrame, speaker: str = "speaker_id",
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Silhouette of each speaker's clips against one reference corpus.

    All speakers share one table of distance sums: the reference is label 0 and
    each speaker a label of its own, so distances inside the reference are summed
    once, and speakers are not compared with each other. The only clip of a
    speaker scores 0. Speaker ids may be of any type; null is no speaker.
    """
    numbers = dense_numbers(speakers.select(speaker).filter(F.col(speaker).isNotNull()).distinct(), speaker, "label")
    known = speakers.join(numbers, speaker).select("label", "filename", "embedding")
    points = reference.select(
        F.lit(0).cast("long").alias("part"), F.col("filename").alias("name"), F.lit(-1).cast("long").alias("label"),
        F.col("embedding").alias("vec"),
    ).unionByName(known.select(
        F.lit(0).cast("long").alias("part"), F.col("filename").alias("name"), "label", F.col("embedding").alias("vec"),
    ))
    d = distance_sums(points, block_rows, hub=-1)
    n_reference = d.sizes.filter("label = -1").select("n").first()
    if n_reference is None:
        raise ValueError("the reference has no clips")
    n_ref = F.lit(n_reference[0])
    size = d.sizes.filter("label <> -1").select("label", F.col("n").alias("n_speaker"))

    def score(a: Column, b: Column) -> Column:
        """``a`` is null for the only clip of its label."""
        widest = F.greatest(a, b)
        return F.when(a.isNull() | (widest == 0), F.lit(0.0)).otherwise((b - a) / widest)

    # The quadratic part is written once; three aggregations read it.
    sums = materialise(d.sums, "distance-sums")
    ref = sums.filter("label = -1")
    inside = ref.filter("other = -1").select("id", (F.col("sum_d") / F.nullif(n_ref - 1, F.lit(0))).alias("a"))
    of_ref = ref.filter("other <> -1").join(inside, "id").join(
        size.withColumnRenamed("label", "other"), "other"
    ).select(F.col("other").alias("label"), score(F.col("a"), F.col("sum_d") / F.col("n_speaker")).alias("s"))

    own = sums.filter("label <> -1 and (other = -1 or other = label)").join(size, "label")
    of_speaker = own.groupBy("label", "id", "n_speaker").agg(
        F.max(F.when(F.col("other") == -1, F.col("sum_d"))).alias("to_ref"),
        F.max(F.when(F.col("other") != -1, F.col("sum_d"))).alias("to_own"),
    ).select(
        "label",
        score(F.col("to_own") / F.nullif(F.col("n_speaker") - 1, F.lit(0)), F.col("to_ref") / n_ref).alias("s"),
    )
    scores = of_ref.unionByName(of_speaker).groupBy("label").agg(F.avg("s").alias("score"))
    return scores.join(numbers, "label").select(speaker, "score")


def compare_speakers(embeddings: DataFrame, first: str, second: str, speaker: str = "speaker_id",
                     k: int = 2) -> DataFrame:
    """Clips of two speakers, labelled 0 and 1, on their first principal components."""
    chosen = select_speakers(embeddings, first, second, speaker)
    labelled = merge_embeddings(
        chosen.filter("speaker_order = 1").drop("speaker_order"), chosen.filter("speaker_order = 2").drop("speaker_order")
    )
    return align(fit_pca(labelled, k).transform(labelled), labelled.select("filename", "cluster"))
