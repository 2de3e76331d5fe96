"""Decoding of model output and uncertainty of hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechcurate.functions.edit_distance import cer, wer

# Frames decoded together; a longer clip is decoded in chunks that share one frame.
FRAME_CHUNK = 10_000


def greedy_decode(frames: DataFrame, vocab: list[str], blank: int = 0, delimiter: str = "|",
                  chunk: int = FRAME_CHUNK) -> DataFrame:
    """Text of each clip and pass: best token per frame, repeats collapsed, blanks dropped.

    ``frame_no`` counts 0, 1, 2 ... in each clip. The last frame of a chunk is
    repeated in the next one, where it only tells whether the first token repeats.
    """
    clip = [c for c in ("file_name", "pass_no") if c in frames.columns]
    last = F.col("frame_no") % chunk == chunk - 1
    here = F.floor(F.col("frame_no") / chunk)
    best = frames.select(
        *clip,
        "frame_no",
        (F.array_position("logits", F.array_max("logits")) - 1).alias("token"),
        F.explode(F.when(last, F.array(here, here + 1)).otherwise(F.array(here))).alias("_chunk"),
    )
    w = Window.partitionBy(*clip, "_chunk").orderBy("frame_no")
    symbols = F.array(*[F.lit(" " if v == delimiter else v) for v in vocab])
    spoken = (
        (F.col("frame_no") >= F.col("_chunk") * chunk)
        & (F.col("token") != blank)
        & (F.col("_before").isNull() | (F.col("_before") != F.col("token")))
    )
    heard = best.withColumn("_before", F.lag("token").over(w)).select(
        *clip, "_chunk", F.when(spoken, F.struct("frame_no", F.get(symbols, F.col("token").cast("int")).alias("t"))).alias("_t")
    )

    def in_order(parts: Column, text: str) -> Column:
        return F.array_join(F.transform(F.array_sort(parts), lambda x: x[text]), "")

    # A clip of blanks only has no tokens to collect, and so an empty text.
    parts = heard.groupBy(*clip, "_chunk").agg(in_order(F.collect_list("_t"), "t").alias("_text"))
    return parts.groupBy(*clip).agg(F.trim(in_order(F.collect_list(F.struct("_chunk", "_text")), "_text")).alias("text"))


def base_and_passes(hypotheses: DataFrame, path: str = "file_name") -> DataFrame:
    """Every dropout pass next to the base transcript of its clip; a clip without passes stays."""
    base = hypotheses.filter("pass_no = 0").select(path, F.col("text").alias("base"))
    return base.join(hypotheses.filter("pass_no > 0").select(path, "pass_no", "text"), path, "left")


def uncertainty_mean_wer(hypotheses: DataFrame, path: str = "file_name") -> DataFrame:
    """Mean word error rate of the dropout passes against the base transcript."""
    scored = base_and_passes(hypotheses, path).select(path, wer(F.col("base"), F.col("text")).alias("e"))
    return scored.groupBy(path).agg(F.avg("e").alias("uncertainty"))


def uncertainty_cer(hypotheses: DataFrame, path: str = "file_name") -> DataFrame:
    """Character error rate of the first dropout pass."""
    first = hypotheses.filter("pass_no <= 1")
    return base_and_passes(first, path).select(path, cer(F.col("base"), F.col("text")).alias("uncertainty"))


ALGORITHMS = {"inverse": uncertainty_mean_wer, "inverse_sequential": uncertainty_mean_wer, "smca": uncertainty_cer}


def score_pool(hypotheses: DataFrame, algorithm: str = "inverse", path: str = "file_name") -> DataFrame:
    """Uncertainty of every clip. Reads the hypotheses twice, so write the output of a model first."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {tuple(ALGORITHMS)}")
    return ALGORITHMS[algorithm](hypotheses, path)


def score_first(hypotheses: DataFrame, manifest: DataFrame, n: int, algorithm: str = "inverse", passes: int = 2,
                order: str = "row_idx", path: str = "file_name") -> DataFrame:
    """A trial of ``score_pool``: the first ``n`` clips of a numbered manifest, with a few dropout passes.

    The slice is taken before the hypotheses are read twice; clips without hypotheses give no row.
    """
    first = manifest.filter(F.col(order) < n).select(path).distinct()
    heard = hypotheses.filter(F.col("pass_no") <= passes).join(first, path, "left_semi")
    return score_pool(heard, algorithm, path)


def label_wer(hypotheses: DataFrame, manifest: DataFrame, path: str = "file_name",
              label: str = "sentence") -> DataFrame:
    """Word error rate of every hypothesis against the human transcript."""
    joined = hypotheses.join(manifest.select(path, F.col(label).alias("_label")), path)
    return joined.select(path, "pass_no", wer(F.col("_label"), F.col("text")).alias("wer"))
