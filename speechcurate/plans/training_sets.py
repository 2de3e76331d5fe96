"""A folder of training clips made from one or two manifests: clips copied, manifests written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.operators.manifest import SPLITS, clean_manifest
from speechcurate.operators.selection import train_test_split
from speechcurate.operators.sets import union_manifests
from speechcurate.session import materialise
from speechcurate.sources.clips import clip_copy_plan, copy_clips
from speechcurate.sources.manifests import write_manifest

# Folders of the two sets that a manifest is split into.
PARTS = ("_split_1", "_split_2")


def split_clips(manifest: DataFrame, source: str, target: str, test_size: float = 0.3, seed: int | str = 42,
                path: str = "file_name", relative: bool = True) -> DataFrame:
    """Divide a manifest into two sets, each a folder with its clips and a manifest of its own.

    ``<target>_split_1`` gets the rows that are kept, ``<target>_split_2`` the ``test_size`` that is held out. Labels stay as
    they are. Gives ``(part, src, dst, error)`` per file; clips that fail to copy are reported and stay in the manifest.
    A manifest is written after the clips it names. All files move into place or are replaced, so a job that was stopped
    can be repeated: the division depends on the seed and the rows alone.
    """
    reports = []
    for part, half in zip(PARTS, train_test_split(manifest, test_size, path, seed)):
        plan = materialise(clip_copy_plan(half, source, target, path, "split", relative, part), "set")
        reports.append(copy_clips(plan).select(F.lit(part).alias("part"), "src", "dst", "error"))
        write_manifest(plan.drop("src", "dst"), f"{target}{part}/metadata")
    return reports[0].unionByName(reports[1])


def collect_clips(parts: list[tuple[DataFrame, str, str]], target: str, path: str = "file_name", label: str = "sentence",
                  speaker: str | None = None, speaker_column: str = "speaker_id", relative: bool = True) -> DataFrame:
    """Put the clips of ``(manifest, source folder, mode)`` into one folder with one cleaned manifest.

    ``mode`` is ``same``, or the split that the clips join (``train``, ``dev``, ``test``), whose paths in the manifest then change,
    too. ``speaker`` keeps only that speaker's rows of the first manifest. Gives ``(src, dst, error)`` per file. Two different
    files that would get the same place are an error before anything is copied.
    """
    if wrong := [mode for *_, mode in parts if mode not in ("same", *SPLITS)]:
        raise ValueError(f"mode must be one of {('same', *SPLITS)}, not {wrong[0]}")
    plans = []
    for i, (manifest, source, mode) in enumerate(parts):
        if i == 0 and speaker is not None:
            manifest = manifest.filter(F.col(speaker_column).cast("string") == speaker)
        plans.append(clip_copy_plan(manifest, source, target, path, mode, relative))
    plan = plans[0]
    for other in plans[1:]:
        plan = union_manifests(plan, other)
    plan = materialise(plan, "set")
    places = plan.groupBy("dst").agg(F.min("src").alias("one"), F.max("src").alias("other"))
    if clash := places.filter("one <> other").limit(1).collect():
        raise ValueError(f"{clash[0]['one']} and {clash[0]['other']} would both become {clash[0]['dst']}")
    copied = copy_clips(plan)
    write_manifest(clean_manifest(plan.drop("src", "dst"), "creator", label), f"{target}/metadata")
    return copied
