"""Long recordings by windows: clips are read, resampled and mixed a range of frames at a time.

A window is a range of the resampled clip. Its row holds the place of the clip, not its samples; a task
reads the bytes of the range and of the filter's reach around it (overlap-save), so neither a whole
recording nor a whole noise is ever in memory, and the parts are those of the whole clip.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.functions import audio as A
from speechcurate.operators.audio import clip_headers, file_header, readable
from speechcurate.session import file_system, ship_package

SECONDS = 60.0
# Samples that a batch of windows holds before it is sent; a row counts as a few more.
BATCH_SAMPLES, ROW_SAMPLES = 1 << 20, 64
# Formats that ``decode_samples`` reads.
DECODABLE = "(kind = 1 and width between 1 and 4) or (kind = 3 and width in (4, 8))"
PLACE = ["file_name", "path", "kind", "channels", "sample_rate", "width", "frames", "start"]


@dataclass(frozen=True)
class Recording:
    """A WAV file and the format and place of its samples."""

    path: str
    header: A.Header

    def resampled(self, rate: int) -> int:
        return A.resampled_length(self.header.frames, self.header.rate, rate)

    def open(self) -> pa.NativeFile:
        system, name = file_system(self.path)
        return system.open_input_file(name)

    def part(self, first: int, stop: int, rate: int, file: pa.NativeFile | None = None) -> np.ndarray:
        """Frames ``first`` to ``stop`` of the clip at ``rate``, channels averaged, from a ranged read; ``file`` is the clip's, if it is open."""
        if file is None:
            with self.open() as file:
                return self.part(first, stop, rate, file)
        h = self.header
        low, high = A.needed_frames(first, stop, h.frames, h.rate, rate)
        file.seek(h.start + low * h.channels * h.width)
        raw = file.read((high - low) * h.channels * h.width)
        samples = A.to_mono(A.decode_samples(raw, h.kind, h.width), h.channels)
        return A.resample_part(samples, low, first, stop, h.rate, rate).astype(np.float32)


def open_recording(path: str) -> Recording:
    return Recording(path, file_header(path))


def _recording(row) -> Recording:
    return Recording(row.path, A.Header(row.kind, row.channels, row.sample_rate, row.width, row.frames, row.start))


def clip_windows(scan: DataFrame, rate: int = 16_000, seconds: float = SECONDS, tasks: int | None = None) -> DataFrame:
    """One row per window of each clip of a scan that can be decoded: its place, ``window_no``, and frames ``first`` to ``stop`` at ``rate``.

    Only headers are read. An empty clip has one empty window. Windows are dealt
    over ``tasks`` (the session's shuffle partitions by default) in runs of up to ``SECONDS``, so those of a long recording
    don't meet in a task, and a short clip is opened once.
    """
    step = max(1, round(seconds * rate))
    total = F.expr(f"(frames * {int(rate)} + sample_rate - 1) div sample_rate")
    clips = readable(clip_headers(scan)).filter(DECODABLE).select(*PLACE, total.alias("total"))
    windows = clips.withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(total + {step - 1}) div {step}"), F.lit(1)) - 1)))
    first = F.col("window_no") * step
    windows = windows.withColumns({"first": first, "stop": F.least(first + step, F.col("total"))})
    tasks = tasks or int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = max(1, int(SECONDS / seconds))
    return windows.repartition(tasks, F.col("path"), F.floor(F.col("window_no") / run)).sortWithinPartitions("path", "window_no")


_SAMPLES = "file_name string, window_no long, first long, samples array<float>"


def _batched(windows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows of ``_SAMPLES`` in batches of bounded size, so that short windows don't travel one by one."""
    held, size = [], 0
    for row in windows:
        held.append(row)
        size += len(row[-1]) + ROW_SAMPLES
        if size >= BATCH_SAMPLES:
            yield pd.DataFrame(held, columns=["file_name", "window_no", "first", "samples"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["file_name", "window_no", "first", "samples"])


def resample_windows(windows: DataFrame, rate: int = 16_000) -> DataFrame:
    """``(file_name, window_no, first, samples)``: each window's samples at ``rate``, one channel."""
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        path, file = None, None
        try:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    clip = _recording(row)
                    if row.path != path:
                        if file is not None:
                            file.close()
                        path, file = row.path, clip.open()
                    yield row.file_name, row.window_no, row.first, clip.part(row.first, row.stop, rate, file)
        finally:
            if file is not None:
                file.close()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _batched(parts(batches))

    ship_package(windows.sparkSession)
    return windows.select(*PLACE, "window_no", "first", "stop").mapInPandas(run, _SAMPLES)


def window_energies(windows: DataFrame, noise: Recording, rate: int = 16_000) -> DataFrame:
    """``(path, signal_energy, noise_energy)`` per clip: squares of its samples and of the noise as far as the clip goes.

    One pair of numbers per window is shuffled. The noise must be as long as the longest clip.
    """
    length = noise.resampled(rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for row in pdf.itertuples(index=False):
                if row.stop > length:
                    raise ValueError(f"noise of {length} samples is shorter than the clip {row.file_name} of {row.total}")
                parts = (_recording(row).part(row.first, row.stop, rate), noise.part(row.first, row.stop, rate))
                sums.append((row.path, *[float((p.astype(np.float64) ** 2).sum()) for p in parts]))
            yield pd.DataFrame(sums, columns=["path", "s", "n"])

    ship_package(windows.sparkSession)
    measured = windows.select(*PLACE, "total", "first", "stop").mapInPandas(run, "path string, s double, n double")
    return measured.groupBy("path").agg(F.sum("s").alias("signal_energy"), F.sum("n").alias("noise_energy"))


def mixed_part(clip: Recording, noise: Recording, first: int, stop: int, rate: int, gain: float) -> np.ndarray:
    signal = clip.part(first, stop, rate)
    if not gain:
        return signal
    return (signal.astype(np.float64) + gain * noise.part(first, stop, rate).astype(np.float64)).astype(np.float32)


def mix_windows(windows: DataFrame, noise: Recording, snr: float, rate: int = 16_000) -> DataFrame:
    """``(file_name, window_no, first, samples)`` with noise at ``snr`` dB of the whole clip.

    Two passes over the files: one sums the energies, one mixes; samples are never shuffled.
    """
    def mixed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                gain = A.noise_gain(row.signal_energy, row.noise_energy, snr) if row.total else 0.0
                yield row.file_name, row.window_no, row.first, mixed_part(_recording(row), noise, row.first, row.stop, rate, gain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _batched(mixed(batches))

    known = windows.join(window_energies(windows, noise, rate), "path")
    return known.select(*PLACE, "total", "window_no", "first", "stop", "signal_energy", "noise_energy").mapInPandas(run, _SAMPLES)


def join_windows(parts: DataFrame, rate: int = 16_000) -> DataFrame:
    """``(file_name, sample_rate, channels, samples)``: windows of clips that fit into a row, put together again.

    Long recordings stay in windows; ``plans.noise`` writes them a window at a time.
    """
    ordered = F.array_sort(F.collect_list(F.struct("window_no", "samples")))
    return parts.groupBy("file_name").agg(ordered.alias("w")).select(
        "file_name", F.lit(rate).alias("sample_rate"), F.lit(1).alias("channels"), F.flatten("w.samples").alias("samples")
    )
