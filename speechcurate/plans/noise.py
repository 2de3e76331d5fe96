"""Noise over a folder of clips, to 16 bit WAV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechcurate.functions import audio as A
from speechcurate.operators import windows as W
from speechcurate.operators.audio import clip_headers
from speechcurate.session import file_system
from speechcurate.sources.clips import put_parts, report, scan_clips


def noisy_folder(spark: SparkSession, source: str, noise: str, target: str, snr: float, rate: int = 16_000,
                 seconds: float = W.SECONDS, extension: str = ".wav") -> DataFrame:
    """Mix a noise file into every clip of a folder; gives ``(file_name, error)`` of all clips.

    Clips and noise are brought to ``rate`` and one channel first. Energies are
    summed over all windows of all clips; then each clip is written by one task, a window
    of ``seconds`` in memory at a time. Broken clips, clips longer than the noise and a silent noise are errors of
    their rows. Files move into place when whole, so the job can be repeated.
    """
    recording = W.open_recording(noise)
    length = recording.resampled(rate)
    scan = scan_clips(spark, source, extension)
    headers = clip_headers(scan).withColumn("total", F.expr(f"(frames * {int(rate)} + sample_rate - 1) div sample_rate"))
    windows = W.clip_windows(scan, rate, seconds).filter(F.col("total") <= length)
    known = headers.join(W.window_energies(windows, recording, rate), "path", "left").withColumn(
        "problem", F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.expr(W.DECODABLE), F.format_string("WAV format %d of %d bytes is not supported", "kind", "width"))
        .when(F.col("total") > length, F.format_string(f"noise of {length} samples is shorter than the clip of %d", "total")))
    step = max(1, round(seconds * rate))

    def act(row) -> None:
        if row.problem is not None:
            raise ValueError(row.problem)
        clip = W.Recording(row.path, A.Header(*[int(getattr(row, c)) for c in ("kind", "channels", "sample_rate", "width", "frames", "start")]))
        total = int(row.total)
        gain = A.noise_gain(row.signal_energy, row.noise_energy, snr) if total else 0.0

        def parts():
            yield A.pcm_header(total, rate)
            for first in range(0, total, step):
                yield A.to_pcm(W.mixed_part(clip, recording, first, min(first + step, total), rate, gain))

        system, root = file_system(target)
        put_parts(system, f"{root.rstrip('/')}/{row.file_name}", parts())

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    jobs = known.select(*W.PLACE, "total", "signal_energy", "noise_energy", "problem").repartition(tasks, "path")
    return report(jobs, act, "file_name string")
