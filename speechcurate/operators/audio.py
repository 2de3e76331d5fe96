"""Audio jobs on clip tables: durations, decoding, resampling, noise, model inference.

Each job maps batches of clips inside Arrow tasks and needs no shuffle. Clips
that cannot be read become rows with an ``error``, not lost rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechcurate.functions import audio as A
from speechcurate.session import file_system, ship_package

# Bytes of noise that may be sent to every executor.
NOISE_BYTES = 256 << 20
# Samples of a batch for a model when its clips are padded to the longest (64 MB).
PADDED_SAMPLES = 1 << 24

_loaded: dict[str, Any] = {}


def _load_once(token: str, factory: Callable[[], Any]) -> Any:
    """One model per Python worker, also across tasks."""
    if token not in _loaded:
        _loaded.clear()
        _loaded[token] = factory()
    return _loaded[token]


def _attempt(function: Callable, *args) -> tuple[Any, str | None]:
    try:
        return function(*args), None
    except Exception as problem:  # any broken file is data, not a failure of the job
        return None, f"{type(problem).__name__}: {problem}"


def _spread(audio: DataFrame, tasks: int | None) -> DataFrame:
    """Inference is slow per byte, so it may want more tasks than the scan gives."""
    return audio.repartition(tasks) if tasks else audio


def _schema(df: DataFrame, drop: tuple[str, ...], *add: tuple[str, T.DataType]) -> T.StructType:
    names = {n for n, _ in add}
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in names]
    return T.StructType(kept + [T.StructField(n, t) for n, t in add])


FLOATS = T.ArrayType(T.FloatType())


HEADER = "kind int, channels int, sample_rate int, width int, frames long, start long, error string"
HEADER_FIELDS = [field.split()[0] for field in HEADER.split(", ")]


def file_header(path: str, length: int | None = None) -> A.Header:
    """Header of a WAV file by ranged reads."""
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        return A.read_header(read, f.size() if length is None else length)


def clip_headers(scan: DataFrame) -> DataFrame:
    """Format, frames and place of the samples of each clip, or the reason why there are none.

    A scan with ``path`` and ``length`` is read from its files, a few hundred bytes
    each, in tasks; ``content`` then isn't read at all. Other tables are measured by ``content``.
    """
    ship_package(scan.sparkSession)
    ranged = {"path", "length"} <= set(scan.columns)

    def rows(read: Callable, *columns: pd.Series) -> pd.DataFrame:
        out = []
        for values in zip(*columns):
            header, error = _attempt(read, *values)
            out.append((header.kind, header.channels, header.rate, header.width, header.frames, header.start, None)
                       if header else (None,) * 6 + (error,))
        return pd.DataFrame(out, columns=HEADER_FIELDS)

    @F.pandas_udf(HEADER)
    def of_file(path: pd.Series, length: pd.Series) -> pd.DataFrame:
        return rows(file_header, path, length)

    @F.pandas_udf(HEADER)
    def of_content(content: pd.Series) -> pd.DataFrame:
        return rows(lambda c: A.read_header(lambda at, n: c[at : at + n], len(c)), content)

    # A filter on what a deterministic function gives would be moved below it with a copy of it, and read each header twice.
    header = of_file.asNondeterministic()("path", "length") if ranged else of_content.asNondeterministic()("content")
    kept = [c for c in scan.columns if c != "content" and c not in HEADER_FIELDS]
    return scan.select(*kept, *([] if ranged else ["content"])).withColumn("_m", header).select(*kept, "_m.*")


def clip_durations(scan: DataFrame) -> DataFrame:
    """Seconds of each clip from its header, or the reason why there are none; see ``clip_headers``."""
    kept = [c for c in scan.columns if c != "content" and c not in HEADER_FIELDS]
    return clip_headers(scan).select(*kept, (F.col("frames") / F.col("sample_rate")).alias("duration"), "error")


def decode_clips(scan: DataFrame) -> DataFrame:
    """Content to ``sample_rate``, ``channels`` and interleaved ``samples``, or an ``error``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results = [_attempt(A.decode_wav, c) for c in pdf["content"]]
            out = pdf.drop(columns="content")
            out["sample_rate"] = pd.array([r[0] if r else None for r, _ in results], dtype="Int32")
            out["channels"] = pd.array([r[1] if r else None for r, _ in results], dtype="Int32")
            out["samples"] = [r[2] if r else None for r, _ in results]
            out["error"] = [e for _, e in results]
            yield out

    ship_package(scan.sparkSession)
    return scan.mapInPandas(run, _schema(
        scan, ("content",), ("sample_rate", T.IntegerType()), ("channels", T.IntegerType()),
        ("samples", FLOATS), ("error", T.StringType()),
    ))


def readable(audio: DataFrame) -> DataFrame:
    return audio.filter("error is null")


def rejected(audio: DataFrame) -> DataFrame:
    return audio.filter("error is not null").select("file_name", "error")


def resample_clips(audio: DataFrame, rate: int = 16_000, mono: bool = True) -> DataFrame:
    """All clips at one sample rate, channels averaged to one unless ``mono`` is off."""
    def one(samples: np.ndarray, old: int, channels: int) -> np.ndarray:
        channels = int(channels)
        if mono or channels == 1:
            return A.resample(A.to_mono(samples, channels), int(old), rate).astype(np.float32)
        lanes = [A.resample(samples[c::channels], int(old), rate) for c in range(channels)]
        return np.stack(lanes, axis=1).ravel().astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["samples"] = [
                one(s, r, c) for s, r, c in zip(pdf["samples"], pdf["sample_rate"], pdf["channels"])
            ]
            pdf["sample_rate"] = np.int32(rate)
            if mono:
                pdf["channels"] = np.int32(1)
            yield pdf

    ship_package(audio.sparkSession)
    return audio.mapInPandas(run, audio.schema)


def _shared_noise(audio: DataFrame, noise: np.ndarray):
    noise = np.asarray(noise, dtype=np.float32)
    if noise.nbytes > NOISE_BYTES:
        raise ValueError(f"noise of {noise.nbytes} bytes is too long to send around; read it by windows (plans.noise)")
    ship_package(audio.sparkSession)
    return audio.sparkSession.sparkContext.broadcast(noise)


def add_noise(audio: DataFrame, noise: np.ndarray, snr: float | str | None) -> DataFrame:
    """Mix one noise recording into every clip.

    ``snr`` is a number of dB or the name of a column of them; null leaves the
    clip as it is. The noise is a broadcast, so its size is limited: cut it to the
    longest clip, or read clips and noise by windows (``operators.windows``), which has no limit.
    """
    shared = _shared_noise(audio, noise)

    @F.pandas_udf(FLOATS)
    def mix(samples: pd.Series, level: pd.Series) -> pd.Series:
        return pd.Series([
            A.mix_noise(np.asarray(s), shared.value, None if pd.isna(v) else float(v)).astype(np.float32)
            for s, v in zip(samples, level)
        ])

    level = F.col(snr) if isinstance(snr, str) else F.lit(snr)
    return audio.withColumn("samples", mix("samples", level.cast("double")))


def encode_clips(audio: DataFrame) -> DataFrame:
    """Samples to the bytes of a 16 bit PCM WAV file in ``content``."""
    ship_package(audio.sparkSession)

    @F.pandas_udf("binary")
    def encode(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([A.encode_wav(s, r, int(c)) for s, r, c in zip(samples, rate, channels)], dtype=object)

    channels = F.col("channels") if "channels" in audio.columns else F.lit(1)
    return audio.withColumn("content", encode("samples", "sample_rate", channels)).drop("samples")


def batches_by_length(lengths: np.ndarray, padded: int) -> Iterator[np.ndarray]:
    """Places of the clips in batches of similar length.

    A batch times its longest clip holds at most ``padded`` samples, so what a model
    pads it to is bounded; a clip longer than that is a batch of its own.
    """
    order = np.argsort(lengths, kind="stable")
    first = 0
    for i, at in enumerate(order):
        if i > first and (i + 1 - first) * lengths[at] > padded:
            yield order[first:i]
            first = i
    if first < len(order):
        yield order[first:]


def _by_length(audio: DataFrame, tasks: int | None) -> DataFrame:
    """Clips of a task by length, so that those of similar length reach a model together."""
    return _spread(audio, tasks).sortWithinPartitions(F.size("samples"))


def _length_batches(pdf: pd.DataFrame, padded: int) -> Iterator[tuple[pd.Series, list[np.ndarray]]]:
    clips = [np.asarray(s) for s in pdf["samples"]]
    for at in batches_by_length(np.array([len(c) for c in clips], np.int64), padded):
        yield pdf["file_name"].iloc[at], [clips[i] for i in at]


def embed_clips(audio: DataFrame, encoder: Callable[[], Callable[[list[np.ndarray]], Any]],
                tasks: int | None = None, padded: int = PADDED_SAMPLES) -> DataFrame:
    """``(filename, embedding)`` from a user's encoder.

    ``encoder()`` loads the model, once per Python worker; the result maps a list
    of waveforms to one vector each. It gets clips of similar length, at most
    ``padded`` samples when all are padded to the longest.
    """
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load_once(token, encoder)
        for pdf in batches:
            for names, clips in _length_batches(pdf, padded):
                yield pd.DataFrame({"filename": names.values, "embedding": _vectors(model, clips)})

    ship_package(audio.sparkSession)
    return _by_length(_bare_names(audio), tasks).mapInPandas(run, "filename string, embedding array<float>")


def _bare_names(audio: DataFrame) -> DataFrame:
    return audio.select(F.substring_index("file_name", "/", -1).alias("file_name"), "samples")


def _vectors(model: Callable, clips: list[np.ndarray]) -> list[np.ndarray]:
    return [np.asarray(v, dtype=np.float32).ravel() for v in model(clips)]


def embed_noise_levels(audio: DataFrame, noise: np.ndarray, levels: list[float], encoder: Callable[[], Callable[[list[np.ndarray]], Any]],
                       tasks: int | None = None, padded: int = PADDED_SAMPLES) -> DataFrame:
    """``(filename, level_no, snr, embedding)`` of every clip at every noise level, numbered from 0; an infinite level is the clean clip.

    A clip is decoded and sent to Python once: it is mixed and embedded there for
    all levels, and only vectors leave the task.
    """
    shared = _shared_noise(audio, noise)
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load_once(token, encoder)
        for pdf in batches:
            for names, clips in _length_batches(pdf, padded):
                for number, level in enumerate(levels):
                    mixed = [A.mix_noise(c, shared.value, float(level)).astype(np.float32) for c in clips]
                    yield pd.DataFrame({"filename": names.values, "level_no": np.int32(number), "snr": float(level), "embedding": _vectors(model, mixed)})

    return _by_length(_bare_names(audio), tasks).mapInPandas(run, "filename string, level_no int, snr double, embedding array<float>")


def _passes(audio: DataFrame, model: Callable, passes: int, tasks: int | None, column: str, type_: str, padded: int) -> DataFrame:
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = _load_once(token, model)
        for pdf in batches:
            for names, clips in _length_batches(pdf, padded):
                for p in range(passes + 1):
                    yield pd.DataFrame({"file_name": names.values, "pass_no": np.int32(p), column: list(loaded(clips, p))})

    ship_package(audio.sparkSession)
    return _by_length(audio.select("file_name", "samples"), tasks).mapInPandas(run, f"file_name string, pass_no int, {column} {type_}")


def transcribe(audio: DataFrame, model: Callable[[], Callable[[list[np.ndarray], int], list[str]]],
               passes: int = 20, tasks: int | None = None, padded: int = PADDED_SAMPLES) -> DataFrame:
    """``(file_name, pass_no, text)``: pass 0 is the base transcript, the others use dropout.

    ``model()`` is loaded once per Python worker; the result maps waveforms and a
    pass number to texts. All passes of a clip run in one task, so its audio is
    sent to Python once. Batches are those of ``embed_clips``.
    """
    return _passes(audio, model, passes, tasks, "text", "string", padded)


def frame_logits(audio: DataFrame, model: Callable, passes: int = 20, tasks: int | None = None,
                 padded: int = PADDED_SAMPLES) -> DataFrame:
    """``(file_name, pass_no, frame_no, logits)`` from a model that gives one vector per frame."""
    nested = _passes(audio, model, passes, tasks, "frames", "array<array<float>>", padded)
    return nested.select("file_name", "pass_no", F.posexplode("frames").alias("frame_no", "logits"))


def folder_duration(scan: DataFrame) -> DataFrame:
    """Total seconds of the clips of a folder."""
    return clip_durations(scan).agg(F.sum("duration").alias("total_seconds"))


def file_number(scan: DataFrame) -> DataFrame:
    """Number of files of a folder; no file is opened."""
    return scan.agg(F.count("*").alias("files"))
