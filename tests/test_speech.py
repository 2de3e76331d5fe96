from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechcurate.functions import audio as A
from speechcurate.operators import audio as U
from speechcurate.operators import scoring as S
from speechcurate.operators import windows as W
from speechcurate.plans.noise import noisy_folder
from speechcurate.plans.separation import separation_from_audio, separation_by_snr
from speechcurate.plans.training_sets import PARTS, collect_clips, split_clips
from speechcurate.sources import clips as C
from speechcurate.sources import manifests as SM
from speechcurate.sources import vectors as SV


def sine(rate, hz=440.0, seconds=0.5):
    return (0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)).astype(np.float32)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "clips"
    root.mkdir()
    for rate in (8_000, 16_000, 48_000):
        (root / f"mono {rate}%20+é.wav").write_bytes(A.encode_wav(sine(rate), rate))
        (root / f"stereo{rate}.wav").write_bytes(A.encode_wav(np.repeat(sine(rate), 2), rate, 2))
    (root / "broken.wav").write_bytes(b"RIFF....not audio")
    (root / "notes.txt").write_text("no clip")
    (root / "sub").mkdir()
    return f"file://{root}"


def test_scan_duration_and_rejects(spark, folder):
    scan = C.scan_clips(spark, folder)
    assert scan.count() == 7 and "mono 8000%20+é.wav" in {r.file_name for r in scan.select("file_name").collect()}
    seconds = {r.file_name: r for r in U.clip_durations(scan).collect()}
    assert seconds["broken.wav"].duration is None and seconds["broken.wav"].error
    assert all(r.duration == 0.5 for n, r in seconds.items() if n != "broken.wav")
    assert U.folder_duration(scan).first()[0] == 3.0 and U.file_number(scan).first()[0] == 7
    audio = U.decode_clips(scan)
    assert [r.file_name for r in U.rejected(audio).collect()] == ["broken.wav"]
    assert U.readable(audio).count() == 6


def test_resample_keeps_the_tone(spark, folder):
    out = U.resample_clips(U.readable(U.decode_clips(C.scan_clips(spark, folder)))).collect()
    want = sine(16_000)
    for r in out:
        got = np.array(r.samples)
        assert (r.sample_rate, r.channels, len(got)) == (16_000, 1, len(want))
        assert np.abs(got[200:-200] - want[200:-200]).max() < 5e-3
    both = U.resample_clips(U.readable(U.decode_clips(C.scan_clips(spark, folder))), 8_000, mono=False)
    assert {len(r.samples) for r in both.collect()} == {4_000, 8_000}


def test_write_and_copy_clips(spark, folder, tmp_path):
    audio = U.readable(U.decode_clips(C.scan_clips(spark, folder)))
    target = f"file://{tmp_path}/out"
    report = C.write_clips(U.encode_clips(audio), target)
    assert report.count() == 6 and report.filter("error is not null").count() == 0
    again = U.decode_clips(C.scan_clips(spark, target))
    same = again.select("file_name", F.col("samples").alias("s")).join(audio, "file_name").filter("s = samples")
    assert same.count() == 6
    plan = C.clip_copy_plan(report.select("file_name"), target, f"file://{tmp_path}/copy", mode="train")
    for _ in range(2):
        assert C.copy_clips(plan).filter("error is not null").count() == 0
    assert C.scan_clips(spark, f"file://{tmp_path}/copy/clips/train").count() == 6
    missing = C.copy_clips(plan.limit(1).withColumn("src", F.lit(f"file://{tmp_path}/none.wav")))
    assert missing.filter("error is not null").count() == 1


def test_sets_of_clips(spark, folder, tmp_path):
    source = f"file://{tmp_path}/in"
    names = [r[0] for r in C.write_clips(U.encode_clips(U.readable(U.decode_clips(C.scan_clips(spark, folder)))), f"{source}/clips").select("file_name").collect()]
    rows = spark.createDataFrame([(n, "a-b (c)", i) for i, n in enumerate(names)], "file_name string, sentence string, speaker_id int")
    for _ in range(2):
        done = split_clips(rows, source, f"{tmp_path}/out", 0.3, relative=False)
        assert done.count() == 6 and done.filter("error is not null").count() == 0
    halves = [SM.read_manifest(spark, f"{tmp_path}/out{p}/metadata") for p in PARTS]
    assert [h.count() for h in halves] == [4, 2] and {r.sentence for r in halves[0].collect()} == {"a-b (c)"}
    for part, half in zip(PARTS, halves):
        assert {r.file_name for r in half.collect()} == {p.name for p in (tmp_path / f"out{part}" / "clips").iterdir()}

    broken = rows.unionByName(spark.createDataFrame([("none.wav", "x", 9)], rows.schema))
    report = split_clips(broken, source, f"{tmp_path}/bad", 0.3, relative=False).filter("error is not null").collect()
    assert [r.src for r in report] == [f"{source}/clips/none.wav"]

    first, second = rows.filter("speaker_id < 3"), rows.filter("speaker_id >= 3")
    report = collect_clips([(first, source, "train"), (second, source, "same")], f"{tmp_path}/all", speaker="1", relative=False)
    assert report.count() == 4 and report.filter("error is not null").count() == 0
    got = {r.file_name: r.sentence for r in SM.read_manifest(spark, f"{tmp_path}/all/metadata").collect()}
    assert got == {f"clips/train/{names[1]}": "a b  c ", **{n: "a b  c " for n in names[3:]}}
    with pytest.raises(ValueError, match="would both become"):
        collect_clips([(rows, source, "train"), (rows, f"{source}2", "train")], f"{tmp_path}/clash", relative=False)
    with pytest.raises(ValueError, match="mode must be"):
        collect_clips([(rows, source, "split")], f"{tmp_path}/x")


def test_noise(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=20_000).astype(np.float32)
    clip = sine(16_000, seconds=1.0)
    df = spark.createDataFrame(
        [("a", 16_000, [float(v) for v in clip], 10.0), ("b", 16_000, [float(v) for v in clip], None)],
        "file_name string, sample_rate int, samples array<float>, snr double",
    )
    got = {r.file_name: np.array(r.samples) for r in U.add_noise(df, noise, "snr").collect()}
    assert np.array_equal(got["b"].astype(np.float32), clip)
    added = got["a"] - clip
    assert 10 * np.log10((clip ** 2).sum() / (added ** 2).sum()) == pytest.approx(10.0, abs=1e-3)
    assert U.add_noise(df, noise, None).count() == 2
    with pytest.raises(Exception, match="shorter"):
        U.add_noise(df, noise[:100], 5.0).collect()
    pcm = A.decode_wav(U.encode_clips(U.add_noise(df, noise, 0.0)).first()["content"])
    assert pcm[0] == 16_000 and np.abs(pcm[2]).max() <= 1.0


FRAMES = [("a", 0), ("a", 1), ("a", 1), ("a", 0), ("a", 1), ("a", 2), ("a", 2), ("a", 3), ("a", 4), ("a", 0),
          ("b", 0), ("b", 0), ("c", 3), ("c", 4), ("c", 4)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 10_000])
def test_greedy_decode(spark, chunk):
    rows, number = [], {}
    for clip, token in FRAMES:
        n = number.get(clip, 0)
        number[clip] = n + 1
        rows.append((clip, n, [1.0 if i == token else 0.0 for i in range(5)]))
    df = spark.createDataFrame(rows, "file_name string, frame_no int, logits array<double>").repartition(4)
    got = {r.file_name: r.text for r in S.greedy_decode(df, ["-", "x", "y", "|", "z"], chunk=chunk).collect()}
    assert got == {"a": "xxy z", "b": "", "c": "z"}


def test_scores(spark):
    df = spark.createDataFrame([
        ("a", 0, "one two three four"), ("a", 1, "one two three"), ("a", 2, "one two three four"),
        ("b", 0, ""), ("b", 1, "x"), ("c", 0, "only base"),
    ], "file_name string, pass_no int, text string")
    got = {r.file_name: r.uncertainty for r in S.score_pool(df, "inverse").collect()}
    assert got == {"a": 0.125, "b": None, "c": None}
    smca = {r.file_name: r.uncertainty for r in S.score_pool(df, "smca").collect()}
    assert smca["a"] == pytest.approx(5 / 18) and smca["b"] is None
    with pytest.raises(ValueError):
        S.score_pool(df, "other")
    labels = spark.createDataFrame([("a", "one two")], "file_name string, sentence string")
    assert sorted((r.pass_no, r.wer) for r in S.label_wer(df, labels).collect()) == [(0, 1.0), (1, 0.5), (2, 1.0)]


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    marker = str(tmp_path / "loads")

    def model():
        with open(marker, "a") as f:
            f.write("x")
        return lambda clips, p: [f"{len(c)} {p}" for c in clips]

    df = spark.range(0, 50).select(F.col("id").cast("string").alias("file_name"), F.array(F.lit(0.5).cast("float")).alias("samples"))
    out = U.transcribe(df, model, passes=3, tasks=4).collect()
    assert len(out) == 200 and {r.text for r in out} == {"1 0", "1 1", "1 2", "1 3"}
    with open(marker) as f:
        assert 1 <= len(f.read()) <= 8


def test_embed_uses_base_names(spark):
    df = spark.createDataFrame([("clips/train/a.wav", [1.0, 2.0])], "file_name string, samples array<float>")
    got = U.embed_clips(df, lambda: lambda clips: [[c.sum()] for c in clips]).first()
    assert (got.filename, list(got.embedding)) == ("a.wav", [3.0])


def test_text_vectors(spark, tmp_path):
    path = tmp_path / "ark.txt"
    path.write_text("utt-1  [ 1.5 -2 3e-1 ]\n\nutt-2 [ 4 5 6 ]\n")
    got = SV.import_ivectors(SV.read_text_vectors(spark, str(path))).orderBy("filename").collect()
    assert [(r.filename, [round(v, 6) for v in r.embedding]) for r in got] == [
        ("utt-1.wav", [1.5, -2.0, 0.3]), ("utt-2.wav", [4.0, 5.0, 6.0])]


def test_wav_forms():
    import struct

    import numpy as np
    import pytest as pt

    whole = A.encode_wav(np.linspace(-0.5, 0.5, 16_000), 16_000)
    assert A.wav_seconds(whole) == 1.0
    for broken in (whole[:1_000], whole[:40], b"RIFF"):
        with pt.raises(ValueError):
            A.decode_wav(broken)

    def wav(kind, bits, data):
        fmt = struct.pack("<HHIIHH", kind, 1, 8_000, 8_000 * bits // 8, bits // 8, bits)
        body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
        return b"RIFF" + struct.pack("<I", len(body)) + body

    assert A.decode_wav(wav(1, 24, bytes([0, 0, 0x40, 0, 0, 0xC0])))[2].tolist() == [0.5, -0.5]
    assert A.decode_wav(wav(3, 32, np.array([0.25, -1], "<f4").tobytes()))[2].tolist() == [0.25, -1.0]
    with pt.raises(ValueError, match="silent"):
        A.mix_noise(np.ones(4), np.zeros(4), 3.0)


def test_headers_by_ranged_reads(spark, tmp_path):
    root = tmp_path / "long"
    root.mkdir()
    size = 0
    for i in range(3):
        data = A.encode_wav(sine(16_000, seconds=20.0 + i), 16_000)
        (root / f"{i}.wav").write_bytes(data)
        size += len(data)
    whole = (root / "0.wav").read_bytes()
    # A long chunk before the samples is skipped, not read; a cut file is rejected by its length.
    junk = b"LIST" + (100_001).to_bytes(4, "little") + bytes(100_002)
    (root / "junk.wav").write_bytes(whole[:36] + junk + whole[36:])
    (root / "cut.wav").write_bytes(whole[:-10])
    (root / "tiny.wav").write_bytes(b"R")
    scan = C.scan_clips(spark, f"file://{root}")
    durations = U.clip_durations(scan)
    got = {r.file_name: r for r in durations.collect()}
    assert {n: r.duration for n, r in got.items()} == {"0.wav": 20.0, "1.wav": 21.0, "2.wav": 22.0, "junk.wav": 20.0, "cut.wav": None, "tiny.wav": None}
    assert "is cut to" in got["cut.wav"].error and got["tiny.wav"].error
    plan = durations._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    read = []

    def counted(data):
        def get(at, n):
            read.append(len(data[at : at + n]))
            return data[at : at + n]

        return A.read_header(get, len(data))

    for name in ("0.wav", "1.wav", "2.wav", "junk.wav"):
        counted((root / name).read_bytes())
    assert sum(read) < 0.01 * size


def test_headers_are_read_once_and_short_windows_travel_together(spark, folder):
    windows = W.clip_windows(C.scan_clips(spark, folder), 11_025, 0.0113, tasks=5)
    assert windows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = [("a.wav", i, 16 * i, np.zeros(16, np.float32)) for i in range(40_000)]
    batches = list(W._batched(iter(rows)))
    assert len(batches) <= 4 and sum(map(len, batches)) == len(rows)
    long = [("b.wav", i, 0, np.zeros(1 << 20, np.float32)) for i in range(3)]
    assert [len(b) for b in W._batched(iter(long))] == [1, 1, 1]
    # A clip shorter than a run is in one task.
    tasks = windows.withColumn("task", F.spark_partition_id()).groupBy("path").agg(F.countDistinct("task").alias("n"), F.max("total").alias("total"), F.count("*").alias("windows")).collect()
    assert any(r["windows"] > 1 for r in tasks) and all(r["n"] == 1 for r in tasks if r["total"] < 11_025 * W.SECONDS)


@pytest.mark.parametrize("seconds", [0.0113, 0.25, 60.0])
def test_windows_equal_the_whole_clip(spark, folder, seconds):
    whole = U.resample_clips(U.readable(U.decode_clips(C.scan_clips(spark, folder))), 11_025)
    want = {r.file_name: np.array(r.samples) for r in whole.collect()}
    windows = W.clip_windows(C.scan_clips(spark, folder), 11_025, seconds, tasks=5)
    got = {r.file_name: np.array(r.samples) for r in W.join_windows(W.resample_windows(windows, 11_025), 11_025).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    assert all(np.array_equal(got[n], want[n]) for n in want)
    longest = W.resample_windows(windows, 11_025).select(F.max(F.size("samples"))).first()[0]
    assert longest <= max(1, round(seconds * 11_025))


def test_noise_over_a_folder(spark, folder, tmp_path):
    noise = np.random.default_rng(2).normal(scale=0.1, size=60_000).astype(np.float32)
    (tmp_path / "noise.wav").write_bytes(A.encode_wav(noise, 44_100))
    root = tmp_path / "clips"
    (root / "empty.wav").write_bytes(A.encode_wav(np.zeros(0), 16_000))
    (root / "silent.wav").write_bytes(A.encode_wav(np.zeros(4_000), 16_000))
    (root / "long.wav").write_bytes(A.encode_wav(sine(16_000, seconds=3.0), 16_000))
    law = bytearray(A.encode_wav(sine(16_000), 16_000))
    law[20] = 7
    (root / "law.wav").write_bytes(bytes(law))
    whole = U.resample_clips(U.readable(U.decode_clips(C.scan_clips(spark, folder).filter("file_name not in ('law.wav', 'long.wav')"))))
    other = A.decode_wav((tmp_path / "noise.wav").read_bytes())
    at_rate = A.resample(other[2], 44_100, 16_000)
    want = {r.file_name: np.array(r.samples) for r in U.add_noise(whole, at_rate, 5.0).filter("size(samples) > 0").collect()}
    for _ in range(2):
        errors = {r.file_name: r.error for r in noisy_folder(spark, folder, f"file://{tmp_path}/noise.wav", f"file://{tmp_path}/noisy", 5.0, seconds=0.07).collect()}
    assert {n for n, e in errors.items() if e} == {"broken.wav", "law.wav", "long.wav"} and len(errors) == 11
    assert "shorter" in errors["long.wav"] and "format 7" in errors["law.wav"]
    made = sorted(p.name for p in (tmp_path / "noisy").iterdir() if not p.name.startswith("."))
    assert made == sorted(n for n, e in errors.items() if not e)
    for name, samples in want.items():
        rate, channels, got = A.decode_wav((tmp_path / "noisy" / name).read_bytes())
        assert (rate, channels, len(got)) == (16_000, 1, len(samples)) and np.abs(got - np.clip(samples, -1, 1)).max() <= 1.01 / 32768
    windows = W.clip_windows(C.scan_clips(spark, folder).filter("file_name like 'mono%'"), seconds=0.1)
    mixed = W.join_windows(W.mix_windows(windows, W.open_recording(f"file://{tmp_path}/noise.wav"), 5.0)).collect()
    assert len(mixed) == 3 and all(np.allclose(r.samples, want[r.file_name], atol=1e-6) for r in mixed)


def test_batches_by_length():
    rng = np.random.default_rng(3)
    lengths = np.r_[rng.integers(1, 100, 500), rng.integers(5_000, 20_000, 5), 0, 0]
    batches = list(U.batches_by_length(lengths, 2_000))
    assert sorted(np.concatenate(batches)) == list(range(len(lengths)))
    assert all(len(b) == 1 or len(b) * lengths[b].max() <= 2_000 for b in batches) and len(batches) < 60
    assert list(U.batches_by_length(np.zeros(0, np.int64), 10)) == []


def test_models_get_bounded_batches(spark):
    rows = [(f"{i}", [float(i)] * (400 if i % 50 == 0 else 1 + i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "file_name string, samples array<float>")

    def encoder():
        return lambda clips: [[len(clips) * max(map(len, clips)), c[0] if len(clips) == 1 or len(clips) * max(map(len, clips)) <= 60 else -1.0] for c in clips]

    got = {r.filename: r.embedding for r in U.embed_clips(df, encoder, tasks=2, padded=60).collect()}
    assert len(got) == 200 and all(v[1] == float(n) for n, v in got.items())
    texts = U.transcribe(df, lambda: lambda clips, p: [f"{c[0]:.0f} {p}" for c in clips], passes=2, padded=60).collect()
    assert len(texts) == 600 and all(r.text == f"{r.file_name} {r.pass_no}" for r in texts)


def test_separation_from_audio(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{i}.wav", [float(v) for v in (0.2 if i < 6 else 0.6) * np.sin(np.arange(200) * (0.1 if i < 6 else 0.5)) + 0.01 * rng.normal(size=200)]) for i in range(12)]
    df = spark.createDataFrame(rows, "file_name string, samples array<float>").withColumn("n", F.substring_index("file_name", ".", 1).cast("int"))
    noise, levels = rng.normal(size=300), [-20.0, 9.6, 10.4, float("inf")]
    first, second = df.filter("n < 6"), df.filter("n >= 6")

    def encoder():
        return lambda clips: [(c.std(), np.abs(np.diff(c)).mean()) for c in clips]

    got = {r.snr: r.score for r in separation_from_audio(first, second, noise, levels, encoder).collect()}
    assert set(got) == set(levels) and got[float("inf")] > 0.9
    for level in [9.6]:
        one = [U.embed_clips(U.add_noise(side, noise, level), encoder) for side in (first, second)]
        one = [side.withColumn("snr", F.lit(1)) for side in one]
        assert separation_by_snr(*one).first().score == pytest.approx(got[level], abs=1e-6)
