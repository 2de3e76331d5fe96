"""Queries on audio, hypotheses and uncertainties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from speechcurate.catalog.standins import audio, hypotheses, query, sql, table
from speechcurate.functions.edit_distance import cer, wer
from speechcurate.operators import audio as U
from speechcurate.operators import scoring as S
from speechcurate.operators import windows as W
from speechcurate.plans.noise import noisy_folder
from speechcurate.plans.separation import separation_from_audio
from speechcurate.plans.training_sets import PARTS, collect_clips, split_clips
from speechcurate.session import materialise, scratch_path
from speechcurate.sources import clips as C
from speechcurate.sources.manifests import read_manifest


# Pieces of a text in SQL; each distinct piece of a pair becomes one ASCII character.
_WORDS, _CHARS = "regexp_split_to_array(trim({t}), '\\s+')", "string_split({t}, '')"


def _coded(pieces: str) -> str:
    """SQL: ``pairs`` (file_name, pass_no, base, text) with both texts spelled in ASCII, and their rate."""
    a, b = pieces.format(t="base"), pieces.format(t="text")
    spell = "array_to_string(list_transform({x}, lambda w: chr(CAST(list_position(v, w) AS INTEGER))), '')"
    return (
        f"cut AS (SELECT file_name, pass_no, {a} AS a, {b} AS b, list_distinct(list_concat({a}, {b})) AS v FROM pairs), "
        f"rated AS (SELECT file_name, CAST(pass_no AS INTEGER) AS pass_no, "
        f"levenshtein({spell.format(x='a')}, {spell.format(x='b')}) / len(a)::DOUBLE AS rate FROM cut)"
    )


_PAIRED = """pairs AS (SELECT b.file_name, h.pass_no, b.text AS base, h.text AS text FROM hypotheses b JOIN hypotheses h USING (file_name)
    WHERE b.pass_no = 0 AND h.pass_no > 0)"""
_BY_WORD, _BY_CHAR = f"{_PAIRED}, {_coded(_WORDS)}", f"{_PAIRED}, {_coded(_CHARS)}"


@query("S7_scan_clips", "SELECT vec_id || '.wav' AS file_name, CAST(44 + 2 * len(embedding) AS BIGINT) AS length FROM embeddings")
def s7(spark, folder):
    path = scratch_path(spark, "clips")
    C.write_clips(U.encode_clips(audio(spark, folder)), path)
    return C.scan_clips(spark, path).select("file_name", "length")


@query("S10_copy_clips", "SELECT vec_id || '.wav' AS file_name, round(len(embedding) / 16000, 9) AS duration FROM embeddings")
def s10_copy(spark, folder):
    source, target = scratch_path(spark, "clips"), scratch_path(spark, "copied")
    written = C.write_clips(U.encode_clips(audio(spark, folder)), source)
    C.copy_clips(C.clip_copy_plan(written.select("file_name"), source, target))
    return U.clip_durations(C.scan_clips(spark, target)).select("file_name", F.round("duration", 9).alias("duration"))


_SETS = "n AS (SELECT *, vec_id || '.wav' AS f, row_number() OVER (ORDER BY md5('42:' || vec_id || '.wav'), vec_id || '.wav') <= (SELECT ceil(0.3::DOUBLE * count(*)) FROM embeddings) AS held FROM embeddings)"


@query("S11_split_clips", f"WITH {_SETS} SELECT CASE WHEN held THEN '_split_2' ELSE '_split_1' END AS part, 'clips/' || f AS clip, f AS file_name, CAST(label AS VARCHAR) AS speaker_id, CAST(44 + 2 * len(embedding) AS BIGINT) AS length FROM n")
def s11_split_clips(spark, folder):
    """Two sets out of one, each with its clips and its manifest."""
    source, target = scratch_path(spark, "clips"), scratch_path(spark, "sets")
    C.write_clips(U.encode_clips(audio(spark, folder)), f"{source}/clips")
    rows = table(spark, folder, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("file_name"), F.col("label").cast("string").alias("speaker_id"))
    split_clips(rows, source, target, relative=False)
    sets = []
    for part in PARTS:
        found = C.scan_clips(spark, f"{target}{part}/clips").select("file_name", "length", F.concat(F.lit("clips/"), "file_name").alias("clip"))
        listed = read_manifest(spark, f"{target}{part}/metadata", "file_name string, speaker_id string", multi_line=False)
        sets.append(listed.join(found, "file_name").select(F.lit(part).alias("part"), "clip", "file_name", "speaker_id", "length"))
    return sets[0].union(sets[1])


@query("S11_collect_clips", """SELECT 'clips/' || CASE WHEN label % 2 = 0 THEN 'train/' ELSE 'dev/' END || vec_id || '.wav' AS file_name, 'a  and  b' AS sentence,
    CAST(44 + 2 * len(embedding) AS BIGINT) AS length FROM embeddings""")
def s11_collect_clips(spark, folder):
    """One folder out of two sets, the first for training, the second for development."""
    source, target = scratch_path(spark, "clips"), scratch_path(spark, "set")
    C.write_clips(U.encode_clips(audio(spark, folder)), f"{source}/clips")
    name = F.concat(F.col("vec_id").cast("string"), F.lit(".wav"))
    rows = table(spark, folder, "embeddings").select(name.alias("file_name"), F.lit("a & b").alias("sentence"), "label")
    first, second = (rows.filter(F.col("label") % 2 == n).drop("label") for n in (0, 1))
    collect_clips([(first, source, "train"), (second, source, "dev")], target, relative=False)
    listed = read_manifest(spark, f"{target}/metadata", "file_name string, sentence string", multi_line=False)
    found = [C.scan_clips(spark, f"{target}/clips/{s}").select(F.concat(F.lit(f"clips/{s}/"), "file_name").alias("file_name"), "length") for s in ("train", "dev")]
    return listed.join(found[0].union(found[1]), "file_name").select("file_name", "sentence", "length")


@query("A9_folder_duration", "SELECT round(sum(len(embedding) / 16000), 6) AS total_seconds FROM embeddings")
def a9(spark, folder):
    path = scratch_path(spark, "clips")
    C.write_clips(U.encode_clips(audio(spark, folder)), path)
    return U.folder_duration(C.scan_clips(spark, path)).select(F.round("total_seconds", 6).alias("total_seconds"))


@query("A10_file_number", "SELECT count(*) AS files FROM embeddings")
def a10(spark, folder):
    path = scratch_path(spark, "clips")
    C.write_clips(U.encode_clips(audio(spark, folder)), path)
    return U.file_number(C.scan_clips(spark, path))


@query("U1_clip_durations", "SELECT vec_id || '.wav' AS file_name, round(len(embedding) / 16000, 9) AS duration FROM embeddings")
def u1(spark, folder):
    durations = U.clip_durations(U.encode_clips(audio(spark, folder)))
    return durations.select("file_name", F.round("duration", 9).alias("duration"))


@query("F6_rejected_clips", "SELECT vec_id || '.wav' AS file_name FROM embeddings WHERE label = 3")
def f6(spark, folder):
    broken = F.when(F.col("label") == 3, F.substring("content", 1, 20)).otherwise(F.col("content"))
    labels = table(spark, folder, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("file_name"), "label")
    encoded = U.encode_clips(audio(spark, folder)).join(labels, "file_name").withColumn("content", broken)
    return U.rejected(U.decode_clips(encoded)).select("file_name")


_PCM = "greatest(-32768, least(32767, round_even(CAST(x AS DOUBLE) * 32768, 0))) / 32768"


@query("U1_decode_encode", f"""SELECT vec_id || '.wav' AS file_name, 16000 AS sample_rate, len(embedding) AS n,
    round(list_sum(list_transform(embedding, lambda x: {_PCM})), 6) AS total FROM embeddings""")
def u1_decode(spark, folder):
    decoded = U.readable(U.decode_clips(U.encode_clips(audio(spark, folder)).select("file_name", "content")))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return decoded.select("file_name", "sample_rate", F.size("samples").cast("long").alias("n"), F.round(total, 6).alias("total"))


# Weights of the band-limited interpolation at t: reach 17 samples, cut-off 0.99 (rate doubled).
@query("U2_resample", """SELECT vec_id || '.wav' AS file_name, 16000 AS sample_rate, CAST(k AS INTEGER) AS pos, round(CAST(CAST(list_sum(list_transform(
    embedding, lambda x, i: CASE WHEN abs(i - 1 - k / 2) >= 17 THEN 0 ELSE CAST(x AS DOUBLE) * pow(cos(pi() * (i - 1 - k / 2) / 34), 2) * 0.99::DOUBLE
      * CASE WHEN i - 1 = k / 2 THEN 1 ELSE sin(pi() * 0.99::DOUBLE * (i - 1 - k / 2)) / (pi() * 0.99::DOUBLE * (i - 1 - k / 2)) END END)) AS FLOAT) AS DOUBLE), 6) + 0.0 AS value
    FROM embeddings, LATERAL (SELECT unnest(range(2 * len(embedding))) AS k)""")
def u2(spark, folder):
    low = audio(spark, folder).withColumn("sample_rate", F.lit(8_000))
    long = U.resample_clips(low, 16_000).select("file_name", "sample_rate", F.posexplode("samples").alias("pos", "value"))
    return long.withColumn("value", F.round(F.col("value").cast("double"), 6))


_SNR = 7.0


@query("U3_add_noise", f"""WITH noise AS (SELECT CAST(embedding AS DOUBLE[]) AS z, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS en
      FROM embeddings ORDER BY vec_id LIMIT 1),
    e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS s, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS es,
      CASE WHEN label = 0 THEN NULL ELSE {_SNR} END AS snr FROM embeddings)
    SELECT vec_id || '.wav' AS file_name, round(list_sum(list_transform(s, lambda x, i: abs(x + CASE WHEN snr IS NULL THEN 0 ELSE
      pow(10, (10 * log10(es / en) - snr) / 20) * z[i] END))), 4) AS total FROM e, noise""")
def u3(spark, folder):
    clean = audio(spark, folder)
    noise = np.array(table(spark, folder, "embeddings").orderBy("vec_id").select("embedding").first()[0])
    levels = table(spark, folder, "embeddings").select(
        F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("file_name"),
        F.when(F.col("label") != 0, F.lit(_SNR)).alias("snr"),
    )
    noisy = U.add_noise(clean.join(levels, "file_name"), noise, "snr")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return noisy.select("file_name", F.round(total, 4).alias("total"))


@query("U3_noise_folder", f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: {_PCM}) AS s FROM embeddings),
    e AS (SELECT vec_id, s, list_sum(list_transform(s, lambda x: x * x)) AS es FROM p),
    z AS (SELECT s AS z, es AS en FROM e ORDER BY vec_id LIMIT 1),
    m AS (SELECT vec_id, list_transform(s, lambda x, i: CAST(x + pow(10, (10 * (log10(es) - log10(en)) - {_SNR}) / 20) * z[i] AS FLOAT)) AS m FROM e, z)
    SELECT vec_id || '.wav' AS file_name, 16000 AS sample_rate, len(m) AS n, round(list_sum(list_transform(m, lambda x: {_PCM})), 6) AS total FROM m""")
def u3_folder(spark, folder):
    source, target = scratch_path(spark, "clips"), scratch_path(spark, "noisy")
    C.write_clips(U.encode_clips(audio(spark, folder)), source)
    first = table(spark, folder, "embeddings").agg(F.min("vec_id")).first()[0]
    # Windows of a millisecond, so that these short clips too have several.
    noisy_folder(spark, source, f"{source}/{first}.wav", target, _SNR, seconds=0.001)
    decoded = U.readable(U.decode_clips(C.scan_clips(spark, target).select("file_name", "content")))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return decoded.select("file_name", "sample_rate", F.size("samples").cast("long").alias("n"), F.round(total, 6).alias("total"))


# Two samples for one: the clip of 8 kHz is read by windows of a millisecond and joined again.
@query("U2_resample_windows", f"""SELECT vec_id || '.wav' AS file_name, CAST(k AS INTEGER) AS pos, round(CAST(CAST(list_sum(list_transform(
    s, lambda x, i: CASE WHEN abs(i - 1 - k / 2) >= 17 THEN 0 ELSE x * pow(cos(pi() * (i - 1 - k / 2) / 34), 2) * 0.99::DOUBLE
      * CASE WHEN i - 1 = k / 2 THEN 1 ELSE sin(pi() * 0.99::DOUBLE * (i - 1 - k / 2)) / (pi() * 0.99::DOUBLE * (i - 1 - k / 2)) END END)) AS FLOAT) AS DOUBLE), 6) + 0.0 AS value
    FROM (SELECT vec_id, list_transform(embedding, lambda x: {_PCM}) AS s FROM embeddings), LATERAL (SELECT unnest(range(2 * len(s))) AS k)""")
def u2_windows(spark, folder):
    path = scratch_path(spark, "clips")
    C.write_clips(U.encode_clips(audio(spark, folder).withColumn("sample_rate", F.lit(8_000))), path)
    parts = W.resample_windows(W.clip_windows(C.scan_clips(spark, path), 16_000, seconds=0.001), 16_000)
    long = W.join_windows(parts).select("file_name", F.posexplode("samples").alias("pos", "value"))
    return long.withColumn("value", F.round(F.col("value").cast("double"), 6))


def toy_encoder():
    """Stands for a speaker encoder: mean, root mean square, least and greatest sample."""
    return lambda clips: [(c.mean(), np.sqrt((c.astype(float) ** 2).mean()), c.min(), c.max()) for c in clips]


@query("U4_embed_clips", """SELECT vec_id || '.wav' AS filename, round(list_avg(e), 4) + 0.0 AS mean, round(sqrt(list_avg(list_transform(e, lambda x: x * x))), 4) AS rms,
    round(list_min(e), 4) + 0.0 AS low, round(list_max(e), 4) + 0.0 AS high FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def u4(spark, folder):
    vectors = U.embed_clips(audio(spark, folder), toy_encoder)
    return vectors.select("filename", *[
        F.round(F.col("embedding")[i].cast("double"), 4).alias(n) for i, n in enumerate(("mean", "rms", "low", "high"))
    ])


_LEVELS = [0.0, 10.0]


@query("V9_separation_from_audio", f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS s, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS es FROM embeddings),
    z AS (SELECT s AS z, es AS en FROM e ORDER BY vec_id LIMIT 1),
    m AS (SELECT vec_id, label, snr, CAST(list_transform(s, lambda x, i: CAST(x + pow(10, (10 * (log10(es) - log10(en)) - snr) / 20) * z[i] AS FLOAT)) AS DOUBLE[]) AS m
      FROM e, z, (SELECT unnest({_LEVELS}::DOUBLE[]) AS snr)),
    v AS (SELECT vec_id, snr, CASE WHEN label < 5 THEN 0 ELSE 1 END AS c, [list_avg(m), sqrt(list_avg(list_transform(m, lambda x: x * x))), list_min(m), list_max(m)] AS v FROM m),
    sums AS (SELECT a.vec_id, a.snr, a.c, b.c AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM v a JOIN v b USING (snr) GROUP BY ALL),
    ab AS (SELECT vec_id, snr, max(CASE WHEN other = c THEN s / (n - 1) END) AS a, max(CASE WHEN other <> c THEN s / n END) AS b FROM sums GROUP BY ALL)
    SELECT snr, round(avg((b - a) / greatest(a, b)), 4) + 0.0 AS score FROM ab GROUP BY 1""")
def v9_audio(spark, folder):
    labels = table(spark, folder, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("file_name"), "label")
    clips = audio(spark, folder).join(labels, "file_name")
    noise = np.array(table(spark, folder, "embeddings").orderBy("vec_id").select("embedding").first()[0])
    scores = separation_from_audio(clips.filter("label < 5"), clips.filter("label >= 5"), noise, _LEVELS, toy_encoder)
    return scores.withColumn("score", F.round("score", 4) + 0.0)


def toy_model():
    """Stands for a speech model: a word per sample by its sign; pass p drops every seventh."""
    def run(clips, pass_no):
        return [
            " ".join("up" if s > 0 else "down" for i, s in enumerate(c) if pass_no == 0 or (i + pass_no) % 7)
            for c in clips
        ]

    return run


@query("U5_transcribe", """SELECT vec_id || '.wav' AS file_name, CAST(p AS INTEGER) AS pass_no, array_to_string(list_transform(
    list_filter(embedding, lambda x, i: p = 0 OR (i - 1 + p) % 7 <> 0), lambda x: CASE WHEN x > 0 THEN 'up' ELSE 'down' END), ' ') AS text
    FROM embeddings, range(0, 21) r(p)""")
def u5(spark, folder):
    return U.transcribe(audio(spark, folder), toy_model, 20)


VOCAB = ["-", "|", "a", "b"]


def toy_frames():
    """Stands for an acoustic model: every four samples are the scores of one frame."""
    return lambda clips, pass_no: [c.reshape(-1, 4) for c in clips]


@query("U6_greedy_decode", """WITH f AS (SELECT vec_id, t, list_position(v, list_max(v)) - 1 AS tok FROM (
      SELECT vec_id, t, embedding[t * 4 + 1 : t * 4 + 4] AS v FROM embeddings, LATERAL (SELECT unnest(range(len(embedding) // 4)) AS t))),
    k AS (SELECT *, lag(tok) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM f)
    SELECT vec_id || '.wav' AS file_name, 0 AS pass_no, trim(coalesce(string_agg(CASE tok WHEN 1 THEN ' ' WHEN 2 THEN 'a' ELSE 'b' END, ''
      ORDER BY t) FILTER (WHERE tok <> 0 AND tok IS DISTINCT FROM before), '')) AS text FROM k GROUP BY vec_id""")
def u6(spark, folder):
    return S.greedy_decode(U.frame_logits(audio(spark, folder), toy_frames, passes=0), VOCAB)


@query("U7_word_error_rate", sql("hypotheses", f"{_BY_WORD} SELECT file_name, pass_no, round(rate, 6) AS wer FROM rated"))
def u7(spark, folder):
    pairs = S.base_and_passes(hypotheses(spark, folder))
    return pairs.select("file_name", "pass_no", F.round(wer(F.col("base"), F.col("text")), 6).alias("wer"))


@query("U8_character_error_rate", sql("hypotheses", f"{_BY_CHAR} SELECT file_name, pass_no, round(rate, 6) AS cer FROM rated"))
def u8(spark, folder):
    pairs = S.base_and_passes(hypotheses(spark, folder))
    return pairs.select("file_name", "pass_no", F.round(cer(F.col("base"), F.col("text")), 6).alias("cer"))


@query("U9_uncertainty_wer", sql("hypotheses", f"{_BY_WORD} SELECT file_name, round(avg(rate), 6) AS uncertainty FROM rated GROUP BY 1"))
def u9(spark, folder):
    return S.uncertainty_mean_wer(hypotheses(spark, folder)).withColumn("uncertainty", F.round("uncertainty", 6))


@query("U10_uncertainty_cer", sql("hypotheses", f"{_BY_CHAR} SELECT file_name, round(rate, 6) AS uncertainty FROM rated WHERE pass_no = 1"))
def u10(spark, folder):
    return S.uncertainty_cer(hypotheses(spark, folder)).withColumn("uncertainty", F.round("uncertainty", 6))


_HEARD = """t AS (SELECT vec_id || '.wav' AS file_name, p, list_transform(list_filter(embedding, lambda x, i: p = 0 OR (i - 1 + p) % 7 <> 0),
    lambda x: CASE WHEN x > 0 THEN 'u' ELSE 'd' END) AS w FROM embeddings, range(0, 21) r(p))"""


@query("U11_score_pool", f"""WITH {_HEARD} SELECT b.file_name, round(avg(levenshtein(array_to_string(b.w, ''), array_to_string(h.w, ''))
    / len(b.w)::DOUBLE), 6) AS uncertainty FROM t b JOIN t h USING (file_name) WHERE b.p = 0 AND h.p > 0 GROUP BY 1""")
def u11(spark, folder):
    # Inference is written once: scoring reads base and dropout passes from it.
    heard = U.transcribe(audio(spark, folder), toy_model, 20, tasks=spark.sparkContext.defaultParallelism)
    scores = S.score_pool(materialise(heard, "hypotheses"), "inverse")
    return scores.withColumn("uncertainty", F.round("uncertainty", 6))


@query("U12_prototype_two_passes", sql("hypotheses", f"{_BY_WORD} SELECT file_name, round(avg(rate), 6) AS uncertainty FROM rated WHERE pass_no <= 2 GROUP BY 1"))
def u12(spark, folder):
    return S.score_pool(hypotheses(spark, folder, passes=2), "inverse").withColumn("uncertainty", F.round("uncertainty", 6))


@query("U12_prototype_first_slice", sql("hypotheses", f"""{_BY_WORD} SELECT file_name, round(avg(rate), 6) AS uncertainty FROM rated
    WHERE pass_no <= 2 AND CAST(split_part(file_name, '.', 1) AS BIGINT) < 20 GROUP BY 1"""))
def u12_first(spark, folder):
    heard = hypotheses(spark, folder)
    manifest = heard.select("file_name", F.substring_index("file_name", ".", 1).cast("long").alias("row_idx")).distinct()
    return S.score_first(heard, manifest, 20).withColumn("uncertainty", F.round("uncertainty", 6))


@query("U13_label_wer", sql("hypotheses", f"""pairs AS (SELECT file_name, pass_no, h.text, replace(b.text, 'the', 'a') AS base
    FROM hypotheses h JOIN benchmark b ON h.file_name = b.item_id || '.wav'), {_coded(_WORDS)}
    SELECT file_name, pass_no, round(rate, 6) AS wer FROM rated"""))
def u13(spark, folder):
    manifest = table(spark, folder, "benchmark").select(
        F.concat(F.col("item_id").cast("string"), F.lit(".wav")).alias("file_name"),
        F.replace("text", F.lit("the"), F.lit("a")).alias("sentence"),
    )
    return S.label_wer(hypotheses(spark, folder), manifest).withColumn("wer", F.round("wer", 6))
