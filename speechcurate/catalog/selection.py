"""Queries on numbering, sampling, selection and the jobs built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechcurate.catalog.standins import clips, query, skewed_clusters, sql, table, transcripts, uncertainties
from speechcurate.operators import manifest as M
from speechcurate.operators import ordering as O
from speechcurate.operators import selection as S
from speechcurate.operators.joins import assign_cluster, join_uncertainty
from speechcurate.plans import rounds as R
from speechcurate.session import materialise

# --- numbering ---------------------------------------------------------------


@query("W1_number_clients", "SELECT event_id, CAST(user_id AS VARCHAR) AS client_id, "
                            "dense_rank() OVER (ORDER BY CAST(user_id AS VARCHAR)) AS client_no FROM events")
def w1(spark, folder):
    return O.number_clients(table(spark, folder, "events").select("event_id", F.col("user_id").alias("client_id")))


_RUNS = """marked AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS s FROM events),
    islands AS (SELECT *, sum(s) OVER (ORDER BY event_id) AS run FROM marked),
    numbered AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY run ORDER BY event_id) AS file_no FROM islands)"""


@query("W2_number_runs", f"WITH {_RUNS} SELECT event_id, event_type AS client_id, file_no FROM numbered")
def w2(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.col("event_type").alias("client_id"))
    return O.number_runs(rows, order="event_id")


@query("W3_renumber_clips", f"""WITH {_RUNS} SELECT event_id, event_type AS client_id, event_type || '/' || event_id || '.wav' AS file_name,
    file_no, dense_rank() OVER (ORDER BY event_type) AS client_no,
    event_type || '/' || dense_rank() OVER (ORDER BY event_type) || '_' || file_no || '.wav' AS new_name FROM numbered""")
def w3(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("client_id"),
        F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".wav")).alias("file_name"),
    )
    return O.renumber_clips(rows, order="event_id", dense=True)


_QUOTA = """train AS (SELECT * FROM clips WHERE string_split(file_name, '/')[2] = 'train'),
    scored AS (SELECT t.*, 'train' AS split, u.uncertainty, c.cluster FROM train t JOIN uncertainties u USING (file_name)
      JOIN skewed_clusters c ON c.filename = string_split(t.file_name, '/')[-1]),
    sizes AS (SELECT cluster, count(*) AS count FROM scored GROUP BY 1),
    quota AS (SELECT cluster, count, CAST(trunc(((0.0397::DOUBLE - 0.095::DOUBLE) * (count / (SELECT sum(count) FROM sizes)::DOUBLE)
      + 0.095::DOUBLE) * count) AS BIGINT) * 4 AS num_samples FROM sizes)"""


def scored_train(spark, folder):
    """Train clips with uncertainty and cluster, written once as the selections read it several times."""
    train, _ = M.partition_by_split(clips(spark, folder), "train")
    with_scores = join_uncertainty(train, uncertainties(spark, folder))
    return materialise(assign_cluster(with_scores, skewed_clusters(spark, folder), order=None), "train")


def _quota_of(rows):
    return S.inverse_quota(S.cluster_sizes(rows))


def train_quota(spark, folder):
    train, _ = M.partition_by_split(clips(spark, folder), "train")
    return _quota_of(assign_cluster(train, skewed_clusters(spark, folder), order=None))


_BY_UNCERTAINTY = """SELECT * EXCLUDE (r, num_samples) FROM (SELECT s.*, q.num_samples,
    row_number() OVER (PARTITION BY s.cluster ORDER BY uncertainty DESC, row_idx) AS r FROM scored s JOIN quota q USING (cluster)) WHERE r <= num_samples"""
_SCORED = "clips uncertainties skewed_clusters"


@query("W4_top_per_cluster", sql(_SCORED, f"{_QUOTA} {_BY_UNCERTAINTY}"))
def w4(spark, folder):
    rows = scored_train(spark, folder)
    return S.top_uncertain_per_cluster(rows, _quota_of(rows))


@query("W5_first_per_key", "SELECT doc_id, text, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def w5(spark, folder):
    return O.first_per_key(table(spark, folder, "documents").select("doc_id", "text", "lang"), "text", "doc_id")


@query("W5_last_per_key", "SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def w5_last(spark, folder):
    return O.first_per_key(table(spark, folder, "events").select("event_id", "user_id", "value"), "user_id", "event_id", last=True)


@query("T1_top_uncertain", sql(_SCORED, f"""{_QUOTA} SELECT * FROM scored QUALIFY row_number() OVER (ORDER BY uncertainty DESC, row_idx)
    <= (SELECT sum(num_samples) FROM quota)"""))
def t1(spark, folder):
    rows = scored_train(spark, folder)
    return S.top_uncertain(rows, _quota_of(rows).agg(F.sum("num_samples")).first()[0])


@query("T3_row_idx", "SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS row_idx FROM pages")
def t3(spark, folder):
    return O.with_row_idx(table(spark, folder, "pages").select("url", "page_id"), ["url", "page_id"])


@query("F7_head_fraction", sql("clips", "SELECT * FROM clips WHERE row_idx < round((SELECT count(*) FROM clips) * 5 / 100)"))
def f7(spark, folder):
    return S.head_fraction(clips(spark, folder), 5)


# --- sampling ----------------------------------------------------------------

_ORDER = "md5('42:' || {k}), {k}"
_BY_FILE = _ORDER.format(k="file_name")
_CLUSTERED = """rows AS (SELECT t.*, c.cluster FROM clips t JOIN skewed_clusters c ON c.filename = string_split(t.file_name, '/')[-1]),
    sizes AS (SELECT cluster, count(*) AS count FROM rows GROUP BY 1)"""


def _clustered(spark, folder):
    return assign_cluster(clips(spark, folder), skewed_clusters(spark, folder), order=None)


@query("R1_sample_n", sql("clips", f"SELECT * FROM clips ORDER BY {_BY_FILE} LIMIT 100"))
def r1(spark, folder):
    return S.sample_n(clips(spark, folder), 100)


@query("R2_sample_per_cluster", sql("clips skewed_clusters", f"""{_CLUSTERED} SELECT * FROM rows
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY {_BY_FILE}) <= 5"""))
def r2(spark, folder):
    return S.sample_n_per_cluster(_clustered(spark, folder), 5)


@query("R3_sample_frac", sql("clips", f"SELECT * FROM clips QUALIFY row_number() OVER (ORDER BY {_BY_FILE}) <= (SELECT round_even(0.05::DOUBLE * count(*), 0) FROM clips)"))
def r3(spark, folder):
    return S.sample_frac(clips(spark, folder))


@query("R4_sample_stratified", sql("clips skewed_clusters", f"""{_CLUSTERED} SELECT * EXCLUDE (r, count) FROM (SELECT rows.*, count,
    row_number() OVER (PARTITION BY cluster ORDER BY {_BY_FILE}) AS r FROM rows JOIN sizes USING (cluster)) WHERE r <= round_even(0.05::DOUBLE * count, 0)"""))
def r4(spark, folder):
    return S.sample_stratified(_clustered(spark, folder))


@query("R5_inverse_quota", sql("skewed_clusters", """sizes AS (SELECT cluster, count(*) AS count FROM skewed_clusters GROUP BY 1),
    shares AS (SELECT *, count / (SELECT sum(count) FROM sizes)::DOUBLE AS p FROM sizes),
    affine AS (SELECT *, (0.0397::DOUBLE - 0.095::DOUBLE) * p + 0.095::DOUBLE AS a FROM shares)
    SELECT cluster, count, round(p, 9) AS sample_percentage, round(a, 9) AS affine_linear, CAST(trunc(a * count) AS BIGINT) * 4 AS num_samples FROM affine"""))
def r5(spark, folder):
    quota = S.inverse_quota(S.cluster_sizes(skewed_clusters(spark, folder)))
    return quota.withColumns({c: F.round(c, 9) for c in ("sample_percentage", "affine_linear")})


_BY_DIGEST = f"""SELECT * EXCLUDE (r, num_samples) FROM (SELECT s.*, q.num_samples,
    row_number() OVER (PARTITION BY s.cluster ORDER BY {_BY_FILE}) AS r FROM scored s JOIN quota q USING (cluster)) WHERE r <= num_samples"""


@query("R6_sample_inverse", sql(_SCORED, f"{_QUOTA} {_BY_DIGEST}"))
def r6(spark, folder):
    return S.sample_inverse(scored_train(spark, folder))


@query("R7_train_test_split", sql("clips", f"""n AS (SELECT *, row_number() OVER (ORDER BY {_BY_FILE}) AS r FROM clips)
    SELECT * EXCLUDE (r), CASE WHEN r <= (SELECT ceil(0.3::DOUBLE * count(*)) FROM clips) THEN 'test' ELSE 'train' END AS part FROM n"""))
def r7(spark, folder):
    train, test = S.train_test_split(clips(spark, folder))
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


@query("R8_select_random", sql(_SCORED, f"{_QUOTA} SELECT * FROM scored QUALIFY row_number() OVER (ORDER BY {_BY_FILE}) <= (SELECT sum(num_samples) FROM quota)"))
def r8(spark, folder):
    rows = scored_train(spark, folder)
    return S.select_batch(rows, _quota_of(rows), "random")


# --- jobs --------------------------------------------------------------------


@query("R9_active_round", sql(_SCORED, f"{_QUOTA} {_BY_UNCERTAINTY}"))
def r9(spark, folder):
    return R.active_round(
        clips(spark, folder), uncertainties(spark, folder), skewed_clusters(spark, folder), train_quota(spark, folder)
    )


@query("R9_round_summary", sql(_SCORED, f"""{_QUOTA}, taken AS ({_BY_UNCERTAINTY})
    SELECT cluster, count(*) AS selected, round(avg(uncertainty), 6) AS mean_uncertainty, min(uncertainty) AS least FROM taken GROUP BY 1"""))
def r9_summary(spark, folder):
    return r9(spark, folder).groupBy("cluster").agg(
        F.count("*").alias("selected"), F.round(F.avg("uncertainty"), 6).alias("mean_uncertainty"), F.min("uncertainty").alias("least")
    )


@query("R9_round_smca", sql(_SCORED, f"""{_QUOTA} SELECT * FROM scored QUALIFY row_number() OVER (ORDER BY uncertainty DESC, row_idx)
    <= (SELECT sum(num_samples) FROM quota)"""))
def r9_smca(spark, folder):
    return R.active_round(
        clips(spark, folder), uncertainties(spark, folder), skewed_clusters(spark, folder), train_quota(spark, folder), "smca"
    )


@query("R9_round_random", sql("clips skewed_clusters", f"""scored AS (SELECT t.*, 'train' AS split, c.cluster FROM clips t
      JOIN skewed_clusters c ON c.filename = string_split(t.file_name, '/')[-1] WHERE string_split(file_name, '/')[2] = 'train'),
    sizes AS (SELECT cluster, count(*) AS count FROM scored GROUP BY 1),
    n AS (SELECT sum(CAST(trunc(((0.0397::DOUBLE - 0.095::DOUBLE) * (count / (SELECT sum(count) FROM sizes)::DOUBLE) + 0.095::DOUBLE) * count)
      AS BIGINT) * 4) AS n FROM sizes)
    SELECT * FROM scored QUALIFY row_number() OVER (ORDER BY {_BY_FILE}) <= (SELECT n FROM n)"""))
def r9_random(spark, folder):
    return R.active_round(
        clips(spark, folder), None, skewed_clusters(spark, folder), train_quota(spark, folder), "random"
    )


_CLEAN = "replace(translate({t}, '`[]()-âáëéñúōó', '      ''aeenuoo'), '&', ' and ')"
_CLEAN_B = "replace(translate(replace({t}, 'mustard â', 'mustard a'), '`[]()-âáëéñúōó’', '      ''aeenuoo'''), '&', ' and ')"
_DRAWN = f"""cleaned AS (SELECT * REPLACE ({_CLEAN.format(t="sentence")} AS sentence), string_split(file_name, '/')[2] AS split FROM transcripts),
    train AS (SELECT t.*, c.cluster FROM cleaned t JOIN skewed_clusters c ON c.filename = string_split(t.file_name, '/')[-1] WHERE split = 'train'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {_BY_FILE}) AS r FROM train),
    sizes AS (SELECT cluster, count(*) AS count FROM train GROUP BY 1),
    quota AS (SELECT *, round_even(0.05::DOUBLE * count, 0) AS stratified, CAST(trunc(((0.0397::DOUBLE - 0.095::DOUBLE) *
      (count / (SELECT sum(count) FROM sizes)::DOUBLE) + 0.095::DOUBLE) * count) AS BIGINT) * 4 AS inverse FROM sizes)
    SELECT * EXCLUDE (r, count, stratified, inverse) FROM ranked JOIN quota USING (cluster) WHERE r <= {{quota}}
    UNION ALL BY NAME SELECT * FROM cleaned WHERE split IS DISTINCT FROM 'train'"""


@query("R10_cluster_sample_stratified", sql("transcripts skewed_clusters", _DRAWN.format(quota="stratified")))
def r10(spark, folder):
    return R.cluster_sample(transcripts(spark, folder), skewed_clusters(spark, folder), "stratified")


@query("R10_cluster_sample_inverse", sql("transcripts skewed_clusters", _DRAWN.format(quota="inverse")))
def r10_inverse(spark, folder):
    return R.cluster_sample(transcripts(spark, folder), skewed_clusters(spark, folder), "inverse")


@query("R10_cluster_sample_random", sql("transcripts skewed_clusters", _DRAWN.format(quota="drawn").replace(
    "PARTITION BY cluster ORDER BY", "ORDER BY").replace("quota AS (SELECT *,", "quota AS (SELECT *, round_even(0.05::DOUBLE * (SELECT count(*) FROM train), 0) AS drawn,"
).replace("EXCLUDE (r,", "EXCLUDE (r, drawn,")))
def r10_random(spark, folder):
    return R.cluster_sample(transcripts(spark, folder), skewed_clusters(spark, folder), "random")


@query("R11_update_pool", sql(_SCORED, f"""{_QUOTA}, taken AS ({_BY_UNCERTAINTY})
    SELECT * FROM clips WHERE file_name NOT IN (SELECT file_name FROM taken)"""))
def r11(spark, folder):
    return R.update_pool(clips(spark, folder), r9(spark, folder).drop("uncertainty", "split"))


@query("R12_training_set", f"""WITH a AS (SELECT doc_id || '.wav' AS file_name, text AS sentence, source AS speaker_id FROM documents),
    b AS (SELECT 'b' || conv_id || '_' || turn || '.wav' AS file_name, text AS sentence, role AS speaker_id FROM conversations),
    n AS (SELECT *, row_number() OVER (ORDER BY {_BY_FILE}) <= (SELECT ceil(0.3::DOUBLE * count(*)) FROM a) AS held FROM a),
    u AS (SELECT 'clips/' || CASE WHEN held THEN 'dev' ELSE 'train' END || '/' || file_name AS file_name, sentence, speaker_id FROM n
      UNION ALL SELECT 'clips/train/' || file_name, sentence, speaker_id FROM b)
    SELECT * REPLACE ({_CLEAN_B.format(t="sentence")} AS sentence) FROM u""")
def r12(spark, folder):
    first = table(spark, folder, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("file_name"),
        F.col("text").alias("sentence"), F.col("source").alias("speaker_id"),
    )
    second = table(spark, folder, "conversations").select(
        F.concat(F.lit("b"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".wav")).alias("file_name"),
        F.col("text").alias("sentence"), F.col("role").alias("speaker_id"),
    )
    return R.build_training_set(first, second)


# --- repeated and null keys ---------------------------------------------------

_REPEATED = "twice AS (SELECT CASE WHEN row_idx % 4 = 0 THEN NULL ELSE file_name END AS file_name, speaker_id FROM clips UNION ALL SELECT file_name, speaker_id FROM clips)"


def _repeated(spark, folder):
    """Clips twice, a quarter of the first copies without a path."""
    rows = clips(spark, folder)
    unnamed = rows.select(F.when(F.col("row_idx") % 4 != 0, F.col("file_name")).alias("file_name"), "speaker_id")
    return materialise(unnamed.union(rows.select("file_name", "speaker_id")), "repeated")


@query("R1_repeated_keys", sql("clips", f"{_REPEATED} SELECT count(*) AS n, count(file_name) AS named FROM (SELECT * FROM twice ORDER BY "
                                        "md5('42:' || coalesce(file_name, '')), coalesce(file_name, ''), file_name IS NULL LIMIT 333)"))
def r1_repeated(spark, folder):
    return S.sample_n(_repeated(spark, folder), 333).agg(F.count("*").alias("n"), F.count("file_name").alias("named"))


@query("R7_repeated_keys", sql("clips", f"{_REPEATED} SELECT 'test' AS part, CAST(ceil(0.3 * count(*)) AS BIGINT) AS n FROM twice "
                                        "UNION ALL SELECT 'train', count(*) - CAST(ceil(0.3 * count(*)) AS BIGINT) FROM twice"))
def r7_repeated(spark, folder):
    train, test = S.train_test_split(_repeated(spark, folder), 0.3)
    return test.agg(F.lit("test").alias("part"), F.count("*").alias("n")).union(train.agg(F.lit("train").alias("part"), F.count("*").alias("n")))


_TIED = """tied AS (SELECT e.event_id % 16 AS cluster, e.event_id % 7 AS row_idx, c.file_name,
      CASE e.event_id % 11 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN round(e.value) ELSE 1.0 END AS uncertainty
    FROM events e JOIN clips c ON c.row_idx = e.event_id)"""


@query("W4_tied_scores", sql("clips", f"{_TIED} SELECT * FROM tied QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY uncertainty DESC NULLS LAST, row_idx, file_name) <= 25"))
def w4_tied(spark, folder):
    """One score for most rows, infinite and missing ones, repeated row numbers, 16 clusters and ten rows to a task."""
    e = table(spark, folder, "events").join(clips(spark, folder).select("file_name", F.col("row_idx").alias("event_id")), "event_id")
    n = F.col("event_id") % 11
    score = F.when(n == 0, float("inf")).when(n == 1, float("-inf")).when(n == 3, F.round("value")).when(n > 3, 1.0)
    rows = e.select((F.col("event_id") % 16).alias("cluster"), (F.col("event_id") % 7).alias("row_idx"), "file_name", score.alias("uncertainty"))
    quota = rows.select("cluster").distinct().withColumn("num_samples", F.lit(25))
    return S.take_ranked(materialise(rows, "tied"), S.ScoreOrder(), quota, "cluster", rows_per_task=10)


@query("R11_files_to_files", sql(_SCORED, f"""{_QUOTA}, chosen AS ({_BY_UNCERTAINTY})
    SELECT file_name, speaker_id, CAST(duration AS VARCHAR) AS duration FROM clips WHERE file_name NOT IN (SELECT file_name FROM chosen)"""))
def r11_files(spark, folder):
    """Manifest, clusters, uncertainties and quota as files, read with their schemas: a round, then the next pool. The row number goes along, as it orders equal scores."""
    from speechcurate.session import scratch_path
    from speechcurate.sources import manifests as SM
    from speechcurate.sources import vectors as SV

    home = scratch_path(spark, "files")
    SM.write_manifest(clips(spark, folder).select("file_name", F.col("duration").cast("string").alias("duration"), "speaker_id", "row_idx"), f"{home}/pool")
    SM.write_manifest(uncertainties(spark, folder), f"{home}/uncertainty")
    SV.write_clusters(skewed_clusters(spark, folder).select("filename", "cluster"), f"{home}/clusters")
    SM.write_manifest(train_quota(spark, folder), f"{home}/quota")
    pool = SM.read_manifest(spark, f"{home}/pool", "file_name string, speaker_id string, row_idx long")
    scores = SM.read_manifest(spark, f"{home}/uncertainty", "file_name string, uncertainty double")
    quota = SM.read_manifest(spark, f"{home}/quota", "cluster int, num_samples long")
    batch = R.active_round(pool, scores, SV.read_clusters(spark, f"{home}/clusters"), quota)
    return R.update_pool(pool, batch.drop("uncertainty", "split")).drop("row_idx")
