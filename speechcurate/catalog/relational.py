"""Queries on sources, projections, filters, joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechcurate.catalog.standins import clips, emb, query, skewed_clusters, sql, table, transcripts, uncertainties
from speechcurate.functions import text as X
from speechcurate.operators import joins as J
from speechcurate.operators import manifest as M
from speechcurate.operators import sets as U
from speechcurate.operators import stats as A
from speechcurate.operators.selection import cluster_share, cluster_sizes, inverse_quota, sample_inverse
from speechcurate.session import scratch_path
from speechcurate.sources import clips as C
from speechcurate.sources import manifests as SM
from speechcurate.sources import vectors as SV

# --- sources and sinks -------------------------------------------------------


@query("S1_read_manifest", sql("transcripts", "SELECT file_name, sentence, speaker_id FROM transcripts"))
def s1(spark, folder):
    path = scratch_path(spark, "manifest")
    SM.write_manifest(transcripts(spark, folder).select("file_name", "sentence", "speaker_id"), path)
    return SM.read_manifest(spark, path, multi_line=True)


@query("S1_read_by_name", sql("transcripts", "SELECT file_name, sentence, speaker_id, lang, CAST(row_idx AS VARCHAR) AS row_idx FROM transcripts"))
def s1_by_name(spark, folder):
    path = scratch_path(spark, "manifest")
    SM.write_manifest(transcripts(spark, folder).select("speaker_id", "lang", "file_name", "row_idx", "sentence"), path)
    return SM.read_manifest(spark, path, multi_line=True)


@query("S1_mixed_headers", sql("transcripts", "SELECT file_name, sentence, speaker_id, CASE WHEN row_idx % 2 = 1 THEN lang END AS lang FROM transcripts"))
def s1_mixed_headers(spark, folder):
    """A folder whose files have their columns in different orders; half of them lack the language."""
    path = scratch_path(spark, "manifest")
    rows = transcripts(spark, folder)
    SM.write_manifest(rows.filter("row_idx % 2 = 0").select("file_name", "sentence", "speaker_id"), f"{path}/part=a")
    SM.write_manifest(rows.filter("row_idx % 2 = 1").select("lang", "speaker_id", "sentence", "file_name"), f"{path}/part=b")
    return SM.read_manifest(spark, f"{path}/*").select("file_name", "sentence", "speaker_id", "lang")


@query("S2_read_invalid", """SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 5 > 0 THEN value END AS value, CASE WHEN event_id % 3 > 0 THEN user_id END AS user_id,
    CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS problems FROM events""")
def s2_invalid(spark, folder):
    """Numbers spoiled by a text; each is listed beside its row."""
    path = scratch_path(spark, "tsv")
    spoiled = [F.when(F.col("event_id") % n == 0, F.concat(F.lit("x"), F.col("event_type"))).otherwise(F.col(c).cast("string")).alias(c) for c, n in (("value", 5), ("user_id", 3))]
    SM.write_manifest(table(spark, folder, "events").select(F.col("event_id").alias("path"), *spoiled), path, sep="\t")
    read = SM.read_manifest(spark, path, "path string, value double, user_id long", sep="\t", multi_line=False, invalid="report")
    return read.select("path", "value", "user_id", F.size("invalid").alias("problems"))


@query("S2_read_tsv", "SELECT CAST(event_id AS VARCHAR) AS path, event_type AS client_id, props FROM events")
def s2(spark, folder):
    path = scratch_path(spark, "tsv")
    rows = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("path"), F.col("event_type").alias("client_id"), "props"
    )
    SM.write_manifest(rows, path, sep="\t")
    return SM.read_manifest(spark, path, rows.schema, sep="\t", multi_line=False)


@query("S2_read_by_name", "SELECT CAST(event_id AS VARCHAR) AS path, value, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events")
def s2_by_name(spark, folder):
    path = scratch_path(spark, "tsv")
    SM.write_manifest(table(spark, folder, "events").select("event_type", "user_id", "value", F.col("event_id").alias("path")), path, sep="\t")
    return SM.read_manifest(spark, path, "path string, value double", sep="\t")


@query("S3_write_by_split", sql("clips", "SELECT file_name, speaker_id, string_split(file_name, '/')[2] AS split FROM clips"))
def s3(spark, folder):
    path = scratch_path(spark, "by-split")
    rows = M.with_split(clips(spark, folder).select("file_name", "speaker_id"))
    SM.write_manifest(rows, path, partition_by="split")
    return SM.read_manifest(spark, path, rows.schema, multi_line=False)


@query("S4_embeddings", "SELECT vec_id || '.wav' AS filename, CAST(d AS INTEGER) AS dim, "
                        "round(CAST(embedding[d + 1] AS DOUBLE), 6) + 0.0 AS value "
                        "FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS d)")
def s4(spark, folder):
    path = scratch_path(spark, "embeddings")
    SV.write_embeddings(emb(spark, folder).select("filename", "embedding"), path)
    long = M.embedding_long(SV.read_embeddings(spark, path))
    return long.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("S5_clusters", sql("skewed_clusters", "SELECT filename, cluster FROM skewed_clusters"))
def s5(spark, folder):
    path = scratch_path(spark, "clusters")
    SV.write_clusters(skewed_clusters(spark, folder).select("filename", "cluster"), path)
    return SV.read_clusters(spark, path)


@query("S6_text_vectors", "SELECT vec_id || '.wav' AS filename, CAST(d AS INTEGER) AS dim, "
                          "round(CAST(embedding[d + 1] AS DOUBLE), 6) + 0.0 AS value "
                          "FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS d)")
def s6(spark, folder):
    path = scratch_path(spark, "ivectors")
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("pic_path"), F.col("embedding").alias("features"))
    SV.write_text_vectors(rows, path)
    long = M.embedding_long(SV.import_ivectors(SV.read_text_vectors(spark, path)))
    return long.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("S8_ingest_corpus", "SELECT doc_id || '.wav' AS path, text AS sentence, source AS speaker_id, doc_id AS row_idx, "
                           "doc_id || '.wav' AS file_name FROM documents")
def s8(spark, folder):
    raw = table(spark, folder, "documents").select(
        F.concat(F.lit("cache/"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("path"),
        F.col("text").alias("sentence"), F.col("source").alias("client_id"), F.col("doc_id").alias("row_idx"),
    )
    return SM.ingest_corpus(raw, "common_voice")


@query("S9_append_metric", sql("clips", "SELECT string_split(file_name, '/')[2] AS run, round(avg(duration), 6) AS score "
                                        "FROM clips GROUP BY 1"))
def s9(spark, folder):
    path = scratch_path(spark, "metrics")
    rows = M.with_split(clips(spark, folder))
    for split in M.SPLITS:
        one = rows.filter(F.col("split") == split).groupBy(F.col("split").alias("run"))
        SM.append_metric(one.agg(F.round(F.avg("duration"), 6).alias("score")), path)
    return spark.read.schema("run string, score double").parquet(path)


@query("S10_copy_plan", sql("clips", "SELECT file_name, 'pool/' || file_name AS src, 'next/' || file_name AS dst FROM clips"))
def s10(spark, folder):
    return C.clip_copy_plan(clips(spark, folder).select("file_name"), "pool", "next")


_MODES = [(m, "") for m in ("train", "dev", "test", "same")] + [("split", "_split_1")]


@query("S11_copy_plan_modes", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, {moved} AS file_name, 'in/clips/' || f AS src, {dst} AS dst "
    "FROM (SELECT event_type || '/' || event_id || '.wav' AS f FROM events UNION ALL SELECT event_id || '.wav' FROM events)"
    for m, moved, dst in (
        *((s, f"'clips/{s}/' || f", f"'out/clips/{s}/' || f") for s in M.SPLITS),
        *((m, "f", f"'{root}' || CASE WHEN contains(f, '/') THEN '' ELSE 'clips/' END || f")
          for m, root in (("same", "out/"), ("split", "out_split_1/"))),
    )))
def s11(spark, folder):
    events = table(spark, folder, "events")
    bare = F.concat(F.col("event_id").cast("string"), F.lit(".wav"))
    rows = events.select(F.concat("event_type", F.lit("/"), bare).alias("file_name")).union(events.select(bare))
    plans = [
        C.clip_copy_plan(rows, "in", "out", mode=m, relative=False, part=part).withColumn("mode", F.lit(m))
        for m, part in _MODES
    ]
    out = plans[0]
    for plan in plans[1:]:
        out = out.unionByName(plan)
    return out


@query("S12_sidecar_counts", sql("skewed_clusters", """SELECT cluster, count, share AS sample_percentage, affine AS affine_linear,
    CAST(trunc(affine * count) AS BIGINT) * 4 AS num_samples FROM (SELECT *, (0.0397::DOUBLE - 0.095::DOUBLE) * share + 0.095::DOUBLE AS affine FROM (
      SELECT cluster, count(*) AS count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM skewed_clusters GROUP BY 1))"""))
def s12(spark, folder):
    path = scratch_path(spark, "chosen")
    SM.write_with_counts(skewed_clusters(spark, folder), path, "cluster")
    quota = "cluster int, count long, sample_percentage double, affine_linear double, num_samples long"
    return SM.read_manifest(spark, f"{path}/value_counts", quota)


# --- projections -------------------------------------------------------------


@query("P1_split", sql("clips", "SELECT file_name, string_split(file_name, '/')[2] AS split FROM clips "
                                "UNION ALL SELECT url, string_split(url, '/')[2] FROM pages "
                                "UNION ALL SELECT source, string_split(source, '/')[2] FROM documents"))
def p1(spark, folder):
    paths = clips(spark, folder).select("file_name").union(table(spark, folder, "pages").select("url"))
    return M.with_split(paths.union(table(spark, folder, "documents").select("source")))


@query("P2_basename", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def p2(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.basename("url").alias("name"))


@query("P3_swap_extension", "SELECT page_id, string_split(url, '.')[1] || '.wav' AS name FROM pages")
def p3(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.swap_extension("url", ".wav").alias("name"))


@query("P4_append_extension", "SELECT CAST(event_id AS VARCHAR) || '.mp3' AS path FROM events")
def p4(spark, folder):
    return M.with_mp3(table(spark, folder, "events").select(F.col("event_id").cast("string").alias("path")))


@query("P5_change_basename", "SELECT page_id, left(url, length(url) - length(b)) || page_id || CASE WHEN "
                             "contains(ltrim(b, '.'), '.') THEN '.' || string_split(b, '.')[-1] ELSE '' END AS name "
                             "FROM (SELECT *, string_split(url, '/')[-1] AS b FROM "
                             "(SELECT page_id, url FROM pages UNION ALL SELECT page_id, url || '/a.b.wav' FROM pages))")
def p5(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    both = pages.union(pages.select("page_id", F.concat("url", F.lit("/a.b.wav"))))
    return both.select("page_id", X.change_basename("url", F.col("page_id").cast("string")).alias("name"))


_PLAIN = "SELECT '{c}' AS corpus, text AS sentence, {path} AS path, source AS speaker_id, {path} AS file_name FROM documents"


@query("P6_normalise_columns", " UNION ALL ".join((
    _PLAIN.format(c="librispeech", path="'in/a:' || doc_id || '.wav'"),
    _PLAIN.format(c="common_voice", path="'a:' || doc_id || '.wav'"),
    _PLAIN.format(c="voxpopuli", path="'a_' || doc_id || '.b.mp3'"),
)))
def p6(spark, folder):
    docs = table(spark, folder, "documents")
    file = F.concat(F.lit("in/a:"), F.col("doc_id").cast("string"), F.lit(".b.mp3"))
    names = {
        "librispeech": ("text", "file", "speaker_id"),
        "common_voice": ("sentence", "path", "client_id"),
        "voxpopuli": ("sentence", "path", "speaker_id"),
    }
    out = None
    for corpus, (label, path, speaker) in names.items():
        raw = docs.select(F.col("text").alias(label), file.alias(path), F.col("source").alias(speaker))
        one = M.normalise_columns(raw, corpus).withColumn("corpus", F.lit(corpus))
        out = one if out is None else out.unionByName(one)
    return out


@query("P7_columns", sql("clips", "SELECT file_name, speaker_id, row_idx, duration, file_name AS path FROM clips"))
def p7(spark, folder):
    rows = M.with_split(clips(spark, folder)).withColumn("path", F.col("file_name"))
    return M.drop_working_columns(rows.withColumn("uncertainty", F.col("duration")))


_LETTERS = "'`[]()-âáëéñúōó{}', '      ''aeenuoo{}'"


@query("P8_clean_sampler", f"SELECT doc_id, replace(translate(text, {_LETTERS.format('', '')}), '&', ' and ') AS sentence FROM documents")
def p8(spark, folder):
    return M.clean_manifest(table(spark, folder, "documents").select("doc_id", F.col("text").alias("sentence")), "sampler")


_LETTERS_B = _LETTERS.format("’", "''")


@query("P9_clean_creator", "SELECT doc_id, replace(translate(replace(text, 'mustard â', 'mustard a'), "
                           f"{_LETTERS_B}), '&', ' and ') AS sentence FROM documents")
def p9(spark, folder):
    return M.clean_manifest(table(spark, folder, "documents").select("doc_id", F.col("text").alias("sentence")), "creator")


@query("P10_speaker_text", "SELECT event_id, CAST(user_id AS VARCHAR) AS speaker_id FROM events")
def p10(spark, folder):
    return table(spark, folder, "events").select("event_id", F.col("user_id").cast("string").alias("speaker_id"))


@query("P11_corpus_of", "SELECT page_id, CASE WHEN length(url) < 30 THEN 'librispeech' ELSE 'common_voice' END AS corpus FROM pages")
def p11(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.corpus_of("url").alias("corpus"))


@query("P12_cluster_int", "SELECT vec_id, label AS cluster FROM embeddings")
def p12(spark, folder):
    raw = table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("double").alias("cluster"))
    return M.cluster_to_int(raw)


@query("P13_prefix", "SELECT 'clips/dev/' || event_id || '.wav' AS file_name FROM events")
def p13(spark, folder):
    rows = table(spark, folder, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(".wav")).alias("file_name"))
    return M.with_path_prefix(rows, "dev")


@query("P14_explode_embedding", "SELECT vec_id, " + ", ".join(
    f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0.0 AS column{i}" for i in range(64)) + " FROM embeddings")
def p14(spark, folder):
    wide = M.explode_embedding(table(spark, folder, "embeddings").select("vec_id", "embedding"), 64)
    return wide.select("vec_id", *[F.round(F.col(f"column{i}").cast("double"), 6).alias(f"column{i}") for i in range(64)])


@query("P15_constant_label", sql("emb", "SELECT filename, 1 AS label FROM emb"))
def p15(spark, folder):
    return M.with_label(emb(spark, folder).select("filename"), 1, "label")


_DERIVED = ("_output", "_random", "_cluster")


@query("P16_derived_names", "SELECT doc_id, " + ", ".join(f"doc_id || '{s}.tsv' AS name{s}" for s in _DERIVED) + " FROM documents")
def p16(spark, folder):
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".tsv"))
    return table(spark, folder, "documents").select("doc_id", *[X.derived_name(path, s).alias(f"name{s}") for s in _DERIVED])


@query("P17_lists", sql("skewed_clusters", "SELECT filename, cluster FROM skewed_clusters"))
def p17(spark, folder):
    return skewed_clusters(spark, folder).select("filename", "cluster")


# --- filters -----------------------------------------------------------------


@query("F1_partition_by_split", sql("clips", """paths AS (SELECT file_name FROM clips UNION ALL SELECT source FROM documents)
    SELECT file_name, string_split(file_name, '/')[2] AS split,
      CASE WHEN string_split(file_name, '/')[2] = 'train' THEN 'chosen' ELSE 'others' END AS part FROM paths"""))
def f1(spark, folder):
    paths = clips(spark, folder).select("file_name").union(table(spark, folder, "documents").select("source"))
    chosen, others = M.partition_by_split(paths, "train")
    return chosen.withColumn("part", F.lit("chosen")).union(others.withColumn("part", F.lit("others")))


@query("F2_one_speaker", sql("clips", "SELECT * FROM clips WHERE speaker_id = '8'"))
def f2(spark, folder):
    return M.filter_speaker(clips(spark, folder), "8")


@query("F3_two_speakers", sql("clips", "SELECT *, CASE speaker_id WHEN '46' THEN 1 ELSE 2 END AS speaker_order FROM clips "
                                       "WHERE speaker_id IN ('46', '8')"))
def f3(spark, folder):
    return M.select_speakers(clips(spark, folder), "46", "8")


@query("F4_limit_samples", sql("clips", "SELECT * FROM clips WHERE row_idx <= 100"))
def f4(spark, folder):
    return M.limit_samples(clips(spark, folder), 100)


@query("F5_require_not_null", sql("uncertainties", "SELECT * FROM uncertainties WHERE uncertainty IS NOT NULL"))
def f5(spark, folder):
    return M.require_not_null(uncertainties(spark, folder), "uncertainty")


# --- joins -------------------------------------------------------------------


@query("J1_join_clusters", sql("skewed_clusters", "SELECT d.path, d.lang, c.cluster FROM "
                               "(SELECT doc_id || '.wav' AS path, lang FROM documents) d JOIN skewed_clusters c ON d.path = c.filename"))
def j1(spark, folder):
    docs = table(spark, folder, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"), "lang")
    return J.join_clusters_inner(docs, skewed_clusters(spark, folder))


@query("J2_join_uncertainty", sql("clips uncertainties", "SELECT c.*, u.uncertainty FROM clips c LEFT JOIN uncertainties u USING (file_name)"))
def j2(spark, folder):
    return J.join_uncertainty(clips(spark, folder), uncertainties(spark, folder))


_LAST_WINS = """listed AS (SELECT * FROM skewed_clusters UNION ALL
      SELECT doc_id || '.wav', 99, 100000000 + doc_id FROM documents),
    lookup AS (SELECT filename, arg_max(cluster, row_idx) AS cluster FROM listed GROUP BY 1)"""


@query("J3_assign_cluster", sql("clips skewed_clusters", _LAST_WINS + """
    SELECT c.*, l.cluster FROM clips c LEFT JOIN lookup l ON l.filename = string_split(c.file_name, '/')[-1]"""))
def j3(spark, folder):
    again = table(spark, folder, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("filename"), F.lit(99).alias("cluster"),
        (F.col("doc_id") + 100_000_000).alias("row_idx"),
    )
    return J.assign_cluster(clips(spark, folder), skewed_clusters(spark, folder).unionByName(again))


def _two_texts(spark, folder):
    """The documents as they are and cleaned; some speakers are null."""
    rows = transcripts(spark, folder).select("sentence", F.nullif("speaker_id", F.lit("src7")).alias("speaker_id"))
    return rows, M.clean_manifest(rows)


_TWO_TEXTS = f"""a AS (SELECT sentence, nullif(speaker_id, 'src7') AS speaker_id FROM transcripts),
    b AS (SELECT replace(translate(sentence, {_LETTERS.format('', '')}), '&', ' and ') AS sentence, speaker_id FROM a)"""


@query("J4_overlap", sql("transcripts", _TWO_TEXTS + """, na AS (SELECT sentence, speaker_id, count(*) AS copies_a FROM a GROUP BY 1, 2),
    nb AS (SELECT sentence, speaker_id, count(*) AS copies_b FROM b GROUP BY 1, 2)
    SELECT na.*, copies_b, copies_a * copies_b AS matches FROM na JOIN nb ON na.sentence = nb.sentence
      AND na.speaker_id IS NOT DISTINCT FROM nb.speaker_id"""))
def j4(spark, folder):
    return J.overlap(*_two_texts(spark, folder))


@query("J4_overlap_size", sql("transcripts", _TWO_TEXTS + """
    SELECT count(*) AS matches FROM a JOIN b ON a.sentence = b.sentence AND a.speaker_id IS NOT DISTINCT FROM b.speaker_id"""))
def j4_size(spark, folder):
    return J.overlap_size(*_two_texts(spark, folder))


def _pool_and_chosen(spark, folder):
    """A pool that lists every clip twice, and the long texts, cleaned, as the chosen rows."""
    rows = transcripts(spark, folder).withColumn("speaker_id", F.nullif("speaker_id", F.lit("src7")))
    again = rows.withColumns({"row_idx": F.col("row_idx") + 100_000_000, "sentence": F.upper("sentence")})
    chosen = M.clean_manifest(rows.filter(F.length("sentence") > 500))
    return rows.unionByName(again), chosen


_POOL = f"""one AS (SELECT file_name, sentence, nullif(speaker_id, 'src7') AS speaker_id, lang, row_idx FROM transcripts),
    pool AS (SELECT * FROM one UNION ALL SELECT file_name, upper(sentence), speaker_id, lang, row_idx + 100000000 FROM one),
    chosen AS (SELECT file_name, replace(translate(sentence, {_LETTERS.format('', '')}), '&', ' and ') AS sentence, speaker_id, lang, row_idx
      FROM one WHERE length(sentence) > 500)"""


@query("J5_subtract_subset", sql("transcripts", _POOL + """,
    first AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY row_idx) = 1),
    gone AS (SELECT * FROM chosen WHERE string_split(file_name, '/')[2] = 'train'
      QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY row_idx) = 1)
    SELECT * FROM first f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_name = f.file_name AND g.sentence = f.sentence
      AND g.speaker_id IS NOT DISTINCT FROM f.speaker_id AND g.lang = f.lang)"""))
def j5(spark, folder):
    return J.subtract_subset(*_pool_and_chosen(spark, folder))


def _documents_and_events(spark, folder):
    """Listed twice the documents, and all events: paths of either table or both."""
    rows = transcripts(spark, folder).select("file_name", "lang")
    return rows.union(rows), clips(spark, folder).select("file_name", "speaker_id")


_DOCS_EVENTS = """a AS (SELECT file_name, lang FROM transcripts UNION ALL SELECT file_name, lang FROM transcripts),
    b AS (SELECT file_name, speaker_id FROM clips)"""


@query("J6_subset_violations", sql("transcripts clips", _DOCS_EVENTS + " SELECT * FROM b WHERE file_name NOT IN (SELECT file_name FROM a)"))
def j6(spark, folder):
    return J.subset_violations(*_documents_and_events(spark, folder))


@query("J7_outer_audit", sql("transcripts clips", _DOCS_EVENTS + """,
    o AS (SELECT coalesce(a.file_name, b.file_name) AS f, lang, speaker_id, a.file_name AS fa, b.file_name AS fb
      FROM a FULL JOIN b ON a.file_name = b.file_name), d AS (SELECT DISTINCT * FROM o)
    SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(*) FROM o) AS rows_outer,
      (SELECT count(*) FROM o) - (SELECT count(*) FROM d) AS duplicated,
      (SELECT count(*) FROM d WHERE fb IS NULL) AS left_only, (SELECT count(*) FROM d WHERE fa IS NOT NULL AND fb IS NOT NULL) AS both,
      (SELECT count(*) FROM d WHERE fa IS NULL) AS right_only"""))
def j7(spark, folder):
    return J.outer_audit(*_documents_and_events(spark, folder))


@query("J8_inner_audit", sql("transcripts clips", _DOCS_EVENTS + """,
    n AS (SELECT (SELECT count(*) FROM a JOIN b USING (file_name)) AS rows_inner, (SELECT count(*) FROM b) AS rows_b)
    SELECT *, rows_inner = rows_b AS equal FROM n"""))
def j8(spark, folder):
    return J.inner_audit(*_documents_and_events(spark, folder))


@query("J9_matching_rows", sql("transcripts clips", "SELECT file_name, speaker_id FROM clips WHERE file_name IN (SELECT file_name FROM transcripts)"))
def j9(spark, folder):
    rows = clips(spark, folder).select("file_name", "speaker_id")
    return J.matching_rows(rows, transcripts(spark, folder))


_QUOTA_SQL = """sizes AS (SELECT cluster, count(*) AS count FROM skewed_clusters GROUP BY 1),
    shares AS (SELECT *, count / (SELECT sum(count) FROM sizes)::DOUBLE AS sample_percentage FROM sizes),
    quota AS (SELECT *, (0.0397::DOUBLE - 0.095::DOUBLE) * sample_percentage + 0.095::DOUBLE AS affine_linear,
      CAST(trunc(((0.0397::DOUBLE - 0.095::DOUBLE) * sample_percentage + 0.095::DOUBLE) * count) AS BIGINT) * 4 AS num_samples FROM shares)"""


@query("J10_attach_quota", sql("skewed_clusters", _QUOTA_SQL + """
    SELECT c.filename, c.cluster, q.num_samples FROM skewed_clusters c JOIN quota q USING (cluster)"""))
def j10(spark, folder):
    rows = skewed_clusters(spark, folder)
    quota = inverse_quota(cluster_sizes(rows)).select("cluster", "num_samples")
    return rows.select("filename", "cluster").join(quota, "cluster")


@query("J11_align", sql("emb", "SELECT filename, cluster, len(embedding) AS dims, round(list_sum(embedding), 6) AS total FROM emb"))
def j11(spark, folder):
    rows = emb(spark, folder)
    both = J.align(rows.select("filename", "embedding"), rows.select("filename", "cluster"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return both.select("filename", "cluster", F.size("embedding").cast("long").alias("dims"), F.round(total, 6).alias("total"))


@query("J12_speaker_count", "SELECT o_orderkey, o_custkey AS speaker_id, count(*) OVER (PARTITION BY o_custkey) AS count FROM orders")
def j12(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("speaker_id"))
    return J.with_speaker_count(rows)


# --- aggregations ------------------------------------------------------------


def _orders(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("speaker_id"))


_COUNTS = "SELECT o_custkey AS speaker_id, count(*) AS count FROM orders GROUP BY 1"


@query("A1_speaker_counts", _COUNTS)
def a1(spark, folder):
    return A.speaker_counts(_orders(spark, folder))


@query("A1_top_speakers", _COUNTS + " ORDER BY count DESC, speaker_id LIMIT 5")
def a1_top(spark, folder):
    return A.speaker_counts(_orders(spark, folder), 5)


@query("A2_number_of_speakers", "SELECT count(DISTINCT o_custkey) AS speakers FROM orders")
def a2(spark, folder):
    return A.number_of_speakers(_orders(spark, folder))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_MOMENTS = ("round(avg({x}), 6) AS mean, round(var_samp({x}), 6) AS variance, round(skewness({x}), 6) AS skew, "
            "round(kurtosis({x}), 6) AS kurtosis")


@query("A3_A7_speaker_stats", f"SELECT {_MOMENTS.format(x='count')}, count(*) FILTER (WHERE count = 1) AS ones FROM ({_COUNTS})")
def a3(spark, folder):
    return _rounded(A.speaker_count_stats(_orders(spark, folder)), "mean", "variance", "skew", "kurtosis")


@query("A8_total_duration", "SELECT round(sum(value), 4) AS total_seconds FROM events")
def a8(spark, folder):
    return A.total_duration(clips(spark, folder)).select(F.round("total_seconds", 4).alias("total_seconds"))


@query("A11_duration_per_speaker", "SELECT CAST(user_id AS VARCHAR) AS speaker_id, round(sum(value), 6) AS seconds FROM events GROUP BY 1")
def a11(spark, folder):
    return A.duration_per_speaker(clips(spark, folder), digits=6)


@query("A11_top_durations", "SELECT CAST(user_id AS VARCHAR) AS speaker_id, round(sum(value), 6) AS seconds FROM events GROUP BY 1 "
                            "ORDER BY seconds DESC, speaker_id LIMIT 5")
def a11_top(spark, folder):
    return A.duration_per_speaker(clips(spark, folder), 5, digits=6)


@query("A12_duration_stats", f"SELECT {_MOMENTS.format(x='value')} FROM events")
def a12(spark, folder):
    return _rounded(A.duration_stats(clips(spark, folder)), "mean", "variance", "skew", "kurtosis")


@query("A13_cluster_sizes", sql("skewed_clusters", "SELECT cluster, count(*) AS count FROM skewed_clusters GROUP BY 1"))
def a13(spark, folder):
    return cluster_sizes(skewed_clusters(spark, folder))


@query("A14_cluster_overlap", """SELECT c AS cluster, count(*) FILTER (WHERE l < 30) AS librispeech,
    count(*) FILTER (WHERE l >= 30) AS common_voice, least(count(*) FILTER (WHERE l < 30), count(*) FILTER (WHERE l >= 30)) AS overlap
    FROM (SELECT CAST(page_id % 7 AS INTEGER) AS c, length(url) AS l FROM pages) GROUP BY 1""")
def a14(spark, folder):
    rows = table(spark, folder, "pages").select(F.col("url").alias("filename"), (F.col("page_id") % 7).cast("int").alias("cluster"))
    return A.cluster_overlap(rows)


@query("A15_cluster_total", sql("skewed_clusters", "SELECT count(cluster) AS elements FROM skewed_clusters"))
def a15(spark, folder):
    return A.cluster_total(skewed_clusters(spark, folder))


@query("A16_min_cluster", sql("skewed_clusters", "SELECT min(n) AS smallest FROM (SELECT count(*) AS n FROM skewed_clusters GROUP BY cluster)"))
def a16(spark, folder):
    return A.min_cluster_size(skewed_clusters(spark, folder))


@query("A17_cluster_share", sql("skewed_clusters", _QUOTA_SQL + " SELECT cluster, count, round(sample_percentage, 9) AS sample_percentage FROM shares"))
def a17(spark, folder):
    return cluster_share(cluster_sizes(skewed_clusters(spark, folder))).withColumn(
        "sample_percentage", F.round("sample_percentage", 9)
    )


@query("A18_duplicate_count", "SELECT count(*) - count(DISTINCT text) AS duplicates FROM documents")
def a18(spark, folder):
    return A.duplicate_count(table(spark, folder, "documents"), "text")


@query("A19_duplicated_rows", """SELECT text, lang, s AS source FROM (SELECT *, count(*) OVER (PARTITION BY text, lang, s) AS n
    FROM (SELECT text, lang, nullif(source, 'src7') AS s FROM documents)) WHERE n > 1""")
def a19(spark, folder):
    rows = table(spark, folder, "documents").select("text", "lang", F.nullif("source", F.lit("src7")).alias("source"))
    return A.duplicated_rows(rows)


@query("A20_unassigned", sql("transcripts clips", """SELECT count(*) FILTER (WHERE t.file_name IS NULL) AS unassigned
    FROM clips c LEFT JOIN transcripts t USING (file_name)"""))
def a20(spark, folder):
    known = transcripts(spark, folder).select(X.basename("file_name").alias("filename"), F.lit(0).alias("cluster"))
    return A.unassigned_count(J.assign_cluster(clips(spark, folder), known, strict=False, order=None))


@query("A21_distinct_clients", "SELECT count(DISTINCT user_id) AS speakers FROM events")
def a21(spark, folder):
    return A.number_of_speakers(clips(spark, folder))


@query("A22_quota_audit", sql("skewed_clusters", _QUOTA_SQL + """,
    drawn AS (SELECT filename FROM (SELECT filename, num_samples, row_number() OVER (PARTITION BY cluster ORDER BY md5('42:' || filename), filename) AS r
      FROM skewed_clusters JOIN quota USING (cluster)) WHERE r <= num_samples),
    cur AS (SELECT cluster, count(*) AS n FROM skewed_clusters WHERE filename NOT IN (SELECT filename FROM drawn) GROUP BY 1)
    SELECT q.cluster, CAST(q.count - q.num_samples - coalesce(c.n, 0) AS BIGINT) AS diff FROM quota q LEFT JOIN cur c USING (cluster)"""))
def a22(spark, folder):
    rows = skewed_clusters(spark, folder)
    sizes = cluster_sizes(rows)
    drawn = sample_inverse(rows, key="filename")
    rest = rows.join(drawn.select("filename"), "filename", "left_anti")
    return A.quota_audit(sizes, inverse_quota(sizes), cluster_sizes(rest))


@query("A23_shape", sql("transcripts", "SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM transcripts"))
def a23(spark, folder):
    return A.shape(transcripts(spark, folder))


# --- set operations ----------------------------------------------------------


@query("U_1_union_manifests", sql("clips transcripts", """SELECT file_name, speaker_id, duration, row_idx, NULL AS sentence, NULL AS lang FROM clips
    UNION ALL SELECT file_name, speaker_id, NULL, row_idx, sentence, lang FROM transcripts"""))
def u1(spark, folder):
    return U.union_manifests(clips(spark, folder), transcripts(spark, folder))


@query("U_2_reattach", sql("clips", "SELECT *, string_split(file_name, '/')[2] AS split FROM clips"))
def u2(spark, folder):
    return U.reattach(*M.partition_by_split(clips(spark, folder), "train"))


@query("U_3_build_metadata", """SELECT 'data/' || s || '/' || path || '.mp3' AS file_name, client_id, path FROM (
    SELECT CASE WHEN event_id % 10 < 8 THEN 'train' WHEN event_id % 10 = 8 THEN 'dev' ELSE 'test' END AS s,
      event_type AS client_id, CAST(event_id AS VARCHAR) AS path FROM events)""")
def u3(spark, folder):
    rows = clips(spark, folder).join(table(spark, folder, "events"), F.col("row_idx") == F.col("event_id")).select(
        F.col("event_type").alias("client_id"), F.col("event_id").cast("string").alias("path"), X.split_of("file_name").alias("s")
    )
    return U.build_metadata(*[rows.filter(F.col("s") == s).drop("s") for s in ("train", "test", "dev")])


@query("U_4_merge_embeddings", sql("emb", "SELECT filename, CASE WHEN cluster < 5 THEN 0 ELSE 1 END AS cluster FROM emb"))
def u4(spark, folder):
    rows = emb(spark, folder)
    first, second = (rows.filter(c).select("filename", "embedding") for c in ("cluster < 5", "cluster >= 5"))
    return U.merge_embeddings(first, second).select("filename", "cluster")


@query("U_5_value_diff", sql("clips transcripts", """SELECT DISTINCT file_name, 'a' AS only_in FROM clips WHERE file_name NOT IN (SELECT file_name FROM transcripts)
    UNION ALL SELECT DISTINCT file_name, 'b' FROM transcripts WHERE file_name NOT IN (SELECT file_name FROM clips)"""))
def u5(spark, folder):
    return U.value_diff(clips(spark, folder), transcripts(spark, folder), "file_name")


@query("U_6_compare_manifests", sql("transcripts", _TWO_TEXTS + """ SELECT 'shape' AS "check", (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS equal
    UNION ALL SELECT 'columns', true
    UNION ALL SELECT 'sentence', (SELECT count(*) FROM (SELECT sentence FROM a EXCEPT SELECT sentence FROM b)) = 0
      AND (SELECT count(*) FROM (SELECT sentence FROM b EXCEPT SELECT sentence FROM a)) = 0
    UNION ALL SELECT 'speaker_id', (SELECT count(*) FROM (SELECT speaker_id FROM a EXCEPT SELECT speaker_id FROM b)) = 0
      AND (SELECT count(*) FROM (SELECT speaker_id FROM b EXCEPT SELECT speaker_id FROM a)) = 0"""))
def u6(spark, folder):
    return U.compare_manifests(*_two_texts(spark, folder), columns=("sentence", "speaker_id"))


@query("U_7_aligned_diff", f"""SELECT doc_id AS row_idx, text AS sentence_a, c AS sentence_b FROM (
    SELECT *, replace(translate(text, {_LETTERS.format('', '')}), '&', ' and ') AS c FROM documents) WHERE text <> c""")
def u7(spark, folder):
    rows = transcripts(spark, folder)
    return U.aligned_diff(rows, M.clean_manifest(rows), "sentence")
