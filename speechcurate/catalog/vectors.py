"""Queries on embeddings: clustering, separation, projection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from speechcurate.catalog.standins import emb, query, sql
from speechcurate.operators import dbscan as D
from speechcurate.operators import projection as P
from speechcurate.operators import silhouette as V
from speechcurate.operators.blocks import BLOCK_ROWS
from speechcurate.plans import separation as N

EPS, MIN_SAMPLES = 1.15, 3


def _block(spark, folder):
    """Rows of a block: eight blocks at least, so that the small tables too are dealt over dozens of meetings. No block grows with the table."""
    return min(BLOCK_ROWS, max(64, emb(spark, folder).count() // 8))

_NEAR = f"""pairs AS (SELECT a.row_idx AS i, b.row_idx AS j FROM emb a JOIN emb b ON list_distance(a.embedding, b.embedding) <= {EPS}),
    degree AS (SELECT i, count(*) AS n FROM pairs GROUP BY 1)"""


@query("J13_neighbours", sql("emb", f"{_NEAR} SELECT e.filename, d.n AS neighbours FROM emb e JOIN degree d ON d.i = e.row_idx"))
def j13(spark, folder):
    return D.neighbour_counts(emb(spark, folder), EPS, block_rows=_block(spark, folder))


@query("V1_dbscan", sql("emb", f"""RECURSIVE {_NEAR}, core AS (SELECT i FROM degree WHERE n >= {MIN_SAMPLES}),
    edges AS (SELECT p.i, p.j FROM pairs p WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
    reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, e.j FROM reach r JOIN edges e ON e.i = r.j),
    comp AS (SELECT i, min(j) AS root FROM reach GROUP BY 1),
    number AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM comp)),
    label AS (SELECT i, cluster FROM comp JOIN number USING (root)),
    border AS (SELECT p.i, min(l.cluster) AS cluster FROM pairs p JOIN label l ON l.i = p.j WHERE p.i NOT IN (SELECT i FROM core) GROUP BY 1)
    SELECT e.filename, CAST(coalesce(l.cluster, b.cluster, -1) AS INTEGER) AS cluster FROM emb e
      LEFT JOIN label l ON l.i = e.row_idx LEFT JOIN border b ON b.i = e.row_idx"""))
def v1(spark, folder):
    return D.dbscan(emb(spark, folder), EPS, MIN_SAMPLES, block_rows=_block(spark, folder))


def _pca(source: str, k: int) -> str:
    """SQL: common tables e1 ... ek (v, lam), vec (filename, v) and total (t) of the points of ``source``.

    The covariance matrix is squared until only its first component is left, which
    is then taken out of it; the sign makes the largest loading positive.
    """
    diagonal = "list_transform(range(1, len({m}) + 1), lambda i: {m}[i][i])"
    steps = [f"""WITH RECURSIVE pts AS ({source}),
    long AS (SELECT filename, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS d FROM pts),
    centred AS (SELECT filename, d, x - avg(x) OVER (PARTITION BY d) AS x FROM long),
    vec AS (SELECT filename, list(x ORDER BY d) AS v FROM centred GROUP BY 1),
    cov AS (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) / ((SELECT count(*) FROM pts) - 1) AS c FROM centred a JOIN centred b USING (filename) GROUP BY ALL),
    m1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)),
    total AS (SELECT sum(c) AS t FROM cov WHERE i = j)"""]
    for n in range(1, k + 1):
        steps.append(f"""p{n}(s, m) AS (SELECT 0, m FROM m{n} UNION ALL
      SELECT s + 1, list_transform(sq, lambda r: list_transform(r, lambda e: e / tr)) FROM (SELECT s, sq, list_sum({diagonal.format(m='sq')}) AS tr FROM (
        SELECT s, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS sq FROM p{n} WHERE s < 24))),
    c{n} AS (SELECT m[list_position({diagonal.format(m='m')}, list_max({diagonal.format(m='m')}))] AS c FROM p{n} WHERE s = 24),
    v{n} AS (SELECT list_transform(c, lambda e: e / sqrt(list_dot_product(c, c)) * CASE WHEN list_max(c) >= -list_min(c) THEN 1 ELSE -1 END) AS v FROM c{n}),
    e{n} AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS lam FROM v{n}, m{n}),
    m{n + 1} AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda c, j: c - lam * v[i] * v[j])) AS m FROM m{n}, e{n})""")
    return ",\n    ".join(steps)


def _axes(k: int) -> str:
    named = zip("xyz"[:k], range(1, k + 1))
    return ", ".join(f"round(list_dot_product(vec.v, e{n}.v), 6) + 0.0 AS {a}" for a, n in named)


_POINTS = "SELECT vec_id || '.wav' AS filename, CAST(embedding AS DOUBLE[]) AS embedding, label AS cluster FROM embeddings"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("V2_kmeans", sql("emb", """first AS (SELECT cluster, min(row_idx) AS f FROM emb GROUP BY 1)
    SELECT filename, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS cluster FROM emb JOIN first USING (cluster)"""))
def v2(spark, folder):
    """Points that each label moves far along an axis of its own: the clusters are the labels, numbered by their first clip."""
    rows = emb(spark, folder)
    moved = F.transform("embedding", lambda x, i: x + F.when(i == F.col("cluster"), 100.0).otherwise(0.0))
    return _numbered_clusters(rows, rows.select("filename", moved.alias("embedding")))


@query("V2_kmeans_given")
def v2_given(spark, folder):
    """Clusters of the vectors as given, as many as there are labels; tested against Lloyd rounds by brute force."""
    rows = emb(spark, folder)
    return _numbered_clusters(rows, rows.select("filename", "embedding"))


def _numbered_clusters(rows, points):
    """k-means clusters of the points, numbered by their first clip."""
    found = P.kmeans(points, rows.agg(F.countDistinct("cluster")).first()[0])
    first = found.join(rows.select("filename", "row_idx"), "filename").groupBy("cluster").agg(F.min("row_idx").alias("f"))
    numbered = first.select("cluster", (F.row_number().over(Window.orderBy("f")) - 1).cast("int").alias("n"))
    return found.join(numbered, "cluster").select("filename", F.col("n").alias("cluster"))


@query("V3_pca_project", f"{_pca(_POINTS, 3)} SELECT filename, {_axes(3)} FROM vec, e1, e2, e3")
def v3(spark, folder):
    return _rounded(P.pca_project(emb(spark, folder), 3), "x", "y", "z")


@query("V4_pca_variance", f"{_pca(_POINTS, 3)} " + " UNION ALL ".join(
    f"SELECT {n - 1} AS component, round(lam / t, 9) AS ratio FROM e{n}, total" for n in (1, 2, 3)))
def v4(spark, folder):
    return P.pca_variance(emb(spark, folder), 3).withColumn("ratio", F.round("ratio", 9))


_SILHOUETTE = """sums AS (SELECT a.filename, a.cluster, b.cluster AS other, sum({d}) AS s, count(*) AS n
      FROM emb a JOIN emb b ON true GROUP BY ALL),
    ab AS (SELECT filename, cluster, max(CASE WHEN other = cluster AND n > 1 THEN s / (n - 1) END) AS a,
      max(CASE WHEN other = cluster THEN n END) AS own, min(CASE WHEN other <> cluster THEN s / n END) AS b FROM sums GROUP BY ALL),
    per_clip AS (SELECT filename, cluster, CASE WHEN own = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS v FROM ab)"""
_PER_CLIP = _SILHOUETTE.format(d="list_distance(a.embedding, b.embedding)")
_SQUARED = _SILHOUETTE.format(d="list_distance(a.embedding, b.embedding) ** 2")


def _parts(spark, folder):
    rows = emb(spark, folder)
    return rows.select("filename", "embedding"), rows.select("filename", "cluster")


@query("V5_silhouette_score", sql("emb", f"{_PER_CLIP} SELECT round(avg(v), 6) AS score FROM per_clip"))
def v5(spark, folder):
    return V.silhouette_score(*_parts(spark, folder), block_rows=_block(spark, folder)).select(F.round("score", 6).alias("score"))


@query("V6_silhouette_samples", sql("emb", f"{_PER_CLIP} SELECT filename, cluster, round(v, 6) AS silhouette FROM per_clip"))
def v6(spark, folder):
    return V.silhouette_samples(*_parts(spark, folder), block_rows=_block(spark, folder)).withColumn("silhouette", F.round("silhouette", 6))


@query("T4_silhouette_profile", sql("emb", f"""{_PER_CLIP} SELECT filename, cluster, round(v, 6) AS silhouette,
    row_number() OVER (PARTITION BY cluster ORDER BY v, filename) - 1 AS place FROM per_clip"""))
def t4(spark, folder):
    return V.silhouette_profile(*_parts(spark, folder), 10, block_rows=_block(spark, folder)).withColumn("silhouette", F.round("silhouette", 6))


@query("V7_silhouette_squared", sql("emb", f"{_SQUARED} SELECT round(avg(v), 6) AS score FROM per_clip"))
def v7(spark, folder):
    return V.silhouette_squared(*_parts(spark, folder)).select(F.round("score", 6).alias("score"))


@query("V8_projection_table", f"{_pca(_POINTS, 2)} SELECT filename, cluster, {_axes(2)} FROM vec JOIN pts USING (filename), e1, e2")
def v8(spark, folder):
    rows = emb(spark, folder)
    table = P.projection_table(rows.select("filename", "embedding"), rows.select("filename", "cluster"), 2)
    return _rounded(table, "x", "y")


@query("V9_separation_by_snr", sql("emb", """corpora AS (SELECT filename, embedding, CASE WHEN cluster < 5 THEN 0 ELSE 1 END AS c, row_idx % 3 + 1 AS snr FROM emb),
    sums AS (SELECT a.filename, a.snr, a.c, b.c AS other, sum(list_distance(a.embedding, b.embedding)) AS s, count(*) AS n
      FROM corpora a JOIN corpora b USING (snr) GROUP BY ALL),
    ab AS (SELECT filename, snr, max(CASE WHEN other = c THEN s / (n - 1) END) AS a, max(CASE WHEN other <> c THEN s / n END) AS b FROM sums GROUP BY ALL)
    SELECT snr, round(avg((b - a) / greatest(a, b)), 6) AS score FROM ab GROUP BY 1"""))
def v9(spark, folder):
    rows = emb(spark, folder).withColumn("snr", F.col("row_idx") % 3 + 1)
    first, second = (rows.filter(c).select("filename", "embedding", "snr") for c in ("cluster < 5", "cluster >= 5"))
    return N.separation_by_snr(first, second, block_rows=_block(spark, folder)).withColumn("score", F.round("score", 6))


@query("V10_separation_by_speaker", sql("emb", """ref AS (SELECT * FROM emb WHERE cluster < 5), sp AS (SELECT *, cluster AS speaker_id FROM emb WHERE cluster >= 5),
    rr AS (SELECT a.filename, sum(list_distance(a.embedding, b.embedding)) / ((SELECT count(*) FROM ref) - 1) AS a FROM ref a JOIN ref b ON true GROUP BY 1),
    rs AS (SELECT r.filename, speaker_id, avg(list_distance(r.embedding, s.embedding)) AS b FROM ref r JOIN sp s ON true GROUP BY ALL),
    sr AS (SELECT s.filename, speaker_id, avg(list_distance(r.embedding, s.embedding)) AS b FROM ref r JOIN sp s ON true GROUP BY ALL),
    ss AS (SELECT a.filename, sum(list_distance(a.embedding, b.embedding)) / (count(*) - 1) AS a FROM sp a JOIN sp b USING (speaker_id) GROUP BY 1),
    v AS (SELECT speaker_id, (b - a) / greatest(a, b) AS v FROM rr JOIN rs USING (filename)
      UNION ALL SELECT speaker_id, (b - a) / greatest(a, b) FROM ss JOIN sr USING (filename))
    SELECT 's' || speaker_id AS speaker_id, round(avg(v), 6) AS score FROM v GROUP BY 1"""))
def v10(spark, folder):
    rows = emb(spark, folder)
    speakers = rows.filter("cluster >= 5").withColumn("speaker_id", F.concat(F.lit("s"), F.col("cluster").cast("string")))
    return N.separation_by_speaker(rows.filter("cluster < 5"), speakers, block_rows=_block(spark, folder)).withColumn("score", F.round("score", 6))


@query("V11_compare_speakers", f"""{_pca(_POINTS + ' WHERE label IN (3, 7)', 2)}
    SELECT filename, CASE cluster WHEN 3 THEN 0 ELSE 1 END AS cluster, {_axes(2)} FROM vec JOIN pts USING (filename), e1, e2""")
def v11(spark, folder):
    rows = emb(spark, folder).select("filename", "embedding", F.col("cluster").alias("speaker_id"))
    return _rounded(N.compare_speakers(rows, "3", "7"), "x", "y")
