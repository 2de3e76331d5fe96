"""Clustering, silhouette and projection against NumPy, with blocks small enough to matter."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechcurate.operators import dbscan as DB
from speechcurate.operators import projection as P
from speechcurate.operators import silhouette as V
from speechcurate.operators.components import connected_components
from speechcurate.plans import separation as N


def table(spark, x, labels=None):
    rows = [(f"{i:04d}.wav", [float(v) for v in p], int(labels[i]) if labels is not None else 0, i) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "filename string, embedding array<float>, cluster int, row_idx long")


def distances(x):
    x = x.astype(np.float32).astype(np.float64)
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def plain_dbscan(x, eps, min_samples):
    near = distances(x) <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    number = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack, label[i] = [i], number
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core):
                if label[j] < 0:
                    label[j] = number
                    stack.append(j)
        number += 1
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        if len(around):
            label[i] = around.min()
    return label


@pytest.fixture(scope="module")
def blobs():
    """Half of the points in one dense blob, exact copies among them, chains between others, far noise."""
    rng = np.random.default_rng(3)
    parts = [rng.normal(0, 0.3, (150, 5)), np.zeros((40, 5)), rng.normal(4, 0.5, (60, 5)), rng.uniform(-9, 9, (50, 5))]
    chain = np.zeros((60, 5))
    chain[:, 0] = np.linspace(6, 12, 60)
    x = np.concatenate([*parts, chain])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("block_rows", [7, 50, 4_096])
@pytest.mark.parametrize("eps,min_samples", [(0.5, 4), (0.9, 8), (50.0, 3), (0.01, 2)])
def test_dbscan(spark, blobs, block_rows, eps, min_samples):
    if block_rows == 7 and eps != 0.9:
        pytest.skip("one setting is enough for many blocks")
    got = DB.dbscan(table(spark, blobs), eps, min_samples, block_rows=block_rows)
    labels = [r.cluster for r in got.orderBy("filename").collect()]
    assert labels == list(plain_dbscan(blobs, eps, min_samples))


def test_dbscan_without_order_or_points(spark, blobs):
    df = table(spark, blobs)
    got = DB.dbscan(df.drop("row_idx"), 0.9, 8, order=None, block_rows=60)
    assert [r.cluster for r in got.orderBy("filename").collect()] == list(plain_dbscan(blobs, 0.9, 8))
    assert DB.dbscan(df.limit(0), 1.0, 2).count() == 0


def test_pair_exactly_at_eps(spark):
    x = np.array([[0.0, 0.0], [3.0, 4.0], [3.0, 9.0], [100.0, 0.0]])
    got = DB.dbscan(table(spark, x), 5.0, 2)
    assert [r.cluster for r in got.orderBy("filename").collect()] == [0, 0, 0, -1]
    counts = DB.neighbour_counts(table(spark, x), 5.0)
    assert [r.neighbours for r in counts.orderBy("filename").collect()] == [2, 3, 2, 1]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(900, 900)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {a: find(a) for a in list(parent)}
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(edges, "u long, v long"), max_rounds=1)


def plain_silhouette(d, labels):
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == other].mean() for other in set(labels) - {own})
        out.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("block_rows", [9, 64, 4_096])
def test_silhouette(spark, blobs, block_rows):
    labels = plain_dbscan(blobs, 0.9, 8)
    labels[0] = 77
    df = table(spark, blobs, labels)
    want = plain_silhouette(distances(blobs), labels)
    got = V.silhouette_samples(df.select("filename", "embedding"), df.select("filename", "cluster"), block_rows)
    assert np.allclose([r.silhouette for r in got.orderBy("filename").collect()], want, atol=1e-6)
    score = V.silhouette_score(df.select("filename", "embedding"), df.select("filename", "cluster"), block_rows)
    assert score.first()[0] == pytest.approx(want.mean(), abs=1e-6)


def test_silhouette_needs_labels(spark, blobs):
    df = table(spark, blobs)
    with pytest.raises(ValueError):
        V.silhouette_score(df.select("filename", "embedding"), df.select("filename", "cluster"))
    each = df.select("filename", F.col("row_idx").alias("cluster"))
    with pytest.raises(ValueError):
        V.silhouette_score(df.select("filename", "embedding"), each)


@pytest.mark.parametrize("moment_bytes", [16 << 20, 64, 200])
def test_squared_silhouette_in_chunks(spark, blobs, moment_bytes):
    labels = np.arange(len(blobs)) % 4
    labels[0] = 9
    df = table(spark, blobs + 1_000, labels)
    parts = df.select("filename", "embedding"), df.select("filename", "cluster")
    want = plain_silhouette(distances(blobs + 1_000) ** 2, labels).mean()
    assert V.silhouette_squared(*parts, moment_bytes=moment_bytes).first()[0] == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError):
        V.silhouette_squared(parts[0], parts[1].withColumn("cluster", F.lit(1)))


def test_silhouette_in_groups(spark, blobs):
    """Several groups of blocks to a side, and a label that ends and begins inside blocks."""
    labels = np.sort(np.arange(len(blobs)) % 3)
    points = table(spark, blobs, labels).select(F.lit(0).cast("long").alias("part"), F.col("filename").alias("name"), F.col("cluster").cast("long").alias("label"), F.col("embedding").alias("vec"))
    d = V.distance_sums(points, 16, group_bytes=16 * 5 * 8 * 2)
    V._require_labels(d.sizes)
    got = V.samples_from_sums(d).orderBy("id").collect()
    assert np.allclose([r.silhouette for r in got], plain_silhouette(distances(blobs), labels), atol=1e-6)


def test_only_blocks_with_the_hub_or_a_common_label_meet():
    def block(*labels):
        return {"labels": np.array(labels)}

    assert V._needed(block(1, 2), block(5), None) and V._needed(block(-1, 0), block(7), -1) and V._needed(block(7), block(-1), -1)
    assert V._needed(block(1, 3), block(3, 4), -1) and not V._needed(block(1, 2), block(3, 4), -1)


def test_pairs_of_blocks_grow_with_the_blocks(spark):
    """Ten times the points of a chain, ten times the pairs that are considered; a few wide boxes don't change that."""
    counts = []
    for n in (400, 4_000):
        boxes = [(i, [float(i), 0.0], [i + 1.0, 0.5]) for i in range(n)] + [(n, [0.0, 0.0], [float(n), 9.0])]
        counts.append(DB._candidate_pairs(spark.createDataFrame(boxes, "_block long, lo array<double>, hi array<double>"), 0.5, 2).count())
    assert counts[0] < 400 * 8 and counts[1] < 12 * counts[0]


def test_forests_are_merged_in_steps(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(DB, "MERGED", 5)
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b), bool(c)) for a, b, c in zip(rng.integers(0, 40, 30), rng.integers(0, 40, 30), rng.random(30) < 0.8)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("u", "v", "core"), e)) for e in edges[i:i + 4]]) for i in range(0, 30, 4)]
    out = [tuple(r.values()) for b in DB._merge_forests(iter(batches)) for r in b.to_pylist()]
    group = {x: {x} for e in edges if e[2] for x in e[:2]}
    for _ in group:
        for u, v, core in edges:
            if core:
                both = group[u] | group[v]
                for x in both:
                    group[x] = both
    assert sorted(e for e in out if e[2]) == sorted((x, min(g), True) for x, g in group.items())
    assert sorted(e for e in out if not e[2]) == sorted({e for e in edges if not e[2]})


def test_edges_of_a_dense_blob(spark):
    """A forest per task, and few tasks for a block: edges per point don't grow with the points."""
    per_point = []
    for n in (400, 1_200):
        x = np.random.default_rng(1).normal(0, 0.1, (n, 3))
        placed, pairs = DB._place(table(spark, x).select("filename", "embedding", "row_idx"), 5.0, "row_idx", 25)
        alive = placed.withColumn("core", F.lit(True)).select("id", "_vec", "_block", "core")
        assert pairs.count() > (n / 25) ** 2 / 2
        per_point.append(DB._grown(alive, pairs, 5.0).count() / n)
    assert per_point[1] <= 1.3 * per_point[0] and per_point[1] < 12


def test_blocks_are_sent_to_a_row_and_a_column_of_squares(spark):
    """Where all blocks meet, a block goes to the squares of its row and its column, not to each block."""
    from speechcurate.operators.blocks import task_width

    x = np.random.default_rng(2).normal(0, 0.1, (1_200, 3))
    placed, pairs = DB._place(table(spark, x).select("filename", "embedding", "row_idx"), 5.0, "row_idx", 25)
    points = placed.withColumn("core", F.lit(True)).select("id", "_vec", "_block", "core")
    sent = DB._meetings(points, pairs).count().agg(F.sum("count")).first()[0]
    side = int(np.ceil(np.sqrt(2 * task_width(spark))))
    assert pairs.count() == 48 * 49 // 2 and sent <= 48 * 2 * side


def test_blocks_of_the_queries_are_bounded(spark, tmp_path):
    from speechcurate.catalog import vectors as queries
    from speechcurate.operators.blocks import BLOCK_ROWS

    for n, rows in ((400, 64), (4_000, 500), (80_000, BLOCK_ROWS)):
        spark.range(n).selectExpr("id as vec_id", "array(0f) as embedding", "0 as label").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        assert queries._block(spark, f"{tmp_path}/{n}") == rows


def test_profile(spark, blobs):
    labels = np.arange(len(blobs)) % 3
    df = table(spark, blobs, labels)
    got = V.silhouette_profile(df.select("filename", "embedding"), df.select("filename", "cluster"), 2).collect()
    assert {r.cluster for r in got} == {0, 1}
    for k in (0, 1):
        mine = sorted((r for r in got if r.cluster == k), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        values = [r.silhouette for r in mine]
        assert values == sorted(values)


@pytest.mark.parametrize("block_rows", [11, 4_096])
def test_separation_by_speaker(spark, blobs, block_rows):
    speaker = np.arange(len(blobs)) % 7
    speaker[5] = 50
    df = table(spark, blobs, speaker)
    got = N.separation_by_speaker(
        df.filter("cluster < 3"), df.filter("cluster >= 3").withColumnRenamed("cluster", "speaker_id"), block_rows=block_rows
    )
    d = distances(blobs)
    want = {}
    for s in sorted(set(speaker[speaker >= 3])):
        keep = (speaker < 3) | (speaker == s)
        want[s] = plain_silhouette(d[np.ix_(keep, keep)], np.where(speaker[keep] == s, 1, 0)).mean()
    got = {r.speaker_id: r.score for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_separation_by_snr(spark, blobs):
    half = len(blobs) // 2
    first, second = blobs[:half], blobs[half:]
    def levels(x):
        return table(spark, x).select("filename", "embedding").withColumn("snr", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
            "embedding", F.transform("embedding", lambda v: (v * F.col("snr") + F.col("snr") * F.col("snr")).cast("float"))
        )
    got = {r.snr: r.score for r in N.separation_by_snr(levels(first), levels(second), block_rows=30).collect()}
    d = distances(np.concatenate([first, second]))
    want = plain_silhouette(d, np.repeat([0, 1], [half, len(blobs) - half])).mean()
    assert got.keys() == {1, 2} and all(v == pytest.approx(want, abs=1e-5) for v in got.values())


@pytest.mark.parametrize("k", [2, 3])
def test_pca(spark, blobs, k):
    x = blobs.astype(np.float32).astype(np.float64)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    signs = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)])
    want = (x - x.mean(0)) @ (vt[:k] * signs[:, None]).T
    got = P.pca_project(table(spark, blobs), k).orderBy("filename").drop("filename").collect()
    assert np.allclose(np.array(got), want, atol=1e-6)
    ratio = [r.ratio for r in P.pca_variance(table(spark, blobs), k).orderBy("component").collect()]
    assert np.allclose(ratio, (s ** 2 / (s ** 2).sum())[:k], atol=1e-9)
    with pytest.raises(ValueError):
        P.fit_pca(table(spark, blobs), 4)


def test_kmeans_and_tables(spark, blobs):
    df = table(spark, blobs, np.arange(len(blobs)) % 2)
    assert P.kmeans(df, 3).select("cluster").distinct().count() == 3
    joined = P.projection_table(df.select("filename", "embedding"), df.select("filename", "cluster"))
    assert joined.columns == ["filename", "x", "y", "cluster"] and joined.count() == len(blobs)
    two = N.compare_speakers(df.withColumnRenamed("cluster", "speaker_id"), "1", "0")
    assert {r.cluster for r in two.collect()} == {0, 1}


def test_kmeans_of_the_given_vectors(spark):
    from speechcurate.catalog import vectors as queries
    from speechcurate.catalog.standins import emb

    folder = "/root/testdata/sf0.01"
    rows = emb(spark, folder).orderBy("row_idx").collect()
    points, k = np.array([r.embedding for r in rows], float), len({r.cluster for r in rows})
    found = {r.filename: r.cluster for r in queries.v2_given(spark, folder).collect()}
    got = np.array([found[r.filename] for r in rows])
    assert len(found) == len(rows) and list(dict.fromkeys(got)) == list(range(got.max() + 1)) and got.max() < k

    def inertia(labels):
        return sum(((points[labels == c] - points[labels == c].mean(0)) ** 2).sum() for c in set(labels.tolist()))

    def lloyd(seed):
        centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
        for _ in range(100):
            labels = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([points[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
        return inertia(labels)

    assert inertia(got) <= 1.03 * np.median([lloyd(s) for s in range(5)])
