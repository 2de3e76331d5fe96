"""The Jaccard join, the neighbour search and the pipeline against brute force."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from speechcurate.llm import jaccard, neighbours, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """{row number: (size, smallest id)}"""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(rows), key=repr)


def test_components_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("change", [0.01, 0.03, 0.06])
def test_groups_of_near_copies(spark, change):
    """Copies at and around the bound, in sizes from a few words to thousands, with passages that many share."""
    rng = np.random.default_rng(int(change * 100))
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    passage = list(rng.choice(vocabulary, 60))
    rows, n = [], 0
    for size in (3, 6, 9, 14, 40, 150, 900):
        base = list(rng.choice(vocabulary, size))
        for k in range(14):
            words = [w if rng.random() > change else str(rng.choice(vocabulary)) for w in base]
            cut = int(rng.integers(0, 1 + size // 4))
            rows.append((n, " ".join(words[:size - cut] if k % 3 == 0 else words)))
            n += 1
    for _ in range(40):
        rows.append((n, " ".join([*rng.choice(vocabulary, int(rng.integers(1, 80))), *passage])))
        n += 1
    check(spark, rows)


def test_components_of_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " "), (8, "One two"), (3, "one TWO"), (None, "one two"), (None, "nothing like it"), (9, "x" * 200_000), (9, "y " * 50_000), (2, "a b c d e"),
            (2, "a b c d e"), (1, "a b c d e f")]
    check(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0


def brute_neighbours(ids, vectors, queries_, k):
    out = {}
    for q in queries_:
        v = vectors[ids.index(q)]
        s = [(-float(v @ w / np.sqrt((v @ v) * (w @ w))), i) for i, w in zip(ids, vectors) if i != q]
        out[q] = [i for _, i in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("cell_rows", [8192, 60])
def test_neighbour_recall(spark, cell_rows):
    df = queries.table(spark, FOLDER, "embeddings")
    rows = df.collect()
    ids, vectors = [r.vec_id for r in rows], [np.array(r.embedding, float) for r in rows]
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0, cell_rows=cell_rows).collect()
    want = brute_neighbours(ids, vectors, [i for i in ids if i % 50 == 0], 5)
    found = {q: {r.vec_id for r in got if r.query_id == q} for q in want}
    assert sum(len(found[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
    for r in got:
        a, b = vectors[ids.index(r.query_id)], vectors[ids.index(r.vec_id)]
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    for q in want:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 6)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)


def test_search_verifies_in_projected_order():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    vectors = np.repeat(centres, 50, 0) + 0.2 * rng.normal(size=(2000, 64))
    points = neighbours.project(vectors, 1)
    limit = neighbours.chi_square_quantile(neighbours.CERTAINTY, neighbours.DIMS)
    hits = seen = 0
    for depth in (0, 3):
        tree = neighbours.build_tree(points, depth)
        leaf = tree.leaf_of(points)
        order = np.argsort(leaf, kind="stable")
        starts = np.searchsorted(leaf[order], np.arange(2**depth + 1))
        for q in range(0, 2000, 100):
            best, verified = neighbours._search(vectors, [[i] for i in range(2000)], points, vectors[q], points[q], float("inf"), 6, limit, tree, order, starts)
            want = np.argsort(-neighbours.cosines(vectors, vectors[q]), kind="stable")[:6]
            hits += len({i for _, i in best} & set(want.tolist()))
            seen += verified
    # 40 searches for 6 neighbours among 2,000 rows in groups of 50.
    assert hits >= 0.9 * 40 * 6 and seen <= 0.2 * 40 * 2000


def test_neighbours_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 1.0, 1.0]),
            (10, [0.0, 1.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0]), (50, [1.0, 0.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    out = neighbours.nearest_neighbours(df, F.col("vec_id").isin(0, 5, 9, 10, 50)).collect()
    by = {q: [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in (0, 5, 9, 10, 50)}
    assert by[0] == [1, 2, 3, 50, 100] and by[50] == [0, 1, 2, 3, 100] and by[5] == [] and by[9] == [] and by[10] == [0, 1, 2, 3, 50]
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_pipeline(spark):
    docs = queries.table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(None, None, None, None, 0), (900_001, "", None, None, 0)], docs.schema)
    docs = docs.union(odd).withColumn("counts", F.lit("c")).withColumn("kept", F.lit(False))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialise(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "counts", "kept"]
        assert docs.filter("counts <> 'c' OR kept").isEmpty()
        if name != "mixing sources to target weights":
            assert 0 < docs.count() <= before
        if name == "n-gram Jaccard join":
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert len({c for _, _, c in brute_components(kept)}) == len(kept)
    blocks = docs.filter("text <> ''").collect()
    for source in {r.source for r in blocks}:
        sizes = {r.text: len(r.text.split()) for r in blocks if r.source == source}
        assert sum(n != corpus_pipeline.BLOCK_WORDS for n in sizes.values()) <= 1
    assert any(r.text.count("\n") for r in blocks)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len(last) == docs.count() and all(r.n_pieces == len(r.ids) for r in last)
    # Both copies of a block have a sample of their own.
    long = [tuple(r.ids) for r in last if r.n_pieces > 300]
    assert len(set(long)) == len(long) > len({r.text for r in blocks if len(r.text) > 600})


def test_pipeline_of_nothing(spark):
    docs = queries.table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, FOLDER), "stage")
    assert docs.count() == 0
