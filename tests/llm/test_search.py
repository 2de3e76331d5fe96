"""Ranked search against a brute-force version: several shards and blocks, ties, odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechcurate.llm import search

DOCS, ITEMS = "doc_id long, text string, score int", "item_id long, text string, rank string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            found += [(-s, d is None, d or 0)] if s > 0 else []
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["É1", "Straße", "ab-cd", "X_y"]
    share = 1 / np.arange(1, len(words) + 1)
    texts = [", ".join(rng.choice(words, rng.integers(0, 40), p=share / share.sum())) for _ in range(n)]
    texts += texts[:20] * 3
    docs = [(int(i) if rng.random() < 0.95 else None, t) for i, t in enumerate(texts)] + [(3, None), (None, ""), (4, "-- !")]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(12)] + [(1, "W1 w2"), (1, "W1 w2"), (None, "w3 straße"), (20, None), (21, ""), (22, "unseen")]
    return docs, items


@pytest.mark.parametrize("k,block,shard", [(10, 200_000, 1 << 20), (3, 12, 50), (1, 200_000, 1)])
def test_against_brute_force(spark, k, block, shard):
    docs, items = corpus(k, 150)
    asked = spark.createDataFrame([(*i, "clash") for i in items], ITEMS)
    out = search.best_documents(spark.createDataFrame([(*d, 0) for d in docs], DOCS).repartition(3), asked, k, block_terms=block, shard_postings=shard)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 0)], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert search.best_documents(docs.limit(0), items).count() == 0
    assert search.best_documents(docs, items.limit(0)).count() == 0
    assert search.best_documents(docs, items.withColumn("text", F.lit("..."))).count() == 0
    assert search.best_documents(docs, items).count() == 1


def test_a_shard_prunes():
    """Far from all documents of a shard are scored, and each at most once."""
    rng = np.random.default_rng(0)
    n, size = 5_000, 400
    lists = [np.unique(rng.integers(0, size, 20) * rng.integers(0, 2, 20)) for _ in range(n)]
    term, off = np.concatenate(lists), np.r_[0, np.cumsum([len(x) for x in lists])]
    weight = rng.integers(100, 5000, size)
    impact = weight[term] * rng.integers(1, 100, len(term))
    shard = search.Shard(np.arange(n), off, term, impact, weight)
    asked = rng.choice(size, 8, replace=False)
    score, ids, scored = shard.search(asked, 10, np.zeros(0, np.int64), np.zeros(0, np.int64), beam=16)
    every = defaultdict(int)
    for d, (a, b) in enumerate(zip(off[:-1], off[1:])):
        every[d] = int(impact[a:b][np.isin(term[a:b], asked)].sum())
    want = sorted(((-s, d) for d, s in every.items() if s > 0))[:10]
    assert [(-s, d) for s, d in zip(score, ids)] == want and scored < n / 2
