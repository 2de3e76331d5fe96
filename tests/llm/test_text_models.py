"""Quality rules, language mixtures and maximum-entropy scores: brute force, held-out rows, odd input."""

from __future__ import annotations

import math
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechcurate.llm import language, lm, quality, queries

DOCS = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ÀÉ 日本語 𝒳y"), (6, "a b c d e f g h a b c d e f g h\na b c\n\nx # $\na b c"), (6, "one"), (None, "no id at all"),
       (7, "word " * 60_000), (8, "nobreaks" * 20_000)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("counts", F.lit(7)).withColumn("score", F.lit("x"))


def brute_counts(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark):
    rows = queries.op7(spark, DOCS).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, DOCS, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_counts_of_odd_texts(spark):
    out = quality.with_counts(odd(spark)).select("doc_id", "text", "counts.*").collect()
    assert len(out) == len(ODD)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)


def test_rules_find_thresholds():
    rng = np.random.default_rng(1)
    table = pd.DataFrame({"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)})
    bad = ((table.a > 0.8) & (table.b < 0.5)).to_numpy()
    rules = quality.learn_rules(table, bad)
    assert 1 <= len(rules) <= 4
    hit = np.logical_or.reduce([r.holds(table) for r in rules])
    assert (hit == bad).mean() > 0.97
    assert quality.learn_rules(table, np.zeros(900, bool)) == [] and quality.learn_rules(table[:0], bad[:0]) == []


def test_quality_keeps_good_and_rejects_bad(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (queries.table(spark, folder, t) for t in ("documents", "labels"))
    rows = queries.op7(spark, folder).join(labels, "doc_id").filter("NOT base_failed")
    share = {r.quality: r.kept for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.98 and share[0] < 0.1
    assert quality.fit_rules(docs.limit(0), labels.limit(0)) == []


def test_rules_count_each_labelled_text_once(spark, monkeypatch):
    plans = []
    to_pandas = type(spark.range(0)).toPandas
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or to_pandas(df))
    docs, labels = (queries.table(spark, DOCS, t) for t in ("documents", "labels"))
    quality.fit_rules(docs, labels)
    assert len(plans) == 1 and plans[0].count("ArrowEvalPython") == 1


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op9(spark, folder).join(queries.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    got = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.98 and 0 <= got[1] <= got[2] <= 1


def test_language_mixture_and_odd_texts(spark):
    docs = queries.table(spark, DOCS, "documents")
    model = language.train_languages(docs)
    one, two = (docs.filter(F.col("lang") == x).orderBy(F.desc("n_chars")).first().text[:3000] for x in ("en", "de"))
    mixed = spark.createDataFrame([(one + " " + two,)], "text string")
    r = language.with_language(mixed, model).first()
    assert set(r.languages) == {"en", "de"} and all(0.35 < p < 0.65 for p in r.proportions)
    out = {r.doc_id: r for r in language.with_language(odd(spark).filter("doc_id <> 6"), model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and out[1].score == 0.0
    assert out[4].lang_pred in model.names and out[5].lang_pred in model.names
    empty = language.train_languages(docs.limit(0))
    assert {r.lang_pred for r in language.with_language(odd(spark), empty).collect()} == {"und"}


def _lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("head", [1 << 16, 300])
def test_maxent_base_and_held_out(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    docs = queries.table(spark, DOCS, "documents").select("doc_id", "text").withColumn("held_out", queries.remainder("doc_id", 5) == 1)
    docs = docs.union(spark.createDataFrame([(-5, None, True), (-6, "zzz QQQ zzz", True)], docs.schema))
    rows = lm.score_texts(docs, ~F.col("held_out"), ["doc_id", "held_out"]).toPandas()
    texts = {r.doc_id: r for r in docs.collect()}
    count = Counter()
    for r in texts.values():
        if not r.held_out:
            count.update([*WORD.findall(_lower(r.text)), "</end>"])
    n, v = sum(count.values()), len(count)
    for r in rows.itertuples():
        own = [*WORD.findall(_lower(texts[r.doc_id].text)), "</end>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[t] > 0 for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), rel_tol=1e-9)
        assert r.score < 0
    held = rows[rows.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_maxent_sums_to_one(spark):
    docs = queries.table(spark, DOCS, "documents").select("text").limit(60)
    counts = lm.count_tokens(docs).cache()
    v = lm.build_vocabulary(counts)
    w = lm.train(docs, v)
    rows = lm.contexts(np.array([5, 6, 7], np.uint64), np.array([0, 3]))
    for i in range(3):
        total = 0.0
        for c in range(lm.CLASSES):
            a, b, _ = lm._chances(w, rows[i:i + 1], np.array([c]))
            total += float(np.exp(a[0, c]) * np.exp(b[0]).sum())
        assert abs(total - 1) < 1e-4
    known = {r.h: r.c for r in counts.collect()}
    h = np.array(list(known), np.int64).view(np.uint64)
    _, bins = v.find(h)
    mass = np.bincount(bins[bins >= lm.OWN_BINS] - lm.OWN_BINS, [known[int(x)] + 0.5 for x in h.view(np.int64)[bins >= lm.OWN_BINS]], lm.BINS - lm.OWN_BINS)
    assert np.allclose(mass + 0.5, v.tail)


def _sorted_step(table, seen, rows, grad, rate):
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    at = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
    row, count = flat[order][at], np.diff(np.r_[at, len(flat)])
    seen[row] += count
    table[row] -= (rate / np.sqrt(seen[row] * count))[:, None].astype(np.float32) * np.add.reduceat(grad[order // rows.shape[1]], at)


def test_maxent_step_is_the_sum_by_row_without_a_sort():
    rng = np.random.default_rng(3)
    n, size = lm.BATCH, lm.KINDS * lm.ROWS
    rows = (rng.zipf(1.3, (n, lm.KINDS)) % lm.ROWS + np.arange(lm.KINDS) * lm.ROWS).astype(np.int32)
    grad = rng.normal(size=(n, lm.WIDTH)).astype(np.float32)
    took = {}
    for step in (lm._step, _sorted_step):
        table, seen, times = np.zeros((size, lm.WIDTH), np.float32), np.zeros(size, np.int64), []
        for _ in range(9):
            start = time.process_time()
            step(table, seen, rows, grad, 0.4)
            times.append(time.process_time() - start)
        took[step] = table, seen, min(times)
    (table, seen, fast), (want, times_seen, slow) = took[lm._step], took[_sorted_step]
    assert np.allclose(table, want, atol=1e-3) and (seen == times_seen).all()
    assert fast < 0.8 * slow


def test_maxent_chances_of_large_weights():
    rng = np.random.default_rng(4)
    w = lm.Weights(*((rng.normal(size=s) * 200).astype(np.float32) for s in ((lm.KINDS * lm.ROWS + 1, lm.CLASSES), (lm.KINDS * lm.ROWS, lm.WIDTH), (lm.CLASSES, lm.WIDTH))))
    rows = lm.contexts(rng.integers(0, 99, 50).astype(np.uint64), np.array([0, 50]))
    a, b, _ = lm._chances(w, rows, rng.integers(0, lm.CLASSES, 50).astype(np.int32))
    assert np.isfinite(a).all() and np.isfinite(b).all()
    assert np.allclose(np.exp(a).sum(1), 1, atol=1e-4) and np.allclose(np.exp(b).sum(1), 1, atol=1e-4)


def test_maxent_without_training_rows(spark):
    rows = lm.score_texts(odd(spark), F.lit(False), ["doc_id", "score"]).collect()
    assert len(rows) == len(ODD) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
