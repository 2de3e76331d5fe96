"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, trained by distributed gradient updates.

The next token falls into one of ``BINS`` bins: the commonest words have one each, the others share the rest
by hash. ``P(word | history) = P(class | history) P(bin | class, history) P(word | bin)``; the first two are
softmax models over hashed n-gram and skip features, the last is the smoothed share of the word in its bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechcurate.llm.text import Words, chunks, mix
from speechcurate.session import materialise, ship_package

CLASSES, WIDTH = 16, 16
BINS = CLASSES * WIDTH
OWN_BINS = 192  # words with a bin of their own; a power of two of bins is left for the others
ROWS = 1 << 13  # weights per feature kind
KINDS = 3  # word before; two words before; the word before the last (skip)
HEAD = 1 << 16  # counts of so many of the commonest words go to every task
BATCH = 8192
SAFE = 60  # sums of weights up to this need no shift before their exponentials are taken
END = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])
_KEYS = mix(np.arange(1, 3 * KINDS + 1, dtype=np.uint64))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each text, its words (A-Z lower-cased) and one end, and their n + 1 offsets."""
    w = Words(data, off, lower=True)
    stop = w.rows[1:]
    return np.insert(w.hash, stop, np.uint64(END & (2**64 - 1))), w.rows + np.arange(len(w.rows))


def _shifted(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The token ``k`` places before each one; before the start of its text, 0."""
    out = np.zeros(len(h), np.uint64)
    out[k:] = h[:-k] if k else h
    for i in range(k):
        first = at[:-1] + i
        out[first[first < at[1:]]] = 0
    return out


def contexts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Feature rows of each token's history, (tokens, KINDS), for the class model."""
    one, two = _shifted(h, at, 1), _shifted(h, at, 2)
    kinds = [one * _KEYS[0], one * _KEYS[1] + two * _KEYS[2], two * _KEYS[3]]
    return np.stack([((mix(x) >> np.uint64(51)) + np.uint64(i * ROWS)).astype(np.int32) for i, x in enumerate(kinds)], 1)


def _within(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Feature rows for the model of bins within a class: the history's rows, scattered by class."""
    return (rows & ~(ROWS - 1)) | ((rows ^ (classes[:, None] * 0x9E5)) * 5 + classes[:, None] * 977 & (ROWS - 1))


@dataclass
class Vocabulary:
    """The commonest words' hashes (ordered), counts and bins, and totals of the training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    bins: np.ndarray
    total: int
    distinct: int
    tail: np.ndarray  # smoothed mass of each shared bin: its words' counts, half a count for each and for an unseen one
    mass: np.ndarray  # training tokens of each bin

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, bin) of each token; count -1 if it isn't among the commonest."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        shared = OWN_BINS + (h & np.uint64(BINS - OWN_BINS - 1)).astype(np.int32)
        if not len(self.hashes):
            return np.full(len(h), -1), shared
        return np.where(known, self.counts[at], -1), np.where(known & (self.bins[at] >= 0), self.bins[at], shared)


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``h, c``: how often each token is in the texts. Tasks count first, so a common word is one row per task."""
    ship_package(docs.sparkSession)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, data, off in chunks(batch.column(0)):
                held.append(np.unique(tokens(data, off)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield _count_rows(*held[0])
                        held, size = [], 0
        if held:
            yield _count_rows(*_merged(held))

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "h long, c long")
    return rows.groupBy("h").agg(F.sum("c").alias("c"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    distinct, where = np.unique(h, return_inverse=True)
    return distinct, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _count_rows(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """Sums over the counts, and the HEAD commonest words; nothing else comes to the driver."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    head = counts.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
    h, c = head["h"].to_numpy().view(np.uint64), head["c"].to_numpy()
    bins = np.where(np.arange(len(h)) < OWN_BINS, np.arange(len(h)), -1)
    own = [int(x) for x in head["h"].to_pylist()[:OWN_BINS]]
    rest = counts.filter(~F.col("h").isin(own)) if own else counts
    shared = rest.groupBy(F.col("h").bitwiseAND(F.lit(BINS - OWN_BINS - 1)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    tail, mass = np.full(BINS - OWN_BINS, 0.5), np.zeros(BINS)
    for r in shared:
        tail[r["b"]] = r["c"] + 0.5 * (r["n"] + 1)
        mass[OWN_BINS + r["b"]] = r["c"]
    mass[: min(len(h), OWN_BINS)] = c[:OWN_BINS]
    order = np.argsort(h, kind="stable")
    return Vocabulary(h[order], c[order].astype(np.int64), bins[order].astype(np.int32), int(total or 0), int(distinct), tail, mass)


@dataclass
class Weights:
    """Weights of the class model and of the models within classes; the last row of each is the bias."""

    classes: np.ndarray
    within: np.ndarray
    within_bias: np.ndarray


def start_weights(v: Vocabulary) -> Weights:
    """No history: the logarithms of the bins' shares."""
    mass = (v.mass + 0.5).reshape(CLASSES, WIDTH)
    zero = np.zeros((KINDS * ROWS + 1, CLASSES), np.float32)
    zero[-1] = np.log(mass.sum(1) / mass.sum())
    return Weights(zero, np.zeros((KINDS * ROWS, WIDTH), np.float32), np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32))


def _scores(w: Weights, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weights of all classes and of all bins of the token's class, and the rows of the latter."""
    inner = _within(rows, classes)
    a, b = w.classes.take(rows[:, 0], 0), w.within.take(inner[:, 0], 0)
    for k in range(1, KINDS):
        a += w.classes.take(rows[:, k], 0)
        b += w.within.take(inner[:, k], 0)
    a += w.classes[-1]
    b += w.within_bias.take(classes, 0)
    for x in (a, b):
        if len(x) and max(x.max(), -x.min()) > SAFE:
            x -= x.max(1, keepdims=True)
    return a, b, inner


def _chances(w: Weights, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of all classes and of all bins of the token's class, and the rows of the latter."""
    a, b, inner = _scores(w, rows, classes)
    for x in (a, b):
        x -= np.log(np.exp(x) @ np.ones(x.shape[1], np.float32))[:, None]
    return a, b, inner


def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Adds ``-rate`` times the gradient to the rows of each token, slower the oftener a row was seen."""
    flat = rows.T.ravel()
    count = np.bincount(flat, minlength=len(table))
    row = np.flatnonzero(count)
    seen[row] += count[row]
    speed = rate / np.sqrt(seen[row] * count[row])
    each = np.empty((rows.shape[1], len(rows)))
    moved = np.empty((len(row), grad.shape[1]), np.float32)
    for k in range(grad.shape[1]):
        each[:] = grad[:, k]
        moved[:, k] = np.bincount(flat, each.ravel(), len(table))[row] * speed
    table[row] -= moved


def train(docs: DataFrame, v: Vocabulary, text: str = "text", rounds: int = 1, rate: float = 0.4) -> Weights:
    """Gradient updates over all texts, in every task from the same start; then rows are averaged by how often tasks saw them.

    Each task sends its weights once a round, 4 MB at most in parts of 256 rows, so what is gathered grows with
    the corpus and what the driver gets doesn't.
    """
    weights = start_weights(v)
    part = 256
    for _ in range(rounds):
        now = weights

        def descend(batches):
            w = Weights(now.classes.copy(), now.within.copy(), now.within_bias)
            seen_a, seen_b = np.zeros(len(w.classes), np.int64), np.zeros(len(w.within), np.int64)
            for batch in batches:
                for _, data, off in chunks(batch.column(0)):
                    h, at = tokens(data, off)
                    rows, (_, bins) = contexts(h, at), v.find(h)
                    for i in range(0, len(h), BATCH):
                        r, c, k = rows[i : i + BATCH], bins[i : i + BATCH] // WIDTH, bins[i : i + BATCH] % WIDTH
                        a, b, inner = _scores(w, r, c)
                        line = np.arange(len(r))
                        for x in (a, b):
                            np.exp(x, out=x)
                            x /= (x @ np.ones(x.shape[1], np.float32))[:, None]
                        a[line, c] -= 1
                        b[line, k] -= 1
                        _step(w.classes, seen_a, r, a, rate)
                        _step(w.within, seen_b, inner, b, rate)
            for name, table, start, seen in (("c", w.classes, now.classes, seen_a), ("w", w.within, now.within, seen_b)):
                for i in range(0, len(seen), part):
                    if seen[i : i + part].any():
                        moved = ((table - start)[i : i + part] * seen[i : i + part, None]).astype(np.float32)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i]), pa.array([moved.tobytes()]), pa.array([seen[i : i + part].tobytes()])], ["kind", "at", "moved", "seen"])

        def average(groups):
            out = None
            for batch in groups:
                for name, i, moved, seen in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    m, s = np.frombuffer(moved, np.float32).astype(np.float64), np.frombuffer(seen, np.int64)
                    out = (name, i, m, s) if out is None else (name, i, out[2] + m, out[3] + s)
            name, i, m, s = out
            mean = m.reshape(len(s), -1) / np.maximum(s, 1)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i]), pa.array([mean.astype(np.float32).tobytes()])], ["kind", "at", "moved"])


        average.__annotations__ = {"groups": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
        rows = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(descend, "kind string, at long, moved binary, seen binary")
        means = rows.groupBy("kind", "at").applyInArrow(average, "kind string, at long, moved binary").toArrow()
        weights = Weights(now.classes.copy(), now.within.copy(), now.within_bias)
        for name, i, moved in zip(*(means[c].to_pylist() for c in ("kind", "at", "moved"))):
            table = weights.classes if name == "c" else weights.within
            delta = np.frombuffer(moved, np.float32).reshape(-1, table.shape[1])
            table[i : i + len(delta)] += delta
    return weights


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, w: Weights, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``n_tokens, n_known, train_tokens, base_score, score`` of each row; a null text has one token, its end.

    A column of ``keep`` that has the name of a new one gives way to it.

    Tokens beyond the commonest are looked up by a join: one row for each of a text's, no word of them is hot.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    given = [c for c in keep if c not in made]
    keep = [f"__k{i}" for i in range(len(given))]
    docs = docs.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(given, keep)])
    kept = docs.select(*keep).schema
    out_schema = pa.schema([("rid", pa.int64()), ("h", pa.int64()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("gain", pa.float64())])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        for batch in batches:
            columns = [batch.column(i + 1) for i in range(len(keep))]
            for first, data, off in chunks(batch.column(0)):
                h, at = tokens(data, off)
                n = len(off) - 1
                rows, (c, bins) = contexts(h, at), v.find(h)
                gain = np.zeros(len(h))
                for i in range(0, len(h), BATCH):
                    k = bins[i : i + BATCH]
                    a, b, _ = _chances(w, rows[i : i + BATCH], k // WIDTH)
                    line = np.arange(len(k))
                    gain[i : i + BATCH] = (a[line, k // WIDTH].astype(np.float64) + b[line, k % WIDTH]) / math.log(10)
                own = bins < OWN_BINS
                known = c >= 0
                logs = np.where(known, np.log10(np.maximum(c, 0) + 0.5), 0.0)
                gain = gain + np.where(own, 0.0, logs - np.log10(v.tail[np.maximum(bins - OWN_BINS, 0)]))
                row = np.repeat(np.arange(n), np.diff(at))
                sums = [np.diff(at), np.bincount(row, known, n).astype(np.int64), np.bincount(row, logs, n), np.bincount(row, gain, n)]
                rid = number + np.arange(n)
                number += n
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *map(pa.array, sums), *[x.slice(first, n) for x in columns]],
                                                 [*out_schema.names, *keep])
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((h[rare], row[rare]))]
                new = np.r_[True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])][: len(order)]
                start = np.flatnonzero(new)
                times = np.diff(np.r_[start, len(order)])
                m = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(rid[row[order[start]]]), pa.array(h[order[start]].view(np.int64)), pa.array(times), *[pa.nulls(m, out_schema.types[k]) for k in range(3, 7)],
                                                  *[pa.nulls(m, x.type) for x in columns]], [*out_schema.names, *keep])

    scored = docs.mapInArrow(run, "rid long, h long, times long, n_tokens long, n_known long, logs double, gain double, " + types)
    scored = materialise(scored, "scored")
    rare = scored.filter("h IS NOT NULL").select("rid", "h", "times")
    found = rare.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = found.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    texts = scored.filter("h IS NULL").drop("h", "times").join(sums, "rid", "left").fillna({"more": 0.0, "seen": 0})
    norm = math.log10(v.total + 0.5 * (v.distinct + 1))
    return texts.select(*[F.col(k).alias(c) for c, k in zip(given, keep)], "n_tokens", (F.col("n_known") + F.col("seen")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
                        (F.col("logs") + F.col("more") - F.col("n_tokens") * norm).alias("base_score"), (F.col("gain") + F.col("more")).alias("score"))


def score_texts(docs: DataFrame, is_training: Column, keep: list[str], text: str = "text") -> DataFrame:
    """Count, train and score: see ``score``. Learns from the rows of ``is_training`` only; without any, every token is unseen."""
    training = docs.filter(is_training)
    counts = materialise(count_tokens(training, text), "counts")
    v = build_vocabulary(counts)
    return score(docs, counts, v, train(training, v, text), keep, text)
