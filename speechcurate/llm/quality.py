"""Quality rules: text statistics, and a decision list learned from labelled rows by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechcurate.llm.text import WHITE, Words, chunks, lines, unique_pairs, windows
from speechcurate.session import materialise, ship_package

COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words",
          "n_digits", "n_distinct_words", "n_stops"]
_SCHEMA = pa.struct([(c, pa.int64()) for c in COUNTS])
_SYMBOL, _DIGIT, _HEAD, _STOP = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT[0x30:0x3A] = True
_HEAD[:] = True
_HEAD[0x80:0xC0] = False  # the other bytes of a UTF-8 character
_STOP[list(b".!?")] = True


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[off[1:]] - total[off[:-1]]


def count_text(column: pa.Array) -> pa.Array:
    """The counts of ``COUNTS`` for each text; a null text counts as an empty one."""
    parts: list[list[np.ndarray]] = []
    for _, data, off in chunks(column):
        w, n = Words(data, off), len(off) - 1
        head = _HEAD[data]
        row, _, count = unique_pairs(*lines(data, off, w))
        n_lines = np.bincount(row, count, n)
        dup_lines = n_lines - np.bincount(row, minlength=n)
        grams, at = windows(w.hash, w.rows, 8)
        gram_row = np.repeat(np.arange(n), np.diff(at))
        order = np.lexsort((grams, gram_row))
        same = (gram_row[order][1:] == gram_row[order][:-1]) & (grams[order][1:] == grams[order][:-1])
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        first = np.arange(len(grams))[twice] + (w.rows[:-1] - at[:-1])[gram_row[twice]]
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + 8, -1)
        covered = np.cumsum(edge)[:-1] > 0
        distinct, _, _ = unique_pairs(w.row(), w.hash)
        parts.append([
            _sums(head, off), np.diff(w.rows), _sums(head & ~WHITE[data], off), _sums(_SYMBOL[data], off), dup_lines, n_lines,
            _sums(covered, w.rows), _sums(_DIGIT[data], off), np.bincount(distinct, minlength=n), _sums(_STOP[data], off),
        ])
    if not parts:
        return pa.array([], _SCHEMA)
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)], fields=list(_SCHEMA)
    )


def _text_counts():
    # Annotations are evaluated here: a module with postponed ones can't type an Arrow UDF.
    def f(texts):
        return count_text(texts)

    f.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(f, "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")


def with_counts(df: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """``df`` and a struct of text counts. Only the text goes to Python; the other columns stay where they are."""
    ship_package(df.sparkSession)
    return df.withColumn(name, _text_counts()(F.col(f"`{text}`").cast("string")))


def base_failed(counts: str = "counts", min_words: int = 20, max_repeat: int = 30) -> Column:
    """True for texts of fewer than ``min_words`` words or over ``max_repeat`` percent of repeated 8-word windows."""
    c = F.col(counts)
    return (c.n_words < min_words) | (100 * c.n_repeat_words > max_repeat * c.n_words)


def features(counts: str = "counts") -> dict[str, Column]:
    """Scale-free statistics on which rules set thresholds; 0 where nothing can be divided."""
    c = F.col(counts)

    def per(a: str, b: str) -> Column:
        return F.when(c[b] > 0, c[a].cast("double") / c[b]).otherwise(0.0)

    return {
        "n_words": c.n_words.cast("double"), "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"), "digit_share": per("n_digits", "n_chars"),
        "distinct_share": per("n_distinct_words", "n_words"), "words_per_line": per("n_words", "n_lines"),
        "stops_per_word": per("n_stops", "n_words"),
    }


@dataclass(frozen=True)
class Test:
    """``feature >= threshold`` or ``feature <= threshold``."""

    feature: str
    at_least: bool
    threshold: float

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        v = table[self.feature].to_numpy()
        return v >= self.threshold if self.at_least else v <= self.threshold

    def column(self, feature: Column) -> Column:
        return feature >= self.threshold if self.at_least else feature <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Reject where all tests hold."""

    tests: tuple[Test, ...]

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        return np.logical_and.reduce([t.holds(table) for t in self.tests])

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _gain(bad: np.ndarray, good: np.ndarray, bad0: int, good0: int) -> np.ndarray:
    """Information gained about the covered bad rows when (bad0, good0) shrinks to (bad, good)."""
    share = bad / np.maximum(bad + good, 1)
    return np.where(bad > 0, bad * (np.log2(np.maximum(share, 1e-12)) - np.log2(bad0 / (bad0 + good0))), -np.inf)


def _best_test(table: pd.DataFrame, bad: np.ndarray) -> Test | None:
    best, found = 1e-9, None
    bad0, good0 = int(bad.sum()), int((~bad).sum())
    for name in table.columns:
        v = table[name].to_numpy()
        order = np.argsort(v, kind="stable")
        x, below = v[order], np.cumsum(bad[order])
        cut = np.flatnonzero(x[1:] > x[:-1])  # cuts lie between different values, so ties stay together
        if not len(cut):
            continue
        p, n = below[cut], cut + 1 - below[cut]
        for at_least, gain in ((False, _gain(p, n, bad0, good0)), (True, _gain(bad0 - p, good0 - n, bad0, good0))):
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Test(name, at_least, float((x[cut[k]] + x[cut[k] + 1]) / 2))
    return found


def _worth(rule: Rule, table: pd.DataFrame, bad: np.ndarray) -> float:
    hit = rule.holds(table)
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(table: pd.DataFrame, bad: np.ndarray, seed: int = 0, precision: float = 0.9, max_tests: int = 4) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune it on the rest, drop what it covers.

    A rule counts if it is right on ``precision`` of the rows it covers, among all rows and among the
    held-out third. Null labels aren't passed in; without bad or good rows the list is empty.
    """
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    full, full_bad = table, bad
    while bad.sum() >= 3 and (~bad).any():
        third = rng.permutation(len(bad)) % 3 == 0
        grow, grow_bad, prune, prune_bad = table[~third], bad[~third], table[third], bad[third]
        tests: list[Test] = []
        inside = np.ones(len(grow_bad), bool)
        while len(tests) < max_tests and (~grow_bad[inside]).any() and grow_bad[inside].any():
            test = _best_test(grow[inside], grow_bad[inside])
            if test is None:
                break
            tests.append(test)
            inside &= test.holds(grow)
        if not tests:
            break
        options = [Rule(tuple(tests[:k])) for k in range(len(tests), 0, -1)]
        rule = max(options, key=lambda r: (_worth(r, prune, prune_bad), -len(r.tests)))
        hit = rule.holds(full)
        right = (hit & full_bad).sum() / max(hit.sum(), 1)
        held = rule.holds(prune)
        if right < precision or (held.any() and prune_bad[held].mean() < precision):
            break
        rules.append(rule)
        left = ~rule.holds(table)
        table, bad = table[left], bad[left]
    return rules


def reject_column(rules: list[Rule], counts: str = "counts") -> Column:
    """The decision list as one conditional expression: the number of the first rule that holds, else null."""
    feature = features(counts)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        hit = F.lit(True)
        for t in rules[i].tests:
            hit = hit & t.column(feature[t.feature])
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def fit_rules(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = 10_000) -> list[Rule]:
    """Learn a decision list for ``labels`` (key, quality 0 or 1) from the texts of ``df``.

    The classifier is fitted on at most ``max_rows`` labelled rows, those of the smallest hashed keys;
    that also bounds the broadcast side of the join and what reaches the driver. Labels that are null
    don't count, and of several for a key the lowest holds.
    """
    sample = (
        labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    )
    docs = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    # At most max_rows rows of 12 bytes. Written, so that texts are counted behind the join and not before it.
    joined = materialise(docs.join(F.broadcast(sample), "_key"), "labelled")
    # Called nondeterministic, or the filter would be pushed below the counts and have them made twice, in two Python workers.
    ship_package(df.sparkSession)
    counted = joined.withColumn("counts", _text_counts().asNondeterministic()(F.col("_text"))).filter(~base_failed())
    rows = counted.select("_key", "_quality", *[c.alias(n) for n, c in features().items()])
    first = rows.groupBy("_key").agg(F.min_by(F.struct("*"), F.struct("*")).alias("r")).select("r.*")
    table = first.toPandas().sort_values("_key").reset_index(drop=True)
    bad = (table["_quality"] == 0).to_numpy()
    return learn_rules(table[list(features())], bad)


def apply_quality(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``df`` with ``counts``, ``base_failed``, ``rule`` (the rejecting one's number) and ``kept``."""
    out = with_counts(df, text).withColumn("base_failed", base_failed())
    out = out.withColumn("rule", F.when(~F.col("base_failed"), reject_column(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
