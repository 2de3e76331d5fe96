"""Language identification of texts that may mix languages: expectation-maximisation over byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.llm.text import WHITE, chunks, mix, series
from speechcurate.session import ship_package

BINS = 4096
UNKNOWN = "und"
_TABLE = series(256, 7)
_TABLE[WHITE] = _TABLE[0x20]
_TABLE[0x41:0x5B] = _TABLE[0x61:0x7B]
_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_GRAM = 3


def _bins(data: np.ndarray) -> np.ndarray:
    """Bin of the trigram that ends at each byte; white space and case of A-Z are levelled."""
    v = _TABLE[data]
    h = v.copy()
    h[1:] += v[:-1] * np.uint64(0x9E3779B97F4A7C15)
    h[2:] += v[:-2] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mix(h) >> np.uint64(52)).astype(np.int64)


def _gram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Trigram counts per text, (texts, BINS). Trigrams don't reach over the start of a text."""
    n = len(off) - 1
    inside = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    row = np.repeat(np.arange(n), np.diff(off))
    full = inside >= _GRAM - 1
    return np.bincount(row[full] * BINS + _bins(data)[full], minlength=n * BINS).reshape(n, BINS)


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(_ASCII[data])]
    found = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace"))
    return found


@dataclass(frozen=True)
class LanguageModel:
    """Trigram probabilities of each language, (languages, BINS)."""

    names: tuple[str, ...]
    probs: np.ndarray


def train_languages(df: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Count the trigrams of all texts of each language.

    Rows with null text or language don't count. Each task sends one row of at most BINS counts per
    language; languages x BINS numbers reach the driver, whatever the number of texts.
    """
    ship_package(df.sparkSession)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1)
            for name in langs.unique().to_pylist():
                texts = batch.column(0).filter(pa.compute.equal(langs, name))
                total = totals.setdefault(name, np.zeros(BINS, np.int64))
                for _, data, off in chunks(texts):
                    inside = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
                    total += np.bincount(_bins(data)[inside >= _GRAM - 1], minlength=BINS)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bin", "n"]
            )

    rows = df.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).dropna()
    counts = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    names = tuple(sorted(set(table["lang"].to_pylist())))
    dense = np.zeros((len(names), BINS))
    where = {n: i for i, n in enumerate(names)}
    dense[[where[x] for x in table["lang"].to_pylist()], table["bin"].to_numpy()] = table["n"].to_numpy()
    dense += smoothing
    return LanguageModel(names, dense / dense.sum(1, keepdims=True) if names else dense)


def _mixture(counts: np.ndarray, probs: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts, languages) by expectation-maximisation, and their log-likelihoods."""
    n = np.maximum(counts.sum(1, keepdims=True), 1)
    share = np.full((len(counts), len(probs)), 1 / len(probs), np.float32)
    mixed = np.maximum(share @ probs, 1e-30)
    for _ in range(rounds):
        share = share * ((counts / mixed) @ probs.T) / n
        share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
        mixed = np.maximum(share @ probs, 1e-30)
    return share, (counts * np.log(mixed)).sum(1, dtype=np.float64)


def infer(counts: np.ndarray, probs: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Language proportions of each text; languages outside its chosen set are 0.

    Sets are nested: the languages by falling proportion in the full mixture. Each further language
    costs half the logarithm of the number of trigrams, and at least 3; the set of the highest penalised
    likelihood wins. A set between one and all languages is tried only where all of them
    together beat the best single one.
    """
    counts, probs = counts.astype(np.float32), probs.astype(np.float32)
    texts, langs = len(counts), len(probs)
    out = np.zeros((texts, langs))
    penalty = np.maximum(0.5 * np.log(np.maximum(counts.sum(1, dtype=np.float64), 1)), 3)
    single = counts.astype(np.float64) @ np.log(probs.T.astype(np.float64))
    best = single.argmax(1)
    out[np.arange(texts), best] = 1
    if langs == 1:
        return out
    share, full = _mixture(counts, probs, rounds)
    value = single.max(1)
    for i in np.flatnonzero(full - penalty > value):
        order = np.argsort(-share[i], kind="stable")
        for k in range(2, langs + 1):
            chosen = order[:k]
            own, fit = _mixture(counts[i : i + 1], probs[chosen], 2 * rounds)
            if fit[0] - (k - 1) * penalty[i] <= value[i]:
                break
            value[i] = fit[0] - (k - 1) * penalty[i]
            out[i] = 0
            out[i, chosen] = own[0]
    return out


def with_language(df: DataFrame, model: LanguageModel, text: str = "text", batch: int = 128) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (its proportion), ``languages`` and ``proportions`` (of the chosen set).

    A text that is null or without a letter is ``und`` with score 0, and so is any text if the model
    has no language. Ties go to the first language by name.
    """
    ship_package(df.sparkSession)
    names = np.array(model.names, object)
    probs = model.probs.astype(np.float32)

    def predict(column):
        pred, score, langs, props = [], [], [], []
        for _, data, off in chunks(column):
            for at in range(0, len(off) - 1, batch):
                o = off[at : at + batch + 1]
                d, o = data[o[0] : o[-1]], o - o[0]
                known = _has_letter(d, o) if len(names) else np.zeros(len(o) - 1, bool)
                share = infer(_gram_counts(d, o), probs) if known.any() else np.zeros((len(o) - 1, max(len(names), 1)))
                for i, p in enumerate(share):
                    if not known[i]:
                        pred.append(UNKNOWN), score.append(0.0), langs.append([]), props.append([])
                        continue
                    order = [k for k in np.argsort(-p, kind="stable") if p[k] > 0]
                    pred.append(names[order[0]]), score.append(min(float(p[order[0]]), 1.0))
                    langs.append([names[k] for k in order]), props.append([float(p[k]) for k in order])
        return pa.StructArray.from_arrays(
            [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())),
             pa.array(props, pa.list_(pa.float64()))], ["lang_pred", "score", "languages", "proportions"],
        )

    predict.__annotations__ = {"column": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(predict, "struct<lang_pred:string,score:double,languages:array<string>,proportions:array<double>>")
    taken = ["lang_pred", "score", "languages", "proportions"]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    out = df.select(*rest, udf(F.col(f"`{text}`").cast("string")).alias("__lang"))
    return out.select(*rest, "__lang.*")
