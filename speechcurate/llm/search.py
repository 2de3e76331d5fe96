"""Ranked lexical search: best-first document intervals, bounded by range-maximum tables over posting lists.

Documents become postings of the items' terms, in shards. A shard keeps each term's postings in the order of its
documents, with a sparse table that answers where the greatest impact of any interval stands. The sum of the answers
of an item's terms bounds every document of an interval. The intervals of the highest bounds are taken first; each is
split at the document of its greatest impact, which is scored, until no interval can reach the best documents found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechcurate.llm.text import Words, chunks, series
from speechcurate.session import materialise, ship_package

TOP = 10
BLOCK_TERMS = 200_000  # terms of the items that are searched at once
SHARD_POSTINGS = 1 << 20
BEAM = 256  # intervals split at once
LAST = np.iinfo(np.int64).max  # stands for a null id

_APART = np.ones(256, bool)
_APART[0x80:] = _APART[0x30:0x3A] = _APART[0x41:0x5B] = _APART[0x61:0x7B] = False
_VALUES = np.where(_APART, np.uint64(0), series(256, 5) | np.uint64(1))
_VALUES[0x41:0x5B] = _VALUES[0x61:0x7B]
_POSTINGS = "doc_id long, n long, terms array<int>, tf array<int>"


def _terms(data: np.ndarray, off: np.ndarray) -> Words:
    """Runs of ASCII letters, digits and all other characters above them; A-Z count as a-z."""
    return Words(data, off, apart=_APART, values=_VALUES)


def _item_terms():
    def f(texts):
        out = []
        for _, data, off in chunks(texts):
            words = _terms(data, off)
            own = [np.unique(words.hash[a:b]) for a, b in zip(words.rows[:-1], words.rows[1:])]
            ends = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int32)
            out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own).view(np.int64))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    f.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(f, "array<bigint>")


def _postings(vocabulary):
    """Of each text its number of terms, and how often it has which term of the vocabulary (by place there)."""
    def run(batches):
        known = vocabulary.value
        for batch in batches:
            for first, data, off in chunks(batch.column(1)):
                words = _terms(data, off)
                n = np.diff(words.rows)
                place = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
                hit = np.flatnonzero(known[place] == words.hash)
                row = np.searchsorted(words.rows, hit, "right") - 1
                pair, tf = np.unique(row * len(known) + place[hit], return_counts=True)
                ends = np.searchsorted(pair, np.arange(len(n) + 1) * len(known)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % len(known), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])

    return run


class Shard:
    """Posting lists of a run of documents, and the place of the greatest impact in every run of 2^j postings.

    Takes the documents' ids, the offsets of their postings, and these postings' terms and impacts. Documents are put in
    the order of their rarest terms, so that similar ones stand in the same intervals.
    """

    def __init__(self, ids: np.ndarray, off: np.ndarray, term: np.ndarray, impact: np.ndarray, weight: np.ndarray):
        doc = np.repeat(np.arange(len(ids)), np.diff(off))
        keep = impact > 0
        doc, term, impact = doc[keep], term[keep], impact[keep]
        self.ids = ids
        doc = self._reorder(doc, term, weight)
        self.docs = len(self.ids)
        order = np.argsort(term.astype(np.int64) * self.docs + doc)
        self.key = (term.astype(np.int64) * self.docs + doc)[order]
        self.doc, self.impact = doc[order].astype(np.int64), np.r_[impact[order], 0]
        begin = np.arange(len(weight) + 1) * self.docs
        self.list = np.searchsorted(self.key, begin)
        longest = int(np.diff(self.list).max(initial=0))
        self.tables = [np.arange(len(self.key), dtype=np.int32)]
        while 2 ** len(self.tables) <= longest:
            half, last = 2 ** (len(self.tables) - 1), self.tables[-1]
            left, right = last[: len(last) - half], last[half:]
            self.tables.append(np.where(self.impact[left] >= self.impact[right], left, right))
        # One flat table: level j begins at its own offset.
        self.level = np.r_[0, np.cumsum([len(t) for t in self.tables])]
        self.flat = np.concatenate(self.tables)
        self.log = np.zeros(longest + 2, np.int64)
        for i in range(1, len(self.tables) + 1):
            self.log[2 ** i :] = i

    def _reorder(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        rank = np.empty(len(weight), np.int64)
        rank[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
        order = np.lexsort((rank[term], doc))
        first = np.searchsorted(doc[order], np.arange(len(self.ids)))
        sort_by = []
        for i in range(4):
            at = np.minimum(first + i, max(len(order) - 1, 0))
            own = (first + i < len(order)) & (doc[order][at] == np.arange(len(self.ids))) if len(order) else np.zeros(len(self.ids), bool)
            sort_by.append(np.where(own, rank[term[order][at]] if len(order) else 0, len(weight)))
        new = np.lexsort(tuple(reversed(sort_by)))
        place = np.empty(len(new), np.int64)
        place[new] = np.arange(len(new))
        self.ids = self.ids[new]
        return place[doc]

    def greatest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, impact) of the greatest among the postings a to b - 1 of a list; (last, 0) where there is none."""
        place = np.full(a.shape, len(self.impact) - 1)
        full = np.flatnonzero((b > a).ravel())
        start, end = a.ravel()[full], b.ravel()[full]
        j = self.log[end - start]
        level = self.level[j]
        i, k = self.flat[level + start], self.flat[level + end - (1 << j)]
        place.ravel()[full] = np.where(self.impact[i] >= self.impact[k], i, k)
        return place, self.impact[place]

    def search(self, terms: np.ndarray, k: int, score: np.ndarray, ids: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best of the documents given by (score, ids) and those of this shard, best first, and how many were scored."""
        terms = terms[self.list[terms + 1] > self.list[terms]]
        scored = 0
        if not len(terms):
            return score, ids, scored
        base = terms * self.docs
        # Open intervals: documents lo to hi - 1, their postings a to b - 1 of each term, and the bound. A closed one has bound 0.
        lo, hi, bound = np.zeros(1, np.int64), np.full(1, self.docs), np.zeros(1, np.int64)
        a, b = self.list[terms][None, :].copy(), self.list[terms + 1][None, :].copy()
        place, value = self.greatest(a, b)
        bound, top = value.sum(1), place[[0], value.argmax(1)]
        used = 1
        while True:
            least = max(score[k - 1], 1) if len(score) >= k else 1
            now = np.flatnonzero(bound[:used] >= least)
            if not len(now):
                return score, ids, scored
            if len(now) > beam:
                now = now[np.argpartition(-bound[now], beam)[:beam]]
            at = self.doc[top[now]]
            goal = base[None, :] + at[:, None]
            cut = np.searchsorted(self.key, goal.ravel()).reshape(goal.shape)
            has = self.key[np.minimum(cut, len(self.key) - 1)] == goal
            found = np.where(has, self.impact[cut], 0).sum(1)
            scored += len(now)
            best = found >= least
            if best.any():
                score, ids = np.r_[score, found[best]], np.r_[ids, self.ids[at[best]]]
                order = np.lexsort((ids, -score))[:k]
                score, ids = score[order], ids[order]
            # The part before the scored document takes the interval's place, the part behind it a new one.
            end = used + len(now)
            while end > len(lo):
                lo, hi, bound, top, a, b = (np.concatenate([x, np.zeros_like(x)]) for x in (lo, hi, bound, top, a, b))
            lo[used:end], hi[used:end], a[used:end], b[used:end] = at + 1, hi[now], cut + has, b[now]
            hi[now], b[now] = at, cut
            both = np.r_[now, np.arange(used, end)]
            place, value = self.greatest(a[both], b[both])
            bound[both], top[both] = value.sum(1), place[np.arange(len(both)), value.argmax(1)]
            used = end


def _search(items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int, postings: int):
    """(item, doc_id, score) of the best documents of a task. It goes through its shards one by one; what it found so far prunes the next."""
    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        waiting, size = [], 0

        def done():
            ids, n, count, term, tf = (np.concatenate(x) for x in zip(*waiting))
            m = 10 + 90 * n * n_docs // n_terms
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, count)))
            shard = Shard(ids, np.r_[0, np.cumsum(count)], term, impact, weight)
            for i, terms in enumerate(items):
                best[i] = shard.search(terms, k, *best[i])[:2]

        for batch in batches:
            ids = batch.column(0)
            none = np.asarray(ids.is_null())
            lists = [batch.column(i) for i in (2, 3)]
            count = lists[0].value_lengths().to_numpy()
            waiting.append((np.where(none, LAST, ids.fill_null(0).to_numpy()), batch.column(1).to_numpy(), count,
                            *(x.flatten().to_numpy().astype(np.int64) for x in lists)))
            size += int(count.sum())
            if size >= postings:
                done()
                waiting, size = [], 0
        if waiting:
            done()
        rows = [(np.full(len(s), i), d, s) for i, (s, d) in enumerate(best)]
        if rows:
            item, doc, score = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=doc == LAST), pa.array(score)], ["item", "doc_id", "score"])

    return run


def best_documents(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest score above 0 for every distinct item.

    Terms are runs of letters, digits and characters beyond ASCII; only A-Z lose their case. Equal scores are ranked by rising
    id, null last (as the id 2^63 - 1, which counts as null). Null, empty and term-free texts are no documents, and items without terms find none. Repeated documents rank one
    after the other; equal items are one, items of the same id with other texts are ranked each for itself. A long text is
    one row of postings.

    Items are searched in blocks of about ``block_terms`` terms, whose vocabulary every task gets; every block runs over all
    documents. A task holds one shard of about ``shard_postings`` postings (or one document) and the best documents of each item.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).distinct()
    asked = materialise(asked.select("item_id", _item_terms()("text").alias("terms")).filter("size(terms) > 0"), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    found = []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).toArrow()
        if rows.num_rows:
            found.append(_search_block(source, rows, k, shard_postings))
    if not found:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _search_block(source: DataFrame, rows: pa.Table, k: int, shard_postings: int) -> DataFrame:
    spark = source.sparkSession
    lists = rows["terms"].combine_chunks()
    hashes = lists.flatten().to_numpy().view(np.uint64)
    vocabulary = np.unique(hashes)
    ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    items = [np.searchsorted(vocabulary, hashes[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    known = spark.sparkContext.broadcast(vocabulary)
    postings = materialise(source.mapInArrow(_postings(known), _POSTINGS).filter("n > 0"), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
    counted = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    best = postings.mapInArrow(_search(items, weight, n_docs, n_terms or 1, k, shard_postings), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(rows.num_rows), pa.int32()), "item_id": rows["item_id"]}))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
