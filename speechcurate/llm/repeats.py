"""Exact substring deduplication: words of a window that an earlier document holds as well are removed.

A window is a run of ``n`` words of one document, named by a rolling Rabin-Karp hash of 64 bits: among a billion distinct
windows two fall together with a chance of about 3 %. Nearly all windows occur once, so a first pass sends only the
leading bits of the hashes, sorted and packed, and finds which may recur. Only those meet with their documents: windows of
few runs of texts in one sorted shuffle, hot ones by counts per task and a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.llm.text import Words, chunks, mix
from speechcurate.session import materialise, ship_package

WORDS = 13
SEGMENT = 1 << 18  # words hashed at once; bounds the tables of powers
SENT = 1 << 21  # windows that a task sorts and sends at once, and windows about that meet in a part of the hash range
LAST = (1 << 63) - 1  # stands for a null id
FILTER_WORDS = 1 << 21  # 64-bit words of a Bloom filter at most, 16 MB
HOT_RUNS = 32  # a window in more runs of texts is hot: no task gets all rows of it
KEYS_PER_WORD = 4
_BASE = 0x5851F42D4C957F2D
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(base))], dtype=np.uint64)
    return _powers[base][:n]


def _rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of ``n`` values, from differences of prefix sums over the inverse powers of the base."""
    out = np.empty(max(len(hashes) - n + 1, 0), np.uint64)
    for at in range(0, len(out), SEGMENT):
        part = hashes[at : at + SEGMENT + n - 1]
        prefix = np.r_[np.uint64(0), np.cumsum(part * _power(pow(_BASE, -1, 1 << 64), len(part)), dtype=np.uint64)]
        own = prefix[n:] - prefix[:-n]
        out[at : at + len(own)] = own * _power(_BASE, len(part))[n - 1 :]
    return out


def rolling_windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words, and the n + 1 offsets of the texts among them."""
    count = np.maximum(np.diff(words.rows) - n + 1, 0)
    off = np.r_[0, np.cumsum(count)]
    at = np.arange(off[-1]) + np.repeat(words.rows[:-1] - off[:-1], count)
    return mix(_rolled(words.hash, n)[at]), off


def _windows_of(batches, n: int):
    """(hashes, document ids, window offsets, first row, batch) of runs of texts; ``id, text`` come first in a batch."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, data, off in chunks(batch.column(1)):
            key, at = rolling_windows(Words(data, off), n)
            if len(key):
                yield key, np.repeat(ids[first : first + len(off) - 1], np.diff(at)), at, first, batch


def pack(values: np.ndarray) -> bytes:
    """Rising 64-bit values as byte planes of their differences; the first is left out. High planes are mostly zero."""
    step = np.diff(values)
    width = max((int(step.max(initial=0)).bit_length() + 7) // 8, 1)
    return np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(first: int, count: int, planes: bytes) -> np.ndarray:
    step = np.zeros((count, 8), np.uint8)
    if count > 1:
        own = np.frombuffer(planes, np.uint8).reshape(-1, count - 1)
        step[1:, : len(own)] = own.T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) + np.uint64(first)


def _leading(n: int, bits: int, parts: int):
    """The distinct leading bits of a task's windows, packed for each part of their range, and which stand in two ids already."""
    ends = np.array([-(-(p << bits) // parts) for p in range(1, parts)], np.uint64)

    def send(waiting):
        key, doc = (np.concatenate(x) for x in zip(*waiting))
        key >>= np.uint64(64 - bits)
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        twice = np.minimum.reduceat(doc, new) < np.maximum.reduceat(doc, new)
        key = key[new]
        cut = np.r_[0, np.searchsorted(key, ends), len(key)]
        full = np.flatnonzero(np.diff(cut))
        spans = [slice(cut[p], cut[p + 1]) for p in full]
        return pa.RecordBatch.from_arrays([
            pa.array(full.astype(np.int32)), pa.array([int(key[s.start]) - (1 << 63) for s in spans], pa.int64()), pa.array([s.stop - s.start for s in spans], pa.int32()),
            pa.array([pack(key[s]) for s in spans], pa.binary()), pa.array([np.packbits(twice[s]).tobytes() for s in spans], pa.binary())],
            ["part", "first", "n", "planes", "twice"])

    def run(batches):
        waiting, size = [], 0
        for key, doc, *_ in _windows_of(batches, n):
            waiting.append((key, doc))
            size += len(key)
            if size >= SENT:
                yield send(waiting)
                waiting, size = [], 0
        if waiting:
            yield send(waiting)

    return run


def _met(table: pa.Table) -> pa.Table:
    """Values of one part that two runs of texts have, or one that has them in two ids, with the number of their runs."""
    keys, twice = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for first, n, planes, flags in zip(*(table[c].to_pylist() for c in ("first", "n", "planes", "twice"))):
        keys.append(unpack(first + (1 << 63), n, planes))
        twice.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool))
    key, flag = np.concatenate(keys), np.concatenate(twice)
    order = np.argsort(key, kind="stable")
    key, flag = key[order], flag[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[new, len(key)])
    kept = (runs > 1) | (np.logical_or.reduceat(flag, new) if len(key) else runs > 1)
    return pa.table({"lead": key[new][kept].view(np.int64), "runs": runs[kept].astype(np.int32)})


def maybe_repeated(docs: DataFrame, n: int, text_bytes: int) -> tuple[DataFrame, int]:
    """(``lead, runs``: the leading bits of windows that may stand in documents of two ids, and in how many runs of texts; how many bits).

    The bits follow the size of the texts: far more values than windows, so hardly any two fall together. No repeated window is missed.
    A window that many documents share is one value per run of texts here.
    """
    bits = min(max(math.ceil(math.log2(max(text_bytes, 2))) + 10, 40), 63)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, text_bytes // (6 * SENT))
    sent = docs.select("id", "text").mapInArrow(_leading(n, bits, parts), "part int, first long, n int, planes binary, twice binary")
    return sent.groupBy("part").applyInArrow(_met, "lead long, runs int"), bits


def _places(lead: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Filter word of each value and the three bits that it sets there."""
    k = mix(lead)
    one, six = np.uint64(1), np.uint64(63)
    bits = one << ((k >> np.uint64(40)) & six) | one << ((k >> np.uint64(46)) & six) | one << ((k >> np.uint64(52)) & six)
    return (k & np.uint64(words - 1)).astype(np.int64), bits


def window_filter(leads: DataFrame, most: int = FILTER_WORDS) -> np.ndarray:
    """Blocked Bloom filter, about four values a word up to ``most`` words; a fuller one only passes more."""
    count, words = leads.count(), 1
    while words * KEYS_PER_WORD < count and words < most:
        words *= 2

    def run(batches):
        for batch in batches:
            word, bits = _places(batch.column(0).to_numpy().view(np.uint64), words)
            order = np.argsort(word)
            new = np.flatnonzero(np.r_[True, word[order][1:] != word[order][:-1]]) if len(word) else np.zeros(0, np.int64)
            merged = np.bitwise_or.reduceat(bits[order], new) if len(word) else bits
            yield pa.RecordBatch.from_arrays([pa.array(word[order][new]), pa.array(merged.view(np.int64))], ["word", "bits"])

    rows = leads.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _passing(key: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    word, mask = _places(key >> np.uint64(64 - bits), len(table))
    return np.flatnonzero(table[word] & mask == mask)


def _extents(n: int, known, bits: int):
    """(key, smallest id, greatest less smallest id) of the windows of a task's runs of texts that the filter passes."""
    def send(waiting):
        key, doc = (np.concatenate(x) for x in zip(*waiting))
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lo, hi = np.minimum.reduceat(doc, new), np.maximum.reduceat(doc, new)
        return pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(lo), pa.array(hi, mask=lo == hi)], ["key", "lo", "hi"])

    def run(batches):
        waiting, size = [], 0
        for key, doc, *_ in _windows_of(batches, n):
            hit = _passing(key, known.value, bits)
            if len(hit):
                waiting.append((key[hit], doc[hit]))
                size += len(hit)
            if size >= SENT:
                yield send(waiting)
                waiting, size = [], 0
        if waiting:
            yield send(waiting)

    return run


def repeated_windows(docs: DataFrame, n: int, known, bits: int) -> DataFrame:
    """``key, owner`` of every window in documents of at least two ids; the owner is the smallest. Takes ``id, text``.

    Windows are merged per run of texts, per task and then overall, so one that a third of all documents share is a row per task.
    """
    seen = docs.select("id", "text").mapInArrow(_extents(n, known, bits), "key long, lo long, hi long")
    return seen.groupBy("key").agg(F.min("lo").alias("owner"), F.max("lo").alias("l"), F.max("hi").alias("h")).filter("owner < l OR owner < h").select("key", "owner")


def _candidates(n: int, known, bits: int, without=None):
    """(key, id, name, place) of the windows that the filter ``known`` passes and the filter ``without`` does not."""
    def run(batches):
        for key, doc, at, first, batch in _windows_of(batches, n):
            hit = _passing(key, known.value, bits)
            if without is not None:
                hit = np.delete(hit, _passing(key[hit], without.value, bits))
            row = np.searchsorted(at, hit, "right") - 1
            names = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (key[hit].view(np.int64), doc[hit], names[first + row], (hit - at[row]).astype(np.int32))], ["key", "id", "name", "at"])

    return run


def _later(batches):
    """Of rows (key, id, name, at) in order those whose id is greater than the first of their key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
        owner = np.where(new, doc, 0)[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if not new[0]:
            owner[: int(np.argmax(new)) if new.any() else len(key)] = last[1]
        last = key[-1], owner[-1]
        yield batch.select(["id", "name", "at"]).filter(pa.array(doc > owner))


def _intervals(n: int):
    """Maximal runs of words that windows cover: rows (id, name, at) in order become (id, name, start, end)."""
    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy().astype(np.int64) for i in range(3)]
            begin, end = cols[2], cols[2] + n
            if last is not None:  # the open run of the batch before goes on
                cols = [np.r_[a, b] for a, b in zip(last[:2], cols[:2])]
                begin, end = np.r_[last[2], begin], np.r_[last[3], end]
            else:
                cols = cols[:2]
            new = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (begin[1:] > end[:-1])])
            close = np.r_[new[1:], len(begin)] - 1
            out = [cols[0][new], cols[1][new], begin[new], end[close]]
            last = [x[-1:] for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in out], ["id", "name", "start", "end"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["id", "name", "start", "end"])

    return run


def removal_intervals(docs: DataFrame, n: int = WORDS, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``id, name, removed`` of the documents that lose words: ``removed`` lists (start, end) in words, in order and apart.

    Takes ``id, text, name``; the name tells texts of the same id apart, equal ones are one. A window of at most ``hot_runs`` runs of
    texts (each of ``SENT`` windows) meets itself in one task. The owners of all others come from counts that tasks have merged before, by a join whose sides are
    plain tables, so adaptive execution can split a hot window.
    """
    context = docs.sparkSession.sparkContext
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    leads, bits = maybe_repeated(docs, n, text_bytes)
    leads = materialise(leads, "leads")
    rows, schema, names = docs.select("id", "text", "name"), "key long, id long, name long, at int", ["id", "name", "at"]
    known, hot, common = context.broadcast(window_filter(leads.select("lead"))), None, leads.filter(F.col("runs") > hot_runs)
    if not common.isEmpty():
        hot = context.broadcast(window_filter(common.select("lead")))
    met = rows.mapInArrow(_candidates(n, known, bits, hot), schema).repartition("key").sortWithinPartitions("key", "id")
    covered = met.mapInArrow(_later, "id long, name long, at int")
    if hot is not None:
        owners = materialise(repeated_windows(docs, n, hot, bits), "owners")
        covered = covered.unionByName(rows.mapInArrow(_candidates(n, hot, bits), schema).join(owners, "key").filter("id > owner").select(names))
    runs = covered.repartition("id", "name").sortWithinPartitions(names).mapInArrow(_intervals(n), "id long, name long, start long, end long")
    return runs.groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))


def _kept_text(data: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(words, removed words, kept words joined by one space) of each text without the given runs of words."""
    words = Words(data, off)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, words.rows[row] + start, 1)
    np.add.at(step, words.rows[row] + end, -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    of = np.searchsorted(words.rows, kept, "right") - 1
    n_kept = np.bincount(of, minlength=len(off) - 1)
    # The byte after a kept word that another one follows becomes the space between them.
    followed = kept[:-1][of[:-1] == of[1:]]
    out, edge = data.copy(), np.zeros(len(data) + 1, np.int8)
    out[words.end[followed]] = 0x20
    np.add.at(edge, words.start[kept], 1)
    np.add.at(edge, words.end[kept], -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    inside[words.end[followed]] = True
    size = np.bincount(of, words.end[kept] - words.start[kept], len(off) - 1).astype(np.int64) + np.maximum(n_kept - 1, 0)
    ends = np.r_[0, np.cumsum(size)]
    text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[inside]))
    n_words = np.diff(words.rows)
    return n_words, n_words - n_kept, text


def _in_filter(table):
    def f(keys):
        word, mask = _places(keys.to_numpy(zero_copy_only=False).view(np.uint64), len(table.value))
        return pa.array(table.value[word] & mask == mask)

    f.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(f, "boolean")


def _without_runs():
    def f(texts, runs):
        out = []
        for first, data, off in chunks(texts):
            own = runs.slice(first, len(off) - 1).fill_null([])
            flat = own.flatten()
            row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
            start, end = (np.asarray(flat.field(i), np.int64) for i in range(2))
            n_words, n_removed, text = _kept_text(data, off, row, start, end)
            out.append(pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_removed), text.cast(pa.string())], ["n_words", "n_removed", "kept"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    f.__annotations__ = {"texts": pa.Array, "runs": pa.Array, "return": pa.Array}
    return F.arrow_udf(f, "struct<n_words:bigint,n_removed:bigint,kept:string>")


def drop_repeated_windows(docs: DataFrame, n: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` (runs of words) and ``kept``, the remaining words joined by one space.

    A word goes if a window of ``n`` words that covers it also starts in a document with a smaller id; windows are those
    of the input. A null id is greater than all others, and rows that share an id (null, too) take nothing from each other. Null, empty and blank
    texts have no words and ``kept`` is empty; fewer than ``n`` words have no window. A text of any length is worked on whole, in one
    task, with about 30 bytes of memory per byte. Columns of the input that bear one of the four names are replaced.
    """
    ship_package(docs.sparkSession)
    made = ("n_words", "n_removed", "removed", "kept")
    content = F.col(f"`{text}`").cast("string")
    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST))
    # A name is needed, and sent, only where ids repeat.
    ids = docs.select(key.alias("id"))
    name = F.lit(0).cast("long") if ids.distinct().count() == ids.count() else F.xxhash64(F.coalesce(content, F.lit("")))
    runs = materialise(removal_intervals(docs.select(key.alias("id"), content.alias("text"), name.alias("name")), n), "intervals")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), content.alias("__text"), key.alias("id"), name.alias("name"))
    # Texts that surely lose nothing stay where they are; the others are shuffled to their runs, at any size of the table.
    touched = docs.sparkSession.sparkContext.broadcast(window_filter(runs.select(F.xxhash64("id", "name"))))
    maybe = _in_filter(touched)(F.xxhash64("id", "name"))
    found = rows.filter(maybe).join(runs.hint("merge"), ["id", "name"], "left")
    whole = rows.filter(~maybe).withColumn("removed", F.lit(None).cast(runs.schema["removed"].dataType))
    joined = found.unionByName(whole).withColumn("__out", _without_runs()(F.col("__text"), F.col("removed")))
    rest = [F.col(f"__row.`{c}`") for c in docs.columns if c not in made]
    removed = F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed")
    return joined.select(*rest, "__out.n_words", "__out.n_removed", removed, "__out.kept")
