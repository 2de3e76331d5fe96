"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text's spaces stand for the vocabulary's space mark; a mark that is in the text itself is spelled in
bytes, as is every character without a piece of its own. The lattice ends with each run of spaces and the
characters up to the next one, so equal chunks share one forward pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from speechcurate.llm.text import chunks, mix, segment_hash, series

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BATCH = 1 << 20  # bytes of text encoded at once
_BYTE = series(256, 11) | np.uint64(1)
_STEP = np.uint64(0x2545F4914F6CDD1D)
_SLOTS = 20


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of each piece (``data`` and ``offsets`` by id), log weights, and ids of the byte pieces."""

    data: np.ndarray
    offsets: np.ndarray
    weight: np.ndarray
    byte_ids: np.ndarray
    slots: np.ndarray
    hashes: np.ndarray
    probes: int
    longest: int


def _piece_hash(piece: bytes) -> int:
    h, power = 0, 1
    for b in reversed(piece):
        h = (h + int(_BYTE[b]) * power) % 2**64
        power = power * int(_STEP) % 2**64
    return h


def load_vocabulary(path: str = MODEL, temperature: float = 1.0, shift: float = 50.0, byte_rank: float = 1e6) -> Vocabulary:
    """Read a SentencePiece model on the driver. A piece of merge rank r weighs ``(r + shift) ** (-1 / temperature)``."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    texts, weight, byte_ids = [b""] * size, np.full(size, -np.inf), np.zeros(256, np.int32)
    for i in range(size):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[1:-1], 16)
            byte_ids[value], texts[i] = i, bytes([value])
            weight[i] = -np.log(byte_rank) / temperature
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            texts[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
            weight[i] = -np.log(shift - sp.get_score(i)) / temperature
    slots, hashes, probes = np.full(1 << _SLOTS, -1, np.int32), np.zeros(1 << _SLOTS, np.uint64), 1
    for i, t in enumerate(texts):
        if t and not sp.is_byte(i):
            h = int(mix(np.array([_piece_hash(t)], np.uint64))[0])
            at, tries = h >> (64 - _SLOTS), 1
            while slots[at] >= 0:
                at, tries = (at + 1) % (1 << _SLOTS), tries + 1
            slots[at], hashes[at], probes = i, h, max(probes, tries)
    data = np.frombuffer(b"".join(texts), np.uint8)
    longest = max(len(t) for t in texts)
    return Vocabulary(data, np.r_[0, np.cumsum([len(t) for t in texts])], weight, byte_ids, slots, hashes, probes, longest)


def _lookup(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """Id of the piece with each hash, or -1."""
    h = mix(h)
    at = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
    out = v.slots[at]
    other = np.flatnonzero((out >= 0) & (v.hashes[at] != h))
    while len(other):  # an occupied slot: the piece may be in the next one
        at[other] = (at[other] + 1) & ((1 << _SLOTS) - 1)
        out[other] = v.slots[at[other]]
        other = other[(out[other] >= 0) & (v.hashes[at[other]] != h[other])]
    return out


def _split(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start of every chunk: the first space of a run of spaces, and every text."""
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[off[:-1][off[:-1] < len(data)]] = True
    return np.flatnonzero(start)


class _Lattice:
    """Forward-filtered lattice of chunks by falling size. Position (j, chunk) is byte j of a chunk; those of equal j stand together.

    ``first[p] .. first[p + 1]`` are the pieces that end at position p, ``piece`` and ``length`` say which, ``upto`` is
    their cumulated chance given that a path goes through p's end.
    """

    def __init__(self, v: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        longest = int(size[0])
        count = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        col = np.r_[0, np.cumsum(count)]
        j = np.repeat(np.arange(longest), count)
        chunk = np.arange(col[-1]) - np.repeat(col[:-1], count)
        text = data[start[chunk] + j]
        ids = self._pieces(v, text, col, j, chunk, min(v.longest, longest))
        width = ids.shape[1]
        flat = np.flatnonzero(ids.ravel() >= 0)
        end, back = np.divmod(flat, width)
        self.col, self.piece, self.length = col, ids.ravel()[flat], back + 1
        self.first = np.searchsorted(end, np.arange(col[-1] + 1))
        weight = v.weight[self.piece]
        before = np.where(j[end] == back, col[-1], col[np.maximum(j[end] - back - 1, 0)] + chunk[end])
        total = np.full(col[-1] + 1, -np.inf)
        total[-1] = 0.0
        degree = np.diff(self.first)
        chance = np.zeros(len(flat))
        for k in range(longest):
            a, b = self.first[col[k]], self.first[col[k + 1]]
            if a == b:
                continue
            ends = col[k] + np.flatnonzero(degree[col[k] : col[k + 1]])
            at = self.first[ends] - a
            score = total[before[a:b]] + weight[a:b]
            top = np.maximum.reduceat(score, at)
            top[~np.isfinite(top)] = 0.0  # inside a character no path ends
            odds = np.exp(score - np.repeat(top, degree[ends]))
            mass = np.add.reduceat(odds, at)
            with np.errstate(divide="ignore"):
                total[ends] = top + np.log(mass)
            chance[a:b] = odds / np.repeat(np.maximum(mass, 1e-300), degree[ends])
        # Sums within each position alone: they must not depend on what else is in the batch.
        upto, some = chance, self.first[np.flatnonzero(degree)]
        left = degree[degree > 0]
        for k in range(1, int(left.max(initial=0))):
            some, left = some[left > k], left[left > k]
            upto[some + k] += upto[some + k - 1]
        self.upto, self.length, self.first = upto.astype(np.float32), self.length.astype(np.uint8), self.first.astype(np.int32)

    @staticmethod
    def _pieces(v: Vocabulary, text: np.ndarray, col: np.ndarray, j: np.ndarray, chunk: np.ndarray, width: int) -> np.ndarray:
        """Id of the piece of each length that ends at each position, or -1. Characters without a piece are spelled in bytes."""
        ids = np.full((len(text), width), -1, np.int32)
        h, values, power = np.zeros(len(text), np.uint64), _BYTE[text], np.ones(1, np.uint64)
        for n in range(1, width + 1):
            low = col[n - 1]  # earlier positions have too few bytes before them
            h[low:] += values[col[j[low:] - (n - 1)] + chunk[low:]] * power
            ids[low:, n - 1] = _lookup(v, h[low:])
            power = power * _STEP
        odd = np.flatnonzero(text >= 0xC0)
        single = np.flatnonzero((text < 0x80) & (ids[:, 0] < 0))
        ids[single, 0] = v.byte_ids[text[single]]
        size = np.select([text[odd] < 0xE0, text[odd] < 0xF0], [2, 3], 4)
        stop = col[np.minimum(j[odd] + size - 1, len(col) - 2)] + chunk[odd]
        known = (size <= width) & (ids[stop, np.minimum(size, width) - 1] >= 0)
        for k in range(4):
            some = odd[~known & (size > k)]
            at = col[j[some] + k] + chunk[some]
            ids[at, 0] = v.byte_ids[text[at]]
        return ids


# Lattices of earlier batches in this worker, so that frequent chunks are filtered once; only a saving of time.
_KEPT_EDGES = 2_000_000
_kept: dict[int, list[tuple[np.ndarray, np.ndarray, _Lattice]]] = {}


def _lattices(v: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[_Lattice]]:
    """Lattices for distinct chunks (``hashes`` in order): number of the lattice of each chunk, and its place there."""
    kept = _kept.setdefault(hash((v.data.tobytes(), v.weight.tobytes())), [])
    which, place = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
    lattices: list[_Lattice] = []
    for own, at, lattice in kept:
        open_ = np.flatnonzero(which < 0)
        near = np.minimum(np.searchsorted(own, hashes[open_]), len(own) - 1)
        hit = own[near] == hashes[open_]
        which[open_[hit]], place[open_[hit]] = len(lattices), at[near[hit]]
        lattices.append(lattice)
    new = np.flatnonzero(which < 0)
    new = new[np.argsort(-size[new], kind="stable")]
    # Chunks of similar length are filtered together, the longest first.
    bounds = [0, *[int(np.searchsorted(-size[new], -b, "left")) for b in (64, 16, 8)], len(new)]
    for a, b in zip(bounds, bounds[1:]):
        some = new[a:b]
        if not len(some):
            continue
        lattice = _Lattice(v, data, start[some], size[some])
        which[some], place[some] = len(lattices), np.arange(len(some))
        lattices.append(lattice)
        if size[some[0]] <= 64 and sum(len(x.upto) for _, _, x in kept) + len(lattice.upto) <= _KEPT_EDGES:
            order = np.argsort(hashes[some])
            kept.append((hashes[some][order], order, lattice))
    return which, place, lattices


def encode_run(v: Vocabulary, data: np.ndarray, off: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of a run of texts, and their n + 1 offsets. ``keys``: 64 random bits per text."""
    start = _split(data, off)
    size = np.diff(np.r_[start, len(data)])
    row = np.searchsorted(off, start, "right") - 1
    distinct, first, same = np.unique(segment_hash(data, start, _BYTE) ^ mix(size.astype(np.uint64)), return_index=True, return_inverse=True)
    number = np.arange(len(start)) - np.searchsorted(row, row)  # of the chunk in its text
    random = mix(keys[row].view(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.zeros(len(start), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    which, place, lattices = _lattices(v, data, start[first], size[first], distinct)
    by_lattice = np.argsort(which[same], kind="stable")
    bounds = np.searchsorted(which[same][by_lattice], np.arange(len(lattices) + 1))
    for lattice, a, b in zip(lattices, bounds, bounds[1:]):
        active = by_lattice[a:b]
        head, left, step = place[same[active]], size[active], np.zeros(1, np.uint64)
        while len(active):
            step = step + np.uint64(1)
            r = (mix(random[active] + step * _STEP) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
            at = lattice.col[left - 1] + head
            edge, last = lattice.first[at], lattice.first[at + 1] - 1
            on = np.flatnonzero((lattice.upto[edge] <= r) & (edge < last))
            while len(on):
                edge[on] += 1
                on = on[(lattice.upto[edge[on]] <= r[on]) & (edge[on] < last[on])]
            found.append((active, lattice.piece[edge], int(step[0])))
            counts[active] += 1
            left = left - lattice.length[edge].astype(np.int64)
            more = left > 0
            active, head, left = active[more], head[more], left[more]
    stop = np.cumsum(counts)
    out = np.zeros(stop[-1] if len(stop) else 0, np.int32)
    for chunk, ids, step in found:
        out[stop[chunk] - step] = ids
    return out, np.r_[0, stop][np.searchsorted(start, off)]


def decode_run(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids' pieces, one after the other, and the n + 1 offsets of the texts. Control pieces are empty."""
    size = np.diff(v.offsets)[ids]
    end = np.r_[0, np.cumsum(size)]
    at = np.arange(end[-1]) + np.repeat(v.offsets[:-1][ids] - end[:-1], size)
    return v.data[at], end[off]


def encode(text: Column, key: Column, vocabulary: Vocabulary, seed: int = 42) -> Column:
    """Sampled piece ids of each text, the same for the same ``key``, text and seed. Null and empty texts have none."""

    def run(texts, keys):
        parts, sizes = [], [np.zeros(1, np.int64)]
        bits = keys.to_numpy(zero_copy_only=False).astype(np.int64)
        total = 0
        for at, data, off in chunks(texts, BATCH):
            ids, bounds = encode_run(vocabulary, data, off, bits[at : at + len(off) - 1])
            parts.append(ids)
            sizes.append(bounds[1:] + total)
            total += len(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(flat))

    run.__annotations__ = {"texts": pa.Array, "keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(text.cast("string"), F.xxhash64(F.lit(seed), key))


def encode_checked(text: Column, key: Column, vocabulary: Vocabulary, seed: int = 42) -> Column:
    """``ids`` as in ``encode``, and ``whole``: whether they decode to the text (null counts as empty). Both in one
    pass, so a task needs one Python worker and not one for each way."""

    def run(texts, keys):
        parts, sizes, whole = [], [np.zeros(1, np.int64)], []
        bits = keys.to_numpy(zero_copy_only=False).astype(np.int64)
        total = 0
        for at, data, off in chunks(texts, BATCH):
            ids, bounds = encode_run(vocabulary, data, off, bits[at : at + len(off) - 1])
            back, ends = decode_run(vocabulary, ids, bounds)
            whole.append(_same_texts(data, off, back, ends))
            parts.append(ids)
            sizes.append(bounds[1:] + total)
            total += len(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(flat))
        return pa.StructArray.from_arrays([lists, pa.array(np.concatenate([np.zeros(0, bool), *whole]))], ["ids", "whole"])

    run.__annotations__ = {"texts": pa.Array, "keys": pa.Array, "return": pa.Array}
    # Called nondeterministic, or a filter by ``whole`` would be pushed below it and have it run twice.
    udf = F.arrow_udf(run, "struct<ids:array<int>,whole:boolean>").asNondeterministic()
    return udf(text.cast("string"), F.xxhash64(F.lit(seed), key))


def _same_texts(data: np.ndarray, off: np.ndarray, other: np.ndarray, other_off: np.ndarray) -> np.ndarray:
    """Whether the texts of two runs are equal byte by byte, one by one."""
    same = np.diff(off) == np.diff(other_off)
    if same.all():
        wrong = np.flatnonzero(data != other)
        same[np.searchsorted(off, wrong, "right") - 1] = False
        return same
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(data[off[i] : off[i + 1]], other[other_off[i] : other_off[i + 1]])
    return same


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of each list of ids; the empty text for null. Bytes that are no UTF-8 become replacement characters."""

    def run(lists):
        if lists.null_count:
            lists = lists.fill_null([])
        off = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
        off, at, runs, ends = off - off[0], 0, [], [np.zeros(1, np.int64)]
        while at < len(off) - 1:  # runs of rows with about a million ids bound the temporary arrays
            to = max(int(np.searchsorted(off, off[at] + (1 << 20), "right")) - 1, at + 1)
            part, stops = decode_run(vocabulary, flat[off[at] : off[to]], off[at : to + 1] - off[at])
            runs.append(part)
            ends.append(stops[1:] + ends[-1][-1])
            at = to
        data, bounds = np.concatenate([np.zeros(0, np.uint8), *runs]), np.concatenate(ends)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)
