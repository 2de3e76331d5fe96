"""Exact Jaccard metric-space join of word shingles: regions around pivots, balls and triangle-inequality windows.

One minus the Jaccard similarity is a metric, so what is known of two documents' distances to a pivot bounds
their own. Nearly all documents are at distance 1 from any pivot, though, and a window around such a
region would hold all of them. Regions therefore begin with the documents that share a shingle of their
prefixes: of documents at or under the bound, at least one such region holds both. Within a region, pivots are
measured against the rest; balls around them become one component each, windows drop what is
too far, and what is left is joined again with further pivots until nothing is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechcurate.llm import urls
from speechcurate.llm.text import Words, chunks, mix, windows
from speechcurate.operators.components import connected_components
from speechcurate.session import materialise, ship_package

WORDS = 5
PERCENT = 75
BIT_WORDS = 16
FIRST_PIVOTS = 32
COMMON = 1 << 16
ROWS_PER_TASK = 20_000
PAIRS_PER_TASK = 5_000
_SETS = "fp long, grams array<long>, bits array<long>"
_SCHEMA = "key long, fp long, n int, doc_id long"


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ordered, and their n + 1 offsets. Fewer than five words are one shingle."""
    w = Words(data, off, lower=True)
    grams, at = windows(w.hash, w.rows, WORDS)
    count = np.diff(w.rows)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, r in enumerate(short):
            own = w.hash[w.rows[r] : w.rows[r + 1]]
            whole[i] = (own * np.arange(3, 2 * len(own) + 3, 2, dtype=np.uint64)).sum(dtype=np.uint64) + np.uint64(len(own))
        grams = np.insert(grams, at[short], mix(whole))
        at = at + np.r_[0, np.cumsum((count > 0) & (count < WORDS))]
    for a, b in zip(at[:-1], at[1:]):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[at[:-1][at[:-1] < len(grams)]] = True
    return grams[new], np.r_[0, np.cumsum(new)][at]


def _fingerprints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each set; 0 for the empty one."""
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)]
    size = np.diff(at).astype(np.uint64)
    return np.where(size > 0, mix(total[at[1:]] - total[at[:-1]] + size) | np.uint64(1), np.uint64(0))


def _spare(n: np.ndarray) -> np.ndarray:
    """Shingles by which prefixes are longer than they must be. Similar sets share over the smaller one's within both prefixes,
    and sizes differ by a quarter at most: three quarters of its own may be left out of each."""
    return n // 10


def _new(fp: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which fingerprints a task meets for the first time."""
    out = np.zeros(len(fp), bool)
    for i, x in enumerate(fp.tolist()):
        if x not in seen:
            out[i] = True
            seen.add(x)
    return out


def _common_rows(batches):
    """(shingle, how many sets of a run of texts have it) for those in two sets at least."""
    seen: set[int] = set()
    for batch in batches:
        for _, data, off in chunks(batch.column(0)):
            sets, at = shingle_sets(data, off)
            fresh = np.repeat(_new(_fingerprints(sets, at), seen), np.diff(at))
            value, count = np.unique(sets[fresh], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value[count > 1].view(np.int64)), pa.array(count[count > 1])], ["gram", "c"])


def common_shingles(texts: DataFrame, most: int) -> np.ndarray:
    """Up to ``most`` shingles that recur most within runs of neighbouring texts, the commonest last.

    They come last in the order of every set's shingles. Any order finds the same links; this one keeps
    what thousands of documents share out of their prefixes.
    """
    rows = texts.select("text").mapInArrow(_common_rows, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    top = rows.orderBy(F.desc("c"), "gram").limit(most).toArrow()
    return top["gram"].to_numpy()[::-1].view(np.uint64)


def _prefix_rows(batches, common: np.ndarray):
    """Rows of ``_SCHEMA``: one for each document (with its id), and the prefix of each set that is new to this task."""
    seen: set[int] = set()
    by_value = np.argsort(common)
    ordered = common[by_value]
    for batch in batches:
        doc_ids = batch.column(0)
        for first, data, off in chunks(batch.column(1)):
            sets, at = shingle_sets(data, off)
            fp, n = _fingerprints(sets, at), np.diff(at)
            size = np.where(_new(fp, seen), np.minimum(n, n - (PERCENT * n + 99) // 100 + 1 + _spare(n)), 0)
            row = np.repeat(np.arange(len(n)), n)
            place = np.zeros(len(sets), np.int64)  # 0, or the place among the common ones
            if len(common):
                near = np.minimum(np.searchsorted(ordered, sets), len(common) - 1)
                place = np.where(ordered[near] == sets, by_value[near] + 1, 0)
            for i in np.flatnonzero(np.bincount(row, place > 0, len(n)) > 0):
                own = slice(at[i], at[i + 1])
                sets[own] = sets[own][np.argsort(place[own], kind="stable")]
            rank = np.arange(len(sets)) - np.repeat(at[:-1], n)
            row, taken = row[rank < size[row]], sets[rank < size[row]]
            ids = doc_ids.slice(first, len(n))
            spread = mix(np.arange(len(n), dtype=np.uint64) ^ fp).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[spread, taken.view(np.int64)]), pa.array(np.r_[fp, fp[row]].view(np.int64)),
                pa.array(np.r_[n, n[row]].astype(np.int32)),
                pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(len(row), pa.int64())]),
                pa.array(np.r_[np.ones(len(n), bool), np.zeros(len(row), bool)]),
            ], ["key", "fp", "n", "doc_id", "doc"])


def _shared_only(batches):
    """Of rows in order of key and fingerprint: documents, and tokens that at least two different sets have, each set once."""
    held, sent = None, False  # the last set so far, and whether it went out
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if (docs := table.filter(table["doc"])).num_rows:
            yield from docs.to_batches()
        rest = table.filter(pa.compute.invert(table["doc"]))
        if not rest.num_rows:
            continue
        if held is not None:
            rest = pa.concat_tables([held, rest])
        key, fp = rest["key"].to_numpy(), rest["fp"].to_numpy()
        at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
        same = key[at][1:] == key[at][:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        last = bool(keep[-1]) or (len(at) == 1 and sent)
        keep[0] &= not sent
        if keep.any():
            yield from rest.take(pa.array(at[keep])).combine_chunks().to_batches()
        held, sent = rest.slice(int(at[-1]), 1), last


def _sets_of(batches):
    """(fp, shingles, bits): the set of each text, and the parity of its shingles in each of 64 * BIT_WORDS classes."""
    for batch in batches:
        for first, data, off in chunks(batch.column(1)):
            sets, at = shingle_sets(data, off)
            row = np.repeat(np.arange(len(off) - 1), np.diff(at))
            place = (mix(sets) >> np.uint64(64 - 6)).astype(np.int64) + 64 * (mix(sets ^ np.uint64(1)) % np.uint64(BIT_WORDS)).astype(np.int64)
            odd = np.bincount(row * 64 * BIT_WORDS + place, minlength=(len(off) - 1) * 64 * BIT_WORDS) & 1
            words = np.packbits(odd.astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, len(off) - 1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(np.arange(len(off), dtype=np.int32) * BIT_WORDS), pa.array(words)),
            ], ["fp", "grams", "bits"])


def _apart(a: str, b: str) -> Column:
    """The number of classes whose parities differ: at most the size of the sets' symmetric difference.

    Sets of sizes a and b are linked if seven times that difference is at most a + b.
    """
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, BIT_WORDS)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def _linked(inter: Column, union: Column) -> Column:
    return 100 * inter >= PERCENT * union


def _possible(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, count: int) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not wanted; none that is wanted goes. ``count``: of wanted keys.

    A blocked Bloom filter of 10 MB at most, so that an exact join after it shuffles texts and sets it needs.
    """
    blocks = min(max(-(-count // urls.KEYS_PER_BLOCK), 1), urls.MAX_BLOCKS)
    return urls.possible_keys(rows, key, urls.blocked_bloom(wanted, wanted_key, blocks), blocks)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: documents link at a Jaccard similarity of 0.75 of their five-word shingles.

    Words are lower-cased (A-Z). A text of fewer than five words is one shingle; a null, empty or blank one
    has none, links with nothing and is a component of its own. Rows with a null id take part and are named
    like others (null if they are alone). Equal rows are one component.

    Each set is named by a 64-bit fingerprint. A document sends the first of its shingles in hash order, common ones last: as many as
    similar documents can differ in, plus a tenth of its size. Similar documents share more than a tenth of the
    smaller one among those, so each may then leave out its commonest ones, 3/40 of its size: what passages and
    idioms put into thousands of documents drops out without loss.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    common = common_shingles(source, COMMON)
    rows = source.mapInArrow(lambda batches: _prefix_rows(batches, common), _SCHEMA + ", doc boolean")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(tasks, "key").sortWithinPartitions("key", "fp").mapInArrow(_shared_only, _SCHEMA + ", doc boolean")
    rows = materialise(rows, "prefixes")
    members = rows.filter("doc").select("doc_id", F.col("n").alias("n_shingles"), "fp")

    # The commonest tokens of each set go, then tokens that one set is left with. The sets that share a token are the
    # region of one of them, its pivot; regions of the same pivot are one.
    tokens = rows.filter("NOT doc").select(F.col("key").alias("token"), "fp", "n")
    common = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(common, "token").withColumn("r", F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("df"), "token")))
    kept = materialise(ranked.filter(F.col("r") > F.floor(F.col("n") * 3 / 40)).select("token", "fp", "n"), "tokens")
    pivot = kept.groupBy("token").agg(F.count("*").alias("m"), F.min_by("fp", F.xxhash64("fp")).alias("region")).filter("m > 1")
    regions = materialise(kept.join(pivot.select("token", "region"), "token").select("region", "fp", "n").distinct(), "regions")
    comps = _components(spark, source, members, regions)

    named = members.join(comps, "fp", "left").withColumn("c", F.coalesce("comp", "fp"))
    least = materialise(named.filter("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("least")), "names")
    named = materialise(named.select("doc_id", "n_shingles", "c"), "named")
    full = named.filter("n_shingles > 0").join(least, "c").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))
    empty = named.filter("n_shingles = 0").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def _components(spark, source: DataFrame, members: DataFrame, regions: DataFrame) -> DataFrame:
    """``fp, comp`` of sets that are linked with another one; regions (region, fp, n) hold every pair that may link."""
    nodes = regions.select("fp").distinct()
    named = members.join(nodes, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    # Sets of one document each; where an id is null or repeated, equal fingerprints tell the right text.
    wanted = materialise(named.select("fp", F.col("doc_id").alias("wanted_id")), "wanted")
    texts = _possible(source, "doc_id", wanted, "wanted_id", wanted.count()).join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("fp", "text")
    sets = materialise(_true_sets(texts.mapInArrow(_sets_of, _SETS)), "sets")

    # Sets that several regions hold are joined by fingerprint once; bits then stay with the rows of a region.
    open_ = regions.join(sets.select("fp", "bits"), "fp").withColumns({"comp": F.col("fp"), "low": F.lit(0.0), "high": F.lit(1.0)})
    bound = 1 - PERCENT / 100 + 1e-9
    # Tables of regions and pairs only shrink; small ones are not dealt over all shuffle partitions.
    tasks = max(1, regions.count() // ROWS_PER_TASK)
    links, comps, pivots = None, None, 1
    while True:
        # The region's own pivot comes first, then those outside its component.
        main = F.when(F.col("fp") == F.col("region"), 0).when(F.col("comp") != F.col("main"), 1).otherwise(2) if pivots > 1 else (F.col("fp") != F.col("region")).cast("int")
        order = Window.partitionBy("region").orderBy(main, F.xxhash64("fp"), "fp")
        placed = materialise(open_.withColumn("r", F.row_number().over(order)).coalesce(tasks), "region")
        if placed.isEmpty():
            break
        centre = placed.filter(F.col("r") <= pivots).select(
            "region", F.col("fp").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc"), F.col("bits").alias("pbits"),
            F.col("low").alias("plow"), F.col("high").alias("phigh"), F.col("r").alias("pr"))
        # Sizes, parities and the distances to the region's pivot bound the distance of a pair from below.
        near = (F.col("low") - F.col("phigh") <= bound) & (F.col("plow") - F.col("high") <= bound)
        sizes = (100 * F.least("n", "pn") >= PERCENT * F.greatest("n", "pn")) & (7 * _apart("bits", "pbits") <= F.col("n") + F.col("pn"))
        met = placed.alias("x").join(centre.alias("c"), (F.col("x.region") == F.col("c.region")) & (F.col("r") > F.col("pr")) & (F.col("comp") != F.col("pc")) & near & sizes)
        asked = met.select(F.least("fp", "p").alias("u"), F.greatest("fp", "p").alias("v")).distinct()
        asked = materialise(asked.coalesce(tasks), "asked")
        count = asked.count()
        shares = max(1, count // PAIRS_PER_TASK)
        ends = {c: _possible(sets.select(F.col("fp").alias(c), F.col("grams").alias(f"g{c}")), c, asked, c, count) for c in "uv"}
        measured = asked.join(ends["u"], "u").join(ends["v"], "v")
        measured = measured.select("u", "v", F.size(F.array_intersect("gu", "gv")).alias("i"), (F.size("gu") + F.size("gv")).alias("s"))
        measured = materialise(measured.select("u", "v", "i", (F.col("s") - F.col("i")).alias("t")).coalesce(shares), "measured")
        new = measured.filter(_linked(F.col("i"), F.col("t"))).select("u", "v")
        links = new if links is None else links.unionByName(new)
        comps = materialise(connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("comp")).coalesce(tasks), "comps")

        # Pivots are done with. In the first round, distances to the region's pivot become known: those measured
        # exactly, of the others a bound from the parities.
        rest = placed.filter(F.col("r") > pivots).drop("comp", "main", "r")
        if pivots == 1:
            least = 2 * _apart("bits", "pbits") / (F.col("n") + F.col("pn") + _apart("bits", "pbits"))
            rest = rest.drop("low", "high").join(centre.select("region", "pn", "pbits"), "region").withColumn("low", least).drop("pn", "pbits")
            rest = rest.withColumns({"u": F.least("fp", "region"), "v": F.greatest("fp", "region")}).join(measured, ["u", "v"], "left")
            exact = 1 - F.col("i") / F.col("t")
            rest = rest.withColumns({"low": F.coalesce(exact, "low"), "high": F.coalesce(exact, F.lit(1.0))}).drop("u", "v", "i", "t")
        rest = rest.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        rest = rest.join(comps.select(F.col("fp").alias("region"), F.col("comp").alias("main")), "region", "left").withColumn("main", F.coalesce("main", "region"))
        rest = materialise(rest.select("region", "fp", "n", "bits", "low", "high", "comp", "main").coalesce(tasks), "rest")
        mixed = rest.groupBy("region").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("region")
        open_ = rest.join(mixed, "region", "left_semi")
        pivots *= FIRST_PIVOTS
    return comps if comps is not None else members.select("fp", F.col("fp").alias("comp")).limit(0)


def _true_sets(sets: DataFrame) -> DataFrame:
    """One row per fingerprint; of several texts with the same id the one whose set has the fingerprint."""
    def check(batches):
        for batch in batches:
            fp, lists = batch.column(0), batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            grams = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].view(np.uint64)
            right = _fingerprints(grams, at - at[0]).view(np.int64) == fp.to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(right))

    return sets.mapInArrow(check, _SETS).groupBy("fp").agg(F.min("grams").alias("grams"), F.min("bits").alias("bits"))
