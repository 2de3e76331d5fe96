"""Mixing sources to target weights by fixed-length blocks of words. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechcurate.operators.ordering import with_row_idx
from speechcurate.session import join_on, materialise, small_table

WORD = r"[^\x20\x09-\x0D]+"
# A word with the white space behind it, the first one of a text also with that before it.
SPACED = r"(^[\x20\x09-\x0D]*)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
CHUNK_ROWS = 2_000


@dataclass(frozen=True)
class Mixture:
    """``rows``: doc_id, source, sid, size, start (its first word in the source). ``sources``: sid, source, weight,
    source_size, target, blocks, quota. ``slots``: shard, sid, slot (number within the source), block. ``texts``: the rows
    that have words, with their text and ``row``, the other columns of the input; not written, as texts are large."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    texts: DataFrame
    block_words: int


def count_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(*keys: Column) -> Column:
    """A number in [0, 1) from the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, *keys: Column) -> Column:
    """Where a pseudorandom permutation of 0 .. n-1, chosen by the keys, sends ``x``.

    Four mixing rounds over a grid of a x b >= n cells; a cell outside goes on through the same permutation
    until it is inside. The grid has fewer than sqrt(n) + 1 cells outside, so walks are short.
    """
    a = F.greatest(F.floor(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")

    def once(v: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), F.pmod(v, b)
        for r in range(2):
            left = F.pmod(left + F.pmod(F.xxhash64(*keys, F.lit(2 * r), right), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(*keys, F.lit(2 * r + 1), left), b), b)
        return left * b + right

    first = once(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(first < n, first).otherwise(F.when(walked < n, walked).otherwise(F.raise_error("permutation walk too long").cast("long")))


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``sid, source, weight, source_size, target`` of each source of ``sizes`` (source, size).

    Sources go by code point, null last, and take the weights in turn. ``share`` times all words is dealt
    by weight; a target stops at ``most`` times its source's size and what is over goes to the others by weight. Each
    round needs two sums over the sources only.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = with_row_idx(totals, [F.col("source").asc_nulls_last()], "sid")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = materialise(numbered.withColumn("weight", F.get(turn, (F.col("sid") % len(weights)).cast("int"))), "sources")
    goal = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    cap = most * F.col("source_size")
    capped, weight = 0.0, None
    while True:
        fair = F.lit(goal - capped) * F.col("weight") / F.lit(weight) if weight else cap if weight == 0 else F.lit(0.0)
        above = fair > cap
        row = table.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        new = (float(row[0] or 0), float(row[1] or 0))
        if new == (capped, weight):
            break
        capped, weight = new
    return table.withColumn("target", F.when(above, cap).otherwise(fair).cast("double"))


def _running(df: DataFrame, key: str, order: str, value: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, most: int = 2, doc_id: str = "doc_id", source: str = "source",
                text: str = "text", block_words: int = 64, shard_slots: int = 4096, seed: int = 42) -> Mixture:
    """Plan a mix of the sources of ``docs``; see ``Mixture``, ``mixed_pieces`` and ``taken_words``.

    The words of each source, one text after the other, are cut into blocks of ``block_words`` (the last one
    may be shorter). Each output shard of ``shard_slots`` slots draws its counts per source from a
    multinomial; draws beyond a source's quota (its target in blocks) are dealt to the sources still short
    of theirs, so every quota is met. The slots of a source run through a pseudorandom permutation of its
    blocks, then through another one; none is taken more than ``most`` times.

    Null texts have no words, null sources are a source of their own, equal rows are rows of their own. A long text is
    cut into pieces in one task. The order within a source is that of hashed chunks, so no task holds a whole source; rows that
    are equal in all columns are counted before they are dealt and stand side by side.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # Equal rows, told by 128 bits, are one row that is there ``copies`` times.
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    given = docs.select(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2"), F.col(f"`{doc_id}`").alias("doc_id"),
                        F.col(f"`{source}`").cast("string").alias("source"), body.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    measured = given.select("h1", "h2", "doc_id", "source", count_words(F.col("text")).alias("size"))
    rows = materialise(measured.groupBy("h1", "h2", "doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes")
    words = F.col("size") * F.col("copies")
    targets = source_targets(rows.select("source", words.alias("size")), weights, share, most)
    size = F.col("source_size")
    targets = targets.withColumn("blocks", F.ceil(size / block_words).cast("long")).withColumn(
        "quota", F.when(size > 0, F.least(F.round(F.col("target") * F.col("blocks") / size).cast("long"), most * F.col("blocks"))).otherwise(0).cast("long"))
    sources, _ = small_table(targets, "targets")

    chunks = max(rows.count() // CHUNK_ROWS, 1)
    chunked = join_on(rows.withColumn("n", words), sources.select("source", "sid"), ["source"]).withColumn("chunk", F.pmod("h1", F.lit(chunks)))
    inner = Window.partitionBy("sid", "chunk").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunked.groupBy("sid", "chunk").agg(F.sum("n").alias("n")).select("sid", "chunk", _running(chunked, "sid", "chunk", "n").alias("base"))
    sums, _ = small_table(sums, "chunks")
    placed = chunked.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(sums, ["sid", "chunk"])
    placed = materialise(placed.select("h1", "h2", "doc_id", "source", "sid", "size", "copies", (F.col("base") + F.col("before")).alias("start")), "places")

    def each(rows: DataFrame) -> DataFrame:
        """One row per copy, each with its own start. In two steps, so that a row copied very often makes no huge array."""
        many = rows.withColumn("tall", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 1000))))
        few = many.withColumn("copy", F.explode(F.sequence(F.col("tall") * 1000, F.least(F.col("tall") * 1000 + 999, F.col("copies") - 1))))
        return few.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("tall", "copy", "copies")

    key, kept = ["h1", "h2"], ["doc_id", "source", "sid", "size", "start", "text", "row"]
    full = placed.filter("size > 0")
    contents = given.select("h1", "h2", "text", "row")
    texts = full.filter("copies = 1").drop("copies").join(contents, key).select(kept)
    again = full.filter("copies > 1")
    if not again.isEmpty():
        # A repeated row is fetched once; then both sides of the join are plain tables, and a hot row can be split.
        once = contents.join(again.select(key), key, "left_semi").groupBy(key).agg(F.any_value("text").alias("text"), F.any_value("row").alias("row"))
        texts = texts.unionByName(each(again).join(materialise(once, "repeated-rows"), key).select(kept))
    return Mixture(each(placed).drop("h1", "h2"), sources, _slots(sources, seed, shard_slots, most), texts, block_words)


def _slots(sources: DataFrame, seed: int, shard_slots: int, most: int) -> DataFrame:
    spark = sources.sparkSession
    total, count = sources.agg(F.sum("quota"), F.count("*")).first()
    total = int(total or 0)
    # A number in [0, 1) finds its source through a grid of cells: by the cell, then by the bounds within it.
    cells = 4 * max(int(count), 1)
    ordered = with_row_idx(sources.filter("quota > 0"), ["sid"], "at")
    part = ordered.withColumn("block_no", F.floor(F.col("at") / 1000))
    base = part.groupBy("block_no").agg(F.sum("quota").alias("n")).select("block_no", F.coalesce(F.sum("n").over(
        Window.orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    bounds = part.join(base, "block_no").withColumn("low", F.col("base") + _running(part, "block_no", "at", "quota"))
    scale = float(max(total, 1))
    bounds = bounds.select("sid", (F.col("low") / scale).alias("low"), ((F.col("low") + F.col("quota")) / scale).alias("high"))
    grid = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    grid, _ = small_table(grid, "grid")

    drawn = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), _unit(F.lit(seed), F.col("id")).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * cells)).join(grid, "cell").filter("u >= low AND u < high")
    counts = materialise(drawn.groupBy("shard", "sid").agg(F.count("*").alias("n")), "draws")

    quota = sources.select("sid", "quota")
    placed = counts.withColumn("first", _running(counts, "sid", "shard", "n")).join(quota, "sid")
    over = F.greatest(F.lit(0), F.least(F.col("n"), F.col("first") + F.col("n") - F.col("quota")))
    placed = placed.withColumn("over", over)
    kept = placed.filter("n > over").select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - F.col("over") - 1)).alias("slot"))
    freed = placed.filter("over > 0").select("shard", "sid", F.explode(F.sequence(F.lit(1), "over")).alias("i"))
    had = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    short = quota.join(had, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("quota > n")
    wanted = short.select("sid", F.explode(F.sequence(F.col("n"), F.col("quota") - 1)).alias("slot"))
    freed = with_row_idx(freed.select(_unit(F.lit(seed + 1), F.col("shard"), F.col("sid"), F.col("i")).alias("u"), "shard", "sid", "i"),
                         ["u", "shard", "sid", "i"], "no").select("no", "shard")
    moved = with_row_idx(wanted, ["sid", "slot"], "no").join(freed, "no").select("shard", "sid", "slot")
    slots = kept.unionByName(moved).join(sources.select("sid", "blocks"), "sid")
    turn = F.floor(F.col("slot") / F.col("blocks"))
    block = permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("sid"), turn)
    return slots.select("shard", "sid", "slot", block.alias("block"))


def mixed_pieces(mix: Mixture, seed: int = 42) -> DataFrame:
    """The mix itself: ``shard, place`` (of the block in its shard, from 1, the sources mixed), ``sid, block, start`` (of the document),
    ``doc_id, first_word`` (of the piece in its document, from 0), ``words, text, row``.

    A block's pieces go by ``start``. The pieces of a document that all its blocks give once make up its text again,
    with its white space. No order of rows; see ``mixed_blocks``.
    """
    joined = _cut(mix).join(_places(mix, seed), ["sid", "block"]).withColumn("s", F.explode("slots"))
    return joined.select("s.shard", "s.place", "sid", "block", "start", "doc_id", "first_word", "words", "text", "row")


def _places(mix: Mixture, seed: int) -> DataFrame:
    """``sid, block, slots``: where each taken block goes. A shard holds ``shard_slots`` slots at most, and a block is in few."""
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.col("sid"), F.col("slot")), "sid", "slot")
    slots = mix.slots.withColumn("place", F.row_number().over(order))
    return slots.groupBy("sid", "block").agg(F.collect_list(F.struct("shard", "place")).alias("slots"))


def _cut(mix: Mixture) -> DataFrame:
    """``sid, start, doc_id, row, block, first_word, words, text`` of the pieces into which the ends of blocks cut the texts."""
    block_words = mix.block_words
    first = F.floor(F.col("start") / block_words).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")

    def piece(words: Column, block: Column) -> Column:
        begin = F.greatest(block * block_words - F.col("start"), F.lit(0))
        n = F.least((block + 1) * block_words - F.col("start"), F.col("size")) - begin
        own = F.slice(words, (begin + 1).cast("int"), n.cast("int"))
        return F.struct(block.alias("block"), begin.alias("first_word"), F.size(own).cast("long").alias("words"), F.array_join(own, "").alias("text"))

    # As a lambda's variable the words are found once a text, not once a block.
    words = F.array(F.regexp_extract_all("text", F.lit(SPACED), F.lit(0)))
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(first, last), lambda b: piece(w, b))))
    return mix.texts.select("sid", "start", "doc_id", "row", F.explode(pieces).alias("p")).select("sid", "start", "doc_id", "row", "p.*")


def mixed_blocks(mix: Mixture, seed: int = 42) -> DataFrame:
    """``shard, place, sid, text, spans, row`` of each block: its text, pieces parted by a line break, ``doc_id, first_word,
    words`` of each piece, and the other columns of its first piece's document. All blocks of a source but one have the mixture's ``block_words`` words.

    A block is made once and then goes to its slots. No order of rows; shard and place give it.
    """
    piece = F.struct("start", "first_word", "doc_id", "words", "text")
    pieces = _cut(mix).groupBy("sid", "block").agg(F.collect_list(piece).alias("p"), F.min_by("row", F.struct("start", "first_word")).alias("row"))
    spans = F.transform("p", lambda x: F.struct(x.doc_id.alias("doc_id"), x.first_word.alias("first_word"), x.words.alias("words")))
    blocks = pieces.withColumn("p", F.array_sort("p", lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(0)))
    blocks = blocks.select("sid", "block", F.array_join("p.text", "\n").alias("text"), spans.alias("spans"), "row")
    return blocks.join(_places(mix, seed), ["sid", "block"]).withColumn("s", F.explode("slots")).select("s.shard", "s.place", "sid", "text", "spans", "row")


def taken_words(mix: Mixture) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` per row: the words that the mixed pieces have of it, repeats counted."""
    taken = mixed_pieces(mix).groupBy("sid", "start").agg(F.sum("words").alias("taken"))
    rows = mix.rows.join(mix.sources.select("sid", "source_size", "target"), "sid")
    # Rows without words share a start with the next one; they take nothing.
    key = F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)))
    joined = rows.withColumn("start", key).join(taken, ["sid", "start"], "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
