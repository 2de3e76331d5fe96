"""Ranked selection per group that no hot group can pull into one task.

``take_ranked`` finds, for every group, the key of the last row to keep, and then
filters the rows against it. The search is a radix descent on narrow columns:
rows are counted per range of the order's first column that still varies in the
group, the range in which the quota ends is kept and cut again, and once it is
small its distinct keys are counted and summed up in order. Of rows that share the
last key just as many are kept as are still needed, so sizes are exact
whatever repeats: the descent goes on over a hash of the whole row, and rows that are
equal in all columns are counted, not numbered. Wide rows are never shuffled.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechcurate.functions.text import sample_digest
from speechcurate.session import join_on, materialise, small_table

# Ranges of up to this many rows are ordered by one task.
ROWS_PER_TASK = 1_000_000
# Ranges that one level cuts a group's order into.
CUTS = 1_024


@dataclass
class DigestOrder:
    """Random but reproducible order: md5 of seed and key. A null key is a key of its own; rows of equal keys stay together."""

    key: str = "file_name"
    seed: int | str = 42
    cut_by = ("_o0",)

    def keys(self, df: DataFrame) -> list[Column]:
        text = F.col(self.key).cast("string")
        digest = F.coalesce(sample_digest(self.key, self.seed), sample_digest(F.lit(""), self.seed))
        leading = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return [leading, digest, F.coalesce(text, F.lit("")), text.isNull()]


@dataclass
class ScoreOrder:
    """Highest score first, missing scores last; among equals the earlier row, then the path.

    Tie columns that the table doesn't have are left out.
    """

    score: str = "uncertainty"
    tie: str = "row_idx"
    path: str = "file_name"
    cut_by = ("_o0", "_o1", "_o2")

    def keys(self, df: DataFrame) -> list[Column]:
        score = F.nullif(F.col(self.score).cast("double"), F.lit(float("nan")))
        endless = F.abs(score) == float("inf")
        kind = F.when(score.isNull(), 3).when(endless & (score > 0), 0).when(endless, 2).otherwise(1)
        finite = F.when(score.isNull() | endless, 0.0).otherwise(-score + F.lit(0.0))
        tie = F.coalesce(F.col(self.tie).cast("long"), F.lit(-1)) if self.tie in df.columns else F.lit(0)
        path = F.coalesce(F.col(self.path).cast("string"), F.lit("")) if self.path in df.columns else F.lit("")
        return [kind.cast("long"), finite.cast("double"), tie.cast("long"), path]


@dataclass
class RowOrder:
    """Order of a hash of the given columns, two words long; only equal rows share a key."""

    columns: list[str]
    cut_by = ("_o0", "_o1")

    def keys(self, df: DataFrame) -> list[Column]:
        row = [F.to_json(F.struct(f"`{c}`")) if "map<" in df.schema[c].dataType.simpleString() else F.col(f"`{c}`") for c in self.columns]
        # Without two bits each, so that differences don't overflow.
        return [F.shiftrightunsigned(h, 2) for h in (F.xxhash64(*row), F.xxhash64(F.lit(1), *row))]


def _named(keys: list[Column]) -> list[Column]:
    return [k.alias(f"_o{i}") for i, k in enumerate(keys)]


def _ends(names: tuple[str, ...]) -> list[Column]:
    return [f(c).alias(f"{c}_{n}") for c in names for n, f in (("lo", F.min), ("hi", F.max))]


def _range(names: tuple[str, ...], types: dict[str, str]) -> Column:
    """Range of a row within its group: by the first column whose least and greatest values differ."""
    out = F.lit(0).cast("long")
    for c in reversed(names):
        x, lo, hi = F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")
        if types[c] == "double":
            half = F.when(hi - lo == float("inf"), 0.5).otherwise(1.0)
            within = F.least(F.floor((x * half - lo * half) / (hi * half - lo * half) * CUTS), F.lit(CUTS - 1))
        else:
            within = F.floor((x - lo) / (F.floor((hi - lo) / CUTS) + 1))
        out = F.when(lo < hi, within.cast("long")).otherwise(out)
    return out


def rank_cutoffs(df: DataFrame, order, need: DataFrame | int, group: str | None = None,
                 rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Key of the last row to keep in each group: ``(_g, _cut, _left, _same)``.

    ``_same`` rows have that key, and ``_left`` of them are kept. ``need`` holds ``(group, num_samples)`` or is
    one number. A group whose quota exceeds its size is kept whole; a group without a quota, or with none
    left, is absent.
    """
    keys = _named(order.keys(df))
    names = [f"_o{i}" for i in range(len(keys))]
    rows = materialise(df.select((F.col(group) if group else F.lit(0)).alias("_g"), *keys), "order")
    types = dict(rows.dtypes)
    if group:
        quota = need.select(F.col(group).alias("_g"), F.col("num_samples").cast("long").alias("_need"))
    else:
        quota = df.sparkSession.createDataFrame([(0, int(need))], "_g int, _need long")
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"), *_ends(order.cut_by))
    state = join_on(sizes, quota, ["_g"]).withColumn("_need", F.least("_need", "_n")).filter("_need > 0")
    before = None
    while True:
        state, few = small_table(state, "boundary")
        if few is None:
            varies = F.lit(False)
            for c in order.cut_by:
                varies = varies | (F.col(f"{c}_lo") < F.col(f"{c}_hi"))
            largest = state.filter(varies).agg(F.max("_n")).first()[0] or 0
        else:
            largest = max((r["_n"] for r in few.to_pylist() if any(r[f"{c}_lo"] < r[f"{c}_hi"] for c in order.cut_by)), default=0)
        if largest <= rows_per_task:
            break
        if before is not None and largest >= before:
            raise RuntimeError(f"a range of {largest} rows does not shrink")
        before = largest
        ranged = join_on(rows, state.drop("_n"), ["_g"]).withColumn("_bucket", _range(order.cut_by, types))
        counts = ranged.groupBy("_g", "_bucket", "_need").agg(F.count("*").alias("_n"), *_ends(order.cut_by))
        running = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = counts.withColumn("_upto", F.sum("_n").over(running))
        ends_here = (F.col("_upto") - F.col("_n") < F.col("_need")) & (F.col("_need") <= F.col("_upto"))
        boundary = materialise(upto.filter(ends_here).withColumn("_need", F.col("_need") - F.col("_upto") + F.col("_n")).drop("_upto"), "boundary")
        rows = join_on(ranged.select("_g", "_bucket", *names), boundary.select("_g", "_bucket"), ["_g", "_bucket"]).drop("_bucket")
        rows, state = materialise(rows, "boundary-rows"), boundary.drop("_bucket")

    # Equal keys are counted before the shuffle, so a hot key is a row per task.
    copies = join_on(rows, state.select("_g", "_need"), ["_g"]).groupBy("_g", "_need", *names).agg(F.count("*").alias("_same"))
    running = Window.partitionBy("_g").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("_need") - F.col("_upto") + F.col("_same")
    last = copies.withColumn("_upto", F.sum("_same").over(running)).withColumn("_left", left)
    last = last.filter("_left > 0 AND _left <= _same")
    return last.select("_g", F.struct(*names).alias("_cut"), "_left", "_same")


def split_ranked(df: DataFrame, order, need: DataFrame | int, group: str | None = None,
                 rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(the first ``need`` rows of every group in ``order``, all other rows).

    Where only a part of the rows with the last key is kept, a hash of the whole row decides which; of rows
    that are equal in all columns as many are kept as are needed.
    """
    cuts, few = small_table(rank_cutoffs(df, order, need, group, rows_per_task), "cutoffs")
    names = [f"_o{i}" for i in range(len(order.keys(df)))]
    keyed = df.select("*", F.struct(*_named(order.keys(df))).alias("_k"), (F.col(group) if group else F.lit(0)).alias("_group"))
    if group or few is None:
        cut = keyed.join(cuts, F.col("_group") == F.col("_g"), "left")
    elif few.num_rows:  # one group: its cut is a literal
        cut = keyed.withColumns({c: F.lit(few[c][0].as_py()) for c in ("_g", "_left", "_same")}).withColumn(
            "_cut", F.struct(*[F.lit(few["_cut"][0].as_py()[n]).cast(cuts.schema["_cut"].dataType[n].dataType).alias(n) for n in names]))
    else:
        return df.filter(F.lit(False)), df
    key, last = F.struct(*[F.col(f"_k.{n}") for n in names]), F.col("_cut")
    inside = last.isNotNull() & ((key < last) | ((key == last) & (F.col("_left") == F.col("_same"))))
    beyond = last.isNull() | (key > last)
    kept, rest = cut.filter(inside).select(df.columns), cut.filter(beyond).select(df.columns)
    in_part = any(r["_left"] < r["_same"] for r in few.select(["_left", "_same"]).to_pylist()) if few is not None else not cuts.filter("_left < _same").isEmpty()
    if in_part:
        split = cut.filter(last.isNotNull() & (key == last) & (F.col("_left") < F.col("_same"))).drop("_k", "_cut", "_same")
        if isinstance(order, RowOrder):
            first, second = _split_equal(split, cuts, df.columns)
        else:
            quota = cuts.filter("_left < _same").select(F.col("_g").alias("_tie"), F.col("_left").alias("num_samples"))
            first, second = split_ranked(split.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_g").alias("_tie")), RowOrder(df.columns), quota, "_tie", rows_per_task)
        kept, rest = kept.unionByName(first.select(df.columns)), rest.unionByName(second.select(df.columns))
    return kept, rest


def _split_equal(equal: DataFrame, cuts: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``_left`` rows of each group, the others), of groups whose rows are all equal: one row and its copies."""
    one = equal.groupBy("_g").agg(*[F.any_value(f"`{c}`").alias(c) for c in columns])
    both = one.join(cuts.filter("_left < _same").select("_g", "_left", (F.col("_same") - F.col("_left")).alias("_over")), "_g")

    def copies(n: str) -> DataFrame:
        # In two steps, so that no array grows with the copies.
        blocks = both.withColumn("_tall", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / 1000))))
        return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000).cast("long"), F.col(n) - F.col("_tall") * 1000)))).select(columns)

    return copies("_left"), copies("_over")


def take_ranked(df: DataFrame, order, need: DataFrame | int, group: str | None = None,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The first ``need`` rows of every group in ``order``."""
    return split_ranked(df, order, need, group, rows_per_task)[0]


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows per cluster; rows without a cluster are not counted."""
    return df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("count"))


def cluster_share(sizes: DataFrame) -> DataFrame:
    """Add each cluster's part of all rows. Takes the table of sizes, one row per cluster, and evaluates it once."""
    sizes, few = small_table(sizes, "sizes")
    total = sizes.agg(F.sum("count")).scalar() if few is None else F.lit(pc.sum(few["count"]).as_py())
    return sizes.withColumn("sample_percentage", F.col("count") / total)


# Fixed values of the method: the parts at both ends and the multiplier.
def inverse_quota(sizes: DataFrame, ymin: float = 0.0397, ymax: float = 0.095, mult: int = 4) -> DataFrame:
    """Quota per cluster, with a larger part taken from smaller clusters.

    The part falls linearly from ``ymax`` for an empty cluster to ``ymin`` for one
    that holds everything. It is cut to a whole number before the multiplier.
    """
    affine = F.lit(ymin - ymax) * F.col("sample_percentage") + F.lit(ymax)
    return cluster_share(sizes).withColumn("affine_linear", affine).withColumn(
        "num_samples", (F.col("affine_linear") * F.col("count")).cast("long") * mult
    )


def _fraction(frac: float, n: Column) -> Column:
    """Share of n rows, halves rounded to the even number."""
    return F.bround(F.lit(frac) * n, 0).cast("long")


def sample_n(df: DataFrame, n: int, key: str = "file_name", seed: int | str = 42) -> DataFrame:
    """n random rows; an error when there are fewer."""
    rows = df.count()
    if n > rows:
        raise ValueError(f"cannot take {n} of {rows} rows")
    return take_ranked(df, DigestOrder(key, seed), n)


def sample_n_per_cluster(df: DataFrame, n: int, key: str = "file_name", seed: int | str = 42,
                         cluster: str = "cluster") -> DataFrame:
    """Up to n random rows of every cluster; warns when the smallest one has fewer."""
    sizes, few = small_table(cluster_sizes(df, cluster), "sizes")
    smallest = sizes.agg(F.min("count")).first()[0] if few is None else pc.min(few["count"]).as_py()
    if smallest is not None and n > smallest:
        warnings.warn(f"the smallest cluster has only {smallest} rows", stacklevel=2)
    return take_ranked(df, DigestOrder(key, seed), sizes.select(cluster, F.lit(n).alias("num_samples")), cluster)


def sample_frac(df: DataFrame, frac: float = 0.05, key: str = "file_name", seed: int | str = 42) -> DataFrame:
    """A random share of all rows."""
    n = df.agg(_fraction(frac, F.count("*"))).first()[0]
    return take_ranked(df, DigestOrder(key, seed), n)


def sample_stratified(df: DataFrame, frac: float = 0.05, key: str = "file_name", seed: int | str = 42,
                      cluster: str = "cluster") -> DataFrame:
    """The same random share of every cluster; a small cluster may give none."""
    quota = cluster_sizes(df, cluster).select(cluster, _fraction(frac, F.col("count")).alias("num_samples"))
    return take_ranked(df, DigestOrder(key, seed), small_table(quota, "quota")[0], cluster)


def sample_inverse(df: DataFrame, quota: DataFrame | None = None, key: str = "file_name", seed: int | str = 42,
                   cluster: str = "cluster", **params) -> DataFrame:
    """Random rows of every cluster, as many as its inverse quota.

    Fails when a quota exceeds the cluster, or a cluster has no quota.
    """
    sizes, _ = small_table(cluster_sizes(df, cluster), "sizes")
    if quota is None:
        quota = inverse_quota(sizes.withColumnRenamed(cluster, "cluster"), **params).withColumnRenamed(
            "cluster", cluster
        )
    checked = sizes.join(quota.select(cluster, "num_samples"), cluster, "left")
    bad = checked.filter(F.col("num_samples").isNull() | (F.col("num_samples") > F.col("count"))).limit(5).collect()
    if bad:
        raise ValueError(f"no quota, or more than the cluster holds: {bad}")
    return take_ranked(df, DigestOrder(key, seed), quota, cluster)


def top_uncertain_per_cluster(df: DataFrame, quota: DataFrame, score: str = "uncertainty", tie: str = "row_idx",
                              cluster: str = "cluster") -> DataFrame:
    """The most uncertain rows of every cluster, as many as its quota."""
    return take_ranked(df, ScoreOrder(score, tie), quota, cluster)


def top_uncertain(df: DataFrame, n: int, score: str = "uncertainty", tie: str = "row_idx") -> DataFrame:
    """The n most uncertain rows of all."""
    return take_ranked(df, ScoreOrder(score, tie), n)


def train_test_split(df: DataFrame, test_size: float = 0.3, key: str = "file_name",
                     seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """Random split into (train, test); the test part is rounded up."""
    n_test = math.ceil(test_size * df.count())
    test, train = split_ranked(df, DigestOrder(key, seed), n_test)
    return train, test


ALGORITHMS = ("inverse", "smca", "random")


def select_batch(df: DataFrame, quota: DataFrame, algorithm: str = "inverse", key: str = "file_name",
                 tie: str = "row_idx", seed: int | str = 42) -> DataFrame:
    """Next batch to label: by cluster quota, the overall top, or at random."""
    if algorithm == "inverse":
        return top_uncertain_per_cluster(df, quota, tie=tie)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    n = quota.agg(F.sum("num_samples")).first()[0] or 0
    return top_uncertain(df, n, tie=tie) if algorithm == "smca" else sample_n(df, n, key, seed)


def head_fraction(df: DataFrame, percent: float, order: str = "row_idx") -> DataFrame:
    """The first percent of a table whose ``order`` counts 0, 1, 2 ..."""
    n = df.count()
    return df.filter(F.col(order) < round(n * percent / 100))
