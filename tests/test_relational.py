from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from speechcurate.operators import joins as J
from speechcurate.operators import manifest as M
from speechcurate.operators import ordering as O
from speechcurate.operators import sets as U
from speechcurate.operators import stats as A
from speechcurate.sources import clips as C
from speechcurate.sources import manifests as SM


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_partition_by_split(spark):
    df = spark.createDataFrame([("clips/train/a",), ("clips/dev/b",), ("c",), (None,)], "file_name string")
    train, others = M.partition_by_split(df)
    assert rows(train) == [("clips/train/a", "train")]
    assert others.count() == 3
    everything, nothing = M.partition_by_split(df, "none")
    assert everything.count() == 4 and nothing.count() == 0


def test_require_not_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "file_name string, uncertainty double")
    with pytest.raises(Exception, match="missing values"):
        M.require_not_null(df, "uncertainty").collect()
    with pytest.raises(Exception, match="missing values"):
        J.join_uncertainty(df.select("file_name"), df.filter("file_name = 'a'")).collect()
    assert M.require_not_null(df.filter("file_name = 'a'"), "uncertainty").count() == 1


def test_assign_cluster(spark):
    m = spark.createDataFrame([("clips/train/a.wav",), ("b.wav",)], "file_name string")
    c = spark.createDataFrame([("a.wav", 1, 0), ("b.wav", 2, 1), ("a.wav", 3, 2)], "filename string, cluster int, row_idx long")
    assert rows(J.assign_cluster(m, c)) == [("b.wav", 2), ("clips/train/a.wav", 3)]
    with pytest.raises(Exception, match="no cluster for b.wav"):
        J.assign_cluster(m, c.filter("cluster <> 2")).collect()
    assert rows(J.assign_cluster(m, c.filter("cluster <> 2"), strict=False), "cluster") == [(3,), (None,)]


def test_subtract_is_null_safe_and_first_row_decides(spark):
    schema = "file_name string, sentence string, row_idx long"
    p = "clips/train/"
    pool = spark.createDataFrame([
        (p + "a", None, 0), (p + "b", "x", 1), (p + "c", "y", 2), (p + "c", "z", 3), (p + "d", "q", 4), (p + "d", "r", 5),
    ], schema)
    chosen = spark.createDataFrame([(p + "a", None, 0), (p + "b", "other", 0), (p + "c", "z", 0), (p + "d", "q", 0), ("clips/dev/b", "x", 9)], schema)
    # a goes (null equals null), b stays (other sentence), c stays (its first row is y), d goes with both rows
    assert rows(J.subtract_subset(pool, chosen)) == [(p + "b", "x", 1), (p + "c", "y", 2)]


def test_overlap_counts_copies(spark):
    a = spark.createDataFrame([("x", None)] * 3 + [("y", 1)], "s string, v int")
    b = spark.createDataFrame([("x", None)] * 2 + [("y", 2)], "s string, v int")
    assert rows(J.overlap(a, b)) == [("x", None, 3, 2, 6)]
    assert J.overlap_size(a, b).first()[0] == 6
    assert J.overlap_size(a, b.filter("s = 'y'")).first()[0] == 0


def test_audits(spark):
    a = spark.createDataFrame([("p", 1), ("p", 1), ("q", 2), (None, 3)], "file_name string, v int")
    b = spark.createDataFrame([("p", "s"), ("r", "t"), (None, "u")], "file_name string, w string")
    merged = a.toPandas().merge(b.toPandas(), how="outer", on="file_name", indicator=True)
    r = J.outer_audit(a, b).first()
    distinct = merged.drop_duplicates()
    side = distinct["_merge"].value_counts()
    assert (r.rows_outer, r.duplicated) == (len(merged), int(merged.duplicated().sum()))
    assert (r.left_only, r.both, r.right_only) == (side["left_only"], side["both"], side["right_only"])
    i = J.inner_audit(a, b).first()
    assert (i.rows_inner, i.rows_b, i.equal) == (len(a.toPandas().merge(b.toPandas(), on="file_name")), 3, True)
    assert rows(J.subset_violations(a, b)) == [("r", "t")]
    with pytest.raises(ValueError, match="disjoint"):
        J.assert_disjoint(a, b)
    J.assert_disjoint(a.filter("file_name = 'q'"), b)


def test_moments_are_bias_corrected(spark):
    pd = pytest.importorskip("pandas")
    for values in ([1, 2, 2, 9, 4], [3, 3, 3, 3], [1, 2], [5], [1, 2, 4]):
        df = spark.createDataFrame([(f"s{i}",) for i, n in enumerate(values) for _ in range(n)] + [(None,)], "speaker_id string")
        r = A.speaker_count_stats(df).first()
        s = pd.Series(values, dtype=float)
        for got, want in ((r.mean, s.mean()), (r.variance, s.var()), (r.skew, s.skew()), (r.kurtosis, s.kurtosis())):
            assert (got is None and pd.isna(want)) or got == pytest.approx(want, abs=1e-9)
        assert r.ones == values.count(1)
        assert A.number_of_speakers(df).first()[0] == len(values)
    assert statistics.mean([1]) == 1


def test_duplicates(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1), (None, 2), (None, 2)], "file_name string, v int")
    assert A.duplicate_count(df).first()[0] == 2
    assert rows(A.duplicated_rows(df)) == [("a", None), ("a", None), (None, 2), (None, 2)]
    assert A.duplicate_count(df.limit(0)).first()[0] == 0


def test_numbering(spark):
    ids = [("c10", 0), ("c9", 1), ("c9", 2), ("c10", 3), ("c10", 4), ("c10", 5), (None, 6), (None, 7), ("c9", 8)]
    df = spark.createDataFrame(ids, "client_id string, row_idx long").repartition(3)
    want = [1, 1, 2, 1, 2, 3, 1, 2, 1]
    for block in (1, 2, 3, 100):
        for dense in (True, False):
            got = {r.row_idx: r.file_no for r in O.number_runs(df, dense=dense, block_rows=block).collect()}
            assert [got[i] for i in range(len(ids))] == want
    known = df.filter("client_id is not null")
    assert {r.client_id: r.client_no for r in O.number_clients(known).collect()} == {"c10": 1, "c9": 2}


def test_one_client_over_many_blocks(spark):
    df = spark.range(0, 50).select(F.col("id").alias("row_idx"), F.when(F.col("id") < 3, "a").otherwise("b").alias("client_id"))
    got = {r.row_idx: r.file_no for r in O.number_runs(df, dense=True, block_rows=4).collect()}
    assert [got[i] for i in range(50)] == [1, 2, 3] + list(range(1, 48))


def test_row_idx(spark):
    df = spark.range(0, 3_000).select((F.col("id") * 7919 % 3_001).alias("k"))
    got = {r.k: r.row_idx for r in O.with_row_idx(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_first_per_key_plans_a_partial_limit(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    plan = O.first_per_key(df, "user_id", "event_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_build_metadata(spark):
    def part(name):
        return spark.createDataFrame([("u", name)], "client_id string, path string")
    got = rows(U.build_metadata(part("a"), part("b"), part("c").toDF("x", "y")))
    assert got == [("data/dev/c.mp3", "u", "c"), ("data/test/b.mp3", "u", "b"), ("data/train/a.mp3", "u", "a")]


def test_value_diff_with_null(spark):
    a = spark.createDataFrame([("x",), (None,), ("x",)], "s string")
    b = spark.createDataFrame([("y",), ("y",)], "s string")
    assert rows(U.value_diff(a, b, "s")) == [("x", "a"), ("y", "b"), (None, "a")]
    assert rows(U.compare_manifests(a, a, ("s",)), "equal") == [(True,)] * 3


def test_copy_plan_errors_and_bare_names(spark):
    df = spark.createDataFrame([("a.wav",), ("clips/b.wav",)], "file_name string")
    with pytest.raises(ValueError):
        C.clip_copy_plan(df, "i", "o", mode="other")
    same = C.clip_copy_plan(df, "i", "o", mode="same")
    assert rows(same, "src", "dst") == [("i/a.wav", "o/clips/a.wav"), ("i/clips/b.wav", "o/clips/b.wav")]
    two = spark.createDataFrame([("c/a.wav", "7"), ("c/b.wav", "9")], "file_name string, speaker_id string")
    assert rows(C.speaker_copy_plan(two, "i", "o", "7"), "dst") == [("o/speaker1/a.wav",), ("o/speaker2/b.wav",)]


def test_manifest_round_trip(spark, tmp_path):
    text = [("a", ' two\n"lines", & comma ', "1"), ("b", "tab\tand space ", None), ("c", 'q"', "3")]
    df = spark.createDataFrame(text, SM.MANIFEST)
    for sep in (",", "\t"):
        path = f"{tmp_path}/m{ord(sep)}"
        SM.write_manifest(df, path, sep)
        SM.write_manifest(df, path, sep)
        assert rows(SM.read_manifest(spark, path, sep=sep)) == rows(df)
    SM.append_metric(spark.createDataFrame([("a", 0.5)], "run string, score double"), f"{tmp_path}/s")
    SM.append_metric(spark.createDataFrame([("b", 0.6)], "run string, score double"), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2


def test_ingest_keeps_one_more(spark):
    df = spark.createDataFrame([(f"x/{i}.mp3", "s", "u", i) for i in range(9)], "path string, sentence string, client_id string, row_idx long")
    got = SM.ingest_corpus(df, "common_voice", 3)
    assert rows(got, "file_name", "speaker_id") == [(f"{i}.wav", "u") for i in range(4)]
    with pytest.raises(ValueError):
        SM.ingest_corpus(df, "unknown")


def test_quota_audit(spark):
    before = spark.createDataFrame([(0, 5), (1, 4)], "cluster int, count long")
    quota = spark.createDataFrame([(0, 2), (1, 4)], "cluster int, num_samples long")
    after = spark.createDataFrame([(0, 3)], "cluster int, count long")
    A.assert_quota(before, quota, after)
    with pytest.raises(ValueError, match="do not add up"):
        A.assert_quota(before, quota, before)


def test_checks_survive_pruning(spark):
    m = spark.createDataFrame([("a",), ("b",)], "file_name string")
    u = spark.createDataFrame([("a", 0.5)], "file_name string, uncertainty double")
    c = spark.createDataFrame([("a", 1)], "filename string, cluster int")
    for df in (J.join_uncertainty(m, u), J.assign_cluster(m, c, order=None)):
        for use in (lambda d: d.count(), lambda d: d.select("file_name").collect(), lambda d: d.join(m, "file_name").count()):
            with pytest.raises(Exception, match="missing values|no cluster"):
                use(df)


def test_manifest_by_header_name(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("s1", "clips/a.wav", "hello, you", "north")], "speaker_id string, file_name string, sentence string, accent string")
    SM.write_manifest(df, path)
    got = SM.read_manifest(spark, path)
    assert got.columns == ["file_name", "sentence", "speaker_id", "accent"]
    assert tuple(got.first()) == ("clips/a.wav", "hello, you", "s1", "north")
    with pytest.raises(ValueError, match="no column duration"):
        SM.read_manifest(spark, path, "duration double")


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    home = tmp_path / "a folder 50% +é"
    home.mkdir()
    (home / "one %20.csv").write_text('\nfile_name,sentence,speaker_id\na.wav,"hello, you",s1\n')
    (home / "two.csv").write_text('speaker_id,accent,file_name,sentence\ns2,north,b.wav,"a\nb"\n')
    (home / "three.csv").write_text("file_name,sentence,speaker_id\nc.wav,,s3\n")
    (home / "four.csv").write_text("")
    got = {tuple(r) for r in SM.read_manifest(spark, str(home)).select("file_name", "sentence", "speaker_id", "accent").collect()}
    assert got == {("a.wav", "hello, you", "s1", None), ("b.wav", "a\nb", "s2", "north"), ("c.wav", None, "s3", None)}
    (home / "five.csv").write_text("file_name,sentence\nd.wav,x\n")
    with pytest.raises(ValueError, match="five.csv has no column speaker_id"):
        SM.read_manifest(spark, str(home))
    with pytest.raises(Exception, match="(?i)header"):
        SM.read_manifest(spark, str(home), "file_name string", multi_line=False).collect()

    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "one {x}[1].csv").write_text("file_name,n\na.wav,1\n")
    (odd / "two*.csv").write_text("n,file_name\n2,b.wav\n")
    got = SM.read_manifest(spark, str(odd), "file_name string, n int", multi_line=False, mixed_headers=True)
    assert {tuple(r) for r in got.collect()} == {("a.wav", 1), ("b.wav", 2)}


def test_values_that_do_not_fit(spark, tmp_path):
    (tmp_path / "m.csv").write_text("file_name,cluster,score\na.wav,3,0.5\nb.wav,xx,1e999x\nc.wav,,2\n")
    path, schema = str(tmp_path), "file_name string, cluster int, score double"
    with pytest.raises(Exception, match="cluster of .* is no int: xx"):
        SM.read_manifest(spark, path, schema).select("cluster").collect()
    assert SM.read_manifest(spark, path, schema).select("file_name").count() == 3
    null = {tuple(r) for r in SM.read_manifest(spark, path, schema, invalid="null").collect()}
    assert null == {("a.wav", 3, 0.5), ("b.wav", None, None), ("c.wav", None, 2.0)}
    told = {r.file_name: [tuple(x) for x in r.invalid] for r in SM.read_manifest(spark, path, schema, invalid="report").collect()}
    assert told == {"a.wav": [], "b.wav": [("cluster", "xx"), ("score", "1e999x")], "c.wav": []}
    with pytest.raises(ValueError, match="invalid must be"):
        SM.read_manifest(spark, path, schema, invalid="drop")


def test_a_repeated_run_adds_no_second_row(spark, tmp_path):
    path = f"{tmp_path}/runs"
    for run, score in (("a", 0.5), ("b", 0.6), ("a", 0.5), ("b", 0.7), ("c/1 x", 0.1)):
        SM.append_metric(spark.createDataFrame([(score,), (score + 1,)], "score double"), path, run)
    rows = sorted((r.run, r.score) for r in spark.read.parquet(path).collect())
    assert rows == [("a", 0.5), ("a", 1.5), ("b", 0.7), ("b", 1.7), ("c/1 x", 0.1), ("c/1 x", 1.1)]


def test_bloom_filter_before_audits(spark):
    pool = spark.range(200_000).select(F.when(F.col("id") % 3 != 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("file_name"), "id")
    batch = spark.createDataFrame([(f"p{i}",) for i in range(1, 3_000, 7)] + [("new",), (None,), ("p1",)], "file_name string")
    known = {r.file_name for r in batch.collect()}
    want = sorted(r.id for r in pool.collect() if r.file_name in known)
    few = J.may_match(pool.filter("file_name is not null"), batch)
    assert few.columns == pool.columns
    passed, right = few.count(), sum(1 for i in want if i % 3)
    assert right <= passed <= right + 1_000  # of 133,333 rows of the pool
    for limit in (J.BLOOM_KEYS, 5):
        assert right <= J.may_match(pool.filter("file_name is not null"), batch, max_keys=limit).count()
    assert sorted(r.id for r in J.matching_rows(pool, batch).collect()) == want
    missing = [f"p{i}" for i in range(1, 3_000, 7) if i % 3 == 0] + ["new"]
    assert sorted(r.file_name for r in J.subset_violations(pool, batch).collect()) == sorted(missing)
    J.assert_disjoint(pool, spark.createDataFrame([("new",)], "file_name string"))
    with pytest.raises(ValueError, match="disjoint"):
        J.assert_disjoint(pool, batch)
    # The pool's side of the join is filtered before it is shuffled.
    plan = J.matching_rows(pool, batch)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "_block" in plan
    numbers = spark.createDataFrame([(1,)], "file_name int")
    assert J.matching_rows(spark.range(5).withColumnRenamed("id", "file_name"), numbers).count() == 1
    assert J.matching_rows(pool, batch.limit(0)).count() == 0
