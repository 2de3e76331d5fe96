from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from speechcurate.functions import text as X
from speechcurate.functions.edit_distance import cer, wer, word_distance
from speechcurate.sources.manifests import derived_path


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


CLEANED = [
    ("[What] a piece of work [is man]", " What  a piece of work  is man "),
    ("Play pop-rap off Google Music.", "Play pop rap off Google Music."),
    ("table for five at Space Aliens Grill & Bar in FM", "table for five at Space Aliens Grill  and  Bar in FM"),
    ("I canât understand it.", "I can't understand it."),
    ("Play a Nóta song", "Play a Nota song"),
    ("á ë é ñ ú ō ó `x` (y)", "a e e n u o o  x   y "),
]


@pytest.mark.parametrize("variant", X.VARIANTS)
@pytest.mark.parametrize("raw,clean", CLEANED)
def test_clean(spark, variant, raw, clean):
    assert one(spark, X.clean_transcript("s", variant), s=raw) == clean


def test_clean_variants_differ(spark):
    raw = "Hunger is good mustard â the best sauce. It’s"
    assert one(spark, X.clean_transcript("s", "creator"), s=raw) == "Hunger is good mustard a the best sauce. It's"
    assert one(spark, X.clean_transcript("s", "sampler"), s=raw) == "Hunger is good mustard ' the best sauce. It’s"
    assert one(spark, X.clean_transcript("s"), s=None) is None
    with pytest.raises(ValueError):
        X.clean_transcript("s", "other")


@pytest.mark.parametrize("path", ["a/b/c.wav", "c.wav", "/c", "a.b/c", "a/.hidden", "a/..x.y", "a/c.tar.gz", "a/", ""])
def test_change_basename_as_os_path(spark, path):
    folder, base = os.path.split(path)
    want = os.path.join(folder, "new" + os.path.splitext(base)[1])
    if folder == "/":
        want = "/new" + os.path.splitext(base)[1]
    assert one(spark, X.change_basename("p", F.lit("new")), p=path) == want


def test_paths(spark):
    assert one(spark, X.split_of("p"), p="clips/train/x.wav") == "train"
    assert one(spark, X.split_of("p"), p="x.wav") is None
    assert one(spark, X.basename("p"), p="clips/train/x.wav") == "x.wav"
    assert one(spark, X.derived_name("p", "_random"), p="x.tsv") == "x_random.tsv"
    with pytest.raises(Exception, match="not one dot"):
        one(spark, X.derived_name("p", "_random"), p="x.y.tsv")
    assert one(spark, X.swap_extension("p", ".wav"), p="a.b/c.mp3") == "a.wav"
    assert one(spark, X.prefix_path("p", "clips", "dev"), p="x.wav") == "clips/dev/x.wav"
    assert one(spark, X.corpus_of("p"), p="5652-39938-0066.wav") == "librispeech"
    assert one(spark, X.corpus_of("p"), p="5" * 128 + ".wav") == "common_voice"
    assert derived_path("x.tsv", "_output") == "x_output.tsv"


def textbook(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_distance_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = docs.filter(F.length("text") < 3_000)
    pairs = short.alias("a").join(short.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1)
    rows = pairs.select(
        F.col("a.text").alias("ref"), F.col("b.text").alias("hyp"),
        word_distance(F.col("a.text"), F.col("b.text")).alias("d"), wer(F.col("a.text"), F.col("b.text")).alias("w"),
    ).limit(60).collect()
    assert len(rows) > 20
    for r in rows:
        ref, hyp = r.ref.split(), r.hyp.split()
        assert r.d == textbook(ref, hyp)
        assert r.w == (r.d / len(ref) if ref else None)


def test_error_rates_at_the_edges(spark):
    assert one(spark, wer(F.col("a"), F.col("b")), a="", b="x") is None
    assert one(spark, wer(F.col("a"), F.col("b")), a="  a  b ", b="a\nb") == 0.0
    assert one(spark, wer(F.col("a"), F.col("b")), a="a b", b="") == 1.0
    assert one(spark, cer(F.col("a"), F.col("b")), a="", b="x") is None
    assert one(spark, cer(F.col("a"), F.col("b")), a="né", b="ne") == 0.5


def test_more_than_256_distinct_words(spark):
    a = " ".join(f"w{i}" for i in range(700))
    b = " ".join(f"w{i}" for i in range(700) if i % 10)
    assert one(spark, word_distance(F.col("a"), F.col("b")), a=a, b=b) == 70
