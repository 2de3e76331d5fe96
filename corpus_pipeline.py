"""The corpus pipeline: quality rules, language ID, near duplicates, mixing, encoding.

Each stage reads the table its predecessor wrote; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechcurate.llm import jaccard, language, mixing, pieces, quality
from speechcurate.llm.queries import remainder, table
from speechcurate.session import materialise, ship_package

BLOCK_WORDS = 256


def _key() -> Column:
    """The document's id; for one without, a number from its text beyond all usual ids."""
    own = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.col("doc_id"), own)


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` beside the whole row, so that further columns can't clash with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base checks nor the learned rules reject."""
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality.apply_quality(_packed(docs, "text"), rules).filter("kept").select("__row.*")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that holds at least half of them."""
    model = language.train_languages(docs.filter(remainder("doc_id", 4) != 2))
    judged = language.with_language(_packed(docs, "text"), model)
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= 0.5)).select("__row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the smallest id. Equal rows are one; rows
    that share an id but not the text stay as they are."""
    keyed = docs.withColumn("__key", _key())
    judged = jaccard.jaccard_components(keyed, "__key")
    chosen = judged.filter("doc_id = component_id").select(F.col("doc_id").alias("__key")).distinct()
    copy = F.row_number().over(Window.partitionBy("__key", F.xxhash64("text")).orderBy("source", "lang"))
    return keyed.join(chosen, "__key", "left_semi").withColumn("__copy", copy).filter("__copy = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed blocks of the mix, one row for each slot: pieces of documents of one source, parted by line breaks, ``BLOCK_WORDS`` words in all
    but the last block of a source. A row has the other columns of its first piece's document; documents without words stay once."""
    plan = mixing.mix_sources(docs.withColumn("__key", _key()), [5, 2, 1], share=1.5, most=2, doc_id="__key", block_words=BLOCK_WORDS)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("text")}
    blocks = mixing.mixed_blocks(plan).select(*[made[c].alias(c) if c in made else F.col(f"row.`{c}`") for c in docs.columns])
    return blocks.unionByName(docs.filter(mixing.count_words(F.col("text")) == 0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each text; a text that doesn't come back from them whole is an error. Rows are sampled
    by id, text and, where both repeat, by their number, so each repeat of a block has a sample of its own."""
    ship_package(spark)
    vocabulary = pieces.load_vocabulary()
    rows = docs.groupBy("doc_id", "text", "lang", "source").agg(F.count("*").alias("__n")).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__n")))
    coded = rows.withColumn("__coded", pieces.encode_checked(F.col("text"), F.xxhash64("doc_id", "text", "lang", "source", "__copy"), vocabulary))
    whole = F.when(F.col("__coded.whole"), True).otherwise(F.raise_error("a text was not decoded as it was").cast("boolean"))
    return coded.filter(whole).select("doc_id", "lang", "source", F.size("__coded.ids").cast("long").alias("n_pieces"), F.col("__coded.ids").alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("language ID", keep_identified),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]
ORACLE_SQL = None  # learned rules, language models and sampled pieces are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
