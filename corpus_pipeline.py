"""A corpus from raw documents to packed sequences.

Toxic and low-quality documents go, one document of each group of near-duplicates
stays, passages that repeat across documents are cut, and the rest is packed.  Every
stage works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import packing, quality, queries, simhash, suffixes, toxicity
from newsloom.session import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half; null and empty texts stay."""
    lexicon = queries.toxicity_lexicon(spark, docs, sf_dir)
    return toxicity.with_score(docs, "text", lexicon, "_score").where("_score < 0.5").select(*COLUMNS)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of one half or more."""
    model = queries.quality_model(spark, docs, sf_dir)
    return quality.with_score(docs, "text", model, "_score").where("_score >= 0.5").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group: the one of the smallest id, null ids last, and of the smallest text hash.

    Ids need not be unique: two texts under one id that are no near-duplicates both stay.
    """
    order = [F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"]
    firsts = simhash.near_duplicates(docs, "doc_id", "text").groupBy("root").agg(F.min(F.struct(*order)).alias("one"))
    firsts = firsts.select("one.doc_id", "one.text_hash")
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    same = hashed["doc_id"].eqNullSafe(firsts["doc_id"]) & (hashed["text_hash"] == firsts["text_hash"])
    kept = hashed.join(firsts, same, "left_semi")
    # Equal rows fold before the exchange.
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = kept.groupBy("doc_id", "text_hash").agg(F.min(F.struct(*rest)).alias("row"))
    return one.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in rest])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of a smaller id holds."""
    cut = suffixes.repeated(docs, "doc_id", "text", ["lang", "source"])
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                      F.length("kept").cast("long").alias("n_chars"))


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "doc_id", "text", queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near duplicates", without_near_duplicates),
    ("repeated passages", without_repeats),
    ("packing", in_sequences),
]

# The classifiers, SimHash and the tokenizer have no SQL form; the tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
