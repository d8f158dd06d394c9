"""A corpus pipeline of five stages; each reads what its predecessor wrote.

All but the last return the columns of `documents`; rows that a stage drops are
gone for the later ones, and what it changes in a text is what they see.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.mixing import mixed
from tidewire.llm.pieces import digests
from tidewire.llm.quality_rules import judged
from tidewire.llm.shared import counted, shared_folder, written
from tidewire.llm.simhash import similar_classes
from tidewire.llm.substring_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECES = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the base limits or the learned decision list reject, each by its own text; null ids are judged too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected, _ = counted(judged(docs, labels).where("not kept").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct())
    own = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("key"))
    return docs.select(COLUMNS).join(rejected, own, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of texts whose five-word shingle sets are 0.8 similar or more.

    The one with the smallest id stays (of several texts under that id the one
    with the smallest hash, of repeated rows the smallest one). Rows with a
    null id stay.
    """
    classes = written(similar_classes(docs, shingle=5, similarity=0.8).where("doc_id is not null"))
    key = ["doc_id", "text_key"]
    rows = docs.select(COLUMNS).withColumn("text_key", F.xxhash64(F.col("text").cast("string")))
    others, _ = counted(classes.where("not first").select(key).distinct())
    kept = rows.join(others, key, "left_anti")
    again, repeats = counted(classes.where("first").groupBy(key).count().where("count > 1").select(key))
    if not repeats:
        return kept.select(COLUMNS)
    one = kept.join(again, key, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return kept.join(again, key, "left_anti").select(COLUMNS).union(one.select("doc_id", "row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of 50 words or more that a document with a smaller id has; a text that loses all its words goes."""
    left = without_repeats(docs, length=50).where("n_removed > 0")
    # Equal texts of one id are cut alike, so one row for each is enough.
    cut = left.select("doc_id", "text_key", F.struct("text", "n_words", "n_removed").alias("cut")).dropDuplicates(["doc_id", "text_key"])
    rows = docs.select(COLUMNS).withColumn("text_key", F.xxhash64(F.col("text").cast("string"))).join(cut, ["doc_id", "text_key"], "left")
    rest = rows.where("cut is null or cut.n_removed < cut.n_words")
    changed = F.col("cut").isNotNull()
    return rest.withColumn("n_chars", F.when(changed, F.length("cut.text")).otherwise(F.col("n_chars")).cast("long")).withColumn(
        "text", F.when(changed, F.col("cut.text")).otherwise(F.col("text"))
    ).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders all documents so that sources hold their target weights (roots of their sizes) within one block.

    The files, in the order of their names, hold the rows in that order.
    """
    out = mixed(docs.select(COLUMNS))
    return out.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, what they decode to and their spans, as digests, with the place in the mixed order where docs come from files."""
    places = {"mix_part": F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"), "mix_row": F.col("_metadata.row_index")}
    try:
        docs = docs.select("doc_id", "text", *(c.alias(n) for n, c in places.items()))
    except AnalysisException:  # docs don't come from files
        docs = docs.select("doc_id", "text", F.lit(None).cast("int").alias("mix_part"), F.lit(None).cast("long").alias("mix_row"))
    return digests(docs, public_tokenizers.path(PIECES), keep=("mix_part", "mix_row"), spans=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources", mixing),
    ("SentencePiece", pieces),
]

#: Learned rules, SimHash candidates and SentencePiece have no SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_folder(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
