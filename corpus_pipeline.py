"""The corpus pipeline: five stages, each one of the text operators.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage as Parquet in
the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavox.llm.classifier import score, train
from stratavox.llm.common import table, written
from stratavox.llm.minhash import near_duplicates
from stratavox.llm.packing import pack
from stratavox.llm.quality_rules import quality_rules
from stratavox.llm.substring import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; the texts stay."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    judged = quality_rules(docs, keep=["text", "lang", "source", "n_chars"]).filter("kept")
    # a document without failing lines keeps its text byte for byte
    text = F.when(F.col("n_failed_lines") > 0, F.col("clean_text")).otherwise(F.col("text"))
    return judged.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates, one of least id; rows without an id stay.

    Ids may repeat, so rows are told apart by a number of their own.
    """
    # written once, so the numbers are fixed whatever executors are lost
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    known = rows.filter("doc_id is not null")
    groups = near_duplicates(known, id_col="row").select("row", "component_id")
    least = known.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    kept = known.join(least.select("least.row"), "row")
    return kept.select(*COLUMNS).unionByName(rows.filter("doc_id is null").select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; words of repeated windows are gone from the texts that have any."""
    found = substring_dedup(docs, keep=["text", "lang", "source"])
    text = F.when(F.col("n_removed") > 0, F.col("clean_text")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 tokens."""
    return pack(docs)


STAGES = [("quality_classifier", classify), ("quality_rules", clean), ("minhash_dedup", near), ("substring_dedup", substrings), ("packing", packing)]

#: The classifier, the tokenizer and the linear program can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
