"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All stages but the last
return the columns of documents. `run` applies them one after another, each on a written copy of what the one before
it kept. Columns beside those of documents pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gausslake.llm import decontaminate, packing, paragraphs, quality, simhash
from gausslake.llm.common import checkpointed, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, learned from the labels of rows not held out, does not reject.

    Null and empty texts have the score of the share of good labels; equal rows have equal scores.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=docs.columns, names=("__score", "__predicted"))
    return scored.where("__predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike in their five-word shingles (similarity 0.8 and more): that of the smallest id,
    null ids last. Null, empty and blank texts are one group; of equal rows one stays.
    """
    return simhash.deduplicate(docs).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the paragraphs and passages that stand in an earlier place, too; n_chars follows; a row left blank goes.

    The place that stays is that of the smallest id (null ids last), then the first. Null texts stay null, texts that
    were blank before stay; equal rows are treated alike.
    """
    cut = paragraphs.remove_repeats(docs, count="__removed")
    cut = cut.where((F.col("__removed") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    sized = F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", sized).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark item stands, exactly or with few edits. Null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes in sequences of 1024 to 8192 words. Null and empty texts take one place each."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, fingerprints, MinHash, embeddings or packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents under `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
