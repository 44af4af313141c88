"""The corpus pipeline: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from truemark.llm import line_dedup, mixing, near_dedup, packing, toxicity
from truemark.llm.common import columns, fresh, id_bucket, table, written
from truemark.llm.queries import word_tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go."""
    known = docs.where(id_bucket(F.col("doc_id"), 4) != 2)
    field = toxicity.learn(known, table(spark, sf_dir, "labels"))
    judged = docs.select(F.struct(*columns(docs)).alias("row"), "text")
    return toxicity.score(judged, field).where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 or more documents hold stay in the first of these only, however short they are.

    Documents with nothing left go; n_chars follows the text.
    """
    judged = docs.select("doc_id", "text", F.struct(*columns(docs)).alias("row"))
    left = line_dedup.dedup_lines(judged, min_docs=10, min_chars=1, keep_first=True)
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    row = F.col("row").withField("text", F.col("text")).withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(row.alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles stays: the smallest id."""
    own, row = fresh(docs, "_kept"), fresh(docs, "_row")
    kept = near_dedup.link_documents(docs, words=5, percent=80).where("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    named = docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col(own), "left_semi")
    # rows that repeat an id are one document
    one = named.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where(F.col(row) == 1).select(*columns(docs))
    return one.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy that the mix takes is a row, in training order; documents that it doesn't take go."""
    judged = docs.select("doc_id", "text", "source", F.struct(*columns(docs)).alias("row"))
    return mixing.training_stream(mixing.mix(judged), ["row"]).select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, copies included, packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Tokenizing and the learned model have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
