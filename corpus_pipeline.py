"""A training-data pipeline over ``documents``: stages that each read what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.llm import line_dedup, minhash, packing, quality, toxicity
from cohortlab.session import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below 0.3; learned from the labelled documents among ``docs``.

    Null and empty texts score by the bias alone, rows of one doc_id each by their own text; without labels all documents stay.
    """
    weights = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), weights).filter("score < 0.3").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null, empty and short texts go; equal rows share their fate."""
    return quality.survivors(quality.judge(docs.select(*COLUMNS))).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three of them hold (the largest doc_id keeps its own). A null text becomes an empty one; equal rows are documents of their own."""
    out = line_dedup.dedup(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of similarity 0.8 on five-word shingles; texts without words stay.

    Rows of one doc_id are one document; those without a doc_id stay.
    """
    gone = minhash.near_duplicates(docs, size=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti")  # one plan at every size


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: the place of every piece. A null or empty text is one token; every row is packed, repeated ones too."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", quality_rules), ("line_dedup", drop_lines), ("near_dedup", near_dedup), ("packing", best_fit)]

#: Learned scores, sketches and packing have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
