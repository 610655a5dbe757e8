"""A corpus from raw documents to token ids, in stages that each read what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontamination, jaccard_join, line_dedup, sentencepiece_codec, toxicity
from tidelog.session import staged, table

#: SQL cannot fit the ordinal regression of the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text."""
    kept = line_dedup.without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(kept.schema["n_chars"].dataType))


def _digest() -> Column:
    """Half a SHA-256 of the text (null as empty); with doc_id it names a row, and rows it cannot tell apart get equal verdicts."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), 1, 32))


def _without(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose doc_id (null too) and digest are in ``rows``, a frame of their structs ``row``."""
    # Written, so that Spark knows its size before it shuffles the documents for the join.
    gone = staged(rows.select(F.col("row.doc_id").alias("__gone"), F.col("row.digest").alias("__digest")).distinct(), name)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")) & _digest().eqNullSafe(F.col("__digest")), "left_anti")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, of one id that with the smallest digest.

    Documents without an id link nothing and stay; of rows with equal doc_id and text one stays. Rows of
    one id and different texts are documents of their own: each stays or goes with its own group.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", _digest().alias("digest")))
    found = jaccard_join.near_duplicates(docs.select(row.alias("row"), "text"), id_col="row").where("doc_id IS NOT NULL")
    kept = _without(docs, found.where("component_id <> doc_id").select(F.col("doc_id").alias("row")), "copies")
    twice = found.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("doc_id.doc_id").alias("__twice")).distinct()
    if twice.isEmpty():
        return kept
    again = F.col("doc_id") == F.col("__twice")
    return kept.join(twice, again, "left_anti").unionByName(kept.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; each row by its own text, whatever shares its doc_id."""
    rows = docs.select(F.struct("doc_id", _digest().alias("digest")).alias("row"), "text")
    found = decontamination.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="row")
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("row")), "contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their digests."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
