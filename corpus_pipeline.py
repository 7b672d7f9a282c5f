"""A corpus cleaned in stages, each written as Parquet and read again by the next.

Every stage works on all that the one before kept; rows it drops are gone and
texts it changes stay changed. All but the last return the columns of the
documents, the last the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.llm.decontam import keep_clean
from proxima.llm.langid import keep_identified
from proxima.llm.lines import drop_boilerplate
from proxima.llm.pieces import encode
from proxima.llm.simhash import keep_one
from proxima.session import stage_table


#: Lines on more than this share of a source's documents are boilerplate. Menus and footers often
#: belong to one section of a source, so the share is set for a source of some tens of sections.
BOILERPLATE_RATIO = 0.02


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the rest (no letters at all) go."""
    return keep_identified(docs)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a large share of a source's documents hold are dropped; every document stays."""
    clean = drop_boilerplate(docs, docs["source"], "text", BOILERPLATE_RATIO)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by items of the benchmark."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's best segmentation, and how far the second best falls short."""
    found = docs.select("doc_id", "source", "lang", encode(docs, F.col("text"), n=2).alias("best"))
    first, second = (F.get("best", F.lit(k)) for k in (0, 1))
    return found.select(
        "doc_id", "source", "lang", F.size(first["ids"]).alias("n_pieces"), first["score"].alias("score"),
        (first["score"] - second["score"]).alias("margin"), first["ids"].alias("piece_ids"))


STAGES = [
    ("language ID", language),
    ("line dedup", boilerplate),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", pieces),
]

#: Hashed n-gram scores, bit-majority fingerprints and lattices are not SQL's to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), "stage")
    return docs
