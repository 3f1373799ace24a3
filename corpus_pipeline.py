"""A corpus from raw documents to tokens, in stages that read what the stage before wrote.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatsheet.llm import bpe, jaccard, mixing, quality, templates
from heatsheet.scratch import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; ``n_chars`` follows the text."""
    from pyspark.sql import functions as F

    lines = templates.drop_templates(docs)
    if "n_chars" not in docs.columns:
        return lines
    kind = docs.schema["n_chars"].dataType
    return lines.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks, pattern = bpe.public_ranks()
    return bpe.encode(docs, ranks, pattern)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Balanced sampling and byte-level BPE cannot be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
