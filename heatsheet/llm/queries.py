"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, jaccard, langid, lexical, licenses, mixing, quality, rollup, substrings, templates, topk, trie
from .text import word_count


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(_read(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.line_figures(_read(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load in two tokenizer versions, a revision, a deletion and a repeated load."""
    docs = _read(spark, sf_dir, "documents")
    store = rollup.Store.new(spark)

    def changes(rows: DataFrame, tokenizer: str, n: F.Column | None) -> DataFrame:
        return rows.select(
            "doc_id", F.lit(tokenizer).alias("tokenizer"), "source", "lang",
            (F.lit(0) if n is None else n).cast("long").alias("n_tokens"), F.lit(n is None).alias("deleted"),
        )

    words = changes(docs, "words", word_count(F.col("text")))
    store.commit("words", words)
    store.commit("characters", changes(docs, "characters", F.coalesce(F.length("text"), F.lit(0))))
    tables = docs.filter(F.col("text").contains("|"))
    lettered = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]*[A-Za-z][^\x20\x09-\x0D]*"))
    store.commit("words-of-tables-revised", changes(tables, "words", lettered))
    store.commit("reserved-deleted", changes(docs.filter(F.col("text").contains("All rights reserved.")), "words", None))
    store.commit("words", words)  # a repeated commit changes nothing
    return store.totals()


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.public_ranks()
    return bpe.encode(_read(spark, sf_dir, "documents"), ranks, pattern)


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        q.__name__: q
        for q in (
            op1_mixing, op2_language, op3_ngram_jaccard, op4_substrings, op5_line_templates, op6_token_rollup,
            op7_topk, op8_quality, op9_main_text, op10_byte_bpe, op11_block_max, op12_prefix_trie, op13_license_join, pipeline,
        )
    }
