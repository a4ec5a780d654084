"""The registered queries of this subpackage: thin, over whole tables, each through its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm import choices, fingerprints, leaks, lines, lm, mixing, nearcopies, prefixes, quality, repeats, tokens, toxicity, urls, whitening
from meterwise.llm.sql import SQL  # noqa: F401

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(
        table(spark, sf_dir, "documents"), choices.mix_weights(spark), choices.mix_domain(), **choices.MIX
    )
    return mixed.withColumnRenamed("id", "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = quality.judged(table(spark, sf_dir, "documents"))
    return result.selectExpr(
        "id AS doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "concat_ws(',', failed_rules) AS failed_rules"
    )


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.counted(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "n_chars"
    )


def op6_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return result.drop("kept").withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).withColumnRenamed("id", "doc_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document its path ends in: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS key", "cast(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS int) AS bad"
    )
    key = F.expr(r"try_cast(regexp_extract(path, '/([0-9]{1,18})(\\.html)?/?$', 1) AS bigint)")
    return urls.judged(table(spark, sf_dir, "pages"), labels, key).withColumnRenamed("id", "page_id")


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt first, so that they share what they begin with."""
    return prefixes.trie(*prefixes.branched(prefixes.numbered(table(spark, sf_dir, "conversations"))))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_mix": op2_mix,
    "op3_quality_rules": op3_quality_rules,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_token_counts": op5_token_counts,
    "op6_byte_repeats": op6_byte_repeats,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_near_copies": op9_near_copies,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fingerprints": op13_fingerprints,
}
