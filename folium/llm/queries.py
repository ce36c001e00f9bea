"""One thin query for each operator, with production parameters, over its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import bpe, hard_negatives, html_extraction, language_model, mixing, near_dedup, oracles, quality_classifier, quality_rules, sharding, suffix_arrays, suffix_trees, topk_search, whitening

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _crc(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string")) % parts


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(_crc(F.col("doc_id"), 10) == 0, F.lit(False))
    scores = language_model.learned_and_scored(docs, ~held_out).scores
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return suffix_arrays.remove_repeats(docs, window=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return suffix_trees.remove_repeats(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("_size"), mixing.quality_weight(F.col("text")).alias("_quality"))
    return mixing.mix(docs, F.col("_size"), F.col("_quality")).select("doc_id", "size", "source_size", "target", "taken")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), k=3, limit=85)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), TOKENIZER)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    docs = _documents(spark, sf_dir).select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    placed = sharding.assign(docs, [1.0] * 8, order=("text_crc32", "size"))
    return placed.withColumns({"law": F.lit("key"), "grown_shard": sharding.shard_of(F.col("doc_id"), [1.0] * 9).cast("int")})


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(topk_search.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk_search.grid(F.col("embedding")).alias("v"))
    return topk_search.search(vectors, F.col("vec_id") % 50 == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(_crc(F.col("doc_id"), 4) == 2, F.lit(False))
    model = quality_classifier.fit(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    texts = html_extraction.main_texts(pages, html_extraction.learn(pages))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(topk_search.usable(F.col("embedding")))
    rows = rows.select("vec_id", whitening.grid(F.col("embedding")).alias("x"))
    model = whitening.fit(rows, "x", fill=100_000)
    white = whitening.whiten(rows, "x", model)
    explained = F.array(*[F.lit(float(e)) for e in model.explained[:8]]).cast("array<double>")
    parts = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return parts.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.sums.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(whitening.identity_error(white, model)).alias("identity_error"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(topk_search.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), topk_search.grid(F.col("embedding")).alias("v")), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_katz_backoff, op2_suffix_arrays, op3_suffix_trees, op4_quality_rules, op5_mixing, op6_near_dedup, op7_bpe, op8_sharding, op9_topk_search, op10_quality_classifier, op11_html_extraction, op12_whitening, op13_hard_negatives]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; tests hold the others against plain Python."""
    return dict(oracles.SQL)
