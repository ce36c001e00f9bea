"""Documents to training tokens: quality rules, near duplicates, repeated passages, mixing, encoding.

Every stage takes (spark, docs, folder of the tables) and gives a DataFrame, the columns of documents but
for the last; further columns are dropped, so their names cannot clash. Rows without doc_id and rows that
repeat one are told apart by a number of their own; for passages alone, rows of one doc_id and text count
as one document, and rows without doc_id come last. Null and empty texts go in the first stage; given to
a later one they are linked with nothing, have no passages, size 0 and no ids. Of an empty table every
stage makes an empty one.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import bpe, mixing, near_dedup, quality_rules, suffix_trees
from folium.llm.storage import written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words that a passage must share with an earlier one to be removed.
PASSAGE_WORDS = 50


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row_id: the doc_id if all have one of their own, else a number in their order."""
    docs = docs.select(*COLUMNS)
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        return docs.withColumn("row_id", F.col("doc_id"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return written(ordered.withColumn("row_id", F.monotonically_increasing_id()), "numbered-rows")


def _by_row(docs: DataFrame) -> DataFrame:
    return docs.drop("doc_id").withColumnRenamed("row_id", "doc_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; null and empty texts go, as they have no words."""
    docs = _numbered(docs)
    kept = quality_rules.judge(_by_row(docs)).where("kept").select(F.col("doc_id").alias("row_id"))
    return docs.join(kept, "row_id", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of the least doc_id; a row that repeats another goes too."""
    docs = _numbered(docs)
    kept = near_dedup.near_duplicates(_by_row(docs), k=5, limit=80).where("kept").select(F.col("doc_id").alias("row_id"))
    return docs.join(kept, "row_id", "left_semi").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier place too, with their lines and gaps as they
    are. A document of which nothing is left goes."""
    cut = suffix_trees.remove_repeats(docs.select(*COLUMNS), window=PASSAGE_WORDS, layout=True)
    left = cut.where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = _numbered(docs)
    text = F.col("text")
    sized = docs.select(F.col("row_id").alias("doc_id"), "source", mixing.word_count(text).alias("_size"), mixing.quality_weight(text).alias("_quality"))
    taken = mixing.mix(sized, F.col("_size"), F.col("_quality")).where("copies > 0").select(F.col("doc_id").alias("row_id"), "copies")
    return docs.join(taken, "row_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes of the ids and of the decoded text, and the ids."""
    return bpe.encode(docs, TOKENIZER, with_ids=True)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("substring dedup", passages), ("mixing", mix), ("encoding", encode)]

#: Perplexity bands, MinHash and BPE are beyond SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
