"""The sample tables seen as a document library, its chunk embeddings, and a timeline."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import chronology, text

#: The same views in SQL.
LIBRARY_SQL = "library AS (SELECT sha256(text) AS hash, source AS source_name, '{' || source || '}/' || lang || '/' || doc_id || '.md' AS descriptor, text, doc_id AS ord, lang FROM documents)"
CHUNKS_SQL = "chunks AS (SELECT vec_id // 5 AS doc, vec_id % 5 AS chunk_index, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)"
SCORES_SQL = CHUNKS_SQL + ", q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0), scores AS (SELECT doc, chunk_index, list_dot_product(embedding, v) AS cosine FROM chunks, q)"
EVENTS_SQL = "tl AS (SELECT event_id, epoch_us(ts)::DOUBLE / 86400000000.0 + 2440587.5 AS jd_start, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts)::DOUBLE / 86400000000.0 + 2440587.5 + value / 24 END AS jd_end, event_type || '/' || user_id AS context, event_type, user_id FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, source_name, descriptor, text, ord, lang: every document as a note of its source."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".md"))
    return docs.select(F.sha2("text", 256).alias("hash"), F.col("source").alias("source_name"), text.descriptor(F.col("source"), path).alias("descriptor"), "text", F.col("doc_id").alias("ord"), "lang")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, chunk_index, embedding: five vectors a document."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 5).alias("doc"), (F.col("vec_id") % 5).alias("chunk_index"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with vec_id 0, one row."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, jd_start, jd_end (of every third), context, eventdata and metadata as arrays of (k, v)."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 86400000000.0 + chronology.UNIX_EPOCH
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    context = F.concat_ws("/", "event_type", "user_id")
    return e.select(
        "event_id",
        start.alias("jd_start"),
        F.when(F.col("event_id") % 3 == 0, start + F.col("value") / 24).alias("jd_end"),
        context.alias("context"),
        F.array(pair("kind", F.col("event_type")), pair("user", F.col("user_id"))).alias("eventdata"),
        F.array(pair("context", context)).alias("metadata"),
    )
