"""Models side by side: their stored vectors by folder, what each has of the library, timings shared by desks, bundles."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.operators import library
from folium.sources import snapshots

VECTORS = "hash string, chunk_index int, embedding array<float>, model string"


def store(chunks: DataFrame, folder: str) -> None:
    """chunks (model, hash, chunk_index, embedding) with a folder for each model; a model's folder is written anew."""
    columns = [c.split()[0] for c in VECTORS.split(", ")]
    chunks.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(folder)


def scan(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """hash, chunk_index, embedding of one model; the folders of others are not read."""
    return spark.read.schema(VECTORS).parquet(folder).where(F.col("model") == model).drop("model")


def stored_models(spark: SparkSession, folder: str) -> DataFrame:
    """model, chunks of the folders that are there."""
    return spark.read.schema(VECTORS).parquet(folder).groupBy("model").agg(F.count("*").alias("chunks"))


def rollup(models: DataFrame, chunks: DataFrame, texts: DataFrame, clean: bool = False) -> DataFrame:
    """model, enabled, selected, documents, embeddings, dim, debris, deleted, missing of models (model, enabled, selected).

    documents are those of the library (texts: hash) that the model has vectors of, debris those it has of others, which
    a clean deletes, missing what it lacks; embeddings are all its vectors. A model that is not enabled has nothing."""
    per_doc = chunks.groupBy("model", "hash").agg(F.count("*").alias("_n"), F.max(F.size("embedding")).alias("_dim"))
    live = texts.select("hash", F.lit(True).alias("_live")).distinct()
    sums = per_doc.join(live, "hash", "left").groupBy("model").agg(F.count("_live").alias("_docs"), F.sum("_n").alias("_all"), F.max("_dim").alias("_dims"), F.count_if(F.col("_live").isNull()).alias("_debris"))
    total = texts.agg(F.countDistinct("hash").alias("_total"))
    both = models.join(sums, "model", "left").crossJoin(F.broadcast(total))
    number = lambda c: F.when(F.col("enabled"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    debris = number(F.col("_debris"))
    return both.select("model", "enabled", (F.col("selected") & F.col("enabled")).alias("selected"), number(F.col("_docs")).alias("documents"), number(F.col("_all")).alias("embeddings"), number(F.col("_dims")).alias("dim"), debris.alias("debris"), (debris if clean else F.lit(0).cast("long")).alias("deleted"), number(F.col("_total") - F.coalesce("_docs", F.lit(0))).alias("missing"))


def batch_size(device: str, chunk_batch: int = 4, base: int = 1, multiplier: int = 1, indexing: bool = True) -> int:
    """Chunks that a model is given at once: more on a graphics device, many where single queries are embedded."""
    return chunk_batch * base * multiplier * ((4 if device == "cuda" else 1) if indexing else 256)


PERFORMANCE = "host string, task string, backend string, device string, timing double, unit string"
KEYS = ["host", "task", "backend", "device"]


def performance(spark: SparkSession, shared: str, local: str) -> DataFrame:
    """The records of the shared folder if there are any, else the local ones, with their place by task and timing."""
    held = [snapshots.read_all(spark, root).get("performance", spark.createDataFrame([], PERFORMANCE)) for root in (shared, local)]
    place = F.row_number().over(Window.partitionBy("task").orderBy("timing", *KEYS))
    return library.read_performance(*held).withColumn("place", place)


def sync_performance(spark: SparkSession, shared: str, local: str, new: DataFrame | None = None) -> None:
    """Writes what `performance` reads to both folders; with new records (PERFORMANCE) each timing of theirs counts for a
    fifth beside the known one."""
    records = performance(spark, shared, local).drop("place")
    if new is not None:
        now = new.select(*KEYS, F.col("timing").alias("_timing"), F.col("unit").alias("_unit"))
        timing = F.coalesce((F.col("timing") * 4 + F.col("_timing")) / 5, "_timing", "timing")
        records = records.join(now, KEYS, "full_outer").select(*KEYS, timing.alias("timing"), F.coalesce("unit", "_unit").alias("unit"))
    for root in (shared, local):
        snapshots.write(root, {"performance": records})


def bundle(texts: DataFrame, chunks: DataFrame, cloud: DataFrame, folder: str, model: str) -> None:
    """What a viewer of one model needs, in one folder: the library for all models, and below the model's name its
    points and vectors. Other models' parts stay."""
    texts.write.mode("overwrite").parquet(f"{folder}/library")
    cloud.write.mode("overwrite").json(f"{folder}/points/model={model}")
    store(chunks.where(F.col("model") == model), f"{folder}/vectors")


def bundled_models(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """model, points of a bundle's models (schema: of their points)."""
    return spark.read.schema(f"{schema}, model string").option("basePath", f"{folder}/points").json(f"{folder}/points").groupBy("model").agg(F.count("*").alias("points"))
