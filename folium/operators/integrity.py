"""Checks of stored embeddings against the library, and of ranges in one large store."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.operators.ordered import running


def embedding_shape(embeddings: DataFrame) -> DataFrame:
    """n, dim of a model's embeddings; fails if they differ in length."""
    size = F.size("embedding")
    shape = embeddings.agg(F.count("*").alias("n"), F.min(size).alias("_low"), F.max(size).alias("dim"))
    even = F.when(F.col("_low") == F.col("dim"), F.col("dim")).otherwise(F.raise_error(F.lit("embeddings differ in length")).cast("int"))
    return shape.select("n", F.when(F.col("n") == 0, 0).otherwise(even).alias("dim"))


def model_check(library: DataFrame, embeddings: DataFrame) -> DataFrame:
    """model, docs, live, debris, missing: documents with embeddings, of them in the library and not, and
    documents of the library without."""
    stored = embeddings.select("model", "hash").distinct().join(library.select("hash", F.lit(1).alias("_held")).distinct(), "hash", "left")
    total = library.select("hash").distinct().agg(F.count("*").alias("_docs"))
    sums = stored.groupBy("model").agg(F.count("*").alias("docs"), F.count("_held").alias("live"))
    return sums.crossJoin(F.broadcast(total)).select("model", "docs", "live", (F.col("docs") - F.col("live")).alias("debris"), (F.col("_docs") - F.col("live")).alias("missing"))


def coverage(library: DataFrame, embeddings: DataFrame) -> DataFrame:
    """model, coverage: none, partial or full by documents of the library that have embeddings."""
    check = model_check(library, embeddings)
    return check.select("model", F.when(F.col("live") == 0, "none").when(F.col("missing") == 0, "full").otherwise("partial").alias("coverage"))


def compacted(ranges: DataFrame) -> DataFrame:
    """Ranges (id, start, len, deleted) that stay, moved down by what was deleted before them."""
    gone = F.when(F.col("deleted"), F.col("len")).otherwise(0)
    moved = running(ranges, ["start"], gone, "gone")
    return moved.where(~F.col("deleted")).select("id", (F.col("start") - F.coalesce("gone", F.lit(0))).alias("new_start"), "len")


def range_faults(ranges: DataFrame) -> DataFrame:
    """id, fault of ranges (id, start, len): negative, overlap with an earlier one, or gap before it."""
    reached = running(ranges, ["start", "id"], F.col("start") + F.col("len"), "reach", "max")
    reach = F.coalesce("reach", F.lit(0))
    fault = F.when((F.col("start") < 0) | (F.col("len") < 0), "negative").when(F.col("start") < reach, "overlap").when(F.col("start") > reach, "gap")
    return reached.withColumn("fault", fault).where("fault is not null").select("id", "fault")
