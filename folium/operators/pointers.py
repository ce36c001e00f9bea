"""Vectors of a model in one numbered store: an index points to each document's stretch of rows.

index: hash, start, len; rows: row, embedding. Appended documents get their stretches behind the last row, dealt by
a running sum over stretches of the order, so no task sees all of them; a purge moves what stays down, in order."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.operators import integrity, library
from folium.operators.ordered import running

INDEX = "hash string, start long, len long"
ROWS = "row long, embedding array<float>"


class Store(NamedTuple):
    index: DataFrame
    rows: DataFrame


def empty(like: DataFrame) -> Store:
    spark = like.sparkSession
    return Store(spark.createDataFrame([], INDEX), spark.createDataFrame([], ROWS))


def hash_order(hash_: Column) -> Column:
    """A number that orders hexadecimal hashes as text does, by their first digits."""
    return F.conv(F.substring(hash_, 1, 15), 16, 10).cast("long")


def dealt(sizes: DataFrame, end: DataFrame) -> DataFrame:
    """INDEX rows of documents (hash, order, len), in the order of order and hash from end (one row, end) on."""
    placed = running(sizes, ["order", "hash"], F.col("len"), "_before")
    return placed.crossJoin(F.broadcast(end)).select("hash", (F.col("end") + F.coalesce("_before", F.lit(0))).alias("start"), "len")


def appended(store: Store, new: DataFrame, order: Column | None = None) -> Store:
    """The store with the chunks (hash, chunk_index, embedding) of documents that it does not hold. order: a number
    that documents are dealt by; else their hash."""
    todo = library.missing(new, store.index, "hash")
    number = hash_order(F.col("hash")) if order is None else order
    sizes = todo.groupBy("hash").agg(F.min(number).alias("order"), F.count("*").alias("len"))
    end = store.rows.agg((F.coalesce(F.max("row"), F.lit(-1)) + 1).alias("end"))
    ranges = dealt(sizes, end)
    rows = todo.join(ranges, "hash").select((F.col("start") + F.col("chunk_index")).alias("row"), "embedding")
    return Store(store.index.unionByName(ranges), store.rows.unionByName(rows))


def found(store: Store) -> DataFrame:
    """hash, chunk_index, embedding of all rows that the index points to: rows meet the stretch that they are in by
    the numbers that it covers."""
    covered = store.index.where("len > 0").select("hash", "start", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("row"))
    return store.rows.join(covered, "row").select("hash", (F.col("row") - F.col("start")).alias("chunk_index"), "embedding")


def purged(store: Store, texts: DataFrame) -> Store:
    """The store without documents that the library (texts: hash) does not have; what stays moves down."""
    live = texts.select("hash", F.lit(False).alias("_gone")).distinct()
    ranges = store.index.join(live, "hash", "left").select(F.col("hash").alias("id"), "start", "len", F.coalesce("_gone", F.lit(True)).alias("deleted"))
    index = integrity.compacted(ranges).select(F.col("id").alias("hash"), F.col("new_start").alias("start"), "len")
    kept = library.present(found(store), index, "hash").join(index, "hash")
    return Store(index, kept.select((F.col("start") + F.col("chunk_index")).alias("row"), "embedding"))


def checked(store: Store, texts: DataFrame) -> DataFrame:
    """One row: documents, rows, lengths (their sum), negatives, faults (overlaps and gaps), debris (documents that the
    library does not have) and missing (of the library, not in the store)."""
    live = texts.select("hash", F.lit(True).alias("_live")).distinct()
    both = store.index.join(live, "hash", "full_outer")
    sums = both.agg(F.count("len").alias("documents"), F.coalesce(F.sum("len"), F.lit(0)).alias("lengths"), F.count_if((F.col("start") < 0) | (F.col("len") < 0)).alias("negatives"), F.count_if(F.col("_live").isNull()).alias("debris"), F.count_if(F.col("len").isNull()).alias("missing"))
    faults = integrity.range_faults(store.index.select(F.col("hash").alias("id"), "start", "len")).where("fault != 'negative'").agg(F.count("*").alias("faults"))
    return sums.crossJoin(F.broadcast(store.rows.agg(F.count("*").alias("rows")))).crossJoin(F.broadcast(faults)).select("documents", "rows", "lengths", "negatives", "faults", "debris", "missing")
