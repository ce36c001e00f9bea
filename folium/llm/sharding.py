"""Sharding by rendezvous hashing: every record goes to the shard that its key scores highest.

A shard of weight w scores w / -ln(u), u a hash of key and shard in (0, 1). A shard that is added
takes only the records that it now scores highest, about its share of the weight; no other record moves.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each shard's slots are counted out in so many parts, so that no task orders a whole shard.
PARTS = 512


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(0x5EED), key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(float(weight)) / -F.log(u)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The index of the shard that wins the key; equal scores go to the smaller index.

    A null key is one key like any other. A shard of weight 0 wins nothing while another has more."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must hold a positive number, and none below 0")
    return -F.array_max(F.array(*[F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]))["shard"]


def assign(records: DataFrame, weights: list[float], key: str = "doc_id", order: tuple[str, ...] = ()) -> DataFrame:
    """records with shard and slot, a gapless number from 0 within the shard.

    Slots follow hashed parts of the shard, then key, then the columns in order; equal rows share
    their slots out in any way. Columns of records named shard or slot are replaced. An empty table gives an
    empty result."""
    records = records.drop("shard", "slot")
    spread = F.pmod(F.xxhash64(F.lit(0x0DD), F.col(key), *[F.col(c) for c in order]), F.lit(PARTS)).cast("int")
    placed = records.withColumn("shard", shard_of(F.col(key), weights).cast("int")).withColumn("_part", spread)
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most PARTS rows a shard, whatever the input
    firsts = placed.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_part").orderBy(F.col(key).asc_nulls_last(), *order)
    numbered = placed.withColumn("_slot", F.row_number().over(within).cast("long") - 1)
    return numbered.join(F.broadcast(firsts), ["shard", "_part"]).withColumn("slot", F.col("_first") + F.col("_slot")).drop("_part", "_first", "_slot")
