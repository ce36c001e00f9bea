"""Running values over a whole table in one order, without bringing the table to one task.

The order is cut at some quantiles of its leading column; each stretch runs by itself, from what the
stretches before it come to."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCHES = 256


def _cut(rows: DataFrame, by: str) -> DataFrame:
    """rows with the number of their stretch, _part; equal values of by are of one stretch."""
    bounds = rows.agg(F.percentile_approx(by, [i / STRETCHES for i in range(1, STRETCHES)], 10_000)).first()[0] or []
    marks = F.array(*[F.lit(b) for b in dict.fromkeys(bounds)]) if bounds else F.array().cast("array<double>")
    return rows.withColumn("_part", F.size(F.filter(marks, lambda b: b < F.col(by))))


def running(rows: DataFrame, by: list[str], value: Column, name: str, how: str = "sum") -> DataFrame:
    """rows with the sum or max of value over all rows before each, in the order of by; null before the first."""
    fold = {"sum": F.sum, "max": F.max}[how]
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest}[how]
    cut = _cut(rows, by[0]).withColumn("_value", value)
    before = lambda w: fold("_whole").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # a row for each stretch
    starts = cut.groupBy("_part").agg(fold("_value").alias("_whole")).select("_part", before(Window.orderBy("_part")).alias("_start"))
    within = fold("_value").over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    joined = cut.withColumn("_within", within).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, both(F.col("_start"), F.col("_within"))).drop("_part", "_value", "_within", "_start")
