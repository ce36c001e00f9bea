"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, u a hash of its id in (0, 1) and w its quality weight;
the smallest keys are a weighted sample without replacement. Within each source the documents stand
in the order of their keys, and sums over that order meet the source's budget: complete epochs first,
then the leading documents of one more epoch.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A source's order is cut into so many stretches of keys, so that no task orders a whole source.
STRETCHES = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.1 for a text without letters and spaces to 1 for one of nothing else."""
    total = F.octet_length(text)
    odd = total - F.octet_length(F.translate(text, "#*$%&|<>{}[]\\^~=_@0123456789", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 4 * odd / F.nullif(total, F.lit(0))), F.lit(0.1))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """One row for each source: source, source_size, target.

    Sources in the order of their code points, null last, weigh as weights say, repeating. All sizes
    together are shared out by weight; a target stops at most times its source's size, and the excess
    goes to the others by weight until none is above. With ratios most * size / weight in rising order,
    the sources that stop are the first k, where k is the least with level(k) <= the next ratio."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a table of one row for each source from here on
    ranked = sums.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rising = Window.orderBy("_ratio", "_rank")
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / rest
    levels = ranked.withColumn("_level", level)
    # the level of the first source that does not stop; there is one as most >= 1
    chosen = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everything)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(chosen, F.lit(float("inf"))) * F.col("_w"))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, quality: Column, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, copies and taken = copies * size, all of one row.

    A source takes all its documents floor(target / source_size) times and, for the rest, the leading
    documents in key order; the document that crosses the rest is taken if that comes nearer to it.
    Documents without words are taken once for each complete epoch and add nothing. The result depends
    on the rows alone: the same rows give the same mix. A null source is a source of its own; null ids are one id
    like any other, and rows that repeat stand side by side. Columns of docs that are named as those given here are
    replaced. An empty table gives an empty mix."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = docs.withColumns({"_size": size, "_w": quality}).drop("size", "source_size", "target", "copies", "taken").withColumnRenamed("_size", "size")
    keyed = keyed.withColumn("_key", -F.log(u) / F.greatest(F.col("_w"), F.lit(1e-6))).drop("_w")
    keyed = keyed.withColumn("_part", F.floor((1 - F.exp(-F.col("_key") * 0.8)) * STRETCHES).cast("int"))
    small = keyed.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = small.withColumn("_start", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    targets = source_targets(small.select("source", F.col("_sum").alias("size")), weights, most)
    # (source, stretch) rows: at most STRETCHES for each source
    plan = starts.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_sum")
    plan = plan.withColumn("_epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    plan = plan.withColumnsRenamed({"source": "_s", "_part": "_p"})
    row = Window.partitionBy("source", "_part").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size")
    ordered = keyed.withColumn("_before", F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = ordered.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    before = F.col("_start") + F.col("_before")
    # nearer with it than without: the middle of the document lies within the rest
    leading = (F.col("size") > 0) & (before + F.col("size") / 2 <= F.col("_rest"))
    copies = F.col("_epochs") + F.when(leading & (F.col("_epochs") < int(most)), 1).otherwise(0)
    out = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("_key", "_part", "_before", "_start", "_epochs", "_rest", "_s", "_p")
