"""Connected components of a table of links, by large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.storage import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a > b. Large: every neighbour larger than a node is tied to the
    least of the node and its neighbours. Small: the node and its smaller neighbours are tied to the least."""
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = ways.join(least, "a")
    if large:
        tied = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        own = least.select("a", F.col("least").alias("b"))
        tied = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own)
    return tied.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that can be reached) of every node that has a link to another.

    The steps end when they change nothing, after a number of rounds that grows with the logarithm of
    the nodes. Each round is a written table; the driver sees its count and checksum alone. Links with
    a null end, and of a node with itself, count for nothing."""
    pair = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = written(pair.distinct(), "links")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = mark(edges)
    while before[0]:
        edges = written(_star(_star(edges, large=True), large=False), "links")
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
