"""Vector operators: search by chunks and documents, significance curves, point clouds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.chronology import once
from folium.operators.embedding import Embedder, windows_embedded
from folium.operators.ordered import running

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scored(chunks: DataFrame, query: list[float]) -> DataFrame:
    """chunks (doc, chunk_index, embedding) with their cosine to a query; vectors have length 1."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    return chunks.withColumn("cosine", dot(F.col("embedding"), vector))


def best_chunks(scores: DataFrame) -> DataFrame:
    """doc, cosine, chunk_index of each document's best chunk, the first one of equals."""
    best = F.max(F.struct("cosine", (-F.col("chunk_index")).alias("back"))).alias("best")
    return scores.groupBy("doc").agg(best).select("doc", F.col("best.cosine").alias("cosine"), (-F.col("best.back")).alias("chunk_index"))


def ranked(documents: DataFrame, k: int) -> DataFrame:
    """The k best documents with rank from 1, equals in the order of doc."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    top = documents.orderBy(F.desc("cosine"), "doc").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "doc")))


def gated(documents: DataFrame, k: int) -> DataFrame:
    """As ranked, among the document of the least doc and those better than it."""
    first = documents.agg(F.min_by("cosine", "doc").alias("_bar"), F.min("doc").alias("_first"))
    return ranked(documents.crossJoin(F.broadcast(first)).where((F.col("cosine") > F.col("_bar")) | (F.col("doc") == F.col("_first"))).drop("_bar", "_first"), k)


def merged_chunks(scores: DataFrame, k: int) -> DataFrame:
    """doc, first_chunk, n_chunks, cosine: of the 2k best chunks, neighbours become one; the k best of them."""
    hits = scores.orderBy(F.desc("cosine"), "doc", "chunk_index").limit(2 * k)
    island = F.col("chunk_index") - F.row_number().over(Window.partitionBy("doc").orderBy("chunk_index"))
    spans = hits.withColumn("_island", island).groupBy("doc", "_island").agg(F.min("chunk_index").alias("first_chunk"), F.count("*").alias("n_chunks"), F.max("cosine").alias("cosine"))
    return spans.drop("_island").orderBy(F.desc("cosine"), "doc", "first_chunk").limit(k)


#: Characters of a text, at least, whose windows are cut out of one block.
WINDOW_BLOCK = 2048


def context_windows(text: Column, length: int = 32, steps: int = 16) -> Column:
    """Stretches of a text, one every steps characters, each length wide and moved in at the ends.

    The text is cut into blocks in one go, and a window out of a block and its neighbours' edges: a place in the
    whole text would have to be looked for from its start, window by window."""
    half = length // 2
    size = steps * -(-max(WINDOW_BLOCK, length + 1) // steps)

    def window(i: Column, b: Column) -> Column:
        start = F.greatest(i - half, F.lit(0))
        end = F.least(i + half + length % 2, b["n"])
        wide = F.when((start == 0) & (end < b["n"]), F.least(F.lit(length), b["n"])).otherwise(end)
        begin = F.when((end == b["n"]) & (start > 0), F.greatest(b["n"] - length, F.lit(0))).otherwise(start)
        return F.substring(b["text"], begin - b["low"] + 1, wide - begin)

    def blocks(whole: Column) -> Column:
        parts, n = whole["parts"], whole["n"]

        def block(part: Column, k: Column) -> Column:
            before = F.coalesce(F.right(F.get(parts, k - 1), F.lit(length)), F.lit(""))
            behind = F.coalesce(F.left(F.get(parts, k + 1), F.lit(length + 1)), F.lit(""))
            low = F.when(k > 0, k * size - length).otherwise(0)
            places = F.sequence(k * size, F.least((k + 1) * size, n) - 1, F.lit(steps))
            return once(F.struct(F.concat(before, part, behind).alias("text"), low.alias("low"), n.alias("n")), lambda b: F.transform(places, lambda i: window(i, b)))

        return F.flatten(F.transform(parts, block))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    n = F.length(text)
    return F.when(n > 0, once(F.struct(parts.alias("parts"), n.alias("n")), blocks)).otherwise(F.array(text))


def significance(cosines: Column, cutoff: float = 0.0) -> Column:
    """Cosines scaled to 0..1 between the least (1 at most) and the greatest (0 at least), bent by an
    exponential, and 0 below the cutoff; as they are where all are equal."""
    low, high = F.least(F.lit(1.0), F.array_min(cosines)), F.greatest(F.lit(0.0), F.array_max(cosines))

    def curve(bounds: Column) -> Column:
        low, high = bounds["low"], bounds["high"]

        def bent(c: Column) -> Column:
            value = (F.exp((c - low) / (high - low)) - 1) / (F.exp(F.lit(1.0)) - 1)
            return F.when(value < cutoff, 0.0).otherwise(value)

        return F.when(high - low > 0, F.transform(cosines, bent)).otherwise(cosines)

    return once(F.struct(low.alias("low"), high.alias("high")), curve)


def flat_significance(cosines: Column) -> Column:
    """Cosines scaled to 0..1; where all are equal, 1 if they are above 0, else 0."""
    low, high = F.array_min(cosines), F.array_max(cosines)
    return F.transform(cosines, lambda c: F.when(high > low, (c - low) / (high - low)).otherwise(F.when(c > 0, 1.0).otherwise(0.0)))


def spread_significance(steps_values: Column, n: Column, cosine: Column, steps: int = 16, dampening: float = 1.4) -> Column:
    """One value for each of n characters: that of its step, times the hit's cosine over the dampening."""
    damp = dampening or 1.0
    at = lambda values: lambda i: F.get(values, F.floor(i / steps).cast("int")) * cosine / damp
    spread = once(steps_values, lambda values: F.transform(F.sequence(F.lit(0), n - 1), at(values)))
    return F.when(n > 0, spread).otherwise(F.array().cast("array<double>"))


def highlighted(hits: DataFrame, query: list[float], embed: Embedder, length: int = 32, steps: int = 16, cutoff: float = 0.3, dampening: float = 1.4) -> DataFrame:
    """hits (key, text, cosine) with steps (the significance of each window) and marks (that of each character).

    The windows of a hit's text are embedded and compared with the query; the curve of their cosines is bent, cut
    off and spread over the characters, weighted by the hit's own cosine."""
    windows = hits.select("key", context_windows(F.col("text"), length, steps).alias("windows"))
    vector = F.array(*[F.lit(float(x)) for x in query])
    curves = windows_embedded(windows, embed).select("key", F.transform("vectors", lambda v: dot(v, vector)).alias("_cosines"))
    both = hits.join(curves, "key").withColumn("steps", significance(F.col("_cosines"), cutoff)).drop("_cosines")
    return both.withColumn("marks", spread_significance(F.col("steps"), F.length("text"), F.col("cosine"), steps, dampening))


def first_points(points: DataFrame, n: int, *order: str) -> DataFrame:
    return points.orderBy(*order).limit(n)


def sampled_points(points: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n points without repetition, the same ones for a seed, in the order of their ids."""
    return points.orderBy(F.md5(F.concat_ws("-", F.lit(seed), *ids)), *ids).limit(n).orderBy(*ids)


def with_points(hits: DataFrame, cloud: DataFrame) -> DataFrame:
    """hits (doc, chunk_index, ...) with x, y, z of their chunk's point; nulls where the cloud has none."""
    return hits.join(cloud.select("doc", "chunk_index", "x", "y", "z"), ["doc", "chunk_index"], "left")


def normalised_cloud(points: DataFrame, side: float = 10.0) -> DataFrame:
    """Points (x, y, z) moved and scaled, alike on all axes, into a cube of that side around 0."""
    axes = ["x", "y", "z"]
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))])
    reach = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in axes])
    box = box.withColumn("reach", F.when(reach > 0, reach).otherwise(1.0))
    moved = {c: (F.col(c) - (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2) / F.col("reach") * side for c in axes}
    return points.crossJoin(F.broadcast(box)).withColumns(moved).select(*points.columns)


def shades(chunks: DataFrame) -> DataFrame:
    """chunks with lightness, from 0.6 for a document's first chunk to 0.3 for its last."""
    most = F.max("chunk_index").over(Window.partitionBy("doc"))
    return chunks.withColumn("lightness", F.when(most > 0, 0.6 - F.col("chunk_index") / most * 0.3).otherwise(0.5))


def document_hues(chunks: DataFrame) -> DataFrame:
    """doc, hue: the place of each document in their order, over their number."""
    docs = chunks.select("doc").distinct()
    total = docs.agg(F.count("*").alias("_n"))
    placed = running(docs, ["doc"], F.lit(1), "_i")
    return placed.crossJoin(F.broadcast(total)).select("doc", (F.coalesce("_i", F.lit(0)) / F.col("_n")).alias("hue"))


def projected(chunks: DataFrame, axes: int = 3) -> DataFrame:
    """doc, chunk_index, x, y, z by principal components (their signs are free)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = chunks.select("doc", "chunk_index", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=axes, inputCol="v", outputCol="p").fit(rows)
    p = vector_to_array("p")
    return model.transform(rows).select("doc", "chunk_index", *[p[i].alias(n) for i, n in enumerate("xyz"[:axes])])
