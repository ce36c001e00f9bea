"""Queries over chunk embeddings: searches, significance, point clouds."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text
from folium.operators import integrity, vectors
from folium.plans.samples import CHUNKS_SQL, SCORES_SQL, chunks, query_vector, table

K = 8
_BEST_SQL = SCORES_SQL + ", best AS (SELECT doc, cosine, chunk_index FROM scores QUALIFY row_number() OVER (PARTITION BY doc ORDER BY cosine DESC, chunk_index) = 1)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.scored(chunks(spark, sf_dir), query_vector(spark, sf_dir))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("rank").cast("long").alias("rank"), "doc", "chunk_index", F.round("cosine", 6).alias("cosine"))


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(vectors.ranked(vectors.best_chunks(_scores(spark, sf_dir)), K))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(vectors.gated(vectors.best_chunks(_scores(spark, sf_dir)), K))


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents with the chunk that was hit, widened to sentences and cleaned: texts are read for the hits alone."""
    hits = vectors.ranked(vectors.best_chunks(_scores(spark, sf_dir)), K)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    chunk = text.clean_text(text.sentence_chunk(F.col("text"), F.col("chunk_index"), 300, 100))
    return docs.join(F.broadcast(hits), "doc").select(F.col("rank").cast("long").alias("rank"), "doc", F.round("cosine", 6).alias("cosine"), F.md5(chunk).alias("chunk_md5"))


def _search_sql() -> str:
    from folium.catalogue.texts import QUERIES as TEXTS

    inner = TEXTS["sentence_chunk"][1]
    inner = inner.replace("SELECT doc_id, text, doc_id % 5 AS i,", "SELECT doc_id, text, chunk_index AS i, rank, cosine,").replace("FROM documents)", "FROM documents JOIN hits ON doc_id = doc)", 1)
    inner = inner.replace("SELECT doc_id, md5(", "SELECT rank, doc_id AS doc, round(cosine, 6) AS cosine, md5(regexp_replace(").replace(") AS chunk FROM f", ", '[\\n\\r\\t ]+', ' ', 'g')) AS chunk_md5 FROM f")
    return f"WITH {_BEST_SQL}, hits AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, doc) AS rank FROM best QUALIFY rank <= {K}), " + inner.removeprefix("WITH ")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.merged_chunks(_scores(spark, sf_dir), K)
    return out.select("doc", "first_chunk", "n_chunks", F.round("cosine", 6).alias("cosine"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "cosine"))).alias("c")).select("doc", F.transform("c", lambda x: x["cosine"]).alias("cosines"))


def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _curve(spark, sf_dir).select("doc", F.posexplode(vectors.significance(F.col("cosines"), 0.3)).alias("i", "v"))
    return out.select("doc", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _curve(spark, sf_dir).select("doc", F.posexplode(vectors.flat_significance(F.col("cosines"))).alias("i", "v"))
    return out.select("doc", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = vectors.spread_significance(F.col("cosines"), F.size("cosines") * 16 - 3, F.lit(0.7))
    out = _curve(spark, sf_dir).select("doc", F.posexplode(values).alias("i", "v"))
    return out.groupBy("doc").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


def _windows(docs: DataFrame, text: Column) -> DataFrame:
    out = docs.select("doc_id", F.posexplode(vectors.context_windows(text)).alias("i", "w"))
    return out.select("doc_id", F.col("i").cast("long").alias("i"), F.md5("w").alias("w_md5"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(table(spark, sf_dir, "documents"), F.col("text"))


_WINDOW_SQL = """WITH t AS (SELECT doc_id, text AS t FROM documents), w AS (SELECT doc_id, t, length(t) AS n, j AS k, j * 16 AS i FROM t, LATERAL (SELECT unnest(generate_series(0, (length(t) - 1) // 16)) AS j)),
a AS (SELECT *, greatest(i - 16, 0) AS s, least(i + 16, n) AS e FROM w), b AS (SELECT *, CASE WHEN e = n AND s > 0 THEN greatest(n - 32, 0) ELSE s END AS lo, CASE WHEN s = 0 AND e < n THEN least(32, n) ELSE e END AS hi FROM a)
SELECT doc_id, k AS i, md5(t[lo + 1 : hi]) AS w_md5 FROM b"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return chunks(spark, sf_dir).select("doc", "chunk_index", at(0).alias("x"), (at(1) * 2).alias("y"), at(2).alias("z"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.normalised_cloud(_points(spark, sf_dir)).select("doc", "chunk_index", *[F.round(c, 6).alias(c) for c in "xyz"])


def shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.shades(chunks(spark, sf_dir)).select("doc", "chunk_index", F.round("lightness", 6).alias("lightness"))


def hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.document_hues(chunks(spark, sf_dir)).select("doc", F.round("hue", 6).alias("hue"))


def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.projected(chunks(spark, sf_dir))


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return integrity.compacted(d.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 10).alias("start"), (F.col("doc_id") % 10).alias("len"), (F.col("doc_id") % 3 == 0).alias("deleted")))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return integrity.range_faults(d.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 10 + F.col("doc_id") % 3).alias("start"), (8 + F.col("doc_id") % 5).alias("len")))


_SHADE_SQL = f"WITH {CHUNKS_SQL}, c AS (SELECT doc, chunk_index, max(chunk_index) OVER (PARTITION BY doc) AS most FROM chunks) SELECT doc, chunk_index, round(CASE WHEN most > 0 THEN 0.6::DOUBLE - chunk_index::DOUBLE / most * 0.3::DOUBLE ELSE 0.5 END, 6) AS lightness FROM c"

QUERIES = {
    "semantic_topk": (topk, f"WITH {_BEST_SQL} SELECT row_number() OVER (ORDER BY cosine DESC, doc) AS rank, doc, chunk_index, round(cosine, 6) AS cosine FROM best QUALIFY rank <= {K}"),
    "semantic_topk_gated": (gated, f"WITH {_BEST_SQL} SELECT row_number() OVER (ORDER BY cosine DESC, doc) AS rank, doc, chunk_index, round(cosine, 6) AS cosine FROM best WHERE doc = 0 OR cosine > (SELECT cosine FROM best WHERE doc = 0) QUALIFY rank <= {K}"),
    "semantic_search": (semantic_search, _search_sql()),
    "chunk_topk_merge": (merged, f"WITH {SCORES_SQL}, h AS (SELECT * FROM scores ORDER BY cosine DESC, doc, chunk_index LIMIT {2 * K}), g AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY doc ORDER BY chunk_index) AS island FROM h), m AS (SELECT doc, min(chunk_index) AS first_chunk, count(*) AS n_chunks, max(cosine) AS c FROM g GROUP BY doc, island) SELECT doc, first_chunk, n_chunks, round(c, 6) AS cosine FROM m ORDER BY c DESC, doc, first_chunk LIMIT {K}"),
    "significance_curve": (significance, f"WITH {SCORES_SQL}, r AS (SELECT doc, chunk_index AS i, cosine, least(1.0, min(cosine) OVER (PARTITION BY doc)) AS lo, greatest(0.0, max(cosine) OVER (PARTITION BY doc)) AS hi FROM scores), v AS (SELECT doc, i, CASE WHEN hi > lo THEN (exp((cosine - lo) / (hi - lo)) - 1) / (exp(1.0) - 1) ELSE cosine END AS v, hi > lo AS bent FROM r) SELECT doc, i, round(CASE WHEN bent AND v < 0.3 THEN 0.0 ELSE v END, 6) AS v FROM v"),
    "significance_flat": (flat, f"WITH {SCORES_SQL}, r AS (SELECT doc, chunk_index AS i, cosine, min(cosine) OVER (PARTITION BY doc) AS lo, max(cosine) OVER (PARTITION BY doc) AS hi FROM scores) SELECT doc, i, round(CASE WHEN hi > lo THEN (cosine - lo) / (hi - lo) WHEN cosine > 0 THEN 1.0 ELSE 0.0 END, 6) AS v FROM r"),
    "significance_spread": (spread, f"WITH {SCORES_SQL}, m AS (SELECT doc, max(chunk_index) AS last FROM scores GROUP BY doc), v AS (SELECT doc, cosine * 0.7::DOUBLE / 1.4::DOUBLE AS v, CASE WHEN chunk_index = last THEN 13 ELSE 16 END AS times FROM scores JOIN m USING (doc)) SELECT doc, sum(times)::BIGINT AS n, round(sum(v * times), 6) AS total FROM v GROUP BY doc"),
    "context_windows": (windows, _WINDOW_SQL),
    "cloud_normalise": (cloud, f"WITH {CHUNKS_SQL}, p AS (SELECT doc, chunk_index, embedding[1] AS x, embedding[2] * 2 AS y, embedding[3] AS z FROM chunks), b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS b_y, min(z) AS az, max(z) AS bz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS reach FROM p) SELECT doc, chunk_index, round((x - (ax + bx) / 2) / reach * 10, 6) AS x, round((y - (ay + b_y) / 2) / reach * 10, 6) AS y, round((z - (az + bz) / 2) / reach * 10, 6) AS z FROM p, b"),
    "doc_shade": (shades, _SHADE_SQL),
    "doc_hue": (hues, f"WITH {CHUNKS_SQL}, d AS (SELECT DISTINCT doc FROM chunks) SELECT doc, round((row_number() OVER (ORDER BY doc) - 1)::DOUBLE / count(*) OVER (), 6) AS hue FROM d"),
    "pca_cloud": (pca, None),
    "pointer_compaction": (compaction, "WITH r AS (SELECT doc_id AS id, doc_id * 10 AS start, doc_id % 10 AS len, doc_id % 3 = 0 AS deleted FROM documents), c AS (SELECT *, coalesce(sum(CASE WHEN deleted THEN len ELSE 0 END) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM r) SELECT id, (start - gone)::BIGINT AS new_start, len FROM c WHERE NOT deleted"),
    "pointer_gaps": (gaps, "WITH r AS (SELECT doc_id AS id, doc_id * 10 + doc_id % 3 AS start, 8 + doc_id % 5 AS len FROM documents), c AS (SELECT *, coalesce(max(start + len) OVER (ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM r) SELECT id, CASE WHEN start < reach THEN 'overlap' ELSE 'gap' END AS fault FROM c WHERE start != reach"),
}
