"""Queries over the library: worklists, debris, inventories, syncs, caches."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import integrity, library
from folium.plans.samples import LIBRARY_SQL, library as notes, table

#: Two models' embeddings in SQL: one lacks every seventh document and has some that are gone, one is whole.
_EMB_SQL = "emb AS (SELECT 'a' AS model, hash FROM library WHERE ord % 7 != 0 UNION ALL SELECT 'a', sha256('gone' || ord) FROM library WHERE ord % 50 = 0 UNION ALL SELECT 'b', hash FROM library UNION ALL SELECT 'c', sha256('gone' || ord) FROM library WHERE ord % 50 = 0)"


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = notes(spark, sf_dir)
    gone = held.where("ord % 50 = 0").select(F.sha2(F.concat(F.lit("gone"), "ord"), 256).alias("hash"))
    of = lambda model, rows: rows.select(F.lit(model).alias("model"), "hash")
    return of("a", held.where("ord % 7 != 0")).unionByName(of("a", gone)).unionByName(of("b", held)).unionByName(of("c", gone))


def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.missing(notes(spark, sf_dir), _embedded(spark, sf_dir).where("model = 'a'"), "hash").select("hash", "descriptor")


def debris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.missing(_embedded(spark, sf_dir), notes(spark, sf_dir), "hash").select("model", "hash")


def model_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.model_check(notes(spark, sf_dir), _embedded(spark, sf_dir))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.coverage(notes(spark, sf_dir), _embedded(spark, sf_dir))


def embedding_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.embedding_shape(table(spark, sf_dir, "embeddings")).select("n", F.col("dim").cast("long").alias("dim"))


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = notes(spark, sf_dir)
    own = held.where("ord % 3 = 0").select("descriptor", F.concat(F.lit("t"), "ord").alias("title"))
    folder = held.where("lang != 'fr'").select(F.regexp_extract("descriptor", "^(.*)/[^/]*$", 1).alias("descriptor")).distinct().withColumn("title", F.concat(F.lit("folder "), "descriptor"))
    return library.with_metadata(held.select("descriptor"), own.unionByName(folder), "title")


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    file = lambda shift, size: d.select(F.concat("lang", F.lit("/"), F.col("doc_id") + shift).alias("rel_path"), size.alias("size"), (F.col("doc_id") % 10).alias("modified"))
    local = file(0, F.col("doc_id") % 4)
    target = d.where("doc_id % 9 != 0").select(F.concat("lang", F.lit("/"), F.when(F.col("doc_id") % 8 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))).alias("rel_path"), F.when(F.col("doc_id") % 5 == 0, 9).otherwise(F.col("doc_id") % 4).alias("size"), F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("doc_id") % 10).alias("modified"))
    return library.reconcile(local, target)


_RECONCILE_SQL = """WITH a AS (SELECT lang || '/' || doc_id AS p, doc_id % 4 AS s, doc_id % 10 AS m FROM documents),
b AS (SELECT lang || '/' || CASE WHEN doc_id % 8 = 0 THEN -doc_id - 1 ELSE doc_id END AS p, CASE WHEN doc_id % 5 = 0 THEN 9 ELSE doc_id % 4 END AS s, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id % 10 END AS m FROM documents WHERE doc_id % 9 != 0)
SELECT coalesce(a.p, b.p) AS rel_path, CASE WHEN b.p IS NULL THEN 'copy' WHEN a.p IS NULL THEN 'delete' WHEN a.s != b.s OR a.m > b.m THEN 'update' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.p = b.p"""


def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = library.moving_average(table(spark, sf_dir, "events"), ["event_type", "user_id"], "event_id", "value")
    return out.select("event_type", "user_id", F.round("timing", 6).alias("timing"))


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = notes(spark, sf_dir)
    return held.where("ord % 6 != 0"), library.first_claims(held.where("ord % 4 != 0")).where("claim = 1").drop("claim")


_SYNC_SQL = f"WITH {LIBRARY_SQL}, files AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ord) AS claim FROM library WHERE ord % 6 != 0), held AS (SELECT * FROM library WHERE ord % 4 != 0 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ord) = 1)"


def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.sync_actions(*_files(spark, sf_dir))


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.synced(*_files(spark, sf_dir)).select("hash", "descriptor", F.length("text").cast("long").alias("n"))


def metadata_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = notes(spark, sf_dir)
    was = held.where("ord % 4 != 0").select("descriptor", F.when(F.col("ord") % 3 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return library.metadata_actions(held.where("ord % 6 != 0").select("descriptor", "hash"), was)


def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    local, remote = F.col("n_nationkey") % 4, F.col("n_nationkey") % 3
    return n.select(F.col("n_nationkey").cast("long").alias("id"), library.update_required(local, remote).alias("required"))


def cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = notes(spark, sf_dir)
    cache = held.select(F.when(F.col("ord") % 10 == 0, "gone").otherwise(F.col("hash")).alias("hash"), (F.col("ord") % 7 == 0).alias("previous_failure"))
    return library.cache_report(cache, held)


def pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("pdf", "txt", "epub", "pdf", "md")]), (c % 5 + 1).cast("int"))
    files = d.select(F.col("lang").alias("dir"), F.floor(F.col("doc_id") / 3).cast("string").alias("base"), ext(F.col("doc_id")).alias("ext"), "doc_id")
    return library.without_shadowed_pdfs(files).select("doc_id")


def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, o = notes(spark, sf_dir), F.col("ord")
    some: "dict[str, Column]" = {"title": F.when(o % 2 == 0, F.col("lang")), "creation_date": F.when(o % 3 == 0, F.lit("2020")), "creation": F.when(o % 5 == 0, F.lit("2019")), "publication_date": F.lit(None).cast("string"), "pubdate": F.when(o % 4 == 0, F.lit("1999")), "context": F.when(o % 7 == 0, F.lit("own")), "uuid": F.when(o % 11 == 0, F.lit("u"))}
    return library.normalised_metadata(held.select("descriptor", "hash", *[c.alias(n) for n, c in some.items()]))


QUERIES = {
    "index_worklist": (worklist, f"WITH {LIBRARY_SQL}, {_EMB_SQL} SELECT hash, descriptor FROM library WHERE hash NOT IN (SELECT hash FROM emb WHERE model = 'a')"),
    "index_debris": (debris, f"WITH {LIBRARY_SQL}, {_EMB_SQL} SELECT model, hash FROM emb WHERE hash NOT IN (SELECT hash FROM library)"),
    "model_check": (model_check, f"WITH {LIBRARY_SQL}, {_EMB_SQL}, e AS (SELECT DISTINCT model, hash FROM emb), l AS (SELECT DISTINCT hash FROM library) SELECT model, count(*) AS docs, count(l.hash) AS live, count(*) - count(l.hash) AS debris, (SELECT count(*) FROM l) - count(l.hash) AS missing FROM e LEFT JOIN l USING (hash) GROUP BY model"),
    "model_coverage": (coverage, f"WITH {LIBRARY_SQL}, {_EMB_SQL}, e AS (SELECT DISTINCT model, hash FROM emb), l AS (SELECT DISTINCT hash FROM library) SELECT model, CASE WHEN count(l.hash) = 0 THEN 'none' WHEN count(l.hash) = (SELECT count(*) FROM l) THEN 'full' ELSE 'partial' END AS coverage FROM e LEFT JOIN l USING (hash) GROUP BY model"),
    "embedding_shape": (embedding_shape, "SELECT count(*) AS n, max(len(embedding)) AS dim FROM embeddings"),
    "metadata_fallback": (fallback, f"WITH {LIBRARY_SQL} SELECT descriptor, CASE WHEN ord % 3 = 0 THEN 't' || ord WHEN lang != 'fr' THEN 'folder {{' || source_name || '}}/' || lang END AS title FROM library"),
    "file_reconcile": (reconcile, _RECONCILE_SQL),
    "perf_ema": (ema, "SELECT event_type, user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, v: (a * 4 + v) / 5), 6) AS timing FROM events GROUP BY ALL"),
    "sync_actions": (sync_actions, f"{_SYNC_SQL} SELECT coalesce(f.hash, h.hash) AS hash, coalesce(f.descriptor, h.descriptor) AS descriptor, CASE WHEN f.hash IS NULL THEN 'debris' WHEN f.claim > 1 THEN 'duplicate' WHEN h.hash IS NULL THEN 'insert' ELSE 'unchanged' END AS action FROM files f FULL JOIN held h ON f.hash = h.hash"),
    "sync_library": (synced, f"{_SYNC_SQL} SELECT hash, descriptor, length(text) AS n FROM held WHERE hash IN (SELECT hash FROM files) UNION ALL SELECT hash, descriptor, length(text) FROM files WHERE claim = 1 AND hash NOT IN (SELECT hash FROM held)"),
    "metadata_actions": (metadata_actions, f"WITH {LIBRARY_SQL} SELECT descriptor, CASE WHEN ord % 6 = 0 THEN 'orphan' WHEN ord % 4 = 0 THEN 'new' WHEN ord % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS action FROM library WHERE ord % 6 != 0 OR ord % 4 != 0"),
    "version_gate": (version_gate, "SELECT n_nationkey::BIGINT AS id, n_nationkey % 3 > n_nationkey % 4 OR n_nationkey % 3 = 0 AS required FROM nation"),
    "cache_report": (cache_report, "SELECT count(*) AS entries, count(*) FILTER (doc_id % 7 = 0) AS failures, count(*) FILTER (doc_id % 10 = 0) AS orphans FROM documents"),
    "shadowed_pdfs": (pdfs, "WITH f AS (SELECT doc_id, lang, doc_id // 3 AS base, ['pdf', 'txt', 'epub', 'pdf', 'md'][doc_id % 5 + 1] AS ext FROM documents) SELECT doc_id FROM f WHERE ext != 'pdf' OR NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = f.lang AND g.base = f.base AND g.ext IN ('txt', 'md'))"),
    "metadata_normalise": (normalise, f"WITH {LIBRARY_SQL} SELECT descriptor, CASE WHEN ord % 2 = 0 THEN lang ELSE '' END AS title, CASE WHEN ord % 3 = 0 THEN '2020' WHEN ord % 5 = 0 THEN '2019' ELSE '' END AS creation_date, CASE WHEN ord % 4 = 0 THEN '1999' ELSE '' END AS publication_date, CASE WHEN ord % 7 = 0 THEN 'own' ELSE lang END AS context, CASE WHEN ord % 11 = 0 THEN 'u' ELSE hash[1:8] || '-' || hash[9:12] || '-' || hash[13:16] || '-' || hash[17:20] || '-' || hash[21:32] END AS uuid FROM library"),
}
