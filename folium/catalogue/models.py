"""Queries over several models: roll-ups, scans by model, timings of two desks, bundles, samples."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import library, models, vectors
from folium.plans.samples import CHUNKS_SQL, LIBRARY_SQL, chunks, library as notes, table
from folium.sources import snapshots


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two models: documents of the library, and some that are gone."""
    all_ = chunks(spark, sf_dir)
    held = notes(spark, sf_dir).select(F.col("ord").alias("doc"), "hash")
    of = lambda name, rows, hash_: rows.select(F.lit(name).alias("model"), hash_.alias("hash"), F.col("chunk_index").cast("int").alias("chunk_index"), "embedding")
    there = all_.join(held, "doc")
    gone = F.sha2(F.concat(F.lit("gone"), F.col("doc").cast("string")), 256)
    return of("a", there.where("doc % 7 != 0"), F.col("hash")).unionByName(of("a", all_.where("doc % 5 = 0"), gone)).unionByName(of("b", there, F.col("hash"))).unionByName(of("c", there, F.col("hash")))


_MODELS_SQL = f"""{LIBRARY_SQL}, {CHUNKS_SQL}, there AS (SELECT c.doc, c.chunk_index, c.embedding, l.hash FROM chunks c JOIN library l ON c.doc = l.ord),
v AS (SELECT 'a' AS model, hash, chunk_index, embedding FROM there WHERE doc % 7 != 0 UNION ALL SELECT 'a', sha256('gone' || doc), chunk_index, embedding FROM chunks WHERE doc % 5 = 0 UNION ALL SELECT 'b', hash, chunk_index, embedding FROM there UNION ALL SELECT 'c', hash, chunk_index, embedding FROM there)"""


def model_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with and without vectors, one not enabled, checked and cleaned."""
    listed = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True), ("d", True, False)], "model string, enabled boolean, selected boolean")
    held, texts = _chunks(spark, sf_dir), notes(spark, sf_dir)
    return models.rollup(listed, held, texts).withColumn("clean", F.lit(False)).unionByName(models.rollup(listed, held, texts, clean=True).withColumn("clean", F.lit(True)))


_ROLLUP_SQL = f"""WITH {_MODELS_SQL}, h AS (SELECT DISTINCT hash FROM library), d AS (SELECT model, v.hash, count(*) AS n, max(len(embedding)) AS dim, bool_or(h.hash IS NOT NULL) AS live FROM v LEFT JOIN h ON v.hash = h.hash GROUP BY ALL),
s AS (SELECT model, count(*) FILTER (live) AS docs, sum(n) AS n, max(dim) AS dim, count(*) FILTER (NOT live) AS debris FROM d GROUP BY model),
m AS (SELECT * FROM (VALUES ('a', true, true), ('b', true, false), ('c', false, true), ('d', true, false)) t(model, enabled, selected))
SELECT model, enabled, selected AND enabled AS selected, CASE WHEN enabled THEN coalesce(docs, 0) ELSE 0 END::BIGINT AS documents, CASE WHEN enabled THEN coalesce(n, 0) ELSE 0 END::BIGINT AS embeddings, CASE WHEN enabled THEN coalesce(dim, 0) ELSE 0 END::BIGINT AS dim, CASE WHEN enabled THEN coalesce(debris, 0) ELSE 0 END::BIGINT AS debris,
CASE WHEN enabled AND clean THEN coalesce(debris, 0) ELSE 0 END::BIGINT AS deleted, CASE WHEN enabled THEN (SELECT count(*) FROM h) - coalesce(docs, 0) ELSE 0 END::BIGINT AS missing, clean FROM m LEFT JOIN s USING (model), (SELECT unnest([false, true]) AS clean)"""


def model_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model's vectors out of a store with a folder for each."""
    folder = f"{snapshots.work_folder(spark)}/vectors"
    models.store(_chunks(spark, sf_dir), folder)
    return models.scan(spark, folder, "a").select("hash", F.col("chunk_index").cast("long").alias("chunk_index"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def _records(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == rest)
    made = library.moving_average(rows, ["event_type", "user_id"], "event_id", "value")
    return made.select(F.concat(F.lit("h"), "user_id").alias("host"), F.col("event_type").alias("task"), F.lit("cpu").alias("backend"), F.lit("x").alias("device"), "timing", F.lit("s").alias("unit"))


def perf_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two desks: the local records go to the shared folder when that has none; then others come in, and both are alike."""
    shared, local = snapshots.work_folder(spark), snapshots.work_folder(spark)
    snapshots.write(local, {"performance": _records(spark, sf_dir, 0)})
    models.sync_performance(spark, shared, local)
    models.sync_performance(spark, shared, local, _records(spark, sf_dir, 1).where("task != 'view'"))
    both = [models.performance(spark, *roots).withColumn("side", F.lit(i)) for i, roots in enumerate(((shared, local), (local, shared)))]
    return both[0].unionByName(both[1]).select("side", "host", "task", F.round("timing", 6).alias("timing"), F.col("place").cast("long").alias("place"))


_PERF_SQL = """WITH r AS (SELECT event_type AS task, 'h' || user_id AS host, event_id % 2 AS rest, list_reduce(list(value ORDER BY event_id), lambda a, v: (a * 4 + v) / 5) AS timing FROM events GROUP BY ALL),
b AS (SELECT coalesce(x.task, y.task) AS task, coalesce(x.host, y.host) AS host, CASE WHEN x.task IS NULL THEN y.timing WHEN y.task IS NULL THEN x.timing ELSE (x.timing * 4 + y.timing) / 5 END AS timing FROM (SELECT * FROM r WHERE rest = 0) x FULL JOIN (SELECT * FROM r WHERE rest = 1 AND task != 'view') y ON x.task = y.task AND x.host = y.host)
SELECT side, host, task, round(timing, 6) AS timing, row_number() OVER (PARTITION BY side, task ORDER BY timing, host) AS place FROM b, (SELECT unnest([0, 1]) AS side)"""


def visual_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of two models in one folder, read back: the library's size, each model's points and vectors."""
    folder, held, texts = snapshots.work_folder(spark), _chunks(spark, sf_dir), notes(spark, sf_dir)
    for name in ("a", "b"):
        points = held.where(F.col("model") == name).select("hash", "chunk_index", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])
        models.bundle(texts.select("hash", "descriptor"), held, vectors.normalised_cloud(points), folder, name)
    shown = models.bundled_models(spark, folder, "hash string, chunk_index int, x double, y double, z double")
    total = spark.read.parquet(f"{folder}/library").agg(F.count("*").alias("texts"))
    return shown.join(models.stored_models(spark, f"{folder}/vectors"), "model").crossJoin(F.broadcast(total))


QUERIES = {
    "model_rollup": (model_rollup, _ROLLUP_SQL),
    "model_scan": (model_scan, f"WITH {_MODELS_SQL} SELECT hash, chunk_index, round(embedding[1], 6) AS first FROM v WHERE model = 'a'"),
    "perf_sync": (perf_sync, _PERF_SQL),
    "visual_bundle": (visual_bundle, f"WITH {_MODELS_SQL} SELECT model, count(*) AS points, count(*) AS chunks, (SELECT count(*) FROM documents) AS texts FROM v WHERE model != 'c' GROUP BY model"),
}
