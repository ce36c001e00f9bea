import math
import random

import pytest

from folium.operators import library


def _folded(values):
    held = None
    for v in values:
        held = v if held is None or v is None else (held * 4 + v) / 5
    return held


def test_a_key_of_many_stretches_with_nulls_and_ties(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(3000), rng.choice([None] + [rng.uniform(-9, 9)] * 400)) for _ in range(6000)]
    rows += [("one", 1, 5.0), ("none", 1, None), ("last", 1, 2.0), ("last", 2, None), ("high", 0, math.inf)] + [("high", i, 1.0) for i in range(1, 5000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, at long, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        averages = library.moving_average(frame, ["key"], "at", "v")
        got = {r["key"]: r["timing"] for r in averages.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in {r[0] for r in rows}:
        own = sorted((at, v is not None, v or 0.0) for k, at, v in rows if k == key)
        want = _folded([v if there else None for _, there, v in own])
        assert got[key] == (want if want is None else pytest.approx(want)), key


def test_rows_of_a_key_are_not_gathered_in_one_row(spark):
    # 40,000 rows of one key; what is gathered by key is a row for each task
    frame = spark.range(40_000).selectExpr("'k' as key", "id as at", "cast(id % 7 as double) as v")
    plan = library.moving_average(frame, ["key"], "at", "v")
    assert plan.first()["timing"] == pytest.approx(_folded([float(i % 7) for i in range(40_000)]))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("collect_list") < text.index("MapInArrow") < text.index("RepartitionByExpression")


def test_averages_are_those_of_one_fold_to_the_last_bit(spark):
    rng = random.Random(3)
    rows = [("long", i, rng.choice([0.1, 7.3, rng.uniform(-1, 1)])) for i in range(30_000)] + [("same", i, 0.3) for i in range(30_000)] + [("zero", i, float(i < 9)) for i in range(9000)]
    rows += [(f"k{i % 700}", i, round(rng.uniform(0, 100), 2)) for i in range(30_000)] + [("null", i, None if i == 5000 else rng.random()) for i in range(12_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        frame = spark.createDataFrame(rows, "key string, at long, v double").repartition(5)
        got = {r["key"]: r["timing"] for r in library.moving_average(frame, ["key"], "at", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.shuffle.partitions")
    by_key = {}
    for key, _, v in rows:
        by_key.setdefault(key, []).append(v)
    assert got == {key: _folded(values) for key, values in by_key.items()}
