import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folium.operators import library
from folium.streaming import incremental, progress


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_averages_over_batches(spark, tmp_path):
    rows = [("a", i, float(i * i % 7)) for i in range(12)] + [("b", i, float(i)) for i in range(5)]
    source = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, "task string, n long, t double")
    frame.where("n < 4").coalesce(1).write.mode("append").parquet(source)
    frame.where("n >= 4").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = incremental.moving_averages(stream, ["task"], "n", "t", "task string, timing double")
    query = out.writeStream.outputMode("update").format("memory").queryName("averages").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r["task"]: r["timing"] for r in spark.sql("SELECT * FROM averages").collect()}
    want = {r["task"]: r["timing"] for r in library.moving_average(frame, ["task"], "n", "t").collect()}
    assert last.keys() == want.keys()
    assert all(abs(last[k] - want[k]) < 1e-9 for k in want)


def change(name, text, seq):
    return (name, "s", None if text is None else hashlib.sha256(text.encode()).hexdigest(), text, seq, text is None)


def feed(spark, tmp_path, changes):
    spark.createDataFrame(changes, incremental.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def follow(spark, tmp_path, state="state"):
    stream = spark.readStream.schema(incremental.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.followed(stream, f"file://{tmp_path}/library", str(tmp_path / state)).awaitTermination()


def held(spark, tmp_path):
    rows = incremental.library_of(spark, f"file://{tmp_path}/library").collect()
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["hash"] for r in rows)
    return {r["hash"]: r["descriptor"] for r in rows}


def wanted(files):
    out = {}
    for name in sorted(files):
        out.setdefault(hashlib.sha256(files[name].encode()).hexdigest(), name)
    return out


def test_500_random_edits_by_stream_are_the_batch_library(spark, tmp_path):
    """Files that come, change, take another's content and go, with a restart, a compaction and a batch that runs twice."""
    rng, files, seq, watcher = random.Random(9), {}, 0, progress.Progress()
    spark.streams.addListener(watcher)
    try:
        for part in range(2):
            for _ in range(3):
                changes = []
                for _ in range(83 + part):
                    name, what = f"f{rng.randrange(50):02}", rng.choice(["write", "write", "delete", "same"])
                    seq += 1
                    if what == "delete":
                        files.pop(name, None)
                    elif what == "write":
                        files[name] = f"text {rng.randrange(30)}"
                    changes.append(change(name, files.get(name), seq))
                rng.shuffle(changes)
                feed(spark, tmp_path, changes)
            follow(spark, tmp_path)  # the second time from where the first ended
            assert held(spark, tmp_path) == wanted(files)
            if part == 0:
                incremental.compacted(spark, f"file://{tmp_path}/library")
                assert held(spark, tmp_path) == wanted(files)
        follow(spark, tmp_path)  # nothing new
        follow(spark, tmp_path, "other state")  # all of it once more, from the beginning
        assert held(spark, tmp_path) == wanted(files)
        incremental.compacted(spark, f"file://{tmp_path}/library")
        assert held(spark, tmp_path) == wanted(files) and incremental._changes(spark, f"file://{tmp_path}/library").count() == 0
    finally:
        spark.streams.removeListener(watcher)
    sums = watcher.sums["changes"]
    assert sums["added"] - sums["removed"] == 2 * len(files) and sums["changed"] > 0  # by either checkpoint


def test_late_and_repeated_changes(spark, tmp_path):
    feed(spark, tmp_path, [change("a", "x", 5), change("b", "x", 6), (None, "s", "h", "t", 1, False)])
    follow(spark, tmp_path)
    feed(spark, tmp_path, [change("a", None, 7), change("a", None, 7), change("b", "x", 6)])
    follow(spark, tmp_path)
    feed(spark, tmp_path, [change("a", "late", 6), change("c", None, 9)])
    follow(spark, tmp_path)
    assert list(held(spark, tmp_path).values()) == ["b"]
    assert incremental.current(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_a_batch_is_counted_as_it_passes(spark):
    files = spark.createDataFrame([("h1", "a", 1), ("h1", "b", 2), ("h2", "c", 3)], "hash string, descriptor string, ord int")
    there = spark.createDataFrame([("h2", "c"), ("h3", "d")], "hash string, descriptor string")
    rows, seen = progress.watched(library.sync_actions(files, there))
    assert rows.where(F.col("action") == "insert").count() == 1
    assert seen.get == {"insert": 1, "duplicate": 1, "unchanged": 1, "debris": 1}
