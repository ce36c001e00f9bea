"""Streams: keyed moving averages, and libraries that follow their sources batch by batch."""

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folium.operators import library
from folium.sources import snapshots
from folium.streaming import progress

#: What happened to a file: seq orders the changes of a path, deleted ones have neither hash nor text.
CHANGES = "descriptor string, source_name string, hash string, text string, seq long, deleted boolean"
NET_CHANGES = f"{CHANGES}, kind string"


class _Average(StatefulProcessor):
    """The first value, then (4 * old + new) / 5 for each one after it, in the order of each batch."""

    def __init__(self, keys: list[str], order: str, value: str):
        self.keys, self.order, self.value = keys, order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("timing", "timing double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        timing = held[0] if held else None
        for value in pd.concat(list(rows)).sort_values(self.order)[self.value]:
            timing = float(value) if timing is None else (timing * 4 + value) / 5
        self.state.update((timing,))
        yield pd.DataFrame([[*key, timing]], columns=[*self.keys, "timing"])

    def close(self) -> None:
        pass


def moving_averages(samples: DataFrame, keys: list[str], order: str, value: str, schema: str) -> DataFrame:
    """A stream of the averages of keys that changed (schema: keys and timing). Samples that come in a
    later batch count as later. The state store must be RocksDB's."""
    return samples.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Average(keys, order, value), outputStructType=schema, outputMode="Update", timeMode="None")


class _Latest(StatefulProcessor):
    """Of each path the last change and its content's hash, also of paths that are gone, so that a change that comes
    late does not bring them back. What differs from what was known goes on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", "seq long, hash string, deleted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last, held = None, self.state.get()
        for frame in rows:  # of many changes of a path one is kept
            newest = frame.loc[frame["seq"].idxmax()]
            last = newest if last is None or newest["seq"] > last["seq"] else last
        if held and held[0] >= last["seq"]:
            return
        gone = bool(last["deleted"])
        self.state.update((int(last["seq"]), "" if gone else last["hash"], gone))
        known = held[1] if held and not held[2] else None
        if known == (None if gone else last["hash"]):
            return
        kind = "removed" if gone else "added" if known is None else "changed"
        hash_, text = (None, None) if gone else (last["hash"], last["text"])
        yield pd.DataFrame([[key[0], last["source_name"], hash_, text, int(last["seq"]), gone, kind]], columns=[c.split()[0] for c in NET_CHANGES.split(", ")])

    def close(self) -> None:
        pass


def net_changes(changes: DataFrame) -> DataFrame:
    """A stream of NET_CHANGES out of one of CHANGES, in any order: at most one for each path and batch, and none
    where a path is as it was. Observed as "changes". The state store must be RocksDB's."""
    found = changes.where("descriptor is not null and seq is not null").groupBy("descriptor").transformWithStateInPandas(statefulProcessor=_Latest(), outputStructType=NET_CHANGES, outputMode="Update", timeMode="None")
    return found.observe("changes", *progress.counts(F.col("kind"), progress.STREAM))


def followed(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the changes of a library's files at path, a folder for each batch: a batch that runs again after a failure
    writes its folder anew, so nothing is there twice. `current` and `library_of` read what they come to."""
    run = zlib.crc32(checkpoint.encode())  # batches are numbered by checkpoint

    def keep(batch: DataFrame, number: int) -> None:
        batch.drop("kind").write.mode("overwrite").parquet(f"{path}/changes/run={run}/batch={number}")

    return net_changes(changes).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """The changes that no compaction has folded, with run and batch."""
    schema = f"{CHANGES}, run long, batch long"
    try:
        found = spark.read.schema(schema).option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], schema)
    if "folded" in (held := snapshots.read_all(spark, path)):
        for r in held["folded"].collect():  # a row for each checkpoint
            found = found.where((F.col("run") != r["run"]) | (F.col("batch") > r["batch"]))
    return found


def _latest(spark: SparkSession, path: str) -> DataFrame:
    """The last change of each path, removals too; texts are fetched for these alone."""
    columns = [c.split()[0] for c in CHANGES.split(", ")]
    every = _changes(spark, path).select(*columns)
    if "files" in (held := snapshots.read_all(spark, path)):
        every = every.unionByName(held["files"])
    last = every.groupBy("descriptor").agg(F.max("seq").alias("seq"))
    return every.join(last, ["descriptor", "seq"]).dropDuplicates(["descriptor"]).select(*columns)


def current(spark: SparkSession, path: str) -> DataFrame:
    """descriptor, source_name, hash, text, seq of the files that are there."""
    return _latest(spark, path).where("not deleted").drop("deleted")


def library_of(spark: SparkSession, path: str) -> DataFrame:
    """hash, source_name, descriptor, text: each content once, under the first of its paths."""
    found = current(spark, path)
    claims = library.first_claims(found.select("hash", "descriptor"), order="descriptor").where("claim = 1")
    return found.join(claims.select("descriptor"), "descriptor", "left_semi").select("hash", "source_name", "descriptor", "text")


def compacted(spark: SparkSession, path: str) -> int:
    """Folds the changes so far into a snapshot, so that reads need not go through them; its number."""
    folded = _changes(spark, path).groupBy("run").agg(F.max("batch").alias("batch"))
    if "folded" in (held := snapshots.read_all(spark, path)):
        folded = folded.unionByName(held["folded"]).groupBy("run").agg(F.max("batch").alias("batch"))
    return snapshots.write(path, {"files": _latest(spark, path), "folded": folded})
