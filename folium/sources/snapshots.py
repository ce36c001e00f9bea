"""Snapshots of a library's tables: written whole, then pointed to; published to a shared folder and fetched from it.

A table's snapshot is a folder of its own. A version is one file, root/versions/<number>.json, that points to the
folders of its tables; it is created exclusively once they are whole, so of two writers one gets the number and the
other sees it. A reader sees the last whole version whatever a writer does. A file that a writer left empty is none."""

import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import notes_sync
from folium.operators.library import present, synced, update_required

VERSION = "version long, tables array<struct<name string, path string>>"
#: How long a writer that lost a number waits for the other's file to be whole, and how often it starts anew.
WAIT_SECONDS, MOST_TRIES = 5.0, 20


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; on one machine without it, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return "file://" + tempfile.mkdtemp(prefix="folium-")
    return f"{shared.rstrip('/')}/folium-{uuid.uuid4().hex}"


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file that is not there yet; False where another writer was first. On a local or mounted folder the
    system's exclusive creation decides, on other stores theirs."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(unquote(url.path)), exist_ok=True)
        try:
            with open(unquote(url.path), "x") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def versions(spark: SparkSession, root: str) -> dict[int, dict[str, str]]:
    """The folders of the tables of each whole version, by number: a line for each version."""
    try:
        found = spark.read.schema(VERSION).json(f"{root}/versions").where("version is not null and tables is not null").collect()
    except AnalysisException:  # nothing is written there yet
        return {}
    return {r["version"]: {t["name"]: t["path"] for t in r["tables"]} for r in sorted(found)}


def version(spark: SparkSession, root: str) -> int:
    """The number of the last snapshot; 0 without one."""
    return max(versions(spark, root), default=0)


def written(root: str, tables: dict[str, DataFrame]) -> list[dict[str, str]]:
    """Writes tables to folders of their own; where they are."""
    places = []
    for name, table in tables.items():
        places.append({"name": name, "path": f"{root}/{name}-{uuid.uuid4().hex}"})
        table.write.parquet(places[-1]["path"])
    return places


def committed(spark: SparkSession, root: str, places: list[dict[str, str]], number: int) -> bool:
    """Makes tables that are whole the version of a number; False if the number is taken."""
    return created(spark, f"{root}/versions/{number:012}.json", json.dumps({"version": number, "tables": places}) + "\n")


def write(root: str, tables: dict[str, DataFrame], number: int | None = None) -> int:
    """Writes tables as the next snapshot (or that of a number, which must be free); its number. Other writers'
    versions stay as they are and count as earlier or later ones."""
    spark = next(iter(tables.values())).sparkSession
    places = written(root, tables)
    if number is not None:
        if not committed(spark, root, places, number):
            raise ValueError(f"version {number} of {root} is there already")
        return number
    number = version(spark, root) + 1
    while not committed(spark, root, places, number):
        number += 1
    return number


def updated(spark: SparkSession, root: str, change: Callable[[int], dict[str, DataFrame]]) -> int:
    """Writes what change makes of the last version, given its number, as the next one; its number.

    Where another writer takes that number meanwhile, its version is waited for and change starts anew from it,
    so neither writer's work is lost."""
    for _ in range(MOST_TRIES):
        last = version(spark, root)
        places, number = written(root, change(last)), last + 1
        while not committed(spark, root, places, number):
            until = time.monotonic() + WAIT_SECONDS
            while version(spark, root) < number and time.monotonic() < until:
                time.sleep(0.05)
            if version(spark, root) > last:
                break
            number += 1  # a writer that died had taken it
        else:
            return number
    raise RuntimeError(f"{root} kept changing: {MOST_TRIES} tries")


def read_all(spark: SparkSession, root: str, wanted: list[str] | None = None, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of some names, or all there are, each in the last snapshot that has it, or the last up to a number."""
    places: dict[str, str] = {}
    for n, tables in versions(spark, root).items():
        if number is None or n <= number:
            places |= tables
    for name in wanted or []:
        if name not in places:
            raise ValueError(f"no snapshot of {name} in {root}")
    return {name: spark.read.parquet(places[name]) for name in (sorted(places) if wanted is None else wanted)}


def read(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """The table of a name in the last snapshot that has it, or the last up to a number."""
    return read_all(spark, root, [name], number)[name]


def names(spark: SparkSession, root: str) -> list[str]:
    return sorted({name for tables in versions(spark, root).values() for name in tables})


def publish(spark: SparkSession, local: str, shared: str) -> bool:
    """Copies the last local snapshot to the shared folder, unless that is as new; whether it did."""
    number = version(spark, local)
    if not number or version(spark, shared) >= number:
        return False
    return committed(spark, shared, written(shared, read_all(spark, local, number=number)), number)


def fetch(spark: SparkSession, shared: str, local: str) -> bool:
    """Copies the shared snapshot to the local folder if the gate of versions asks for it; whether it did."""
    number = version(spark, shared)
    gate = spark.range(1).select(update_required(F.lit(version(spark, local)), F.lit(number))).first()[0]
    if not gate or not number:
        return False
    return committed(spark, local, written(local, read_all(spark, shared, number=number)), number)


def sync(spark: SparkSession, root: str, files: DataFrame) -> int:
    """The snapshot of a library after its files are synced with it."""

    def change(last: int) -> dict[str, DataFrame]:
        held = read_all(spark, root, number=last).get("texts", files.limit(0))
        return {"texts": synced(files, held)}

    return updated(spark, root, change)


def load_json(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The entries of JSON lines that fit the schema and have a key, and the lines that do not."""
    raw = spark.read.schema(f"{schema}, _line string").option("columnNameOfCorruptRecord", "_line").json(path)
    # Spark tells a bad line by the columns that a query reads, so all are read
    every = F.xxhash64(*[c for c in raw.columns if c != "_line"]) >= -(1 << 63)
    good = every & F.col("_line").isNull() & F.col(key).isNotNull()
    return raw.where(good).drop("_line"), raw.where(~good)


def only_in(entries: DataFrame, library: DataFrame, on: str = "hash") -> DataFrame:
    """Entries of a cache or an index whose text is in the library: what a clean keeps."""
    return present(entries, library, on)


def held_notes(spark: SparkSession, root: str, number: int | None = None) -> notes_sync.Notes:
    """The notes of the last snapshot that has them, or the last up to a number."""
    return notes_sync.Notes(**read_all(spark, root, list(notes_sync.Notes._fields), number))


def sync_notes(spark: SparkSession, root: str, files: DataFrame, actions: bool = False) -> int:
    """The snapshot of the notes of files (descriptor, hash, text) after a sync; notes that are as they were are not
    parsed again. With actions, what became of each note that was not is a table of the snapshot, too."""

    def keep(table: DataFrame) -> DataFrame:
        path = f"{root}/delta-{uuid.uuid4().hex}"
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    def change(last: int) -> dict[str, DataFrame]:
        held = held_notes(spark, root, last) if "notes" in read_all(spark, root, number=last) else notes_sync.nothing(files)
        changes = keep(notes_sync.touched(files, held))
        made = notes_sync.synced(files, held, keep, changes)._asdict()
        return made | ({"actions": changes} if actions else {})

    return updated(spark, root, change)
