"""Files as data sources of Spark: a reader that lists, prunes and packs files, and a sink of one file for each row.

Both go through pyarrow's file systems, so a root is a folder that all machines see or a bucket. `register` makes
them known to a session by the names folium and folium_files."""

import posixpath
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from folium.operators import library
from folium.sources.files import SKIPPED

FILES = "descriptor string, source_name string, path string, extension string, length long, modified timestamp, content binary"
#: Bytes of a partition, about, and of a batch of contents.
PARTITION_BYTES, BATCH_BYTES = 128 << 20, 16 << 20


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root or file, and its path in it. Options of the system may follow as ?name=value."""
    if "://" not in root:
        return fs.LocalFileSystem(), root.removeprefix("file:").rstrip("/")
    place, mark, options = root.partition("?") if re.search(r"\?\w+=", root) else (root, "", "")
    system, path = fs.FileSystem.from_uri(quote(place, safe="/:@") + mark + options)
    return system, path.rstrip("/")


@dataclass(frozen=True)
class File:
    """path is below the root and starts with a stroke."""

    path: str
    length: int
    modified: int

    @property
    def extension(self) -> str:
        return posixpath.splitext(self.path)[1].removeprefix(".")


def listed(root: str, extensions: list[str] | None, hidden: bool = False) -> list[File]:
    """The files below a root that a scan takes: no skipped folder on the way, one of the extensions (any without
    them), no lock file of an editor unless hidden ones are wanted. Skipped folders are not entered."""
    system, top = opened(root)
    todo, found = [top], []
    while todo:
        for info in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
            if info.base_name in SKIPPED:
                continue
            if info.type == fs.FileType.Directory:
                todo.append(info.path)
            elif info.type == fs.FileType.File and (hidden or not info.base_name.startswith(".#")):
                stamp = info.mtime
                one = File(info.path[len(top) :], info.size, int(stamp.timestamp() * 1e6) if stamp else 0)
                if extensions is None or one.extension.lower() in extensions:
                    found.append(one)
    return sorted(found, key=lambda f: f.path)


@dataclass
class _Packed(InputPartition):
    files: list[File]


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.schema_ = schema.fieldNames(), schema
        self.root, self.source = options["path"], options.get("source", "")
        self.extensions = options["extensions"].lower().split(",") if options.get("extensions") else None
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.asked: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of extension, source_name, path and descriptor, and starts of the last two."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in ("extension", "source_name", "path", "descriptor"):
                self.asked.append((column, "in", tuple(f.value) if isinstance(f, In) else (f.value,)))
            elif isinstance(f, StringStartsWith) and column in ("path", "descriptor"):
                self.asked.append((column, "starts", f.value))
            else:
                yield f

    def _values(self, f: File) -> dict[str, object]:
        return {"descriptor": "{" + self.source + "}" + f.path, "source_name": self.source, "path": self.root.rstrip("/") + f.path, "extension": f.extension, "length": f.length, "modified": f.modified}

    def _fits(self, f: File) -> bool:
        values = self._values(f)
        return all(values[c] in x if how == "in" else values[c].startswith(x) for c, how, x in self.asked)

    def partitions(self) -> list[InputPartition]:
        """Files of about as many bytes each; where contents are not asked for, of as many files."""
        cost = (lambda f: f.length + 4096) if "content" in self.columns else (lambda f: 1 << 14)
        packs, size = [[]], 0
        for f in filter(self._fits, listed(self.root, self.extensions, self.hidden)):
            if packs[-1] and size + cost(f) > self.bytes:
                packs.append([])
                size = 0
            packs[-1].append(f)
            size += cost(f)
        return [_Packed(p) for p in packs]

    def read(self, partition: _Packed) -> Iterator[pa.RecordBatch]:
        kinds = {"length": pa.int64(), "modified": pa.timestamp("us", tz="UTC"), "content": pa.binary()}
        system, top = opened(self.root)
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows, size = [], 0
        for f in partition.files:
            values = self._values(f)
            if "content" in self.columns:
                with system.open_input_stream(top + f.path) as stream:
                    values["content"] = stream.read()
                size += len(values["content"])
            rows.append({c: values[c] for c in self.columns})
            if size > BATCH_BYTES or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


class LibraryFiles(DataSource):
    """spark.read.format("folium"): the files of one source. Options: path (the root), source (its name), extensions,
    hidden, partition_bytes. A schema with some of the columns of FILES reads these alone; without content no
    file is opened."""

    @classmethod
    def name(cls) -> str:
        return "folium"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    """(place below the root, temporary path or None of a file that goes)."""

    files: list[tuple[str, str | None]]


class _Sink(DataSourceArrowWriter):
    """Rows (path, content): tasks write to a folder of the run, the commit checks all places and then renames."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.replace = options["path"], overwrite or options.get("replace", "false").lower() == "true"
        self.run = f".folium-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, top = opened(self.root)
        folder, done = f"{top}/{self.run}/{uuid.uuid4().hex}", []
        system.create_dir(folder)
        for batch in iterator:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                place, temporary = posixpath.normpath("/" + (path or "")), None
                if path is None or place == "/" or ".." in path.split("/"):
                    raise ValueError(f"no place below the root: {path!r}")
                if content.is_valid:
                    temporary = f"{folder}/{len(done)}"
                    with system.open_output_stream(temporary) as out:
                        value = content.as_py()
                        out.write(value.encode() if isinstance(value, str) else value)
                done.append((place, temporary))
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        system, top = opened(self.root)
        files = [f for m in messages if m for f in m.files]
        twice = [p for p, n in Counter(p for p, _ in files).items() if n > 1]
        there = [] if self.replace else [p for p, temporary in files if temporary and system.get_file_info(top + p).type != fs.FileType.NotFound]
        folders = [p for p, _ in files if system.get_file_info(top + p).type == fs.FileType.Directory]
        if twice or there or folders:
            self._clear()
            raise ValueError(f"written twice: {twice[:3]}; there already: {there[:3]}; folders: {folders[:3]}")
        for folder in sorted({posixpath.dirname(p) for p, temporary in files if temporary}):
            system.create_dir(top + folder)
        for place, temporary in files:
            if temporary:
                system.move(temporary, top + place)
            elif system.get_file_info(top + place).type == fs.FileType.File:
                system.delete_file(top + place)
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """What failed and repeated tasks left goes, too."""
        system, top = opened(self.root)
        if system.get_file_info(f"{top}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.run}")


class LibraryFolder(DataSource):
    """df.write.format("folium_files"): a file for each row (path below the root, content: text or bytes); a row
    without content removes its file. Options: path (the root), replace (files that are there may be written anew,
    as in mode overwrite). Places out of the root, written twice, or there already fail the whole write, of which
    nothing is then to be seen."""

    @classmethod
    def name(cls) -> str:
        return "folium_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> _Sink:
        return _Sink(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for source in (LibraryFiles, LibraryFolder):
        spark.dataSource.register(source)


def load(spark: SparkSession, root: str, source: str, extensions: list[str], columns: list[str]) -> DataFrame:
    """Columns of FILES of a source's files."""
    register(spark)
    kinds = dict(c.split(" ") for c in FILES.split(", "))
    return spark.read.format("folium").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).options(path=root, source=source, extensions=",".join(extensions)).load()


def save(rows: DataFrame, root: str, replace: bool = False) -> None:
    """Writes rows (path, content) as files below a root; see LibraryFolder."""
    register(rows.sparkSession)
    rows.select("path", "content").write.format("folium_files").mode("append").options(path=root, replace=str(replace).lower()).save()


def fetched(files: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """files (path, length and others) with content, opened within tasks one by one; other files are not touched."""
    at, schema = files.columns.index("path"), StructType([*files.schema.fields, *StructType.fromDDL("content binary").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, contents, size = 0, [], 0
            for n, path in enumerate(batch.column(at).to_pylist()):
                system, place = opened(path)
                with system.open_input_stream(place) as stream:
                    contents.append(stream.read())
                size += len(contents[-1])
                if size > batch_bytes or n == len(batch) - 1:
                    part = batch.slice(start, n + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                    start, contents, size = n + 1, [], 0

    return files.drop("content").mapInArrow(read, schema)


def hashed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, length, modified) with hash and read: the cache's hash (path, length, modified, hash) for the same
    length and time, else that of the bytes, which are read for it."""
    known = library.to_hash(files.select("path", "length", "modified"), cache)
    held = known.where("hash is not null").withColumn("read", F.lit(False))
    new = fetched(known.where("hash is null").drop("hash")).select("path", "length", "modified", F.sha2("content", 256).alias("hash"), F.lit(True).alias("read"))
    return held.unionByName(new)

