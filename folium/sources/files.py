"""Files as tables: scans of sources, texts, catalogues of books."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text as text_functions

#: Folders that are never scanned.
SKIPPED = [".caltrash", ".trash", ".git", ".venv", ".env", ".vscode", ".idea", ".DS_Store"]

#: What of an OPF package is read.
OPF = """title string, description string, creator array<struct<_VALUE string, _role string>>, subject array<string>, language array<string>,
identifier array<struct<_VALUE string, _scheme string>>, date string, publisher string, meta array<struct<_name string, _content string>>"""


def allowed(path: Column, extensions: list[str], hidden: bool = False) -> Column:
    """Whether a path is scanned: no skipped folder on its way, one of the extensions, no lock file of an
    editor (unless hidden ones are wanted)."""
    parts = F.split(path, "/")
    fine = ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED])) & F.lower(text_functions.extension(path)).isin(extensions)
    return fine if hidden else fine & ~F.element_at(parts, -1).startswith(".#")


def directly_in(files: DataFrame, folder: str, extensions: list[str]) -> DataFrame:
    """Files (path) of a folder with one of the extensions, without those of its subfolders."""
    return files.where((text_functions.directory(F.col("path")) == folder.rstrip("/")) & F.lower(text_functions.extension(F.col("path"))).isin(extensions))


def created(git: Column, modified: Column) -> Column:
    """When a note was made: by its history, else by its file, else now."""
    return F.coalesce(git, modified, F.current_timestamp())


def source_type(source: Column, kinds: dict[str, str]) -> Column:
    """The kind of a source by its name; null of an unknown one."""
    pairs = [F.lit(x) for pair in kinds.items() for x in pair]
    return F.create_map(*pairs)[source] if pairs else F.lit(None).cast("string")


def scan(spark: SparkSession, root: str, source: str, extensions: list[str]) -> DataFrame:
    """descriptor, path, length, modified, content of a source's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.substring_index(F.lit(root.rstrip("/")), ":", -1)
    relative = F.regexp_extract("path", r"^(?:[a-z]+:/*(?=/))?(.*)$", 1)
    below = F.substring(relative, F.length(F.regexp_replace(base, "^/+", "/")) + 1, F.length(relative))
    return files.where(allowed(F.col("path"), extensions)).select(text_functions.descriptor(F.lit(source), below).alias("descriptor"), "path", "length", F.col("modificationTime").alias("modified"), "content")


def readable(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 is left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def contents(files: DataFrame) -> DataFrame:
    """hash, descriptor, text of scanned files."""
    return files.select(F.sha2("content", 256).alias("hash"), "descriptor", readable(F.col("content")).alias("text"))


def utc(stamp: Column) -> Column:
    """A time with or without a zone as one of UTC, to the second; what is none stays as it is."""
    time = F.try_to_timestamp(F.when(stamp.rlike(r"(Z|[+-]\d\d:?\d\d)$"), stamp).otherwise(F.concat(stamp, F.lit("Z"))))
    return F.when(stamp.contains("T") & time.isNotNull(), F.concat(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).otherwise(stamp)


def read_opf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each book of a catalogue's OPF packages."""
    raw = spark.read.format("xml").option("rowTag", "metadata").option("ignoreNamespace", True).schema(OPF).load(paths)
    return opf_books(raw)


def opf_books(raw: DataFrame) -> DataFrame:
    """title, authors, description, tags, languages, identifiers, publication_date, publisher, series,
    title_sort: identifiers as scheme/id, without those of the catalogue itself."""
    meta = lambda name: F.get(F.filter("meta", lambda m: m["_name"] == name), F.lit(0))["_content"]
    authors = F.transform(F.filter("creator", lambda c: c["_role"] == "aut"), lambda c: c["_VALUE"])
    own = lambda i: F.lower(i["_scheme"]).isin("calibre", "uuid")
    ids = F.transform(F.filter("identifier", lambda i: ~own(i)), lambda i: F.concat_ws("/", i["_scheme"], i["_VALUE"]))
    of_catalogue = F.transform(F.filter("identifier", lambda i: F.lower(i["_scheme"]) == "calibre"), lambda i: F.concat(F.lit("calibre_id/"), i["_VALUE"]))
    ids = F.concat(ids, of_catalogue)
    empty = F.array().cast("array<string>")
    return raw.select(
        "title", F.coalesce(authors, empty).alias("authors"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("subject", empty).alias("tags"), F.coalesce("language", empty).alias("languages"),
        F.coalesce(ids, empty).alias("identifiers"), utc(F.col("date")).alias("publication_date"), F.coalesce("publisher", F.lit("")).alias("publisher"), meta("calibre:series").alias("series"), text_functions.without_article(meta("calibre:title_sort")).alias("title_sort"),
    )
