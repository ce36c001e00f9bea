"""The metadata of notes, field by field, out of their headers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of an entry in order; lists among them.
FIELDS = "uuid representations authors identifiers languages context creation_date publication_date publisher series tags title title_sort normalized_filename description icon".split()
LISTS = "authors identifiers languages tags".split()
#: A field may stand under another name, which wins.
OTHER_NAMES = {"creation_date": "creation", "publication_date": "pubdate"}
REPRESENTATION = "array<struct<doc_descriptor string, hash string, format string, doc_date string>>"


def stable_uuid(descriptor: Column) -> Column:
    """A uuid of a note's place, so that it stays when the note changes."""
    h = F.md5(descriptor)
    return F.concat_ws("-", *[F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def entries(notes: DataFrame, format: str = "md") -> DataFrame:
    """descriptor, the fields of FIELDS, complete of notes (descriptor, hash, header as JSON, and created as text).

    Defaults: a uuid of the descriptor, the date created, the folders of the descriptor as context, its file's name;
    else empty. A list may stand as one value. complete: uuid and context stand in the header."""
    header = F.col("header")
    given = lambda name: F.get_json_object(header, f"$.{name}")
    named = lambda name: F.coalesce(given(OTHER_NAMES[name]), given(name)) if name in OTHER_NAMES else given(name)
    defaults = {"uuid": stable_uuid(F.col("descriptor")), "creation_date": F.col("created"), "context": F.regexp_extract("descriptor", r"^[^/]*/(.*)/[^/]*$", 1), "normalized_filename": F.substring_index("descriptor", "/", -1)}
    none = F.array().cast("array<string>")

    def field(name: str) -> Column:
        value = named(name)
        if name in LISTS:
            return F.when(value.startswith("["), F.coalesce(F.from_json(value, "array<string>"), none)).when(value != "", F.array(value)).otherwise(none)
        return F.coalesce(value, defaults.get(name, F.lit("")), F.lit(""))

    made = notes.select("descriptor", "hash", (given("uuid").isNotNull() & given("context").isNotNull()).alias("complete"), *[field(f).alias(f) for f in FIELDS if f != "representations"])
    own = F.struct(F.col("descriptor").alias("doc_descriptor"), F.col("hash").alias("hash"), F.lit(format).alias("format"), F.col("creation_date").alias("doc_date"))
    return made.withColumn("representations", F.array(own).cast(REPRESENTATION)).select("descriptor", *FIELDS, "complete")


def representation_text(r: Column) -> Column:
    """A representation as a string in a drawer: JSON with its quotes escaped, within quotes."""
    escaped = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r'(["\\])', r"\\$1")
    pairs = [F.concat(F.lit(f'"{k}": "'), escaped(r[k]), F.lit('"')) for k in ("doc_descriptor", "hash", "format", "doc_date")]
    json = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    return F.concat(F.lit('"'), F.regexp_replace(json, r'(["\\])', r"\\$1"), F.lit('"'))
