"""Metadata, tables and events of a library's notes, kept up to date by what changed alone.

Of a sync only notes with a new hash are parsed. A domain belongs to the first valid table that has it, so a
note that changes or goes may hand a domain to another note or take one: of the domains that any table of such
notes has or had, owner and events are worked out anew from the tables that are kept; all others stay."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.operators import events, library
from folium.sources import notes as formats

NOTES = "descriptor string, hash string, header string"
TABLES = "descriptor string, table_id int, columns array<string>, rows array<array<string>>, metadata map<string,string>"
_PAIRS = "array<struct<k string, v string>>"
EVENTS = f"descriptor string, table_id int, row_id int, domain string, jd_start double, jd_end double, eventdata {_PAIRS}, metadata {_PAIRS}"


class Notes(NamedTuple):
    """notes (descriptor, hash, header as JSON), tables (descriptor, table_id, columns, rows, metadata) and events
    (descriptor, table_id, row_id, domain, jd_start, jd_end, eventdata, metadata)."""

    notes: DataFrame
    tables: DataFrame
    events: DataFrame


def nothing(files: DataFrame) -> Notes:
    """A library without notes."""
    return Notes(*[files.sparkSession.createDataFrame([], schema) for schema in (NOTES, TABLES, EVENTS)])


def parsed(files: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Notes and tables of files (descriptor, hash, text). Texts are read once, for what keep may store: headers and
    tables of each file. Files that share a descriptor have each other's headers, too."""
    parts = formats.parsed_headers(files.select(F.struct("descriptor", "hash").alias("note_id"), "text"))
    named = parts.select(F.col("note_id.descriptor").alias("note_id"), F.col("note_id.descriptor").alias("path"), "note_id.hash", "header", F.col("body").alias("text"))
    each = keep(formats.with_tables(named).drop("path"))
    headers = each.select(F.col("note_id").alias("descriptor"), "header")
    notes = each.select(F.col("note_id").alias("descriptor"), "hash").join(headers, "descriptor").select("descriptor", "hash", "header")
    return notes, formats.tables_of(each).withColumnRenamed("note_id", "descriptor")


def events_of(tables: DataFrame) -> DataFrame:
    """Events of tables whose domains are all theirs: with every table of a domain, its first valid one counts."""
    keyed = tables.withColumn("table_id", F.struct("descriptor", "table_id")).drop("descriptor")
    found = events.table_events(keyed)
    domain = F.get(F.filter("metadata", lambda m: m["k"] == "domain"), F.lit(0))["v"]
    return found.select("table_id.descriptor", "table_id.table_id", "row_id", domain.alias("domain"), "jd_start", "jd_end", "eventdata", "metadata")


def touched(files: DataFrame, held: Notes) -> DataFrame:
    """descriptor, action (new, changed, orphan) of the notes that are not as they were."""
    return library.metadata_actions(files.select("descriptor", "hash"), held.notes).where("action != 'unchanged'")


def synced(files: DataFrame, held: Notes, keep: Callable[[DataFrame], DataFrame] = lambda df: df, changes: DataFrame | None = None) -> Notes:
    """The notes of files (descriptor, hash, text) out of what is held of earlier ones. keep may store what several
    tables follow from: the changes, unless they are given, and what is parsed of changed notes."""
    changes = keep(touched(files, held)) if changes is None else changes
    fresh_notes, fresh_tables = parsed(files.join(changes.where("action != 'orphan'"), "descriptor", "left_semi"), keep)
    notes = library.missing(held.notes, changes, "descriptor").unionByName(fresh_notes)
    tables = library.missing(held.tables, changes, "descriptor").unionByName(fresh_tables)
    domain = F.col("metadata")["domain"].alias("domain")
    had = library.present(held.tables, changes, "descriptor")
    domains = had.select(domain).union(fresh_tables.select(domain)).where("domain is not null").distinct()
    again = library.present(tables.withColumn("domain", domain), domains, "domain").drop("domain")
    return Notes(notes, tables, library.missing(held.events, domains, "domain").unionByName(events_of(again)))
