"""Timeline operators: events of note tables, searches by time, domain and keys, labels."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import chronology
from folium.functions import keys as key_language

#: Buckets that one interval of an overlap join may cover; longer ones are joined apart.
MOST_BUCKETS = 64

#: Characters of a text that are searched for years at once.
YEAR_BLOCK = 16_384


def overlap_class(start: Column, end: Column, from_: Column, to: Column | None = None) -> Column:
    """inside, covers or partial: how an event lies to a query; null if it does not touch it.

    Without an end, event and query are points. What only touches at a bound is not partial."""
    end = F.coalesce(end, start)
    to = from_ if to is None else F.coalesce(to, from_)
    partial = ((start >= from_) & (start < to) & (end > to)) | ((start < from_) & (from_ < end) & (end <= to))
    return F.when((start >= from_) & (end <= to), "inside").when((start < from_) & (end > to), "covers").when(partial, "partial")


def in_time(events: DataFrame, from_: Column, to: Column | None = None, inside: bool = True, covers: bool = True, partial: bool = True) -> DataFrame:
    """The events of the classes that are asked for, with overlap_class."""
    wanted = [name for name, flag in (("inside", inside), ("covers", covers), ("partial", partial)) if flag]
    return events.withColumn("overlap_class", overlap_class(F.col("jd_start"), F.col("jd_end"), from_, to)).where(F.col("overlap_class").isin(wanted))


def _topic_pattern(term: str) -> str:
    """A topic with + for one level and # for all that follow, as a regular expression."""
    parts = [r"[^/]*" if p == "+" else re.escape(p) for p in term.split("/") if p != "#"]
    return "^" + "/".join(parts) + ("(/.*)?$" if term.split("/")[-1] == "#" else "$")


def in_domains(context: Column, domains: list[str]) -> Column:
    """Whether a context holds, or matches as a topic, one of the domains and none of those with !."""
    low = F.lower(context)
    one = lambda term: low.contains(term.lower()) | low.rlike(_topic_pattern(term.lower()))
    wanted = [d for d in domains if not d.startswith("!")]
    found = F.lit(not wanted)
    for d in wanted:
        found = found | one(d)
    for d in domains:
        if d.startswith("!"):
            found = found & ~one(d[1:])
    return found


def key_text(*maps: Column) -> Column:
    """Names and values of arrays of (k, v), joined by spaces."""
    return F.concat_ws(" ", *[F.flatten(F.transform(m, lambda e: F.array(e["k"], e["v"]))) for m in maps])


def event_text(data: Column) -> Column:
    return F.array_join(F.transform(data, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), ", ")


def by_time(events: DataFrame) -> DataFrame:
    """In order of start, then end; a point ends where it starts."""
    return events.orderBy("jd_start", F.coalesce("jd_end", "jd_start"))


def search(events: DataFrame, from_: Column | None = None, to: Column | None = None, domains: list[str] | None = None, keys: list[str] | None = None, **classes: bool) -> DataFrame:
    """Events (jd_start, jd_end, eventdata, metadata, context) by time, then domain, then keys."""
    found = events if from_ is None else in_time(events, from_, to, **classes)
    if domains is not None:
        found = found.where(in_domains(F.col("context"), domains))
    if keys is not None:
        found = found.where(key_language.matches(key_text(F.col("eventdata"), F.col("metadata")), keys))
    return found


def valid_tables(tables: DataFrame) -> DataFrame:
    """Tables (table_id, columns, rows, domain) that hold events: two columns or more, the first Date, all
    rows as wide, a domain that no earlier valid table has."""
    wide = (F.size("columns") >= 2) & (F.get("columns", F.lit(0)) == "Date") & F.forall("rows", lambda r: F.size(r) == F.size("columns"))
    ranked = tables.where(wide & F.col("domain").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("table_id")))
    return ranked.where("_n = 1").drop("_n")


def in_order(rows: DataFrame, table: str = "table_id", row: str = "row_id") -> DataFrame:
    """Rows (jd_start, jd_end) of each table that do not step back in time: start is no less than any
    earlier start, and among rows of one start the end is no less than any earlier one, none being least.

    Rows without start, or that end before they start, are dropped first."""
    valid = rows.where(F.col("jd_start").isNotNull() & (F.col("jd_end").isNull() | (F.col("jd_end") >= F.col("jd_start"))))
    before = Window.partitionBy(table).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(table, "jd_start").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    marked = valid.withColumn("_start", F.max("jd_start").over(before)).withColumn("_end", F.max("jd_end").over(same))
    late = F.col("_end").isNull() | F.coalesce(F.col("jd_end") >= F.col("_end"), F.lit(False))
    fits = F.col("_start").isNull() | (F.col("jd_start") > F.col("_start")) | ((F.col("jd_start") == F.col("_start")) & late)
    return marked.where(fits).drop("_start", "_end")


def without_restarts(rows: DataFrame) -> DataFrame:
    """Rows (cells) of tables, but for a header or a rule that stands again in the middle."""
    first = F.get("cells", F.lit(0))
    return rows.where(~((first == "Date") | (first.startswith("-") & first.endswith("-"))))


def _dated_rows(good: DataFrame) -> DataFrame:
    """The rows of valid tables with the days of their first cells, the other cells by the names of their columns."""
    pairs = lambda keys, values: F.zip_with(keys, values, lambda k, v: F.named_struct(F.lit("k"), k, F.lit("v"), v))
    metadata = F.transform(F.array_sort(F.map_keys("metadata")), lambda k: F.named_struct(F.lit("k"), k, F.lit("v"), F.col("metadata")[k]))
    rows = good.select("table_id", "columns", metadata.alias("metadata"), F.posexplode("rows").alias("row_id", "cells"))
    data = pairs(F.slice("columns", 2, F.size("columns") - 1), F.slice("cells", 2, F.size("columns") - 1))
    dated = without_restarts(rows).select("table_id", "row_id", chronology.parse(F.get("cells", F.lit(0))).alias("_jd"), data.alias("eventdata"), "metadata")
    return dated.select("table_id", "row_id", F.col("_jd.jd_start").alias("jd_start"), F.col("_jd.jd_end").alias("jd_end"), "eventdata", "metadata")


def _valid(tables: DataFrame) -> DataFrame:
    return valid_tables(tables.withColumn("domain", F.col("metadata")["domain"]))


def table_events(tables: DataFrame) -> DataFrame:
    """The events of events_of_tables alone."""
    return in_order(_dated_rows(_valid(tables)))


def events_of_tables(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (table_id, columns, rows, metadata) as events, and tables, added, skipped in all.

    events: table_id, row_id, jd_start, jd_end, eventdata and metadata as arrays of (k, v). Of the rows of valid
    tables those go whose date is none or ends before it starts, and those that step back in time; they are
    skipped. eventdata holds the other cells by the names of their columns."""
    good = _valid(tables)
    all_rows = _dated_rows(good)
    added = in_order(all_rows)
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    sums = count(good, "tables").crossJoin(count(added, "added")).crossJoin(count(all_rows, "rows"))  # one row each
    return added, sums.select("tables", "added", (F.col("rows") - F.col("added")).alias("skipped"))


def overlap_join(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Pairs of intervals (l_id, l_start, l_end) and (r_id, r_start, r_end) that share a point.

    Both are dealt to buckets of width days; a pair is taken in the first bucket that both cover. Intervals
    of more than MOST_BUCKETS buckets meet the others through buckets so much wider, level by level."""

    def dealt(side: DataFrame, p: str) -> DataFrame:
        span = (F.floor(F.col(f"{p}_end") / width) - F.floor(F.col(f"{p}_start") / width) + 1) / MOST_BUCKETS
        level = F.greatest(F.ceil(F.log(float(MOST_BUCKETS), F.greatest(span, F.lit(1.0)))), F.lit(0)).cast("int")
        return side.withColumn(f"{p}_level", level)

    l, r = dealt(left, "l"), dealt(right, "r")
    levels = [x[0] for x in l.select("l_level").distinct().union(r.select("r_level").distinct()).distinct().collect()]  # a handful
    top = max(levels, default=0)
    # each side reaches up to all levels at or above its own, so a pair meets at the higher of the two
    spread = lambda side, p: side.withColumn("level", F.explode(F.sequence(F.col(f"{p}_level"), F.lit(top))))
    cell = lambda p, c: F.floor(F.col(f"{p}_{c}") / (F.lit(width) * F.pow(F.lit(float(MOST_BUCKETS)), F.col("level"))))
    covered = lambda side, p: spread(side, p).withColumn("cell", F.explode(F.sequence(cell(p, "start"), cell(p, "end"))))
    both = covered(l, "l").join(covered(r, "r"), ["level", "cell"])
    meet = (F.col("level") == F.greatest("l_level", "r_level")) & (F.col("cell") == F.greatest(cell("l", "start"), cell("r", "start")))
    touch = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))
    return both.where(meet & touch).drop("level", "cell", "l_level", "r_level")


def years_in_text(texts: DataFrame, before: int = 50, after: int = 20) -> DataFrame:
    """doc_id, at, year, snippet of every number from 1800 to 2099 that stands alone; at counts from 0.

    A text is read in blocks, each with what a snippet or a neighbour needs on either side, so nothing is shuffled."""
    length, low = F.length("text"), F.greatest(F.col("start") - max(before, 1), F.lit(0))
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(YEAR_BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = texts.select("doc_id", "text", F.explode(starts).alias("start")).select("doc_id", "start", low.alias("low"), F.substring(F.col("text"), low + 1, F.col("start") - low + YEAR_BLOCK + max(after, 5)).alias("block"))
    parts = F.split("block", r"(?<![\p{L}\p{N}_])(?=(?:18|19|20)\d\d(?![\p{L}\p{N}_]))")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,year:int>>").alias("found"))
    hit = lambda s, p: F.array(F.struct(s["at"].alias("at"), F.substring(p, 1, 4).cast("int").alias("year")))
    is_year = lambda p: p.rlike(r"^(?:18|19|20)\d\d(?![\p{L}\p{N}_])")
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(is_year(p), F.concat(s["found"], hit(s, p))).otherwise(s["found"]).alias("found"))
    found = blocks.select("doc_id", "start", "low", "block", F.explode(F.aggregate(parts, none, step)["found"]).alias("hit"))
    at, first = F.col("low") + F.col("hit.at"), F.greatest(F.col("hit.at") - before, F.lit(0))
    snippet = F.translate(F.substring(F.col("block"), first + 1, F.col("hit.at") + after - first), "\n\r\t", "   ")
    own = (at >= F.col("start")) & (at < F.col("start") + YEAR_BLOCK)
    return found.where(own).select("doc_id", at.cast("long").alias("at"), F.col("hit.year").alias("year"), snippet.alias("snippet"))


#: A flat block of good JSON strings, else all up to the next closing brace.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PAIR = rf"{_STRING}\s*:\s*{_STRING}\s*"
_BLOCK = rf"(?s)\{{\s*{_PAIR}(?:,\s*{_PAIR})*+\}}|\{{[^}}]*\}}"


def _unescaped(text: Column) -> Column:
    """What stands between the quotes of a JSON string, read; quotes, backslashes and control characters that nobody
    escaped stay."""
    kept = F.regexp_replace(text, r'(?<!\\)((?:\\\\)*+)\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})', r"$1\\\\")
    kept = F.regexp_replace(kept, r'(?<!\\)((?:\\\\)*+)"', r'$1\\"')
    return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), kept, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"}), F.lit(0)), text)


def salvaged_events(replies: DataFrame) -> DataFrame:
    """reply_id, n, date_text, event_description out of flat {...} blocks of text that is not quite JSON.

    A date ends at its next quote. A description may hold quotes that nobody escaped: it ends at the last quote
    before the closing brace, else at the last before a comma, and in any case before the key of the date. A block
    whose strings are good JSON may hold braces in them; escapes of JSON are read."""
    plain = F.translate("reply", "“”‘’", "\"\"''")
    blocks = replies.select("reply_id", F.posexplode(F.regexp_extract_all(plain, F.lit(_BLOCK), F.lit(0))).alias("n", "block"))
    upto = lambda end: F.nullif(F.regexp_extract("block", rf'(?s)"event_description"\s*:\s*"(.*)"\s*{end}', 1), F.lit(""))
    description = F.regexp_replace(F.coalesce(upto(r"\}"), upto(","), F.lit("")), r'(?s)"\s*,\s*"date_text"\s*:.*$', "")
    date = F.regexp_extract("block", r'"date_text"\s*:\s*"([^"\n]*)"', 1)
    both = blocks.select("reply_id", "n", _unescaped(F.trim(date)).alias("date_text"), _unescaped(F.regexp_replace(description, r"^\s+|\s+$", "")).alias("event_description"))
    return both.where("date_text != '' and event_description != ''")
