"""Queries over the timeline."""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions import chronology
from folium.operators import events
from folium.plans.samples import EVENTS_SQL, table, timeline

FROM, TO = "2024-01-10", "2024-01-12"
FROM_JD, TO_JD = 2460319.5, 2460321.5
#: The class of an event in SQL, for bounds a and b.
CLASS_SQL = "CASE WHEN s >= a AND e <= b THEN 'inside' WHEN s < a AND e > b THEN 'covers' WHEN (s >= a AND s < b AND e > b) OR (s < a AND a < e AND e <= b) THEN 'partial' END"


def _classed_sql(where: str, a: float = FROM_JD, b: float = TO_JD) -> str:
    return f"WITH {EVENTS_SQL}, t AS (SELECT *, jd_start AS s, coalesce(jd_end, jd_start) AS e, {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM tl), c AS (SELECT *, {CLASS_SQL} AS overlap_class FROM t) SELECT event_id, overlap_class FROM c WHERE overlap_class IN ({where})"


def _classed(**classes: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounds = spark.range(1).select(chronology.parse(F.lit(f"{FROM} - {TO}")).alias("q")).select("q.*").withColumnsRenamed({"jd_start": "a", "jd_end": "b"})
        found = timeline(spark, sf_dir).crossJoin(F.broadcast(bounds))
        return events.in_time(found, F.col("a"), F.col("b"), **classes).select("event_id", "overlap_class")

    return query


def touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that is the point where an event starts: longer events from there do not count."""
    tl = timeline(spark, sf_dir)
    at = tl.where("event_id = 3").select(F.col("jd_start").alias("a"))
    found = tl.crossJoin(F.broadcast(at)).withColumn("overlap_class", events.overlap_class(F.col("jd_start"), F.col("jd_end"), F.col("a")))
    return found.where("event_id = 3 or overlap_class is not null").select("event_id", "overlap_class")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed()(spark, sf_dir).groupBy("overlap_class").agg(F.count("*").alias("n"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.search(timeline(spark, sf_dir), domains=["view/+", "purch", "!*x", "!click/1"]).select("event_id")


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.search(timeline(spark, sf_dir), keys=["kind", "1*|2*", "!view"]).select("event_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = timeline(spark, sf_dir)
    date = chronology.interval_label(F.floor(F.col("jd_start")) + 0.5, F.floor(F.col("jd_end")) + 1.5)
    return tl.select("event_id", date.alias("date"), events.event_text(F.col("eventdata")).alias("event"))




def _order_text(*kinds: str) -> Column:
    """A text for each order by its key: kind number key % len(kinds). {n} stands for key // len(kinds), {d}, {b}, {m} and
    {y} for its date in ISO form and as words."""
    key, date, n = F.col("o_orderkey"), F.col("o_orderdate"), F.floor(F.col("o_orderkey") / len(kinds)).cast("long")
    named = {"d": F.date_format(date, "yyyy-MM-dd"), "b": F.date_format(date, "MMM d, yyyy"), "m": F.date_format(date, "MMMM yyyy"), "y": F.date_format(date, "MMMM d, yyyy"), "e": F.date_format(F.date_add(date, n.cast("int") % 400), "yyyy-MM-dd")}
    named |= {"bc": n % 4000 + 2, "less": n % 4000 + 1, "bp": n % 40000 + 2000, "k": n % 300 + 14, "ga": n % 8 + 3, "ad": n % 1500 + 50, "cent": n % 9 + 1, "th": F.element_at(F.array(*[F.lit(x) for x in ("st", "nd", "rd", "th", "th", "th", "th", "th", "th")]), (n % 9 + 1).cast("int"))}

    def text(kind: str) -> Column:
        pieces = [named[x].cast("string") if x in named else F.lit(x) for x in re.split(r"[{}]", kind) if x]
        return F.concat(*pieces)

    found = F.lit(None).cast("string")
    for at, kind in enumerate(kinds):
        found = F.when(key % len(kinds) == at, text(kind)).otherwise(found)
    return found


def _order_sql(kinds: int) -> str:
    """A table t of orders: what _order_text names, and kind."""
    return f"""n AS (SELECT *, o_orderkey % {kinds} AS kind, o_orderkey // {kinds} AS n, o_orderdate::DATE AS day FROM orders),
t AS (SELECT *, n % 4000 + 2 AS bc, n % 4000 + 1 AS less, n % 40000 + 2000 AS bp, n % 300 + 14 AS k, n % 8 + 3 AS ga, n % 1500 + 50 AS ad, n % 9 + 1 AS cent, day + (n % 400)::INTEGER AS later FROM n)"""


#: Times of every form that the parser reads, and two that are none.
TIMES = ("{d}", "{bc} BC", "{bp} BP", "{k} kya", "{k}.5 Ma", "{ga} Ga BP", "{ad} AD", "{bc} BC - {less} BC", "{d} - {e}", "no time {bc}", "{k} ka BP", "{d} - never")
_BACK_SQL = "(1721057.5 - 365 * ({0})::BIGINT - ({0})::BIGINT // 4)::DOUBLE"  # the first day of so many years before year 0
_DAY_SQL = "date_diff('day', DATE '1970-01-01', {0}) + 2440587.5::DOUBLE"


def _times_sql() -> str:
    """t(o_orderkey, o_custkey, text, s, e) by counting days from year 0 or from 1970."""
    back, day = _BACK_SQL.format, _DAY_SQL.format
    iso = "strftime(day, '%Y-%m-%d')"
    texts = [iso, "bc || ' BC'", "bp || ' BP'", "k || ' kya'", "k || '.5 Ma'", "ga || ' Ga BP'", "ad || ' AD'", "bc || ' BC - ' || less || ' BC'", f"{iso} || ' - ' || strftime(later, '%Y-%m-%d')", "'no time ' || bc", "k || ' ka BP'", f"{iso} || ' - never'"]
    starts = [day("day"), back("bc - 1"), back("bp - 1950"), back("k * 1000 - 1950"), back("k * 1000000 + 500000 - 1950"), back("ga * 1000000000 - 1950"), "(1721057.5 + 365 * ad + (ad + 3) // 4)::DOUBLE", back("bc - 1"), day("day"), "NULL", back("k * 1000 - 1950"), "NULL"]
    case = lambda xs: "CASE kind " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    return f"WITH {_order_sql(len(TIMES))}, p AS (SELECT o_orderkey, o_custkey, {case(texts)} AS text, {case(starts)} AS s, CASE kind WHEN 7 THEN {back('less - 1')} WHEN 8 THEN {day('later')} END AS e FROM t)"


def jd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of every form, one for each order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _order_text(*TIMES).alias("text"))
    return rows.select("o_orderkey", "text", chronology.parse(F.col("text")).alias("p")).select("o_orderkey", "text", "p.jd_start", "p.jd_end")


def jd_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical texts of the starts of the same times."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", chronology.parse(_order_text(*TIMES))["jd_start"].alias("jd"))
    return rows.select("o_orderkey", chronology.label(F.col("jd")).alias("label"))


_LABELS_SQL = f"""WITH {_order_sql(len(TIMES))} SELECT o_orderkey, CASE WHEN kind IN (0, 8) THEN strftime(day, '%Y-%m-%d') WHEN kind IN (1, 7) THEN bc || ' BC' WHEN kind = 2 AND bp >= 15000 THEN bp || ' BP' WHEN kind = 2 THEN (bp - 1949) || ' BC'
WHEN kind IN (3, 10) AND k < 15 THEN (k * 1000 - 1949) || ' BC' WHEN kind IN (3, 10) AND k * 1000 < 101950 THEN (k * 1000) || ' BP' WHEN kind IN (3, 10) THEN k || ' kya BP' WHEN kind = 4 AND k < 100 THEN (k * 1000 + 500) || ' kya BP' WHEN kind = 4 THEN k || '.5 Ma BP'
WHEN kind = 5 AND ga <= 10 THEN (ga * 1000) || ' Ma BP' WHEN kind = 5 THEN ga || ' Ga BP' WHEN kind = 6 THEN ad::VARCHAR END AS label FROM t"""


def jd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates through text and back."""
    dates = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    jd = chronology.parse(F.col("d").cast("string"))["jd_start"]
    return dates.select(F.col("d").cast("string").alias("date"), jd.alias("jd"), chronology.label(jd).alias("label"))


#: Dates in words.
NORMAL = ("{k} thousand years ago", "{k}.5 ka", "{k} ka BP", "in {m}", "{y}", "{b}", "on the {b}", "{bc} BC to {less} BC", "in the {cent}{th} century BC", "{ad} BC", "1914-1918", " as it is {ad} ", "Foo {ad}", "from 1{cent}99 1999")
_NORMAL_SQL = f"""WITH {_order_sql(len(NORMAL))}, w AS (SELECT *, strftime(day, '%B %Y') AS m, strftime(day, '%B %-d, %Y') AS y, strftime(day, '%b %-d, %Y') AS b, strftime(day, '%Y-%m-%d') AS iso, CASE cent WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END AS th FROM t)
SELECT o_orderkey, CASE kind WHEN 0 THEN k || ' thousand years ago' WHEN 1 THEN k || '.5 ka' WHEN 2 THEN k || ' ka BP' WHEN 3 THEN 'in ' || m WHEN 4 THEN y WHEN 5 THEN b WHEN 6 THEN 'on the ' || b WHEN 7 THEN bc || ' BC to ' || less || ' BC' WHEN 8 THEN 'in the ' || cent || th || ' century BC' WHEN 9 THEN ad || ' BC' WHEN 10 THEN '1914-1918' WHEN 11 THEN ' as it is ' || ad || ' ' WHEN 12 THEN 'Foo ' || ad ELSE 'from 1' || cent || '99 1999' END AS text,
CASE kind WHEN 0 THEN k || ' ka BP' WHEN 1 THEN k || '.5 ka BP' WHEN 2 THEN k || ' ka BP' WHEN 3 THEN strftime(day, '%Y-%m') WHEN 7 THEN bc || ' BC - ' || less || ' BC' WHEN 8 THEN (cent * 100) || ' BC - ' || (cent * 100 - 99) || ' BC' WHEN 9 THEN ad || ' BC' WHEN 10 THEN '1914 - 1918' WHEN 11 THEN 'as it is ' || ad WHEN 12 THEN 'Foo ' || ad WHEN 13 THEN '1' || cent || '99 - 1999' ELSE iso END AS date FROM w"""


def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in words, one for each order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _order_text(*NORMAL).alias("text"))
    return rows.select("o_orderkey", "text", chronology.normalised(F.col("text")).alias("date"))


def order_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as rows of a table: parts of the day as starts, some with an end."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), F.col("event_id").alias("row_id"), F.floor(F.hour("ts") / 4).cast("double").alias("jd_start"), F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value") / 10)).cast("double").alias("jd_end"))
    return events.in_order(rows).select("table_id", "row_id")


_ORDER_SQL = """WITH r AS (SELECT user_id AS table_id, event_id AS row_id, hour(ts) // 4 AS s, CASE WHEN event_id % 3 != 0 THEN floor(value / 10) END AS e FROM events),
v AS (SELECT * FROM r WHERE e IS NULL OR e >= s),
w AS (SELECT *, max(s) OVER (PARTITION BY table_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, max(e) OVER (PARTITION BY table_id, s ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS me FROM v)
SELECT table_id, row_id FROM w WHERE m IS NULL OR s > m OR (s = m AND (me IS NULL OR coalesce(e >= me, false)))"""


def unique_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 7 == 0, "When").otherwise("Date")
    columns = F.when(F.col("doc_id") % 11 == 0, F.array(head)).otherwise(F.array(head, F.lit("Event")))
    rows = F.array(F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("1"))).otherwise(F.transform(columns, lambda c: F.lit("1"))))
    domain = F.when(F.col("doc_id") % 5 != 0, F.concat_ws("/", "lang", "source"))
    tables = docs.select(F.col("doc_id").alias("table_id"), columns.alias("columns"), rows.alias("rows"), domain.alias("domain"))
    return events.valid_tables(tables).select("table_id", "domain")


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, from order date to last shipping, that share a day with each month of 1995 and 1996."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("double")
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    orders = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    left = orders.where("last >= o_orderdate").select(F.col("o_orderkey").alias("l_id"), day("o_orderdate").alias("l_start"), day("last").alias("l_end"))
    month = F.add_months(F.lit("1995-01-01").cast("date"), F.col("id").cast("int"))
    right = spark.range(24).select(F.col("id").alias("r_id"), day(month).alias("r_start"), (day(F.add_months(F.lit("1995-01-01").cast("date"), F.col("id").cast("int") + 1)) - 1).alias("r_end"))
    return events.overlap_join(left, right, 30.0).groupBy("r_id").agg(F.count("*").alias("n"), F.sum("l_id").alias("ids"))


_JOIN_SQL = """WITH o AS (SELECT o_orderkey AS id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1970-01-01', max(l_shipdate)::DATE) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate HAVING max(l_shipdate) >= o_orderdate),
m AS (SELECT i AS r_id, date_diff('day', DATE '1970-01-01', (DATE '1995-01-01' + to_months(i::INT))::DATE) AS a, date_diff('day', DATE '1970-01-01', (DATE '1995-01-01' + to_months(i::INT + 1))::DATE) - 1 AS b FROM range(24) t(i))
SELECT r_id, count(*) AS n, sum(id)::BIGINT AS ids FROM o JOIN m ON s <= b AND a <= e GROUP BY r_id"""


def extracted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each time among those of its customer; what is no time comes first."""
    times = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", chronology.parse(_order_text(*TIMES))["jd_start"].alias("jd"))
    start = F.coalesce("jd", F.lit(-999999999.0))
    return times.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(start, "o_orderkey")).cast("long").alias("place"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = timeline(spark, sf_dir)
    return tl.agg(F.countDistinct("context").alias("tables"), F.count("*").alias("events"))


def in_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("context").orderBy("jd_start", F.coalesce("jd_end", "jd_start"), "event_id"))
    return timeline(spark, sf_dir).select("event_id", place.cast("long").alias("place"))


def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    reply = F.concat(F.lit("Here: [{“date_text”: “"), (1000 + F.col("doc_id")).cast("string"), F.lit('", "event_description": "a '), "lang", F.lit(' b"}, {"date_text": "x"}, { "event_description" : "c", "date_text":"'), "source", F.lit('" }, {"date_text": "7", "event_description": "the “great” fire of '), "lang", F.lit('" } ...'))
    return events.salvaged_events(d.select(F.col("doc_id").alias("reply_id"), reply.alias("reply"))).select("reply_id", F.col("n").cast("long").alias("n"), "date_text", "event_description")


QUERIES = {
    "timeline_inside": (_classed(covers=False, partial=False), _classed_sql("'inside'")),
    "timeline_covers": (_classed(inside=False, partial=False), _classed_sql("'covers'")),
    "timeline_partial": (_classed(inside=False, covers=False), _classed_sql("'partial'")),
    "timeline_default": (_classed(), _classed_sql("'inside', 'covers', 'partial'")),
    "timeline_touching": (touching, f"WITH {EVENTS_SQL}, t AS (SELECT tl.*, tl.jd_start AS s, coalesce(tl.jd_end, tl.jd_start) AS e, p.jd_start AS a, p.jd_start AS b FROM tl, (SELECT jd_start FROM tl WHERE event_id = 3) p), c AS (SELECT event_id, {CLASS_SQL} AS overlap_class FROM t) SELECT * FROM c WHERE event_id = 3 OR overlap_class IS NOT NULL"),
    "timeline_report": (report, f"SELECT overlap_class, count(*) AS n FROM ({_classed_sql(chr(39) + 'inside' + chr(39) + ', ' + chr(39) + 'covers' + chr(39) + ', ' + chr(39) + 'partial' + chr(39))}) GROUP BY 1"),
    "timeline_domains": (domains, f"WITH {EVENTS_SQL} SELECT event_id FROM tl WHERE (regexp_matches(context, '^view/[^/]*$') OR contains(context, 'purch') OR contains(context, 'view/+')) AND NOT contains(context, '*x') AND NOT contains(context, 'click/1')"),
    "timeline_keywords": (keywords, f"WITH {EVENTS_SQL} SELECT event_id FROM tl WHERE event_type != 'view' AND regexp_matches(user_id::VARCHAR, '^[12]')"),
    "timeline_labels": (labels, f"WITH {EVENTS_SQL}, d AS (SELECT *, strftime(DATE '1970-01-01' + (floor(jd_start) + 0.5 - 2440587.5)::INT, '%Y-%m-%d') AS a, strftime(DATE '1970-01-01' + (floor(jd_end) + 1.5 - 2440587.5)::INT, '%Y-%m-%d') AS b FROM tl) SELECT event_id, CASE WHEN b IS NULL THEN a ELSE a || ' - ' || b END AS date, 'kind: ' || event_type || ', user: ' || user_id AS event FROM d"),
    "jd_parse": (jd_parse, f"{_times_sql()} SELECT o_orderkey, text, s AS jd_start, e AS jd_end FROM p"),
    "jd_label": (jd_label, _LABELS_SQL),
    "jd_roundtrip": (jd_roundtrip, "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440587.5::DOUBLE AS jd, strftime(o_orderdate, '%Y-%m-%d') AS label FROM orders"),
    "date_normalise": (date_normalise, _NORMAL_SQL),
    "event_order_filter": (order_filter, _ORDER_SQL),
    "unique_domain": (unique_domain, "SELECT doc_id AS table_id, lang || '/' || source AS domain FROM documents WHERE doc_id % 7 != 0 AND doc_id % 11 != 0 AND doc_id % 13 != 0 AND doc_id % 5 != 0 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1"),
    "interval_overlap_join": (overlap_join, _JOIN_SQL),
    "extracted_order": (extracted_order, f"{_times_sql()} SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(s, -999999999.0), o_orderkey) AS place FROM p"),
    "timeline_inventory": (inventory, "SELECT count(DISTINCT event_type || '/' || user_id) AS tables, count(*) AS events FROM events"),
    "timeline_order": (in_time_order, f"WITH {EVENTS_SQL} SELECT event_id, row_number() OVER (PARTITION BY context ORDER BY jd_start, coalesce(jd_end, jd_start), event_id) AS place FROM tl"),
    "json_salvage": (json_salvage, "SELECT doc_id AS reply_id, unnest([0, 2, 3])::BIGINT AS n, unnest([(1000 + doc_id)::VARCHAR, source, '7']) AS date_text, unnest(['a ' || lang || ' b', 'c', 'the \"great\" fire of ' || lang]) AS event_description FROM documents"),
}
