"""Queries over what a library goes through: snapshots, embedding, extraction, events of notes, exports, caches."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.catalogue import libraries
from folium.functions import text as text_functions
from folium.operators import embedding, events, extraction, library, vectors
from folium.plans.samples import CHUNKS_SQL, EVENTS_SQL, LIBRARY_SQL, chunks, library as notes, table, timeline
from folium.sources import assembly, files, snapshots
from folium.sources import notes as note_formats


def library_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored library after a sync with the files, read back."""
    found, held = libraries._files(spark, sf_dir)
    root = snapshots.work_folder(spark)
    snapshots.write(root, {"texts": held.select("hash", "source_name", "descriptor", "text")})
    snapshots.sync(spark, root, found)
    return snapshots.read(spark, root, "texts").select("hash", "descriptor", F.length("text").cast("long").alias("n"))


def publish_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library published by one desk and fetched by another, twice; the gate lets the first through alone."""
    ours, shared, theirs = (snapshots.work_folder(spark) for _ in range(3))
    snapshots.write(ours, {"texts": notes(spark, sf_dir).select("hash", "descriptor")})
    snapshots.write(ours, {"texts": notes(spark, sf_dir).where("ord % 3 != 0").select("hash", "descriptor")})
    done = [snapshots.publish(spark, ours, shared), snapshots.publish(spark, ours, shared), snapshots.fetch(spark, shared, theirs), snapshots.fetch(spark, shared, theirs)]
    marks = "".join("y" if d else "n" for d in done)
    return snapshots.read(spark, theirs, "texts").select("hash", "descriptor", F.lit(snapshots.version(spark, theirs)).cast("long").alias("version"), F.lit(marks).alias("done"))


def _unindexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = notes(spark, sf_dir).groupBy("hash").agg(F.min("text").alias("text"), F.min("ord").alias("ord"))
    return texts, texts.where("ord % 7 = 0").select(F.lit("a").alias("model"), "hash")


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two models, of which one has every seventh document already."""
    made = embedding.embedded(*_unindexed(spark, sf_dir), {"a": embedding.letter_counts(8), "b": embedding.letter_counts(4)})
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(f"v{i}")
    return made.select("model", "hash", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("embedding").cast("long").alias("dim"), at(0), at(3))


_UNINDEXED_SQL = f"{LIBRARY_SQL}, t AS (SELECT hash, min(text) AS text, min(ord) AS ord FROM library GROUP BY hash), todo AS (SELECT m.model, m.dim, t.* FROM t, (VALUES ('a', 8), ('b', 4)) m(model, dim) WHERE NOT (model = 'a' AND ord % 7 = 0)), counted AS (SELECT *, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 3072 THEN 1 ELSE ceil((length(text) - 3072) / 2048.0)::BIGINT + 1 END AS n FROM todo)"
_INDEX_SQL = f"WITH {_UNINDEXED_SQL}, cut AS (SELECT model, dim, hash, i AS chunk_index, list_transform(string_split(substring(text, i * 2048 + 1, 3072), ''), lambda c: unicode(c)) AS p FROM (SELECT *, unnest(range(0, n)) AS i FROM counted)), v AS (SELECT *, list_transform(range(0, dim), lambda j: len(list_filter(p, lambda x: x % dim = j))) AS v FROM cut) SELECT model, hash, chunk_index, dim::BIGINT AS dim, round((v[1] / sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])))::FLOAT::DOUBLE, 5) AS v0, round((v[4] / sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])))::FLOAT::DOUBLE, 5) AS v3 FROM v"


def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is to index: documents and chunks of each model."""
    todo = embedding.worklist(*_unindexed(spark, sf_dir), ["a", "b"])
    return todo.groupBy("model").agg(F.count("*").alias("docs"), F.sum("chunks").cast("long").alias("chunks"))


QUESTION = "the river of the valley"


def search_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best texts for a question, and how far each stretch of their best chunk answers it."""
    embed = embedding.letter_counts(8)
    query = embedding.unit(embed([QUESTION]))[0].tolist()
    texts, _ = _unindexed(spark, sf_dir)
    made = embedding.embedded(texts, texts.limit(0).select(F.lit("a").alias("model"), "hash"), {"a": embed})
    hits = vectors.ranked(vectors.best_chunks(vectors.scored(made.withColumnRenamed("hash", "doc"), query)), 4)
    chunk = text_functions.chunk_at(F.col("text"), F.col("chunk_index"))
    found = texts.withColumnRenamed("hash", "key").join(hits.withColumnRenamed("doc", "key"), "key").select("key", chunk.alias("text"), "cosine", "rank")
    marked = vectors.highlighted(found, query, embed, cutoff=0.3, dampening=1.4)
    return marked.select("rank", F.posexplode("marks").alias("at", "mark")).select(F.col("rank").cast("long").alias("rank"), F.col("at").cast("long").alias("at"), F.round("mark", 5).alias("mark"))


_HIGHLIGHT_SQL = f"""WITH {LIBRARY_SQL}, t AS (SELECT hash, min(text) AS text FROM library GROUP BY hash),
q AS (SELECT list_transform(range(0, 8), lambda j: len(list_filter(string_split('{QUESTION}', ''), lambda c: unicode(c) % 8 = j))::DOUBLE) AS v), qn AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS q FROM q),
cut AS (SELECT hash, i, substring(text, i * 2048 + 1, 3072) AS c FROM (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 3072 THEN 1 ELSE ceil((length(text) - 3072) / 2048.0)::BIGINT + 1 END)) AS i FROM t)),
cv AS (SELECT hash, i, c, list_transform(range(0, 8), lambda j: len(list_filter(string_split(c, ''), lambda x: unicode(x) % 8 = j))::DOUBLE) AS v FROM cut),
sc AS (SELECT hash, i, c, list_sum(list_transform(range(1, 9), lambda k: (v[k] / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE * q[k])) AS cosine FROM cv, qn),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY hash ORDER BY cosine DESC, i) = 1),
hits AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, hash) AS rank, length(c) AS n FROM best QUALIFY rank <= 4),
w AS (SELECT rank, cosine, n, s, greatest(s * 16 - 16, 0) AS b0, least(s * 16 + 16, n) AS e0, c FROM (SELECT *, unnest(range(0, (n - 1) // 16 + 1)) AS s FROM hits)),
x AS (SELECT rank, cosine, n, s, substring(c, (CASE WHEN e0 = n AND b0 > 0 THEN greatest(n - 32, 0) ELSE b0 END) + 1, (CASE WHEN b0 = 0 AND e0 < n THEN least(32, n) ELSE e0 END) - (CASE WHEN e0 = n AND b0 > 0 THEN greatest(n - 32, 0) ELSE b0 END)) AS win FROM w),
xv AS (SELECT *, list_transform(range(0, 8), lambda j: len(list_filter(string_split(win, ''), lambda y: unicode(y) % 8 = j))::DOUBLE) AS v FROM x),
xc AS (SELECT rank, cosine, n, s, list_dot_product(v, q) / sqrt(list_dot_product(v, v)) AS cc FROM xv, qn),
r AS (SELECT *, least(1.0, min(cc) OVER (PARTITION BY rank)) AS lo, greatest(0.0, max(cc) OVER (PARTITION BY rank)) AS hi FROM xc),
b AS (SELECT *, (exp((cc - lo) / (hi - lo)) - 1) / (exp(1.0) - 1) AS bent FROM r)
SELECT rank::BIGINT AS rank, unnest(range(s * 16, least(s * 16 + 16, n)))::BIGINT AS at, round(CASE WHEN hi - lo > 0 THEN CASE WHEN bent < 0.3 THEN 0.0 ELSE bent END ELSE cc END * cosine / 1.4, 5) AS mark FROM b"""


def extract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of documents with years put at their start and end, piece by piece."""
    i = F.col("doc_id")
    year = F.concat(F.lit("In "), (i % 900 + 1100).cast("string"), F.lit(" it rose. "))
    text = F.concat(year, F.lit("By "), (i % 500 + 1500).cast("string"), F.lit(" \"it\" fell. "), F.col("text"), F.lit(" At last 1999 came."))
    found = extraction.extracted(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), extraction.year_clauses)
    return found.select("doc_id", F.col("piece").cast("long").alias("piece"), F.col("n").cast("long").alias("n"), "date_text", "event_description")


_EXTRACT_SQL = r"""WITH t AS (SELECT doc_id, 'In ' || (doc_id % 900 + 1100) || ' it rose. By ' || (doc_id % 500 + 1500) || ' "it" fell. ' || text || ' At last 1999 came.' AS text FROM documents),
p AS (SELECT doc_id, k AS piece, substring(text, k * 4000 + 1, 4000) AS x FROM (SELECT *, unnest(range(0, (length(text) - 1) // 4000 + 1)) AS k FROM t)),
m AS (SELECT doc_id, piece, unnest(range(0, len(f))) AS n, f FROM (SELECT *, regexp_extract_all(x, '\b[0-9]{4}\b[^.]+\.') AS f FROM p))
SELECT doc_id, piece::BIGINT AS piece, n::BIGINT AS n, substring(f[n + 1], 1, 4) AS date_text, regexp_replace(substring(f[n + 1], 5, length(f[n + 1]) - 5), '^\s+|\s+$', '', 'g') AS event_description FROM m"""


def _versioned_notes(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    """Notes with front matter and a table of three dates. The second time some are gone, some new, and every fifth
    has changed: it claims another domain, so domains change hands."""
    i = F.col("doc_id")
    changed = (i % 5 == 0) if second else F.lit(False)
    claim = F.when(changed, (i + 7) % 300).otherwise(i % 300)
    text = F.concat(F.lit("---\ntitle: T"), i, F.when(changed, "b").otherwise("a"), F.lit("\n---\n# Note\n<!-- domain: d/"), claim, F.lit(" -->\n| Date | Event |\n|---|---|\n| "), i % 50 + 1900, F.lit(" | a "), "source", F.when(changed, " moved").otherwise(""), F.lit(" |\n| 1920 | b |\n| 1970 - 1980 | "), "lang", F.lit(" |\n\n"), "text", F.lit("\n"))
    path = F.concat(F.lit("{"), "source", F.lit("}/"), F.lpad(i.cast("string"), 12, "0"), F.lit(".md"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 4 != 1" if second else "doc_id % 6 != 0")
    return docs.select(path.alias("descriptor"), text.alias("text")).withColumn("hash", F.sha2("text", 256))


def _synced_twice(spark: SparkSession, sf_dir: str) -> str:
    root = snapshots.work_folder(spark)
    for second in (False, True):
        snapshots.sync_notes(spark, root, _versioned_notes(spark, sf_dir, second), actions=True)
    return root


def metadata_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the notes after a second sync, in which only what changed is parsed."""
    found = snapshots.read(spark, _synced_twice(spark, sf_dir), "events")
    data = F.concat_ws(";", F.transform("eventdata", lambda x: F.concat_ws("=", x["k"], x["v"])))
    return found.select("descriptor", F.col("row_id").cast("long").alias("row_id"), "domain", "jd_start", "jd_end", data.alias("eventdata"))


def metadata_sync_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the notes after a second sync, and what became of each; null of those that were as before."""
    root = _synced_twice(spark, sf_dir)
    notes_, actions = (snapshots.read(spark, root, name) for name in ("notes", "actions"))
    title = F.get_json_object("header", "$.title")
    return notes_.join(actions, "descriptor", "full_outer").select("descriptor", title.alias("title"), "action")


_SECOND_SQL = """WITH d AS (SELECT doc_id, lang, source, '{' || source || '}/' || lpad(doc_id::VARCHAR, 12, '0') || '.md' AS descriptor, doc_id % 5 = 0 AS changed, 1900 + doc_id % 50 AS y FROM documents),
n AS (SELECT *, 'd/' || CASE WHEN changed THEN (doc_id + 7) % 300 ELSE doc_id % 300 END AS domain FROM d WHERE doc_id % 4 != 1)"""
_SYNC_EVENTS_SQL = _SECOND_SQL + """, g AS (SELECT *, (floor((y + 4715) * 365.25) + floor(14 * 30.6001) + 1 + 2 - (y - 1) // 100 + (y - 1) // 400 - 1524.5)::DOUBLE AS jd FROM n QUALIFY row_number() OVER (PARTITION BY domain ORDER BY descriptor) = 1)
SELECT descriptor, 0::BIGINT AS row_id, domain, jd AS jd_start, NULL::DOUBLE AS jd_end, 'Event=a ' || source || CASE WHEN changed THEN ' moved' ELSE '' END AS eventdata FROM g
UNION ALL SELECT descriptor, 1, domain, 2422324.5::DOUBLE, NULL, 'Event=b' FROM g WHERE y <= 1920
UNION ALL SELECT descriptor, 2, domain, 2440587.5::DOUBLE, 2444239.5::DOUBLE, 'Event=' || lang FROM g"""
_SYNC_NOTES_SQL = _SECOND_SQL + """ SELECT d.descriptor, CASE WHEN n.doc_id IS NOT NULL THEN 'T' || d.doc_id || CASE WHEN d.changed THEN 'b' ELSE 'a' END END AS title, CASE WHEN n.doc_id IS NULL THEN 'orphan' WHEN d.doc_id % 6 = 0 THEN 'new' WHEN d.changed THEN 'changed' END AS action
FROM d LEFT JOIN n USING (doc_id) WHERE n.doc_id IS NOT NULL OR d.doc_id % 6 != 0"""


def _note_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with a table of five dates, of which some are none, go back or end too early; domains repeat."""
    i = F.col("doc_id")
    text = F.concat(F.lit("# Note\n<!-- domain: d/"), (i % 300).cast("string"), F.lit(" -->\n| Date | Event | Place |\n|---|---|---|\n| "), (i % 50 + 1900).cast("string"), F.lit(" | a "), "source", F.lit(" | x |\n| 1920 | b | y |\n| Date | again | |\n| never | c | z |\n| 1960 - 1950 | d | "), "lang", F.lit(" |\n| 1970 - 1980 | e | w |\n\n"), "text", F.lit("\n"))
    found = note_formats.tables_of(table(spark, sf_dir, "documents").select(i.alias("note_id"), F.concat("lang", F.lit("/note.md")).alias("path"), text.alias("text")))
    return found.withColumn("table_id", F.col("note_id").cast("long") * 1000 + F.col("table_id"))


def notes_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes to tables to dated events in order."""
    found, _ = events.events_of_tables(_note_tables(spark, sf_dir))
    data = F.concat_ws(";", F.transform("eventdata", lambda x: F.concat_ws("=", x["k"], x["v"])))
    return found.select(F.floor(F.col("table_id") / 1000).alias("note_id"), F.col("row_id").cast("long").alias("row_id"), "jd_start", "jd_end", data.alias("eventdata"))


def notes_to_events_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.events_of_tables(_note_tables(spark, sf_dir))[1]


_TABLE_ROWS_SQL = """WITH d AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id) AS n, 1900 + doc_id % 50 AS y FROM documents), g AS (SELECT * FROM d WHERE n = 1),
j AS (SELECT *, (floor((y + 4715) * 365.25) + floor(14 * 30.6001) + 1 + 2 - (y - 1) // 100 + (y - 1) // 400 - 1524.5)::DOUBLE AS jd FROM g),
r AS (SELECT doc_id, 0 AS row_id, jd AS jd_start, NULL::DOUBLE AS jd_end, 'Event=a ' || source || ';Place=x' AS eventdata FROM j
UNION ALL SELECT doc_id, 1, 2422324.5::DOUBLE, NULL, 'Event=b;Place=y' FROM j WHERE y <= 1920
UNION ALL SELECT doc_id, 5, 2440587.5::DOUBLE, 2444239.5::DOUBLE, 'Event=e;Place=w' FROM j)"""


def timeline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, domain and key together."""
    low, high = F.lit(2460315.5), F.lit(2460322.5)
    found = events.in_time(timeline(spark, sf_dir), low, high, True, False, False)
    return events.search(found, domains=["click/+", "view/+"], keys=["7"]).select("event_id", "jd_start")


def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter put together: sorted, without what is empty."""
    i = F.col("doc_id")
    fields = {"title": F.concat_ws(" ", F.lit("it's"), i), "context": F.when(i % 2 == 0, F.col("source")).otherwise(""), "lang": F.col("lang")}
    lists = {"tags": F.when(i % 3 == 0, F.array("lang", F.lit("two words"))).otherwise(F.array().cast("array<string>"))}
    made = assembly.with_front_matter(fields, lists, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(made, 1, 60).alias("head"), F.md5(made).alias("note_md5"))


def org_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawer put together, with quotes around what has spaces."""
    i = F.col("doc_id")
    fields = {"title": F.concat_ws(" ", F.lit("Note"), i), "creation_date": F.when(i % 2 == 0, "2020-01-01").otherwise("2020-01-01 10:00"), "context": F.lit("")}
    lists = {"tags": F.when(i % 3 == 0, F.array("lang", F.lit("two words"))).otherwise(F.array().cast("array<string>"))}
    made = assembly.with_drawer(F.lit("* Head\n"), fields, lists, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(made).alias("note_md5"))


def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    path = F.concat(F.when(i % 7 == 0, "/else/").otherwise("/notes/"), F.col("lang"), F.lit("/"), i, F.when(i % 5 == 0, ".txt").otherwise(".md"))
    existing = docs.where("doc_id % 11 = 0").select(F.concat(F.lit("/org/"), "lang", F.lit("/"), i, F.lit(".org")).alias("path"))
    return assembly.export_plan(docs.select(path.alias("path"), (i % 3 != 0).alias("complete")), "/notes", "/org/", existing)


def export_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# Head\n- **a** _b_\n"), F.regexp_replace("text", r"[^\p{L}\n .]", ""), F.when(F.col("doc_id") % 5 == 0, "\n* star").otherwise(""))
    path = F.concat(F.lit("/n/"), "lang", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".org"))
    return assembly.export_check(table(spark, sf_dir, "documents").select(path.alias("path"), text.alias("text")), "/de/")


def human_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of books named after the documents' first words; some titles end with numbers."""
    i = F.col("doc_id")
    head = F.substring(F.regexp_replace("text", r"\s+", " "), 1, 100)
    title_sort = F.concat(head, F.when(i % 3 == 0, " XIV").when(i % 3 == 1, " 12").otherwise(""))
    name = text_functions.human_filename(head, title_sort, F.concat(F.lit("A: "), "lang"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


def _clean_sql(x: str) -> str:
    out = f"""translate({x}, '<>:"/\\|?*', ',,,,,,,,,')"""
    for old, new in (("__", "_"), (" _ ", ", "), ("_ ", ", "), ("  ", " "), ("  ", " "), (",,", ","), (" ,", " "), ("  ", " "), ("  ", " ")):
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim({out})"


_FILENAME_SQL = rf"""WITH t AS (SELECT doc_id, lang, source, substring(regexp_replace(text, '\s+', ' ', 'g'), 1, 100) AS title FROM documents),
s AS (SELECT *, title || CASE doc_id % 3 WHEN 0 THEN ' XIV' WHEN 1 THEN ' 12' ELSE '' END AS ts, string_split(title, ' ') AS words FROM t),
n AS (SELECT *, coalesce(CASE WHEN regexp_full_match(words[1], '([0-9]*|[IVXLCDM]*)') THEN words[1] WHEN regexp_full_match(string_split(ts, ' ')[-1], '([0-9]*|[IVXLCDM]*)') THEN string_split(ts, ' ')[-1] ELSE list_filter(words, lambda w: regexp_full_match(w, '([0-9]*|[IVXLCDM]*)'))[1] END, '') AS num, {_clean_sql("ts")} AS c FROM s),
p AS (SELECT *, list_min(list_transform(list_filter([',', '.', '-', ':', ';'], lambda z: contains(c, z)), lambda z: CASE WHEN position(z IN substring(c, 31)) = 0 THEN -1 ELSE position(z IN substring(c, 31)) + 29 END)) AS sign, CASE WHEN position(' ' IN substring(c, 31)) = 0 THEN -1 ELSE position(' ' IN substring(c, 31)) + 29 END AS space FROM n),
k AS (SELECT *, trim(CASE WHEN length(c) <= 70 THEN c WHEN sign > 30 AND sign < 70 THEN substring(c, 1, sign) WHEN space >= 30 AND space < 70 THEN substring(c, 1, space) ELSE substring(c, 1, 70) END) AS short FROM p)
SELECT doc_id, source || '/' || trim(CASE WHEN num != '' AND NOT contains(short, num) THEN short || ' ' || num ELSE short END) || ' - A, ' || lang AS name FROM k"""


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two desks, averages of all events: the shared ones win over the local ones, which stand in where there
    are none; each with its place by task and timing."""
    rows = table(spark, sf_dir, "events")
    record = lambda part: library.moving_average(rows.where(part), ["event_type", "user_id"], "event_id", "value").select(F.col("event_type").alias("task"), "user_id", "timing")
    shared, local = record("event_id % 3 != 0"), record("event_id % 3 = 0")
    both = library.read_performance(shared, local).withColumn("side", F.lit("shared")).unionByName(library.read_performance(shared.where("timing is null and timing is not null"), local).withColumn("side", F.lit("local")))
    place = F.row_number().over(Window.partitionBy("side", "task").orderBy("timing", "user_id"))
    return both.select("side", "task", "user_id", F.round("timing", 6).alias("timing"), place.cast("long").alias("place"))


def caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = notes(spark, sf_dir).groupBy("hash").agg(F.min("ord").alias("ord"))
    cache = held.where("ord % 4 != 0").select("hash", (F.col("ord") % 7 == 0).alias("previous_failure")).unionByName(held.where("ord % 9 = 0").select(F.sha2(F.concat("hash", F.lit("x")), 256).alias("hash"), F.lit(True).alias("previous_failure")))
    return library.cache_statistics(cache, held, held.where("ord % 5 != 0"))


def _on_disk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    now = docs.select(F.concat(F.lit("/p/"), "doc_id").alias("path"), F.col("n_chars").alias("length"), (F.col("doc_id") % 4).alias("modified"))
    cache = docs.where("doc_id % 6 != 0").select(F.concat(F.lit("/p/"), "doc_id").alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("length"), F.lit(2).cast("long").alias("modified"), F.md5("text").alias("hash"), (F.col("doc_id") % 3 == 0).alias("previous_failure"))
    return now, cache


def to_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.to_hash(*_on_disk(spark, sf_dir)).select("path", "hash")


def to_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, again = (library.to_extract(*_on_disk(spark, sf_dir), retry).select("path", F.lit(retry).alias("retry")) for retry in (False, True))
    return plain.unionByName(again)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.listing(notes(spark, sf_dir), ["/en/", "7"]).select("descriptor")


def cloud_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the points of their places, of which the cloud lacks some."""
    all_ = chunks(spark, sf_dir)
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    cloud = vectors.first_points(all_.where("doc % 3 != 0").select("doc", "chunk_index", at(0).alias("x"), at(1).alias("y"), at(2).alias("z")), 100, "doc", "chunk_index")
    return vectors.with_points(all_.select("doc", "chunk_index"), cloud)


def sampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that a seed picks."""
    return vectors.sampled_points(chunks(spark, sf_dir).select("doc", F.col("chunk_index").cast("long").alias("chunk_index")), 50, 7, "doc", "chunk_index")


def import_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.pruned(notes(spark, sf_dir), 40, "ord").select("descriptor")


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events read as variables of three kinds."""
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "int").when(i % 3 == 1, "float").otherwise("bool")
    value = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.lit("TRUE")).when(i % 4 == 2, F.lit("2.5")).otherwise("many")
    return table(spark, sf_dir, "events").select("event_id", library.coerced(value, kind).alias("value"))


def flat_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.when(F.col("doc_id") % 3 == 0, F.array(F.array("lang", "source"), F.array(F.lit("x")))).when(F.col("doc_id") % 3 == 1, F.array(F.array("lang")))
    one = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    flat = F.array_join(text_functions.flat_list(nested), ",")
    return table(spark, sf_dir, "documents").select("doc_id", flat.alias("flat"), F.size(text_functions.string_list(one)).cast("long").alias("n"))


def restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("doc_id") % 5 == 0, "Date").when(F.col("doc_id") % 5 == 1, "----").when(F.col("doc_id") % 5 == 2, "-44").otherwise("1900")
    return events.without_restarts(table(spark, sf_dir, "documents").select("doc_id", F.array(first, F.col("lang")).alias("cells"))).select("doc_id")


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/lib/"), F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("/"))).otherwise(""), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".txt"))
    rows = table(spark, sf_dir, "documents").select(path.alias("path"), "source", F.when(F.col("doc_id") % 4 == 0, F.lit("2020-01-01")).alias("git"))
    kinds = {"src0": "md_notes", "src1": "orgmode"}
    return files.directly_in(rows, "/lib/", ["pdf"]).select("path", files.source_type(F.col("source"), kinds).alias("kind"), files.created(F.col("git").cast("timestamp"), F.lit("2021-01-01").cast("timestamp")).cast("date").cast("string").alias("created"))


def composed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters followed by their marks, as single characters."""
    name = F.concat(F.translate("lang", "eu", "ae"), F.lit("̈ô "), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", text_functions.clean_filename(text_functions.composed(name)).alias("name"))


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with and without a zone in UTC."""
    i = F.col("doc_id") % 4
    stamp = F.when(i == 0, "2020-05-01T10:00:00+02:00").when(i == 1, "2020-05-01T10:00:00Z").when(i == 2, "2020-05-01T10:00:00").otherwise("2020")
    return table(spark, sf_dir, "documents").select("doc_id", files.utc(stamp).alias("stamp"))


QUERIES = {
    "library_snapshot": (library_snapshot, libraries.QUERIES["sync_library"][1]),
    "publish_import": (publish_import, f"WITH {LIBRARY_SQL} SELECT hash, descriptor, 2::BIGINT AS version, 'ynyn' AS done FROM library WHERE ord % 3 != 0"),
    "index_documents": (index_documents, _INDEX_SQL),
    "index_totals": (index_totals, f"WITH {_UNINDEXED_SQL} SELECT model, count(*) AS docs, sum(n)::BIGINT AS chunks FROM counted GROUP BY model"),
    "search_highlight": (search_highlight, _HIGHLIGHT_SQL),
    "metadata_sync": (metadata_sync, _SYNC_EVENTS_SQL),
    "metadata_sync_notes": (metadata_sync_notes, _SYNC_NOTES_SQL),
    "extract_events": (extract_events, _EXTRACT_SQL),
    "notes_to_events": (notes_to_events, f"{_TABLE_ROWS_SQL} SELECT doc_id AS note_id, row_id::BIGINT AS row_id, jd_start, jd_end, eventdata FROM r"),
    "notes_to_events_sums": (notes_to_events_sums, f"{_TABLE_ROWS_SQL} SELECT count(DISTINCT doc_id) AS tables, count(*) AS added, count(DISTINCT doc_id) * 5 - count(*) AS skipped FROM r"),
    "timeline_search": (timeline_search, f"WITH {EVENTS_SQL} SELECT event_id, jd_start FROM tl WHERE jd_start >= 2460315.5 AND coalesce(jd_end, jd_start) <= 2460322.5 AND (context LIKE 'click%' OR context LIKE 'view%') AND user_id = 7"),
    "markdown_assembly": (markdown_notes, "WITH m AS (SELECT doc_id, '---' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'context: ' || source || chr(10) ELSE '' END || 'lang: ' || lang || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'tags:' || chr(10) || '- ' || lang || chr(10) || '- two words' || chr(10) ELSE '' END || 'title: ''it''''s ' || doc_id || '''' || chr(10) || '---' || chr(10) || text AS n FROM documents) SELECT doc_id, substring(n, 1, 60) AS head, md5(n) AS note_md5 FROM m"),
    "org_assembly": (org_notes, "SELECT doc_id, md5('* Head' || chr(10) || ':PROPERTIES:' || chr(10) || ':title: \"Note ' || doc_id || '\"' || chr(10) || ':creation_date:>' || CASE WHEN doc_id % 2 = 0 THEN '2020-01-01' ELSE '\"2020-01-01 10:00\"' END || '<' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN ':tags: ' || lang || ' \"two words\"' || chr(10) ELSE '' END || ':END:' || chr(10) || text) AS note_md5 FROM documents"),
    "export_plan": (export_plan, "WITH p AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'incomplete' WHEN doc_id % 5 = 0 THEN 'ending' WHEN doc_id % 7 = 0 THEN 'outside' WHEN doc_id % 11 = 0 THEN 'exists' END AS refusal FROM documents) SELECT CASE WHEN doc_id % 7 = 0 THEN '/else/' ELSE '/notes/' END || lang || '/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.md' END AS path, CASE WHEN refusal IS NULL THEN '/org/' || lang || '/' || doc_id || '.org' END AS target_path, refusal FROM p"),
    "export_check": (export_check, "SELECT count(*) AS tested, count(*) FILTER (doc_id % 5 = 0) AS failures FROM documents WHERE lang = 'de' AND doc_id % 2 = 0"),
    "human_filenames": (human_filenames, _FILENAME_SQL),
    "perf_read": (performance, "WITH r AS (SELECT CASE WHEN event_id % 3 != 0 THEN 'shared' ELSE 'local' END AS side, event_type AS task, user_id, list_reduce(list(value ORDER BY event_id), lambda a, v: (a * 4 + v) / 5) AS timing FROM events GROUP BY ALL) SELECT side, task, user_id, round(timing, 6) AS timing, row_number() OVER (PARTITION BY side, task ORDER BY timing, user_id) AS place FROM r"),
    "cache_statistics": (caches, f"WITH {LIBRARY_SQL}, h AS (SELECT hash, min(ord) AS ord FROM library GROUP BY hash) SELECT (count(*) FILTER (ord % 4 != 0) + count(*) FILTER (ord % 9 = 0))::BIGINT AS entries, (count(*) FILTER (ord % 4 != 0 AND ord % 7 = 0) + count(*) FILTER (ord % 9 = 0))::BIGINT AS failures, count(*) FILTER (ord % 9 = 0) AS orphans, count(*) FILTER (ord % 4 = 0) AS missing, (count(*) FILTER (ord % 4 != 0 AND ord % 5 = 0) + count(*) FILTER (ord % 9 = 0))::BIGINT AS deleted FROM h"),
    "hash_cache": (to_hash, "SELECT '/p/' || doc_id AS path, CASE WHEN doc_id % 6 != 0 AND doc_id % 5 != 0 AND doc_id % 4 = 2 THEN md5(text) END AS hash FROM documents"),
    "extract_worklist": (to_extract, "SELECT '/p/' || doc_id AS path, false AS retry FROM documents WHERE doc_id % 6 = 0 OR doc_id % 5 = 0 UNION ALL SELECT '/p/' || doc_id, true FROM documents WHERE doc_id % 6 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0"),
    "descriptor_listing": (listing, f"WITH {LIBRARY_SQL} SELECT descriptor FROM library WHERE descriptor LIKE '%/en/%' AND descriptor LIKE '%7%'"),
    "cloud_points": (cloud_points, f"WITH {CHUNKS_SQL}, c AS (SELECT * FROM chunks WHERE doc % 3 != 0 ORDER BY doc, chunk_index LIMIT 100) SELECT k.doc, k.chunk_index, c.embedding[1] AS x, c.embedding[2] AS y, c.embedding[3] AS z FROM chunks k LEFT JOIN c USING (doc, chunk_index)"),
    "cloud_sample": (sampled_points, "SELECT vec_id // 5 AS doc, vec_id % 5 AS chunk_index FROM embeddings ORDER BY md5('7-' || vec_id // 5 || '-' || vec_id % 5) LIMIT 50"),
    "import_limit": (import_limit, f"WITH {LIBRARY_SQL} SELECT descriptor FROM library ORDER BY ord LIMIT 40"),
    "variable_coercion": (variables, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN event_id::VARCHAR END WHEN 1 THEN CASE event_id % 4 WHEN 0 THEN event_id::DOUBLE::VARCHAR WHEN 2 THEN '2.5' END ELSE CASE WHEN event_id % 4 = 1 THEN 'true' END END AS value FROM events"),
    "flat_lists": (flat_lists, "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ',' || source || ',x' WHEN 1 THEN lang ELSE '' END AS flat, (doc_id % 2 = 0)::BIGINT AS n FROM documents"),
    "table_restarts": (restarts, "SELECT doc_id FROM documents WHERE doc_id % 5 > 1"),
    "folder_files": (folder_files, "SELECT '/lib/' || doc_id || '.PDF' AS path, CASE source WHEN 'src0' THEN 'md_notes' WHEN 'src1' THEN 'orgmode' END AS kind, CASE WHEN doc_id % 4 = 0 THEN '2020-01-01' ELSE '2021-01-01' END AS created FROM documents WHERE doc_id % 3 != 0 AND doc_id % 2 = 0"),
    "composed_names": (composed_names, "SELECT doc_id, nfc_normalize(translate(lang, 'eu', 'ae') || chr(776) || 'o' || chr(770) || ' ' || doc_id) AS name FROM documents"),
    "utc_stamps": (stamps, "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2020-05-01T08:00:00+00:00' WHEN 3 THEN '2020' ELSE '2020-05-01T10:00:00+00:00' END AS stamp FROM documents"),
}
