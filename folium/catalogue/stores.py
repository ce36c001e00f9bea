"""Queries over caches and stores: texts of PDF files, vectors by pointer, metadata fields, notes as Org."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import metadata, pdf, pointers
from folium.plans.samples import CHUNKS_SQL, chunks, library as notes, table
from folium.sources import assembly, snapshots
from folium.sources import notes as formats

#: Of the files made of documents: every seventh is broken, of which every second has a text by the other extractor;
#: every eleventh has short pages alone.
_PAGES = ("Page one of ", "\f-----\fshort\f")


def _whole(content: bytes) -> str:
    if not content.startswith(b"\xffB+"):
        raise ValueError("broken")
    return content[3:].decode()


def _pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    pages = F.concat(F.lit(_PAGES[0]), i, F.lit(_PAGES[1]), "text")
    broken = F.concat(F.unhex(F.lit("FF")), F.encode(F.concat(F.when(i % 14 == 0, "B+").otherwise("B-"), F.lit("-----\nall of "), i), "UTF-8"))
    content = F.when(i % 7 == 0, broken).when(i % 11 == 0, F.encode(F.concat(F.lit("a\f-----\f"), i % 1000), "UTF-8")).otherwise(F.encode(pages, "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(i.cast("string"), 256).alias("hash"), F.octet_length(content).cast("long").alias("file_size"), content.alias("content"))


def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache after a first run over some files, a run over all with failures kept, and one that tries them again with
    another extractor; then it loses what the library does not have."""
    given, cache = _pdf_files(spark, sf_dir), spark.createDataFrame([], pdf.CACHE)
    root = snapshots.work_folder(spark)
    for name, files, whole, retry in (("first", given.where("doc_id % 3 = 0"), pdf.no_text, False), ("all", given, pdf.no_text, False), ("again", given, _whole, True)):
        snapshots.write(root, {name: pdf.updated(files, cache, pdf.text_pages, whole, retry)})
        cache = snapshots.read(spark, root, name)
    kept = pdf.cleaned(cache, given.where("doc_id % 5 != 0"))
    return kept.select("hash", "file_size", "previous_failure", F.md5("text").alias("text_md5"))


_PDF_SQL = r"""WITH d AS (SELECT doc_id, text, sha256(doc_id::VARCHAR) AS hash, CASE WHEN doc_id % 7 = 0 THEN 'broken' WHEN doc_id % 11 = 0 THEN 'short' ELSE 'pages' END AS kind FROM documents WHERE doc_id % 5 != 0),
t AS (SELECT hash, kind, CASE kind WHEN 'broken' THEN 3 + 6 + strlen('all of ' || doc_id) WHEN 'short' THEN 2 + 6 + strlen((doc_id % 1000)::VARCHAR) ELSE strlen('Page one of ' || doc_id) + 13 + strlen(text) END AS file_size,
CASE WHEN kind = 'broken' AND doc_id % 14 = 0 THEN 'all of ' || doc_id WHEN kind = 'pages' THEN replace('Page one of ' || doc_id || CASE WHEN length(text) >= 8 AND trim(text, E' \t\n\r') != '-----' THEN E'\n' || text ELSE '' END, E'-----\n', '') END AS x FROM d)
SELECT hash, file_size::BIGINT AS file_size, x IS NULL AS previous_failure, md5(x) AS text_md5 FROM t"""


def _store(spark: SparkSession, sf_dir: str) -> tuple[pointers.Store, DataFrame]:
    """A store after documents were appended, some went, and others came."""
    all_ = chunks(spark, sf_dir).select(F.col("doc").cast("string").alias("hash"), "doc", "chunk_index", "embedding")
    order, root = F.col("doc"), snapshots.work_folder(spark)

    def kept(store: pointers.Store) -> pointers.Store:
        snapshots.write(root, store._asdict())
        return pointers.Store(**snapshots.read_all(spark, root, ["index", "rows"]))

    store = kept(pointers.appended(pointers.empty(all_), all_.where("doc % 3 != 0 and chunk_index < 1 + doc % 5"), order))
    store = kept(pointers.purged(store, all_.where("doc % 4 != 0")))
    return kept(pointers.appended(store, all_.where("doc % 3 = 0 or doc % 8 = 0"), order)), all_


def pointer_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's vectors are, and what is there."""
    store, _ = _store(spark, sf_dir)
    firsts = pointers.found(store).groupBy("hash").agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 6).alias("x"))
    return store.index.join(firsts, "hash").select(F.col("hash").cast("long").alias("doc"), "start", "len", "n", "x")


def pointer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, all_ = _store(spark, sf_dir)
    return pointers.checked(store, all_.where("doc % 9 != 0"))


_STORE_SQL = f"""WITH {CHUNKS_SQL}, a AS (SELECT doc, count(*) AS len FROM chunks WHERE doc % 3 != 0 AND chunk_index < 1 + doc % 5 GROUP BY doc), p AS (SELECT * FROM a WHERE doc % 4 != 0),
b AS (SELECT doc, count(*) AS len FROM chunks WHERE (doc % 3 = 0 OR doc % 8 = 0) AND doc NOT IN (SELECT doc FROM p) GROUP BY doc),
o AS (SELECT 0 AS part, * FROM p UNION ALL SELECT 1, * FROM b), s AS (SELECT *, coalesce(sum(len) OVER (ORDER BY part, doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with headers of many kinds: other names, lists that are one value, fields that are missing."""
    i, nl = F.col("ord"), F.lit("\n")
    line = lambda some, *parts: F.when(some, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], nl)).otherwise("")
    header = F.concat(line(i % 2 == 0, "title: 'T ", i, "'"), line(i % 3 == 0, "creation: '2020-01-02'"), line(i % 5 == 0, "creation_date: '2019'"), line(i % 4 == 0, "pubdate: '1999'"), line(i % 7 != 0, "uuid: u-", i), line(i % 6 != 0, "context: own/", F.col("lang")), line(i % 2 == 1, "tags: [", F.col("lang"), ", 'two words']"), line(i % 4 == 1, "authors: Some Body"), line(i % 8 == 0, "icon: x"))
    text = F.concat(F.lit("---\n"), header, F.lit("---\n# Head\n"), F.regexp_replace("text", r"[^\p{L}\n .]", ""))
    return notes(spark, sf_dir).select("descriptor", "hash", "ord", F.lit("2021-01-01").alias("created"), text.alias("text"), F.concat(F.lit("/n/"), "lang", F.lit("/"), i, F.lit(".md")).alias("path"))


def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the metadata of notes, the list fields put together."""
    given = _notes(spark, sf_dir)
    parts = formats.parsed_headers(given.withColumn("note_id", F.col("descriptor")))
    made = metadata.entries(given.join(parts.select(F.col("note_id").alias("descriptor"), "header"), "descriptor"))
    lists = {f: F.array_join(f, "|") for f in metadata.LISTS}
    return made.withColumns(lists).withColumn("representations", F.concat_ws("|", "representations.doc_descriptor", "representations.hash", "representations.doc_date"))


_HEADS_SQL = """library AS (SELECT sha256(text) AS hash, '{' || source || '}/' || lang || '/' || doc_id || '.md' AS descriptor, lang, doc_id AS i, text FROM documents),
m AS (SELECT *, CASE WHEN i % 7 != 0 THEN 'u-' || i ELSE substring(md5(descriptor), 1, 8) || '-' || substring(md5(descriptor), 9, 4) || '-' || substring(md5(descriptor), 13, 4) || '-' || substring(md5(descriptor), 17, 4) || '-' || substring(md5(descriptor), 21, 12) END AS uuid,
CASE WHEN i % 6 != 0 THEN 'own/' || lang ELSE lang END AS context, CASE WHEN i % 3 = 0 THEN '2020-01-02' WHEN i % 5 = 0 THEN '2019' ELSE '2021-01-01' END AS created, CASE WHEN i % 4 = 0 THEN '1999' ELSE '' END AS published, CASE WHEN i % 2 = 0 THEN 'T ' || i ELSE '' END AS title, CASE WHEN i % 4 = 1 THEN 'Some Body' ELSE '' END AS authors, CASE WHEN i % 8 = 0 THEN 'x' ELSE '' END AS icon FROM library)"""


def org_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as Org with a drawer of all fields; what is text of emphasis or code was left out of them."""
    made = assembly.org_documents(_notes(spark, sf_dir))
    return made.select("path", "complete", F.md5(F.regexp_extract("text", r"(?s)^(.*?:END:\n\* Head\n)", 1)).alias("drawer_md5"))


_DRAWER_SQL = f"""WITH {_HEADS_SQL}, r AS (SELECT *, '{{"doc_descriptor": "' || descriptor || '", "hash": "' || hash || '", "format": "md", "doc_date": "' || created || '"}}' AS json FROM m)
SELECT '/n/' || lang || '/' || i || '.md' AS path, i % 7 != 0 AND i % 6 != 0 AS complete, md5(':PROPERTIES:' || chr(10) || ':uuid: ' || uuid || chr(10) || ':representations: "' || replace(json, '"', '\\"') || '"' || chr(10) || CASE WHEN authors != '' THEN ':authors: "Some Body"' || chr(10) ELSE '' END || ':context: ' || context || chr(10) || ':creation_date:>' || created || '<' || chr(10) || CASE WHEN published != '' THEN ':publication_date:>1999<' || chr(10) ELSE '' END
|| CASE WHEN i % 2 = 1 THEN ':tags: ' || lang || ' "two words"' || chr(10) ELSE '' END || CASE WHEN title != '' THEN ':title: "' || title || '"' || chr(10) ELSE '' END || ':normalized_filename: ' || i || '.md' || chr(10) || CASE WHEN icon != '' THEN ':icon: x' || chr(10) ELSE '' END || ':END:' || chr(10) || '* Head' || chr(10)) AS drawer_md5 FROM r"""


QUERIES = {
    "pdf_texts": (pdf_texts, _PDF_SQL),
    "pointer_store": (pointer_store, f"{_STORE_SQL}, x AS (SELECT s.doc, round(sum(c.embedding[1]), 6) AS x FROM s JOIN chunks c ON s.doc = c.doc AND c.chunk_index < s.len GROUP BY s.doc) SELECT s.doc, start::BIGINT AS start, len, len AS n, x FROM s JOIN x USING (doc)"),
    "pointer_check": (pointer_check, f"{_STORE_SQL}, l AS (SELECT DISTINCT doc FROM chunks WHERE doc % 9 != 0) SELECT count(s.doc) AS documents, sum(len)::BIGINT AS rows, sum(len)::BIGINT AS lengths, 0::BIGINT AS negatives, 0::BIGINT AS faults, count(*) FILTER (l.doc IS NULL) AS debris, count(*) FILTER (s.doc IS NULL) AS missing FROM s FULL JOIN l ON s.doc = l.doc"),
    "metadata_fields": (metadata_fields, f"WITH {_HEADS_SQL} SELECT descriptor, uuid, descriptor || '|' || hash || '|' || created AS representations, authors, '' AS identifiers, '' AS languages, context, created AS creation_date, published AS publication_date, '' AS publisher, '' AS series, CASE WHEN i % 2 = 1 THEN lang || '|two words' ELSE '' END AS tags, title, '' AS title_sort, i || '.md' AS normalized_filename, '' AS description, icon, i % 7 != 0 AND i % 6 != 0 AS complete FROM m"),
    "org_documents": (org_documents, _DRAWER_SQL),
}
