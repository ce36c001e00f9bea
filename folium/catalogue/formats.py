"""Queries over note formats, on notes made of the sample documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.plans.samples import table
from folium.sources import files, notes


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    start = F.when(i % 4 == 0, "---\ntitle: a\n---\n").when(i % 4 == 1, "\n---\nlang: b\n---\n").when(i % 4 == 2, "---\nopen: c\n").otherwise("")
    header, body = notes.front_matter(F.concat(start, "text"))
    return _docs(spark, sf_dir).select("doc_id", header.alias("header"), F.md5(body).alias("body_md5"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("---\ntitle: 'A "), "lang", F.lit("'\ntags: [x, "), "source", F.lit("]\n---\nbody"))
    found = notes.parsed_headers(_docs(spark, sf_dir).select(F.col("doc_id").alias("note_id"), text.alias("text")))
    get = lambda p: F.get_json_object("header", p)
    return found.select("note_id", get("$.title").alias("title"), get("$.tags[1]").alias("tag"), "body")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat(F.lit("# Note\n<!-- domain: d/"), "lang", F.lit(" -->\n| Date | Event |\n|---|:-:|\n| 19"), (i % 90 + 10).cast("string"), F.lit(" | a "), "source", F.lit(" |\n| 2000 | b |\n\n```\n| x |\n|---|\n```\n| Date | Big Deal. |\n| --- | --- |\n| 1 | 2 |\n\n| lost | at end |\n|---|---|\n| 1 | 2 |"))
    found = notes.tables_of(_docs(spark, sf_dir).select(i.alias("note_id"), F.concat("lang", F.lit("/note.md")).alias("path"), text.alias("text")))
    rows = found.select("note_id", "table_id", F.col("metadata")["domain"].alias("domain"), F.array_join("columns", ",").alias("columns"), F.posexplode("rows").alias("row_id", "row"))
    return rows.select(F.col("note_id").cast("long").alias("note_id"), F.col("table_id").cast("long").alias("table_id"), "domain", "columns", F.col("row_id").cast("long").alias("row_id"), F.array_join("row", ",").alias("row"))


_TABLES_SQL = """SELECT doc_id AS note_id, 0::BIGINT AS table_id, 'd/' || lang AS domain, 'Date,Event' AS columns, 0::BIGINT AS row_id, '19' || (doc_id % 90 + 10) || ',a ' || source AS row FROM documents
UNION ALL SELECT doc_id, 0, 'd/' || lang, 'Date,Event', 1, '2000,b' FROM documents UNION ALL SELECT doc_id, 1, lang || '/note/Big_Deal', 'Date,Big Deal.', 0, '1,2' FROM documents"""


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('before\n:PROPERTIES:\n:title: "A \\"b\\" '), "lang", F.lit('"\n:tags: one two x\n:when: <2020-01-01 Wed>\n:END:\nbody '), "source")
    found = notes.org_properties(_docs(spark, sf_dir).select(F.col("doc_id").alias("note_id"), text.alias("text")))
    get = lambda p: F.get_json_object("properties", p)
    return found.select("note_id", "prefix", get("$.title").alias("title"), get("$.tags").alias("tags"), get("$.when").alias("when"), "body")


def _round_trips(docs: DataFrame, length: Column) -> DataFrame:
    text = F.concat(F.lit("# Head\n\n- item **bold** and _it_ `code`\n\n> quote [a](http://x.y)\n\n```py\nx = *1*\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$$\nx\n$$\n"), F.substring(F.regexp_replace("text", r"[^\p{L}\n .]", ""), F.lit(1), length), F.when(F.col("doc_id") % 5 == 0, "\n* star").otherwise(""))
    return notes.round_trips(docs.select(F.col("doc_id").alias("note_id"), text.alias("text")))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trips(_docs(spark, sf_dir), F.length("text"))


#: Lines of Markdown and what they are in Org; {} stands for letters of a document.
_TO_ORG = [("# Head {}", "* Head {}"), ("- **{}** and *a* _it_ `co_de`", "- *{}* and /a/ /it/ ~co_de~"), ("* star $x+1$ and $$y$$ for {}", "- star \\(x+1\\) and \\[y\\] for {}"), ("see [{}](http://x.y) and [[note|{}]] [[plain]] <http://a.b>", "see [[http://x.y][{}]] and [[note][{}]] [[plain]] [[http://a.b]]"), ("![pic](p.png) a_b_c {}", "[[p.png]] a_b_c {}"), ("__{}__", "*{}*"), ("| a | b |", "| a | b |"), ("|---|---|", "|---+---|")]
#: And of Org in Markdown.
_TO_MARKDOWN = [("** Head {}", "## Head {}"), ("- *{}* and (/it/) ~code~ =verb=", "- **{}** and (_it_) `code` `verb`"), ("-*a*- '*b*' *c*, {}", "-*a*- '*b*' **c**, {}"), ("\\(x+1\\) [[http://x.y][{}]] [[p.png]] [[http://a.b]] [[note]]", "$x+1$ [{}](http://x.y) ![](p.png) <http://a.b> [[note]]"), ("http://a.b/c/d/e {}", "http://a.b/c/d/e {}"), ("|---+---|", "|---|---|")]


def _converted(to: str, lines: list[tuple[str, str]]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        letters = F.regexp_replace("text", r"[^\p{L}]", "")
        text = F.replace(F.lit("\n".join(a for a, _ in lines)), F.lit("{}"), letters)
        found = notes.converted(_docs(spark, sf_dir).select(F.col("doc_id").alias("note_id"), text.alias("text")), to)
        return found.select("note_id", F.md5("text").alias("text_md5"))

    text = "\n".join(b for _, b in lines).replace("'", "''").replace("\n", "' || chr(10) || '")
    return query, f"SELECT doc_id AS note_id, md5(replace('{text}', '{{}}', regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) AS text_md5 FROM documents"


def opf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages made of the documents, through the XML functions."""
    x = F.concat(F.lit("<metadata><title>T "), "doc_id", F.lit('</title><creator role="aut">A '), "lang", F.lit('</creator><creator role="ill">B</creator><subject>s1</subject><subject>'), "source", F.lit('</subject><language>'), "lang", F.lit('</language><identifier scheme="ISBN">978</identifier><identifier scheme="calibre">7</identifier><meta name="calibre:title_sort" content="T, The"/></metadata>'))
    raw = _docs(spark, sf_dir).select("doc_id", F.from_xml(x, files.OPF).alias("b")).select("b.*")
    b = files.opf_books(raw)
    return b.select("title", *[F.array_join(c, ",").alias(c) for c in ("authors", "tags", "languages", "identifiers")], "title_sort")


QUERIES = {
    "frontmatter_split": (front_matter, "WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'title: a' || chr(10) WHEN 1 THEN 'lang: b' || chr(10) ELSE '' END AS header, CASE WHEN doc_id % 4 = 2 THEN '---' || chr(10) || 'open: c' || chr(10) || text ELSE text END AS body FROM documents) SELECT doc_id, header, md5(body) AS body_md5 FROM d"),
    "frontmatter_parse": (headers, "SELECT doc_id AS note_id, 'A ' || lang AS title, source AS tag, 'body' AS body FROM documents"),
    "note_tables": (tables, _TABLES_SQL),
    "org_properties": (properties, "SELECT doc_id AS note_id, 'before' || chr(10) AS prefix, 'A \"b\" ' || lang AS title, '[\"one\",\"two\"]' AS tags, '2020-01-01 Wed' AS \"when\", 'body ' || source AS body FROM documents"),
    "md_org_roundtrip": (round_trip, "SELECT doc_id AS note_id, doc_id % 5 != 0 AS same FROM documents"),
    "markdown_to_org": _converted("org", _TO_ORG),
    "org_to_markdown": _converted("markdown", _TO_MARKDOWN),
    "opf_metadata": (opf, "SELECT 'T ' || doc_id AS title, 'A ' || lang AS authors, 's1,' || source AS tags, lang AS languages, 'ISBN/978,calibre_id/7' AS identifiers, 'T' AS title_sort FROM documents"),
}
