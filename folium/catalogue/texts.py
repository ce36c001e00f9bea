"""Queries over texts: chunks, cleaning, names, the key language."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import keys, text
from folium.operators import events, library
from folium.plans.samples import LIBRARY_SQL, library as notes, table

SIZE, OVERLAP = 300, 100
STEP = SIZE - OVERLAP
#: chunk count of a text in SQL
COUNT_SQL = f"CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {SIZE} THEN 1 ELSE (length(text) - {SIZE} + {STEP - 1}) // {STEP} + 1 END"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _of_text(columns: Callable[[Column], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in columns(F.col("text")).items()])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.chunks(F.col("text"), SIZE, OVERLAP)).alias("chunk_index", "chunk"))
    return cut.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("long").alias("n"))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = library.first_claims(notes(spark, sf_dir))
    return claimed.where("claim > 1").select("hash", "descriptor", F.col("claim").cast("long").alias("claim"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.first_claims(notes(spark, sf_dir)).where("claim = 1").select("hash", "descriptor")


def descriptor_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("descriptor")
    return notes(spark, sf_dir).select("descriptor", text.descriptor_source(d).alias("source"), text.descriptor_path(d).alias("path"), text.extension(d).alias("ext"), text.directory(d).alias("dir"))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = notes(spark, sf_dir).select(F.col("source_name").alias("source"), F.when(F.col("ord") % 4 == 0, "txt").otherwise(text.extension(F.col("descriptor"))).alias("ext"))
    return library.source_extensions(files)


def _words(column: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(column, r"[ \n]+"), 1, n), " ")


def _years(docs: DataFrame, rest: Column) -> DataFrame:
    marked = F.concat(F.substring("text", 1, 80), F.lit("\n"), (1790 + F.col("doc_id") % 320).cast("string"), F.lit(" "), rest)
    found = events.years_in_text(docs.select("doc_id", marked.alias("text")))
    return found.select("doc_id", F.col("at").cast("long").alias("place"), F.col("year").cast("long").alias("year"), F.md5("snippet").alias("snippet_md5"))


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years(_docs(spark, sf_dir), F.expr("substring(text, 81)"))


def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.sources import notes as formats

    body = F.concat(F.lit("See [[ "), F.upper("source"), F.lit(" | it]], [["), "lang", F.lit("]]\nand [["), "doc_id", F.lit("]] or [[open"))
    return formats.wiki_links(_docs(spark, sf_dir).select("doc_id", body.alias("text")), "doc_id").select("doc_id", "target")


def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lit("the|of* !and *tion*|b !x y*"), " ")
    per_doc = F.transform(words, lambda w: F.concat(w, F.col("lang")))
    out = _docs(spark, sf_dir).select("doc_id", F.explode(keys.highlight_terms(per_doc)).alias("term"))
    return out.select("doc_id", "term")


def important_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over whole texts."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(keys.without_stop_words(F.split("text", " ")), " ").alias("words"))


def _key_query(terms: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _docs(spark, sf_dir).where(keys.matches(F.col("text"), terms)).select("doc_id")


def _word(body: str, before: bool = True, after: bool = True) -> str:
    """A condition on the lower-case text in SQL, with word bounds spelled out."""
    return "regexp_matches(lower(text), '" + (r"(^|[^\p{L}\p{N}_])" if before else "") + body + (r"([^\p{L}\p{N}_]|$)" if after else "") + "', 's')"


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = notes(spark, sf_dir)
    copy = lambda h: F.struct(h.alias("hash"))
    meta = held.select("descriptor", F.substring("text", 1, 60).alias("title"), F.array("lang").alias("authors"), F.array("source_name").alias("tags"), F.substring("text", 61, 300).alias("description"), F.lit("notes").alias("context"), F.array(copy(F.lit("")), copy(F.col("hash"))).alias("representations"))
    found = library.keyword_search(meta, held.where("ord % 5 != 0"), "de|en !fr *a*", "SRC3")
    return found.select("descriptor", "hash", F.md5("summary").alias("summary_md5"))


_KEYWORD_SQL = f"""WITH {LIBRARY_SQL}, m AS (SELECT descriptor, hash, ord, text AS body, lower(concat_ws(' ', text[1:60], lang, source_name, text[61:360], 'notes')) AS text FROM library WHERE lower(source_name) = 'src3')
SELECT descriptor, hash, md5(body[61:260] || '...') AS summary_md5 FROM m WHERE ({_word("de")} OR {_word("en")}) AND NOT {_word("fr")} AND contains(text, 'a') AND hash IN (SELECT hash FROM library WHERE ord % 5 != 0)"""

_YEARS_SQL = "WITH y AS (SELECT doc_id, 1790 + doc_id % 320 AS year, length(text[1:80]) + 1 AS place, text[1:80] || chr(10) || (1790 + doc_id % 320) || ' ' || substr(text, 81) AS t FROM documents) SELECT doc_id, place, year, md5(translate(substr(t, greatest(place - 50, 0) + 1, place + 20 - greatest(place - 50, 0)), chr(10) || chr(13) || chr(9), '   ')) AS snippet_md5 FROM y WHERE year BETWEEN 1800 AND 2099"
_WORDS_SQL = "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda w: lower(w)), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in keys.STOP_WORDS) + ")), ' ') AS words FROM documents"

QUERIES = {
    "chunks": (chunks, f"SELECT doc_id, i AS chunk_index, md5(text[i * {STEP} + 1 : i * {STEP} + {SIZE}]) AS chunk_md5, length(text[i * {STEP} + 1 : i * {STEP} + {SIZE}]) AS n FROM documents, LATERAL (SELECT unnest(generate_series(0, {COUNT_SQL} - 1)) AS i)"),
    "chunk_counts": (_of_text(lambda t: dict(n=text.chunk_count(t).cast("long"), small=text.chunk_count(t, SIZE, OVERLAP).cast("long"))), f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 3072 THEN 1 ELSE (length(text) - 3072 + 2047) // 2048 + 1 END AS n, {COUNT_SQL} AS small FROM documents"),
    "chunk_spans": (_of_text(lambda t: dict(span=F.md5(text.span_chunk(t, F.col("doc_id") % 4, F.lit(3), SIZE, OVERLAP)), one=F.md5(text.chunk_at(t, F.col("doc_id") % 7, SIZE, OVERLAP)))), f"SELECT doc_id, md5(text[doc_id % 4 * {STEP} + 1 : doc_id % 4 * {STEP} + {SIZE + 2 * STEP}]) AS span, md5(text[doc_id % 7 * {STEP} + 1 : doc_id % 7 * {STEP} + {SIZE}]) AS one FROM documents"),
    "sentence_chunk": (
        _of_text(lambda t: dict(chunk=F.md5(text.sentence_chunk(t, F.col("doc_id") % 5, SIZE, OVERLAP)))),
        f"""WITH a AS (SELECT doc_id, text, doc_id % 5 AS i, {COUNT_SQL} AS n FROM documents), b AS (SELECT *, i * {STEP} AS s, CASE WHEN i > 0 THEN {STEP} ELSE 0 END AS back, CASE WHEN i < n - 1 THEN {STEP} ELSE {SIZE} END AS ahead FROM a),
c AS (SELECT *, text[s - back + 1 : s + ahead + {SIZE}] AS w FROM b), d AS (SELECT *, substr(w, 2, back) AS h FROM c), e AS (SELECT *, CASE WHEN contains(h, '.') THEN length(h) - instr(reverse(h), '.') + 1 END AS dot FROM d),
f AS (SELECT *, CASE WHEN dot IS NULL THEN back ELSE dot + length(w[dot + 1 :]) - length(regexp_replace(w[dot + 1 :], '^[. ]+', '')) END AS lo, instr(w[back + {SIZE} + 1 :], '.') AS p FROM e)
SELECT doc_id, md5(CASE WHEN s >= length(text) THEN '' ELSE regexp_replace(substr(w, lo + 1, greatest(CASE WHEN p > 0 THEN back + {SIZE} + p ELSE back + {SIZE} END - lo, 0)), '^\\s+|\\s+$', '', 'g') END) AS chunk FROM f""",
    ),
    "clean_text": (_of_text(lambda t: dict(clean=F.md5(text.clean_text(t)), n=F.length(text.clean_text(t)).cast("long"))), "WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[​‌‍­﻿]', '', 'g'), '[\\n\\r\\x08\\t ]+', ' ', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS clean, length(t) AS n FROM c"),
    "compressed_text": (_of_text(lambda t: dict(line=F.md5(text.compressed(t)))), "SELECT doc_id, md5(trim(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g'))) AS line FROM documents"),
    "dedup_documents": (dedup, f"WITH {LIBRARY_SQL} SELECT hash, descriptor FROM library QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ord) = 1"),
    "duplicate_report": (duplicates, f"WITH {LIBRARY_SQL} SELECT hash, descriptor, row_number() OVER (PARTITION BY hash ORDER BY ord) AS claim FROM library QUALIFY claim > 1"),
    "descriptor_parts": (descriptor_parts, f"WITH {LIBRARY_SQL} SELECT descriptor, source_name AS source, lang || '/' || ord || '.md' AS path, 'md' AS ext, '{{' || source_name || '}}/' || lang AS dir FROM library"),
    "source_ext_rollup": (rollup, f"WITH {LIBRARY_SQL}, f AS (SELECT source_name AS source, CASE WHEN ord % 4 = 0 THEN 'txt' ELSE 'md' END AS ext FROM library) SELECT source, ext, count(*) AS n FROM f GROUP BY CUBE (source, ext)"),
    "shorten": (
        _of_text(lambda t: dict(**{f"{a}_{n}": text.shorten(_words(t, 2), n, a) for a in ("left", "right", "middle") for n in (1, 8, 40)})),
        "WITH w AS (SELECT doc_id, array_to_string(regexp_split_to_array(text, '[ \\n]+')[1:2], ' ') AS t FROM documents) SELECT doc_id, "
        + ", ".join(f"CASE WHEN length(t) <= {n} THEN {'t || repeat(chr(32), ' + str(n) + ' - length(t))' if a != 'right' else 'repeat(chr(32), ' + str(n) + ' - length(t)) || t'} ELSE " + ("'⋯'" if n == 1 else f"t[1:{n - 1}] || '⋯'" if a == "left" else f"right(t, {n - 1}) || '⋯'" if a == "right" else f"t[1:{n // 3}] || '⋯' || right(t, {n - n // 3 - 1})") + f" END AS {a}_{n}" for a in ("left", "right", "middle") for n in (1, 8, 40))
        + " FROM w",
    ),
    "slice_tokens": (_of_text(lambda t: dict(part=F.md5(text.between_tokens(t, F.lit("THE"), F.lit("an"))))), "WITH p AS (SELECT doc_id, text, instr(lower(text), 'the') AS s, length(text) - instr(reverse(lower(text)), 'na') + 1 AS e, contains(lower(text), 'an') AS has FROM documents) SELECT doc_id, CASE WHEN s > 0 AND has AND e >= s THEN md5(text[s:e]) END AS part FROM p"),
    "language_base": (_of_text(lambda t: dict(base=text.language_base(F.concat(F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "_AT").otherwise("-x"))))), "SELECT doc_id, lang AS base FROM documents"),
    "safe_title": (_of_text(lambda t: dict(title=text.safe_title(F.substring(t, 1, 90)))), "SELECT doc_id, rtrim(regexp_replace(text[1:90], '[^\\p{L}\\p{N} \\-]', '', 'g')) AS title FROM documents"),
    "clean_filename": (
        _of_text(lambda t: dict(name=text.clean_filename(F.concat(F.translate(F.substring(t, 1, 90), ".", ":"), F.lit("__a _ b"))))),
        "SELECT doc_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(translate(translate(text[1:90], '.', ':') || '__a _ b', '<>:\"/\\|?*', ',,,,,,,,,'), '__', '_'), ' _ ', ', '), '_ ', ', '), '  ', ' '), '  ', ' '), ',,', ','), ' ,', ' '), '  ', ' '), '  ', ' ')) AS name FROM documents",
    ),
    "title_sort": (_of_text(lambda t: dict(title=text.without_article(F.concat(_words(t, 2), F.element_at(F.array(*[F.lit(x) for x in (", The", ", Die", ", A", "", ", Den")]), (F.col("doc_id") % 5 + 1).cast("int")))))), "SELECT doc_id, array_to_string(regexp_split_to_array(text, '[ \\n]+')[1:2], ' ') || CASE WHEN doc_id % 5 = 4 THEN ', Den' ELSE '' END AS title FROM documents"),
    "hash_hue": (
        _of_text(lambda t: dict(hue=F.round(text.rolling_hue(F.substring(F.sha2(t, 256), 1, 12)), 6))),
        "SELECT doc_id, round(abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(text)[1:12], ''), lambda c: ascii(c)::BIGINT)), lambda h, c: c + (((h * 32 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) - h) % 360) / 360.0, 6) AS hue FROM documents",
    ),
    "year_mentions": (years, _YEARS_SQL),
    "wiki_links": (wiki_links, "SELECT doc_id, unnest([lower(source), lang, doc_id::VARCHAR]) AS target FROM documents"),
    "highlight_terms": (highlight_terms, "SELECT doc_id, unnest(['the', 'of' || lang, 'tion', 'b' || lang, 'y' || lang]) AS term FROM documents"),
    "important_words": (important_words, _WORDS_SQL),
    "keyword_match_and": (_key_query(["the", "of"]), f"SELECT doc_id FROM documents WHERE {_word('the')} AND {_word('of')}"),
    "keyword_match_or": (_key_query(["und|les"]), f"SELECT doc_id FROM documents WHERE {_word('und')} OR {_word('les')}"),
    "keyword_match_not": (_key_query(["!the", "!de"]), f"SELECT doc_id FROM documents WHERE NOT {_word('the')} AND NOT {_word('de')}"),
    "keyword_match_not_or": (_key_query(["!the|de"]), f"SELECT doc_id FROM documents WHERE NOT (regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])the') OR regexp_matches(lower(text), 'de([^\\p{{L}}\\p{{N}}_]|$)'))"),
    "keyword_match_prefix": (_key_query(["é*"]), f"SELECT doc_id FROM documents WHERE {_word('é', after=False)}"),
    "keyword_match_suffix": (_key_query(["*ble", "!*xx"]), f"SELECT doc_id FROM documents WHERE {_word('ble', before=False)} AND NOT {_word('xx', before=False)}"),
    "keyword_match_inner": (_key_query(["th*ble", "*"]), "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])th[^\\n]*ble([^\\p{L}\\p{N}_]|$)')"),
    "keyword_search": (keyword_search, _KEYWORD_SQL),
}
