"""SQL for the operators that SQL can express: exact repeats, near duplicates, exact search and hard
negatives, and main texts of pages that stand in one article element."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _repeats(units: str, window: int) -> str:
    """Common tables over units(doc_id, list): gone(doc_id, pos), the places that an earlier window covers."""
    return f"""units AS ({units}),
windows AS (SELECT doc_id, unnest(range(1, len(list) - {window} + 2)) AS pos, list FROM units WHERE len(list) >= {window}),
keyed AS (SELECT doc_id, pos, md5(array_to_string(list[pos:pos + {window - 1}], ' ')) AS key FROM windows),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM keyed) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {window})) AS pos FROM later)"""


OP2 = rf"""WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS pos FROM texts WHERE length(h) >= 200),
keyed AS (SELECT doc_id, pos, md5(substring(h, pos * 2 + 1, 200)) AS key FROM places),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM keyed) WHERE n > 1),
marked AS (SELECT doc_id, pos, pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 AS apart FROM later),
numbered AS (SELECT doc_id, pos, sum(CASE WHEN apart IS NULL OR apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked),
spans AS (SELECT doc_id, span, min(pos) AS s, max(pos) + 100 AS e FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
joined AS (SELECT t.doc_id, any_value(h) AS h, count(s) AS n_spans, coalesce(sum(e - s), 0) AS n_removed, coalesce(string_agg(substring(h, before * 2 + 1, (s - before) * 2), '' ORDER BY s), '') || substring(any_value(h), coalesce(max(e), 0) * 2 + 1) AS kept FROM texts t LEFT JOIN gaps g ON t.doc_id = g.doc_id GROUP BY t.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM joined"""

OP3 = f"""WITH {_repeats(f"SELECT doc_id, {_WORDS} AS list FROM documents", 20)},
placed AS (SELECT doc_id, unnest(list) AS word, unnest(range(1, len(list) + 1)) AS pos FROM units),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(list)::BIGINT AS n_words, (len(list) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM units LEFT JOIN left_over USING (doc_id)"""

OP6 = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY ALL),
one AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM classes),
common AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM one a JOIN one b ON a.shingle = b.shingle AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id),
links AS (SELECT a, b FROM common WHERE 100 * n >= 85 * (na + nb - n) UNION ALL SELECT b, a FROM common WHERE 100 * n >= 85 * (na + nb - n)),
reach AS (SELECT id AS node, id AS least FROM classes UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node WHERE r.least < l.b),
roots AS (SELECT node, min(least) AS root FROM reach GROUP BY node),
found AS (SELECT s.doc_id, len(s.s) AS n, coalesce(r.root, s.doc_id) AS component FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN roots r ON r.node = c.id)
SELECT doc_id, n::BIGINT AS n_shingles, component AS component_id, component = doc_id AS kept FROM found"""

OP9 = """WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5"""

OP11 = r"""WITH mains AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS inner_html FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?(h1|p|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM mains),
decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM plain),
texts AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts"""

OP13 = """WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND a.vec_id != c.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
pairs AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 10"""

SQL = {"op2_suffix_arrays": OP2, "op3_suffix_trees": OP3, "op6_near_dedup": OP6, "op9_topk_search": OP9, "op11_html_extraction": OP11, "op13_hard_negatives": OP13}
