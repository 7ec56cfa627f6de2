"""SQL equivalents of the queries of ``plans.queries``, in the dialect of DuckDB."""

from loamstack.functions.text import LIGATURES, STOPWORDS
from loamstack.plans.queries import ASKED, ROOT

_VALUE = "ltrim(regexp_replace(lower(trim(hash)), '^0x', ''), '0')"
_CODES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WHITE = "(" + " || ".join(f"chr({c})" for c in _CODES) + ")"
# DuckDB's \s is ASCII only; a class of the same characters.
_BLANK = "[" + "".join(f"\\x{{{c:X}}}" for c in _CODES) + "]"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_ASKED = "asked(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ")"


def _terms(column: str) -> str:
    """Index terms. DuckDB lowers a dotted capital I to a plain one, where others keep the dot as a mark of its own."""
    return f"list_filter(regexp_extract_all(lower(replace({column}, 'İ', 'i' || chr(775))), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) < 40)"


_CHUNKS = "piece AS (SELECT DISTINCT chunk_key, path, ordinal, text, page FROM chunks WHERE chunk_key IS NOT NULL)"
_TEXT = f"words AS (SELECT chunk_key, 'text' AS field, coalesce({_terms('text')}, []) AS t FROM piece)"
_BOTH = f"words AS (SELECT chunk_key, 'text' AS field, coalesce({_terms('text')}, []) AS t FROM piece UNION ALL SELECT chunk_key, 'path', coalesce({_terms('path')}, []) FROM piece)"
_BM25 = f"""
lens AS (SELECT chunk_key, field, len(t) AS len FROM words),
stat AS (SELECT field, count(*)::DOUBLE AS n, avg(len) AS avg FROM lens GROUP BY field),
post AS (SELECT chunk_key, field, term, count(*)::DOUBLE AS tf FROM (SELECT chunk_key, field, unnest(t) AS term FROM words) GROUP BY ALL),
freq AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
wanted AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_terms('query')}) AS term FROM asked) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
scored AS (
  SELECT query_id, chunk_key, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))), 9) AS score
  FROM post JOIN freq USING (field, term) JOIN lens USING (chunk_key, field) JOIN stat USING (field) JOIN wanted USING (term) GROUP BY ALL)
"""
_BEST = "SELECT query_id, chunk_key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM scored) WHERE rank <= 20"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_VECTORS = """
vec AS (SELECT DISTINCT ON (chunk_key) chunk_key, vecs AS embedding FROM vecs WHERE len(vecs) = 384 AND len(list_filter(vecs, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
given AS (SELECT row_number() OVER (ORDER BY chunk_key) AS query_id, embedding AS q FROM vec QUALIFY query_id <= 6)
"""
_NEAR = f"near AS (SELECT query_id, chunk_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM (SELECT query_id, chunk_key, round({_DOT.format(a='q', b='embedding')}, 6) AS score FROM vec CROSS JOIN given) QUALIFY rank <= 20)"


def _fused(words: str) -> str:
    return f"""
WITH {_ASKED}, {_CHUNKS}, {words}, {_BM25}, {_VECTORS}, {_NEAR},
sparse AS (SELECT query_id, path, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, ordinal) AS rank FROM scored JOIN piece USING (chunk_key) QUALIFY rank <= 20),
both_sides AS (SELECT query_id, path, ordinal, rank FROM near JOIN piece USING (chunk_key) UNION ALL SELECT query_id, path, ordinal, rank FROM sparse),
fused AS (SELECT query_id::INT AS query_id, path, ordinal, round(sum(1.0::DOUBLE / (59 + rank)), 12) AS score FROM both_sides GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, ordinal) AS rank FROM fused QUALIFY rank <= 5),
hits AS (SELECT query_id, path, ordinal AS chunk_index, round((n - rank + 1) / n::DOUBLE * 100) / 100 AS score, text, page, rank
         FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ranked) JOIN piece USING (path, ordinal))
"""


def _lines(column: str) -> str:
    """Lines with white space collapsed and cut at both ends."""
    return f"list_transform(string_split(replace({column}, chr(13) || chr(10), chr(10)), chr(10)), lambda l: trim(regexp_replace(l, '{_BLANK}+', ' ', 'g'), {_WHITE}))"


_LIGATED = "text"
for _a, _b in LIGATURES.items():
    _LIGATED = f"replace({_LIGATED}, '{_a}', '{_b}')"
_PARTS = f"list_filter(list_transform(string_split_regex(text, '\\n\\n|\\r\\n\\r\\n'), lambda p: trim(p, {_WHITE})), lambda p: p <> '')"
_EXT = "CASE WHEN lower(regexp_extract(path, '([^/]*)$', 1)) IN ('dockerfile', 'makefile') THEN lower(regexp_extract(path, '([^/]*)$', 1)) ELSE regexp_extract(lower(regexp_extract(path, '([^/]*)$', 1)), '^.+\\.([^.]+)$', 1) END"
_NEWEST = "scan AS (SELECT path, size, mtime_secs FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, scan_id DESC) AS r FROM file_scans WHERE path IS NOT NULL) WHERE r = 1)"

_DENSE = f"""
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, round({_DOT.format(a='q.embedding', b='v.embedding')}, 6) AS score
    FROM embeddings v CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE score >= {{floor}})
WHERE rank <= 10
"""



def _chunked(base: str) -> str:
    """Chunks of the rows (id, text) of ``base``: (id, i, kind, step, piece), in their order within an id."""
    return f"""
base AS ({base}),
para AS (SELECT id, {_PARTS} AS p FROM base WHERE text IS NOT NULL),
pack AS (
  SELECT id, p, 1 AS i, '' AS held, NULL::VARCHAR AS piece FROM para
  UNION ALL
  SELECT id, p, i + 1, CASE WHEN i > len(p) OR big THEN '' WHEN over THEN CASE WHEN tail = '' THEN '' ELSE tail || ' ' END || p[i] || chr(10) ELSE held || p[i] || chr(10) END,
    CASE WHEN over OR i > len(p) THEN trim(held, {_WHITE}) END
  FROM (
    SELECT *, coalesce(length(p[i]) > 1000, false) AS big, i <= len(p) AND held <> '' AND (length(p[i]) > 1000 OR length(held) + length(p[i]) + 1 > 1000) AS over,
      CASE WHEN length(trim(held, {_WHITE})) <= 120 THEN trim(held, {_WHITE})
        WHEN regexp_matches(right(trim(held, {_WHITE}), 120), '{_BLANK}') THEN regexp_extract(right(trim(held, {_WHITE}), 120), '(?s)^.*?{_BLANK}+(.*)$', 1)
        ELSE right(trim(held, {_WHITE}), 120) END AS tail
    FROM pack WHERE i <= len(p) + 1)),
cut AS (
  SELECT id, i, 0 AS step, NULL::VARCHAR AS piece, t AS rest FROM (SELECT id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM para) WHERE length(t) > 1000
  UNION ALL
  SELECT id, i, step + 1, trim(substr(rest, 1, n), {_WHITE}), substr(rest, n + 1) FROM (
    SELECT id, i, step, rest, CASE WHEN length(rest) <= 1000 THEN length(rest)
      WHEN regexp_matches(substr(rest, 1, 1000), '\\. ') THEN length(regexp_extract(substr(rest, 1, 1000), '(?s)^(.*)\\. ', 1)) + 1 ELSE 1000 END AS n
    FROM cut WHERE rest <> '')),
chunked AS (
  SELECT id, i - 1 AS i, 0 AS kind, 0 AS step, piece FROM pack WHERE length(piece) >= 8
  UNION ALL SELECT id, i, 1, step, piece FROM cut WHERE length(piece) >= 8)
"""


# Rows of the store after the changes of store_upsert: keys go by path and ordinal, and on from the last for what came again.
_UPDATED = f"""
{_CHUNKS}, given AS (SELECT DISTINCT path, ordinal, text, page FROM piece WHERE path IS NOT NULL),
first AS (SELECT row_number() OVER (ORDER BY path, ordinal) - 1 AS chunk_key, * FROM given),
again AS (SELECT DISTINCT path FROM given WHERE page = 1),
second AS (SELECT (SELECT count(*) FROM given) + row_number() OVER (ORDER BY path, ordinal) - 1 AS chunk_key, * FROM given WHERE page IS NOT NULL AND path IN (SELECT path FROM again)),
rows AS (SELECT * FROM first WHERE NOT starts_with(path, '{ROOT}/') AND path NOT IN (SELECT path FROM again) UNION ALL SELECT * FROM second)
"""

SQL: dict[str, str] = {
    "chunk_documents": f"""
WITH RECURSIVE {_chunked('SELECT doc_id AS id, text FROM documents')}
SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY i, kind, step) - 1 AS ordinal, piece AS text FROM chunked
""",
    "chunk_sections_pages": f"""
WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (ORDER BY path, section_no, section_id, text, page) AS id FROM (SELECT DISTINCT * FROM sections WHERE path IS NOT NULL)),
{_chunked('SELECT id, text FROM numbered')}
SELECT path, row_number() OVER (PARTITION BY path ORDER BY id, i, kind, step) - 1 AS ordinal, piece AS text, page FROM chunked JOIN numbered USING (id)
""",
    "chunk_hard_split": f"""
WITH RECURSIVE base AS (SELECT doc_id, trim(text, {_WHITE}) AS t FROM documents),
cut AS (
  SELECT doc_id, 0 AS step, NULL::VARCHAR AS piece, t AS rest FROM base WHERE t <> ''
  UNION ALL
  SELECT doc_id, step + 1, trim(substr(rest, 1, n), {_WHITE}), substr(rest, n + 1) FROM (
    SELECT doc_id, step, rest, CASE WHEN length(rest) <= 1000 THEN length(rest)
      WHEN regexp_matches(substr(rest, 1, 1000), '\\. ') THEN length(regexp_extract(substr(rest, 1, 1000), '(?s)^(.*)\\. ', 1)) + 1 ELSE 1000 END AS n
    FROM cut WHERE rest <> '')),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS ordinal, piece FROM cut WHERE piece <> '')
SELECT doc_id, ordinal, piece AS text FROM kept WHERE length(piece) >= 8
""",
    "chunk_paragraphs": f"SELECT doc_id, generate_subscripts(p, 1) - 1 AS ordinal, unnest(p) AS paragraph FROM (SELECT doc_id, {_PARTS} AS p FROM documents)",
    "chunk_pack_overlap": f"""
WITH RECURSIVE {_chunked('SELECT chunk_key AS id, text FROM (SELECT DISTINCT chunk_key, path, ordinal, text, page FROM chunks WHERE chunk_key IS NOT NULL)')}
SELECT id AS chunk_key, row_number() OVER (PARTITION BY id ORDER BY i, kind, step) - 1 AS ordinal, piece AS text FROM chunked
""",
    "tokenize": f"SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_terms('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "query_terms": f"WITH {_ASKED} SELECT query_id, array_to_string(list_filter({_terms('query')}, lambda t: t NOT IN ({_STOP})), ' ') AS terms FROM asked",
    "clean_text": f"""
WITH lines AS (SELECT doc_id, array_to_string({_lines(_LIGATED)}, chr(10)) AS t FROM documents WHERE text IS NOT NULL),
broken AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\n{{2,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS t FROM lines)
SELECT d.doc_id, regexp_replace(t, '-\\n(\\p{{Ll}})', '\\1', 'g') AS clean FROM documents d LEFT JOIN broken USING (doc_id)
""",
    "tidy_text": f"SELECT d.doc_id, t AS tidy FROM documents d LEFT JOIN (SELECT doc_id, array_to_string(list_filter({_lines('text')}, lambda l: l <> ''), chr(10)) AS t FROM documents WHERE text IS NOT NULL) USING (doc_id)",
    "has_text": f"WITH {_CHUNKS} SELECT chunk_key, CASE WHEN text IS NOT NULL THEN len(list_filter(string_split_regex(text, '{_BLANK}+'), lambda w: length(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2)) >= 2 END AS has_text FROM piece",
    "content_hash_dups": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "doc_freq": f"WITH {_CHUNKS}, {_TEXT} SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_key, unnest(t) AS term FROM words) GROUP BY term",
    "field_len": f"WITH {_CHUNKS}, {_TEXT} SELECT chunk_key, len(t) AS len FROM words",
    "bm25_topk": f"WITH {_ASKED}, {_CHUNKS}, {_TEXT}, {_BM25} {_BEST}",
    "bm25_two_field": f"WITH {_ASKED}, {_CHUNKS}, {_BOTH}, {_BM25} {_BEST}",
    "dense_topk": _DENSE.format(floor=-1e9),
    "dense_floor": _DENSE.format(floor=0.3),
    "dense_chunks": f"WITH {_VECTORS}, {_NEAR} SELECT query_id, chunk_key, score, rank FROM near",
    "l2_normalize": f"""
WITH {_VECTORS}, sized AS (SELECT chunk_key, embedding, sqrt({_DOT.format(a='embedding', b='embedding')}) AS n FROM vec),
unit AS (SELECT chunk_key, n, list_transform(embedding, lambda x: x::DOUBLE / n) AS u FROM sized WHERE n > 0)
SELECT chunk_key, round(n, 6) AS length, round({_DOT.format(a='u', b='u')}, 6) AS unit_dot, round(u[1], 6) AS first FROM unit
""",
    "hashed_embedding": f"""
WITH words AS (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 384)::INT AS bucket, CASE WHEN ('0x' || substr(md5(term), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM words),
counts AS (SELECT doc_id, bucket, sum(sign) AS n FROM hashed GROUP BY ALL HAVING sum(sign) <> 0)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)::DOUBLE), 9) AS weight FROM counts
""",
    "rrf_fuse": _fused(_BOTH) + "SELECT query_id, path, ordinal, score, rank FROM ranked",
    "hybrid_search": _fused(_BOTH) + "SELECT * FROM hits",
    "hybrid_tables": _fused(_BOTH) + "SELECT * FROM hits",
    "bm25_stored": f"WITH {_ASKED}, {_CHUNKS}, {_TEXT}, {_BM25} {_BEST}",
    "index_build": f"WITH {_CHUNKS} SELECT count(DISTINCT path) AS documents, count(*) AS chunks, sum(coalesce(strlen(text), 0)) AS bytes FROM piece WHERE path IS NOT NULL",
    "render_hits": _fused(_BOTH) + "SELECT query_id, rank, '[' || rank || '] ' || path || '#chunk' || chunk_index || ' (score ' || printf('%.2f', score) || ')' || chr(10) || text AS rendered FROM hits",
    "chunk_by_ordinal": f"WITH {_CHUNKS} SELECT path, text, page FROM piece WHERE path = '/srv/corpus/ledger/rolling-changelog.md' AND ordinal = 3",
    "stats_totals": "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(DISTINCT chunk_key) FROM chunks) AS chunks, (SELECT coalesce(sum(size), 0)::BIGINT FROM docs) AS total_source_bytes",
    "stats_by_ext": "SELECT coalesce(nullif(regexp_extract(lower(regexp_extract(path, '([^/]*)$', 1)), '^.+\\.([^.]+)$', 1), ''), 'noext') AS ext, count(*) AS n FROM docs GROUP BY 1",
    "latency_percentiles": """
WITH sorted AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, n, round(m, 6) AS mean, v[least(floor(n * 0.5) + 1, n)::BIGINT] AS p50, v[least(floor(n * 0.95) + 1, n)::BIGINT] AS p95 FROM sorted
""",
    "change_set": f"""
WITH {_NEWEST} SELECT s.path, {_EXT.replace('path', 's.path')} AS ext,
  CASE WHEN d.size = s.size AND d.mtime_secs = s.mtime_secs AND coalesce(len(d.chunk_keys), -1) <> 0 THEN 'unchanged' ELSE 'read' END AS action
FROM scan s LEFT JOIN docs d ON s.path = d.path
""",
    "prune_scoped": f"SELECT path FROM docs WHERE starts_with(path, '/srv/corpus/') AND path NOT IN (SELECT path FROM file_scans WHERE path IS NOT NULL)",
    "store_upsert": f"""
WITH {_CHUNKS}, one AS (SELECT path, count(*) AS n, count(page) AS paged, max(CASE WHEN page = 1 THEN 1 ELSE 0 END) AS again FROM (SELECT DISTINCT path, ordinal, page FROM piece) WHERE path IS NOT NULL GROUP BY path)
SELECT path, CASE WHEN again = 1 THEN 'second' ELSE 'first' END AS content_hash, CASE WHEN again = 1 THEN paged ELSE n END AS n_chunks
FROM one WHERE again = 1 OR NOT starts_with(path, '{ROOT}/')
""",
    "store_chunks": f"WITH {_UPDATED} SELECT chunk_key, path, ordinal, text, page FROM rows",
    "store_postings": f"""
WITH {_UPDATED}, words AS (
  SELECT chunk_key, 'text' AS field, coalesce({_terms('text')}, []) AS t FROM rows UNION ALL SELECT chunk_key, 'path', coalesce({_terms('path')}, []) FROM rows),
post AS (SELECT chunk_key, field, term, any_value(n) AS len, count(*) AS tf FROM (SELECT chunk_key, field, len(t) AS n, unnest(t) AS term FROM words) GROUP BY ALL)
SELECT field, term, count(*) AS df, sum(tf) AS tf, sum(len) AS len, min(chunk_key) AS first_key FROM post GROUP BY field, term
""",
    "p4_found": f"""
WITH newest AS (
  SELECT path, {_VALUE} AS h, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, scan_id DESC) AS r
  FROM file_scans WHERE hash IS NOT NULL AND path IS NOT NULL)
SELECT n.path FROM newest n LEFT JOIN (SELECT path, {_VALUE} AS h FROM docs) d ON n.path = d.path
WHERE n.r = 1 AND n.h IS DISTINCT FROM d.h
""",
}
