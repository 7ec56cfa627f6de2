"""SQL that the queries of this subpackage are checked against, where SQL can express them on whole tables."""

# Unicode White_Space by code point, as DuckDB has no class of it.
_WHITE = " || ".join(f"chr({c})" for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

_TERMS = """
WITH pieces AS (SELECT DISTINCT path, chunk_key, text FROM chunks WHERE path IS NOT NULL),
words AS (SELECT path, chunk_key, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i' || chr(775))), '[a-z0-9]{4,}')) AS term FROM pieces WHERE text IS NOT NULL),
counted AS (SELECT path, term, count(DISTINCT chunk_key) AS c, count(*) AS tf FROM words GROUP BY ALL),
spread AS (SELECT term, count(*) AS d, sum(tf)::DOUBLE AS gf, sum(tf * ln(tf)) AS s FROM counted GROUP BY term),
total AS (SELECT count(DISTINCT path)::DOUBLE AS p FROM pieces)
"""

# What Python takes as white space and, without digits, as the letters of words.
_GAP = "[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_LETTER = "[\\p{L}\\p{Nl}\\p{No}]"
_END = "[.!?…”\"»。！？]"

SQL: dict[str, str] = {
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_simple": f"""
WITH seen AS (SELECT doc_id, text, regexp_replace(text, '{_GAP}', '', 'g') AS v FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, v, regexp_extract_all(lower(replace(text, 'İ', 'i' || chr(775))), '{_LETTER}+(?:[''’]{_LETTER}+)*') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '{_GAP}', '', 'g') <> '') AS l FROM seen WHERE v <> '')
SELECT doc_id, len(w) AS n_words, round(ln(1 + len(w)), 9) AS log_words,
  round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) ELSE 0 END, 9) AS mean_word_len,
  round(length(regexp_replace(v, '[\\p{{L}}\\p{{Nd}}²³¹⁰-⁹₀-₉①-⑨]', '', 'g'))::DOUBLE / length(v), 9) AS symbol_ratio,
  round(len(list_filter(l, lambda x: regexp_matches(x, '{_END}{_GAP}*$')))::DOUBLE / len(l), 9) AS punct_lines
FROM parts
""",
    "p2_found": f"""
WITH items AS (
  SELECT 'section' AS item_kind, section_id AS item_id, text FROM sections
  UNION ALL SELECT 'chunk', chunk_key, text FROM chunks)
SELECT DISTINCT item_kind, item_id FROM items WHERE length(trim(text, {_WHITE})) > 1000
""",
    "p3_found": _TERMS
    + """
, scored AS (SELECT path, term, round(c * ln(p / d), 9) AS score FROM counted JOIN spread USING (term) CROSS JOIN total),
ranked AS (SELECT path, term, row_number() OVER (PARTITION BY path ORDER BY score DESC, term) AS r FROM scored WHERE score > 0)
SELECT path, term FROM ranked WHERE r = 1 AND path IN (SELECT path FROM pieces GROUP BY path HAVING count(DISTINCT chunk_key) >= 4)
""",
    "p3_log_entropy": _TERMS
    + """
SELECT path, term, round(ln(1 + tf) * greatest(1 - (ln(gf) - s / gf) / ln(p), 0), 9) AS score
FROM counted JOIN spread USING (term) CROSS JOIN total
""",
}
