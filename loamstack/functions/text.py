"""Scalar text functions as column expressions; they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a query that carry no topic.
STOPWORDS = (
    "a", "about", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "i", "in", "into", "is", "it", "its", "me", "my",
    "of", "on", "or", "our", "that", "the", "their", "this", "to", "was", "we", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your",
)
# Ligatures of text layers and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
# File names that are their own extension.
WHOLE_NAMES = ("dockerfile", "makefile")

TOKEN = r"[\p{L}\p{N}]+"
MAX_TOKEN_BYTES = 40
_SPACE = r"\p{IsWhite_Space}"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    white = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    return F.btrim(text, F.lit(white))


def tokens(text: Column) -> Column:
    """Index terms: lower-cased runs of letters and digits under 40 bytes. Null for null, empty for no terms."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.octet_length(t) < MAX_TOKEN_BYTES)


def is_stopword(token: Column) -> Column:
    return F.lower(token).isin(*STOPWORDS)


def query_terms(query: Column) -> Column:
    """Terms a query asks for: split at all but letters and digits, without stopwords, analysed as the index is."""
    return F.filter(tokens(query), lambda t: ~is_stopword(t))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def ext_of(path: Column) -> Column:
    """Lower-cased extension for indexing; '' where there is none, as for names that only begin with a dot."""
    name = F.lower(file_name(path))
    return F.when(name.isin(*WHOLE_NAMES), name).otherwise(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def stats_ext(path: Column) -> Column:
    """Extension for statistics; 'noext' where there is none, whole names included."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(file_name(path)), r"^.+\.([^.]+)$", 1), F.lit("")), F.lit("noext"))


def _lines(text: Column) -> Column:
    """Lines with white space collapsed and cut at both ends."""
    return F.transform(F.split(F.regexp_replace(text, r"\r\n", "\n"), "\n"), lambda line: strip(F.regexp_replace(line, f"{_SPACE}+", " ")))


def clean(text: Column) -> Column:
    """Text layer of a page: ligatures resolved, white space collapsed, blank lines kept as one paragraph break, and
    words broken at a line end joined where the next line goes on in lower case."""
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    whole = F.array_join(_lines(text), "\n")
    whole = F.regexp_replace(whole, r"\n{2,}", "\n\n")
    whole = F.regexp_replace(whole, r"^\n+|\n+$", "")
    return F.regexp_replace(whole, r"-\n(?=\p{IsLowercase})", "")


def tidy(text: Column) -> Column:
    """Recognised text: white space collapsed, blank lines dropped."""
    return F.array_join(F.filter(_lines(text), lambda line: line != ""), "\n")


def has_text(text: Column) -> Column:
    """Whether at least two words have two letters or digits each."""
    words = F.split(text, f"{_SPACE}+")
    return F.size(F.filter(words, lambda w: F.length(F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}]", "")) >= 2)) >= 2


def under_root(path: Column, root: str) -> Column:
    """Whether an absolute path without '..' is the root or lies under it, by components."""
    base = root.rstrip("/")
    return path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ((path == (base or "/")) | path.startswith(base + "/"))


def display_score(rank: Column, n: Column) -> Column:
    """Score shown for the hit of a 1-based rank among n: its place only, not what it was ranked by."""
    return F.round((n - rank + 1) / n * 100) / 100


def first_lines(text: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(F.split(text, r"\r?\n"), 1, n), "\n")
