"""Noise in text from scanned pages (problem 7).

One pass counts words and finds what may be broken or a running header. Rare words are then held against frequent ones
through an index of deletions: from a rare word the parts that a scanner may have put there are deleted, from a frequent
word the parts that it may have misread, and words that meet are compared by a weighted edit distance in which only such
confusions are cheap. Where several repairs are left, the words before and after each occurrence decide, by exact counts of
just the pairs that come into question. Each text then looks up its own words, and the headers of its file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.io import local
from loamstack.llm.lookup import BROADCAST_ROWS, by_word, with_own
from loamstack.session import cut_lineage

# What a scanner reads (left) where the page has (right), as pairs.
CONFUSIONS = [
    ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("ri", "n"), ("h", "li"), ("m", "rn"), ("d", "cl"), ("nn", "m"),
    ("c", "e"), ("e", "c"), ("o", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("h", "b"), ("u", "n"), ("n", "u"),
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("9", "g"), ("6", "b"), ("8", "b"), ("f", "e"),
]
_READ: dict[str, list[str]] = {}
for _a, _b in CONFUSIONS:
    _READ.setdefault(_a, []).append(_b)
_SEEN = sorted({a for a, _ in CONFUSIONS}, key=len, reverse=True)
_TRUE = sorted({b for _, b in CONFUSIONS}, key=len, reverse=True)
_STRANGE = re.compile(r"[0-9!|]")

WORD = re.compile(r"[^\W\d_]+(?:[0156890!|]{1,2}[^\W\d_]+)*|[015689!|](?=[^\W\d_]{2})[^\W\d_]+(?:[0156890!|]{1,2}[^\W\d_]+)*")
WORD_ANY = re.compile(r"(?<![\w!|])" + f"(?:{WORD.pattern})" + r"(?![\w|])")
_PATH = re.compile(r"[/\\=]")
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not (c.isalnum() or c in "/\\=!|"))
_DUMP = re.compile(r"[0-9A-Za-z+_-]{24,}|(?<![^\W\d_])[^\W\d_]*+\d[^\W_]*\d[^\W_]*")
_HYPHENS = re.compile(r"[-‐¬\xad] ?\n")
_BREAK = re.compile(r"(?<![^\W\d_])([^\W\d_]+)([-‐¬\xad]) ?\n[ \t]*([^\W\d_]+)")
_SOFT = re.compile(r"[^\W\d_]+(?:\xad[^\W\d_]+)+")
_LIGATURE = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_LETTERS = re.compile(r"[^\W\d_]+")
_FUSED = re.compile("[" + "".join(_LIGATURE) + "]")
_PAGE = re.compile(
    r"^(?:(?:Page|Seite|Página|Pagina|page|seite|S\.|p\.|pp\.|P\.)\s?\d{1,4}(?:\s(?:of|von|de|sur|/)\s\d{1,4})?|[-–—] ?\d{1,4} ?[-–—]|\d{1,4} \|"
    r"|\[\d{1,4}\]|\d{1,4}/\d{1,4}| {10,}\d{1,4}|(?=[ivxl])l?x{0,3}(?:ix|iv|v?i{0,3}))$"
)
_BARE = re.compile(r"^\d{1,4}$")
_NUMBERED = re.compile(r"^(?:(\d{1,4}) {3,}(\S.{1,70})|(\S.{1,70}?) {3,}(\d{1,4}))$")
_END = re.compile(r"[.!?:;,…”\"»)\]}>|*_`]$")
# For RE2, which goes through whole texts: what any text has that `_kept_whole` or a repair of breaks and ligatures looks at, and
# that and any line that may be a page number or have one beside it. They may find too much, but never too little.
_WHITE = r"\t\x0b-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_JOINED = "- ?\n|[‐¬\xad" + "".join(_LIGATURE) + "]"
_TRACE = (
    _JOINED + r"|\p{Nd}   |   \p{Nd}|(?:^|\n)[" + _WHITE + r"]*(?:(?:Page|Seite|Página|Pagina|page|seite|S\.|p\.|pp\.|P\.)[" + _WHITE + r"]?\p{Nd}"
    r"|[-–—] ?\p{Nd}{1,4} ?[-–—]|\p{Nd}{1,4} \||\[\p{Nd}{1,4}\]|(?:\p{Nd}{1,4}(?:/\p{Nd}{1,4})?|[ivxl]+)[" + _WHITE + r"]*(?:\n|$))"
)
#: Parameter: letters and digits without a border, longer than this, are a dump and no misread word.
DUMP_CHARS = 40
#: Parameters of a running header: the longest line that may be one, and on how many pieces of its file it must come back:
#: a share of them, but never more than some.
HEADER_CHARS = 90
HEADER_SHARE = 0.05
HEADER_TIMES = 8


def _dump(m: re.Match) -> str:
    """Nothing, unless all of it may be words misread: then the lexicon decides."""
    parts = m[0].strip("-").split("-")
    return " ".join(parts) if all(len(p) <= DUMP_CHARS and WORD.fullmatch(p) for p in parts) else " "


class _Words(dict):
    """Words of what lies between white space, found once for each such string; emptied when it holds many."""

    def __missing__(self, part: str) -> tuple[str, ...]:
        if len(part) < 24 and part.isalpha():
            found = self[part] = (part,)
            if len(self) > 400_000:
                self.clear()
            return found
        # Of words joined by a slash or equals sign all count; a path, dump or formula has other things between them.
        path = _PATH.search(part) and not all(2 < len(p) <= DUMP_CHARS and WORD.fullmatch(p) for p in _PATH.split(part.strip(_SIGNS)))
        found = () if path else tuple(WORD.findall(_DUMP.sub(_dump, part)))
        if len(self) > 400_000:
            self.clear()
        if len(part) <= 64:
            self[part] = found
        return found


_words = _Words()


def words_of(text: str) -> list[str]:
    """Lower-cased words, with the digits and signs inside them that letters may have become; no codes, paths or dumps."""
    return list(chain.from_iterable(map(_words.__getitem__, text.lower().split())))


#: Bytes of text that are taken apart at once; a matter of memory alone.
SLICE_BYTES = 8_000_000


def _slices(batch: pa.RecordBatch, text: int = 0):
    """The batch in parts of some ``SLICE_BYTES`` of text, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


class Pieces:
    """Texts cut at ASCII white space. A word never goes beyond such a piece, so each distinct one is looked at once.

    ``words``: those of each distinct piece; ``codes``: the pieces of the texts, one after the other, as places in it.
    """

    def __init__(self, texts: pa.Array):
        cut = pc.ascii_split_whitespace(texts.fill_null(""))
        self.starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        pieces = cut.flatten().dictionary_encode()
        self.codes = pieces.indices.to_numpy()
        self.words = [words_of(p) for p in pieces.dictionary.to_pylist()]

    def counts(self) -> dict[str, int]:
        """How often the texts have each word."""
        out: dict[str, int] = {}
        for words, n in zip(self.words, np.bincount(self.codes, minlength=len(self.words)).tolist()):
            for w in words:
                out[w] = out.get(w, 0) + n
        return out

    def having(self, wanted) -> np.ndarray:
        """Places of the texts that have one of the words, in order."""
        has = np.fromiter((not wanted.isdisjoint(words) for words in self.words), bool, len(self.words))
        return np.unique(np.searchsorted(self.starts, np.flatnonzero(has[self.codes]), side="right") - 1)

    def pairs(self, wanted) -> dict[tuple[str, str], int]:
        """How often the texts have each pair of neighbouring words of which one is wanted (None: any pair)."""
        place: dict[str, int] = {}
        flat = np.array([place.setdefault(w, len(place)) for words in self.words for w in words], np.int32)
        n = np.fromiter(map(len, self.words), np.int32, len(self.words))
        first = np.cumsum(n, dtype=np.int32) - n
        each = n[self.codes]
        upto = np.cumsum(each, dtype=np.int32)
        ids = flat[np.repeat(first[self.codes] - (upto - each), each) + np.arange(upto[-1], dtype=np.int32)]
        # Two words in a row are neighbours unless a text ends between them.
        inside = np.ones(max(0, len(ids) - 1), bool)
        ends = upto[self.starts[1:-1] - 1]
        inside[ends[(ends > 0) & (ends < len(ids))] - 1] = False
        if wanted is not None:
            is_wanted = np.fromiter((w in wanted for w in place), bool, len(place))[ids]
            inside &= is_wanted[1:] | is_wanted[:-1]
        found, times = np.unique(ids[:-1][inside].astype(np.int64) * len(place) + ids[1:][inside], return_counts=True)
        every = list(place)
        return {(every[f // len(every)], every[f % len(every)]): t for f, t in zip(found.tolist(), times.tolist())}


def deletions(word: str, parts: list[str], most: int = 2) -> set[str]:
    """The word with up to ``most`` of the parts deleted, one after the other from the left."""
    found = {word}
    edge = {(word, 0)}
    for _ in range(most):
        following = set()
        for w, at in edge:
            for part in parts:
                i = w.find(part, at)
                while i >= 0:
                    following.add((w[:i] + w[i + len(part) :], i))
                    i = w.find(part, i + 1)
        found |= {w for w, _ in following}
        edge = following
    return found


def distance(seen: str, true: str, limit: float = 1.0) -> float:
    """Weighted edit distance from what was read to what may have been there; other edits than confusions cost too much.

    Only alignments within the limit are followed, of which there are a few at each place, so long words take linear time.
    """
    at: dict[int, dict[int, float]] = {0: {0: 0.0}}
    for i in range(len(seen) + 1):
        for j, here in at.pop(i, {}).items():
            if i == len(seen):
                if j == len(true):
                    return here
                continue
            steps = [(1, 1, 0.0)] if j < len(true) and seen[i] == true[j] else []
            for n in (1, 2):
                for b in _READ.get(seen[i : i + n], ()) if i + n <= len(seen) else ():
                    if true.startswith(b, j):
                        steps.append((n, len(b), 0.3 if _STRANGE.match(seen[i : i + n]) or n + len(b) > 2 else 0.45))
            for n, m, cost in steps:
                if here + cost <= limit and here + cost < at.setdefault(i + n, {}).get(j + m, limit + 1):
                    at[i + n][j + m] = here + cost
    return limit + 1


# ---- corpus tables --------------------------------------------------------------------------------------------------


def _has_hyphens(text: str) -> bool:
    """Whether a hyphen of any kind may end a line; single signs are sought much faster than a class of them."""
    return ("-\n" in text or "- \n" in text or "‐" in text or "¬" in text or "\xad" in text) and _HYPHENS.search(text) is not None


def _has_fused(text: str) -> bool:
    return not text.isascii() and any(sign in text for sign in _LIGATURE)


def _kept_whole(text: str) -> set[str]:
    """Words that a repair of breaks and ligatures asks for: whether the corpus has them decides how they are joined."""
    out: set[str] = set()
    if _has_hyphens(text):
        for a, _, b in _BREAK.findall(text):
            out |= {(a + b).lower(), a.lower(), b.lower()}
    if "\xad" in text:
        out |= {m[0].replace("\xad", "").lower() for m in _SOFT.finditer(text)}
    if _has_fused(text):
        out |= {_FUSED.sub(lambda x: _LIGATURE[x[0]], w).lower() for w in _LETTERS.findall(text) if _FUSED.search(w)}
    return out


def _looked_up(text: str) -> set[str]:
    """All words that a repair of the text may look up."""
    whole = _kept_whole(text)
    out = {*words_of(text), *whole}
    for w in whole:
        out.update(words_of(w))
    if whole:
        # What stands beside a break may be joined to it.
        out.update(words_of(_BREAK.sub(lambda m: m[1] + m[3], _FUSED.sub(lambda x: _LIGATURE[x[0]], text))))
    return out


def gather(df: DataFrame, text: str = "text", path: str | None = None, key: str | None = None) -> DataFrame:
    """What one pass over the texts tells, in one table: words (``word``, ``n`` and ``asked``; ``path`` is null), and of files the
    lines that may be running headers (``path``, ``word``, in how many rows ``n``, and the least and greatest key, ``a`` and ``b``).
    Tasks add up their own first."""
    schema = "path string, word string, n bigint, asked boolean, a bigint, b bigint"
    kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())

    def count(batches):
        for batch in batches:
            words: Counter = Counter()
            asked: set[str] = set()
            lines: dict[tuple[str, str], list] = {}
            for part in _slices(batch):
                texts = part.column(0)
                words.update(Pieces(texts).counts())
                for t in texts.filter(pc.match_substring_regex(texts, _JOINED)).to_pylist():
                    asked |= _kept_whole(t)
                if path is None:
                    continue
                for t, p, k in zip(*(c.to_pylist() for c in part.filter(pc.and_(pc.match_substring(texts, "\n"), pc.is_valid(part.column(1)))).columns)):
                    for line in {b for _, b in _candidates(t)}:
                        of = lines.setdefault((p, line), [0, k, k])
                        of[0] += 1
                        if k is not None:
                            of[1:] = (k, k) if of[1] is None else (min(of[1], k), max(of[2], k))
            every = [*words, *(asked - words.keys())]
            rows = [(None, w, words[w], w in asked, None, None) for w in every]
            rows += [(p, line, n, False, a, b) for (p, line), (n, a, b) in lines.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["path", "word", "n", "asked", "a", "b"])

    src = df.select(F.col(text).alias("_t"), *([F.col(path).alias("_p"), F.col(key).cast("bigint").alias("_k")] if path else []))
    told = src.mapInArrow(count, schema).groupBy("path", "word").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"), F.min("a").alias("a"), F.max("b").alias("b"))
    return cut_lineage(told)


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n`` and ``asked``: how often the corpus has each word, and whether a broken or fused word asks for it."""
    return gather(df, text).where("path is null").select("word", "n", "asked")


def _keys(word: str, parts: list[str], slack: int) -> set[str]:
    """Where a word is found in the index: its deletions, or, for a long one, pieces of which at least one is whole after two
    confusions: its start, its end, and its middle, which may have moved by ``slack`` places."""
    if len(word) <= DUMP_CHARS:
        return deletions(word, parts)
    half = len(word) // 2
    return {"^" + word[:12], "$" + word[-12:], *("=" + word[i : i + 12] for i in range(half - 6 - slack, half - 5 + slack))}


def corrections(words: DataFrame, least: int = 5, ratio: int = 15) -> DataFrame:
    """``seen``, ``meant``, ``cost``: rare words and the frequent ones (``least`` times, and ``ratio`` times as often) they may be.

    What is rare and what is frequent grows with the root of the corpus, as do chance meetings of words.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    rare, least = max(8, int(0.018 * math.sqrt(total))), max(least, int(0.0013 * math.sqrt(total)))

    def index(parts: list[str], slack: int):
        def run(batches):
            for batch in batches:
                rows = [(key, w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for key in _keys(w, parts, slack)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["key", "word", "n"])

        return run

    schema = "key string, word string, n bigint"
    strange = F.col("word").rlike("[0-9!|]")
    known = words.where((F.length("word") >= 3) & (F.col("n") > 0)).select("word", "n")
    seen = known.where(strange | (F.col("n") <= rare)).mapInArrow(index(_SEEN, 3), schema)
    true = known.where(~strange & (F.col("n") >= least)).mapInArrow(index(_TRUE, 0), schema)
    met = (
        seen.select("key", F.col("word").alias("seen"), F.col("n").alias("a"))
        .join(true.select("key", F.col("word").alias("meant"), F.col("n").alias("b")), "key")
        .where("seen <> meant")
        .where(F.col("b") >= F.when(F.col("seen").rlike("[0-9!|]"), F.lit(1)).otherwise(F.lit(ratio)) * F.col("a"))
        .where("abs(length(seen) - length(meant)) <= 2")
        .select("seen", "meant")
        .distinct()
    )

    def judge(batches):
        for batch in batches:
            rows = [(s, t, d) for s, t in zip(*(c.to_pylist() for c in batch.columns)) if (d := distance(s, t)) <= 1.0]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64()))], names=["seen", "meant", "cost"])

    found = cut_lineage(met.mapInArrow(judge, "seen string, meant string, cost double"))
    # A repair that is itself a misread word leads on to what that one stands for.
    on = found.select(F.col("seen").alias("meant"), F.col("meant").alias("_on"), F.col("cost").alias("_more"))
    led = found.join(on, "meant", "left").select("seen", F.coalesce("_on", "meant").alias("meant"), (F.col("cost") + F.coalesce("_more", F.lit(0.0))).alias("cost"))
    return led.where("seen <> meant").groupBy("seen", "meant").agg(F.min("cost").alias("cost"))


#: Words up to which a text is first searched for them; a matter of speed alone.
HINTED = 64


def _stands_in(text: str, words: list[str]) -> bool:
    """Whether one of the words stands in the text with no letter beside it."""
    for word in words:
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            if not text[at - 1 : at].isalpha() and not text[end : end + 1].isalpha():
                return True
            at = text.find(word, at + 1)
    return False


def contexts(df: DataFrame, fixes: DataFrame, text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """``a``, ``b`` and ``n``: how often the corpus has the pairs of neighbouring words that decide between several repairs.

    Empty if no word has several. Pairs are counted where one of the two is such a repair, and kept where the other stands
    beside an occurrence of a word it may repair.
    """
    spark = df.sparkSession
    several = fixes.join(fixes.groupBy("seen").count().where("count > 1").select("seen"), "seen", "left_semi")
    options = cut_lineage(several.groupBy(F.col("seen").alias("word")).agg(F.sort_array(F.collect_set("meant")).alias("options")))
    if options.isEmpty():
        return local(spark, [], "a string, b string, n bigint")
    meant = options.select(F.explode("options").alias("w")).distinct()
    few = meant.limit(most + 1).toArrow().column(0).to_pylist()
    shared = spark.sparkContext.broadcast(frozenset(few) if len(few) <= most else None)
    src, table = with_own(df.select(F.col(text).alias("_t")), "_t", options, words_of, most)

    def pairs(batches):
        wanted, hint = shared.value, None
        if wanted is not None and table is not None and len(wanted) + len(table.value) <= HINTED:
            # Few words are sought in the text before it is taken apart, which most texts then need not be.
            hint = sorted({*wanted, *table.value})
        for batch in batches:
            seen: Counter = Counter()
            asked: set[tuple[str, str]] = set()
            for part in _slices(batch):
                if hint is not None:
                    part = part.filter(pa.array([bool(t) and _stands_in(t.lower(), hint) for t in part.column(0).to_pylist()], pa.bool_()))
                texts = part.column(0)
                if not len(texts):
                    continue
                pieces = Pieces(texts)
                seen.update(pieces.pairs(wanted))
                at = pieces.having(table.value.keys()) if table is not None else np.flatnonzero(pc.is_valid(part.column(1)).to_numpy(zero_copy_only=False))
                own = part.column(1).take(pa.array(at)).to_pylist() if table is None else [None] * len(at)
                for t, rows in zip(texts.take(pa.array(at)).to_pylist(), own):
                    known = table.value if table is not None else by_word(rows)
                    found = words_of(t or "")
                    for i, w in enumerate(found):
                        if w in known:
                            for o in known[w][0][0]:
                                asked |= {(found[i - 1] if i else "", o), (o, found[i + 1] if i + 1 < len(found) else "")}
            every = [*seen, *(asked - seen.keys())]
            cols = [[p[0] for p in every], [p[1] for p in every], [seen[p] for p in every], [p in asked for p in every]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["a", "b", "n", "asked"])

    counted = src.select("_t", *["_own"][: table is None]).mapInArrow(pairs, "a string, b string, n bigint, asked boolean").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    return cut_lineage(counted.where("asked and n > 0").select("a", "b", "n"))


def _plain(line: str) -> str | None:
    """A line that may be a running header, without its page number; None for others."""
    if not 3 <= len(line) <= HEADER_CHARS or _END.search(line.rstrip()):
        return None
    m = _NUMBERED.match(line.strip())
    body = (m[2] or m[3]).strip() if m else line.strip()
    if not body or not (body[0].isupper() or body[0].isdigit() and m is None and body[1:2].isalpha()) or len(body.split()) > 8 or not re.search(r"[^\W\d_]{3}", body):
        return None
    return body.casefold()


def _candidates(text: str):
    lines = text.split("\n")
    longest = max(map(len, lines))
    for i, line in enumerate(lines):
        body = _plain(line)
        if body is not None and (len(line) <= 0.75 * longest or len(lines) <= 2):
            yield i, body


def headers(df: DataFrame, path: str, key: str, text: str, page: str, least: int = 2, share: float = HEADER_SHARE, times: int = HEADER_TIMES, gathered: DataFrame | None = None) -> DataFrame:
    """(path, line) of short lines that come back on several pages of a paged file, on ``share`` of its pieces or ``times`` times,
    so that the header of a chapter counts in a file of any length. Partial aggregation, then small joins. ``gathered``: what
    ``gather`` told of the table, if it is at hand."""
    lines = gathered if gathered is not None else gather(df, text, path, key)
    src = df.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(page).alias("page"))
    sizes = src.groupBy("path").agg(F.count("*").alias("pieces"), F.max(F.col("page").isNotNull()).alias("paged")).where("paged")
    found = lines.where(F.col("path").isNotNull() & (F.col("n") >= least) & (F.col("a") != F.col("b"))).select("path", F.col("word").alias("line"), "n")
    return found.join(sizes, "path").where(F.col("n") >= F.least(share * F.col("pieces"), F.lit(times))).select("path", "line")


# ---- repair ---------------------------------------------------------------------------------------------------------


class Repairer:
    """``known``: {seen: [(meant, cost)]}. ``pairs``: counts of the pairs of words that decide between several. ``frequent``:
    words that broken and fused ones are held against."""

    def __init__(self, known: dict[str, list[tuple[str, float]]], pairs: dict[tuple[str, str], int], frequent):
        self.known, self.pairs, self.frequent = known, pairs, frequent

    def _best(self, word: str, before: str, after: str) -> str | None:
        options = self.known.get(word)
        if not options:
            return None
        if len(options) == 1:
            return options[0][0]
        seen = lambda a, b: math.log1p(self.pairs.get((a, b), 0))
        return min(options, key=lambda o: (o[1] - 0.15 * seen(before, o[0]) - 0.15 * seen(o[0], after), o[0]))[0]

    @staticmethod
    def _cased(like: str, word: str) -> str:
        return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word

    def text(self, text: str | None, header_lines: frozenset | set) -> tuple[str | None, frozenset[str]]:
        """The repaired text and the kinds of noise: break, misread, fused, header, page. Clean texts come back unchanged."""
        if not text or not text.strip():
            return text, frozenset()
        kinds: set[str] = set()
        lines = text.split("\n")
        drop: set[int] = set()
        short = {i: b for i, b in _candidates(text)} if header_lines else {}
        for i, line in enumerate(lines):
            bare = line.strip()
            size = len(bare)
            if not size or size > HEADER_CHARS:
                continue
            if size <= 40 and _PAGE.match(line.rstrip()):
                kinds.add("page")
                drop.add(i)
            elif size <= 40 and _BARE.match(bare):
                near = [lines[j].strip() for j in (i - 1, i + 1) if 0 <= j < len(lines)]
                if not any(_BARE.match(n) for n in near) and not (i and near[0].endswith(":")) and len(lines) > 1 and size <= 3:
                    kinds.add("page")
                    drop.add(i)
            elif "   " in line and (m := _NUMBERED.match(bare)) and _plain(line) and sum(bool(_NUMBERED.match(x.strip())) for x in lines) <= 2:
                kinds.add("header")
                drop.add(i)
            elif i in short and short[i] in header_lines:
                kinds.add("header")
                drop.add(i)
        body = "\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text
        if _has_fused(body):

            def part(m: re.Match) -> str:
                whole = _FUSED.sub(lambda x: _LIGATURE[x[0]], m[0])
                if whole.lower() not in self.frequent:
                    return m[0]
                kinds.add("fused")
                return whole

            body = re.sub(r"[^\W\d_]+", part, body)

        def rejoin(m: re.Match) -> str:
            a, sign, b = m.groups()
            whole = (a + b).lower()
            if sign == "-":
                if not b[0].islower() or a.isupper():
                    return m[0]
                if whole not in self.frequent and (a.lower() in self.frequent and b.lower() in self.frequent):
                    return f"{a}-{b}"
            kinds.add("break")
            return a + b

        if _has_hyphens(body):
            body = _BREAK.sub(rejoin, body)
        end = body.rstrip()[-2:]
        if len(end) == 2 and end[1] in "‐¬\xad" and end[0].isalpha():
            kinds.add("break")
        if kinds and "\xad" in body:
            body = _SOFT.sub(lambda m: m[0].replace("\xad", "") if m[0].replace("\xad", "").lower() in self.frequent else m[0], body)
        found = words_of(body)
        wrong = {w for w in set(found) if w in self.known} if self.known else ()
        if wrong:
            # The context of each occurrence, in their order.
            context: dict[str, list[tuple[str, str]]] = {}
            for i, w in enumerate(found):
                if w in wrong:
                    context.setdefault(w, []).append((found[i - 1] if i else "", found[i + 1] if i + 1 < len(found) else ""))
            for places in context.values():
                places.reverse()
            before = body

            def mend(m: re.Match) -> str:
                w = m[0].lower()
                if w not in context:
                    return m[0]
                places = context[w]
                return self._cased(m[0], self._best(w, *(places.pop() if len(places) > 1 else places[0])) or m[0])

            body = WORD_ANY.sub(mend, body)
            if body != before:
                kinds.add("misread")
        if not kinds:
            return text, frozenset()
        # Wrapped lines of a repaired text become paragraphs again; lists, headings and tables keep their lines.
        body = re.sub(r"(?<=[^\W\d_,;])\n(?=[a-zß-ÿ])|(?<=,)\n(?=\w)", " ", body)
        return re.sub(r"\n{3,}", "\n\n", body), frozenset(kinds)


def _repair(df: DataFrame, key: str, text: str, path: str, page: str, broadcast_rows: int, whole: bool) -> DataFrame:
    """``key``, ``repaired`` and ``kinds`` of each row; or, if it is not to be ``whole``, key and kinds of those that have any."""
    gathered = gather(df, text, path, key)
    words = gathered.where("path is null").select("word", "n", "asked")
    fixes = cut_lineage(corrections(words.select("word", "n")))
    # Words that broken and fused ones are held against have no repair and the cost 0. A pair comes with either of its words,
    # -1 telling that this is the first and -2 that it is the second.
    looked = fixes.select(F.col("seen").alias("word"), F.col("meant").alias("other"), "cost", F.lit(0).cast("bigint").alias("n"))
    looked = looked.unionByName(words.where("asked and n >= 3").select("word", F.lit(None).cast("string").alias("other"), F.lit(0.0).alias("cost"), F.lit(0).cast("bigint").alias("n")))
    beside = contexts(df, fixes, text, broadcast_rows)
    for one, other, sign in (("a", "b", -1.0), ("b", "a", -2.0)):
        looked = looked.unionByName(beside.select(F.col(one).alias("word"), F.col(other).alias("other"), F.lit(sign).alias("cost"), "n"))
    looked = cut_lineage(looked)
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(path).alias("path"))
    src, table = with_own(src, "_t", looked, _looked_up, broadcast_rows)
    lines = cut_lineage(headers(df, path, key, text, page, gathered=gathered))
    few = lines.limit(broadcast_rows + 1).toArrow()
    heads = None
    if few.num_rows <= broadcast_rows:
        by_path: dict[str, set[str]] = {}
        for p, line in zip(*(c.to_pylist() for c in few.columns)):
            by_path.setdefault(p, set()).add(line)
        heads = df.sparkSession.sparkContext.broadcast(by_path)
    else:
        # The rows of a file go to several tasks, each with a copy of its headers.
        own = lines.groupBy("path").agg(F.collect_set("line").alias("_lines")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
        src = src.withColumn("_s", F.pmod(F.xxhash64("_k", "_t"), F.lit(16)).cast("int")).join(own, ["path", "_s"], "left")
    kind = df.schema[key].dataType.simpleString()
    used = ["_k", "_t", *["path"][: heads is not None], *["_own"][: table is None], *["_lines"][: heads is None]]

    def repairer(rows: dict[str, list[tuple]]) -> Repairer:
        known = {w: fixes for w, own in rows.items() if (fixes := [(o, c) for o, c, _ in own if o is not None and c >= 0])}
        pairs = {(w, o) if c == -1 else (o, w): n for w, own in rows.items() for o, c, n in own if c < 0}
        return Repairer(known, pairs, {w for w, own in rows.items() if any(o is None for o, *_ in own)})

    def run(batches):
        common = repairer(table.value) if table is not None else None
        for batch in batches:
            for part in _slices(batch, 1):
                texts = part.column(1)
                # Only texts that have a trace of any kind are taken apart.
                some = pc.match_substring_regex(texts, _TRACE).fill_null(False).to_numpy(zero_copy_only=False).copy()
                if common is not None:
                    some[Pieces(texts).having(common.known.keys())] = True
                else:
                    some |= pc.is_valid(part.column(used.index("_own"))).to_numpy(zero_copy_only=False)
                if heads is not None:
                    some |= np.fromiter((p in heads.value for p in part.column(2).to_pylist()), bool, len(some))
                else:
                    some |= pc.is_valid(part.column(used.index("_lines"))).to_numpy(zero_copy_only=False)
                done = []
                for row in zip(*(c.to_pylist() for c in part.filter(pa.array(some)).columns)):
                    row = dict(zip(used, row))
                    by = common if common is not None else repairer(by_word(row["_own"]))
                    done.append(by.text(row["_t"], heads.value.get(row["path"], frozenset()) if heads is not None else set(row["_lines"] or ())))
                kinds = [sorted(k) for _, k in done]
                if whole:
                    every = iter(kinds)
                    cols = [pc.replace_with_mask(texts, pa.array(some), pa.array([t for t, _ in done], pa.string())), pa.array([next(every) if x else [] for x in some.tolist()], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[key, "repaired", "kinds"])
                else:
                    noisy = pa.array([bool(k) for k in kinds], pa.bool_())
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(some)).filter(noisy), pa.array([k for k in kinds if k], pa.list_(pa.string()))], names=[key, "kinds"])

    return src.select(*used).mapInArrow(run, f"`{key}` {kind}, {'repaired string, ' if whole else ''}kinds array<string>")


def repair(df: DataFrame, key: str = "chunk_key", text: str = "text", path: str = "path", page: str = "page", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``key``, ``repaired`` and ``kinds`` (sorted) of each row.

    Null, empty and blank texts come back as they are, as do texts without noise. A null path or page only means that the
    text has no headers in common with others. Repeated rows stay, and count once for headers. An empty table gives none.
    Tables of up to ``broadcast_rows`` rows are broadcast; of larger ones each text gets its own by a join.
    """
    return _repair(df, key, text, path, page, broadcast_rows, True)


def traces(df: DataFrame, key: str = "chunk_key", text: str = "text", path: str = "path", page: str = "page", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``key`` and ``kinds`` of the rows in which ``repair`` finds noise; their texts are repaired, but not returned."""
    return _repair(df, key, text, path, page, broadcast_rows, False)
