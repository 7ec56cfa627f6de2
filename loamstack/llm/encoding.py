"""Text garbled by a wrong character encoding (problem 5).

Bytes of one encoding that were read in another turn a letter into one or more unlikely ones. The way back is a path of
operations: write the text in one encoding and read it in another, or resolve escapes. A best-first search over the
texts that can be reached goes on from the most plausible one and keeps the cheapest. Plausibility comes from the corpus:
the pairs of neighbouring characters of all its words that are not plain ASCII, counted in one pass.

Each distinct word is searched once. Ways back that only a step between one-byte encodings gave must make words that the
corpus has; what they are held against are exact counts, by joins. The texts then look their words up.
"""

from __future__ import annotations

import codecs
import heapq
import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.lookup import BROADCAST_ROWS, by_word, with_own
from loamstack.session import cut_lineage

# A word that is not plain ASCII; it begins behind white space, so a long ASCII run is passed over once.
_WORD = re.compile("(?<![^ \n\t\r])[\x00-\x08\x0b\x0c\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^ \n\t\r]*")
# A plain ASCII word, which may hold escapes.
_PLAIN = re.compile("(?<![^ \n\t\r])[!-~]++(?![^ \n\t\r])")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
# What lossy writing leaves: words of question marks, or one inside a word or where a hyphen was at a line's end.
_LOST = re.compile(r"(?<![\w?!])\?{2,}(?: \?{2,}){1,}|(?<=[a-z])\?(?=[a-z]{2})(?![a-z]+=)|(?<=[^\W\d_])\?\n(?=[a-zà-ÿ])")
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[]^_`{|}~"
_LINK = re.compile(r"[/=&#]")
# Parts of a word that has no way back as a whole: what lies between wide blanks, then between ASCII signs, which no
# encoded character has within.
_PARTS = [re.compile(r"\S+"), re.compile("[^\x00-/:-@\\[-`{-\x7f]+")]
_ODD = re.compile("[\x7f-\x9f�]")

# Encodings that texts are wrongly read in, and those they are truly in.
WRONG = ("cp1252", "mac_roman", "cp1251", "cp1250", "cp850", "cp437", "koi8_r")
TRUE = ("cp1252", "cp1251", "mac_roman", "cp850", "koi8_r")


def _reader(codec: str) -> str:
    """The 256 characters of a one-byte encoding; bytes it leaves open are read as control characters, as readers do."""
    out = []
    for byte in range(256):
        try:
            out.append(bytes([byte]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return "".join(out)


_READ = {c: _reader(c) for c in {*WRONG, *TRUE}}
_WRITE = {c: {ord(ch): byte for byte, ch in reversed(list(enumerate(_READ[c])))} for c in WRONG}
for _c in ("cp1252",):  # read as Latin-1, these bytes are control characters
    _WRITE[_c] = {**{n: n for n in range(128, 160)}, **_WRITE[_c]}


def _class(ch: str) -> str:
    """Characters that count as one: ASCII capitals, digits, and each block beyond the symbols."""
    if ch < "\x80":
        return "A" if "A" <= ch <= "Z" else "0" if ch.isdigit() else ch
    return ch if ch < "☀" else chr(ord(ch) & ~0xFF) if ch < "\U00010000" else "\U0001f300"


_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def pairs_of(word: str) -> list[str]:
    shape = "".join(map(_class, word))
    shape = f"^{shape}$"
    return [shape[i : i + 2] for i in range(len(shape) - 1)]


def cores_of(text: str) -> list[str]:
    """Its runs of letters that are not plain ASCII, in lower case."""
    return [c for c in _LETTERS.findall(text.lower()) if not c.isascii()]


def unescaped(word: str) -> str | None:
    """The word with its escapes resolved once; None if it has none."""
    if "&" not in word and "\\u" not in word:
        return None
    plain = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), html.unescape(word))
    return plain if plain != word else None


def resolved(word: str) -> str:
    """The word with its escapes resolved until there are none left."""
    while (plain := unescaped(word)) is not None:
        word = plain
    return word


def suspects(text: str) -> list[re.Match]:
    """The words of a text that may be garbled: those that are not plain ASCII, or not once their escapes are resolved."""
    found = list(_WORD.finditer(text)) if not text.isascii() else []
    if "&" in text or "\\u" in text:
        found += [m for m in _PLAIN.finditer(text) if not resolved(m[0]).isascii()]
        found.sort(key=re.Match.start)
    return found


def parts_of(word: str) -> list[re.Match]:
    """Parts in which a word is looked at that has no way back as a whole; none if it is a part itself."""
    for pattern in _PARTS:
        parts = [m for m in pattern.finditer(word) if not m[0].isascii()]
        if [m[0] for m in parts] != [word]:
            return parts
    return []


def searched(text: str) -> set[str]:
    """All words and parts that may be looked up for a text."""
    out: set[str] = set()
    left = [m[0] for m in suspects(text)]
    while left:
        word = left.pop()
        if word not in out:
            out.add(word)
            left += [m[0] for m in parts_of(word)]
    return out


class Searcher:
    """Finds ways back of words. ``margin``: by how much, in nats, the way back must lower the cost; ``even``: how much more
    for each step between one-byte encodings, which is weaker evidence than well-formed UTF-8."""

    def __init__(self, counts: dict[str, int], margin: float = 4.0, even: float = 2.5, depth: int = 3, expansions: int = 16):
        self.total = math.log(sum(counts.values()) + 1.0)
        self.costs = {pair: self.total - math.log(n + 0.5) for pair, n in counts.items()}
        self.unseen = self.total - math.log(0.05)
        self.margin, self.even, self.depth, self.expansions = margin, even, depth, expansions

    def cost(self, word: str) -> float:
        """Sum over neighbouring characters of how rare the pair is; control characters cost extra."""
        costs, unseen = self.costs, self.unseen
        odd = 6.0 * len(_ODD.findall(word))
        if len(word) > 64:  # the same sum, pair by pair
            shape = f"^{word}$"
            return sum(n * costs.get(_class(a) + _class(b), unseen) for (a, b), n in Counter(zip(shape, shape[1:])).items()) + odd
        return sum(costs.get(p, unseen) for p in pairs_of(word)) + odd

    def _next(self, word: str):
        for codec in WRONG:
            try:
                raw = codecs.charmap_encode(word, "strict", _WRITE[codec])[0]
            except UnicodeEncodeError:
                continue
            try:
                yield raw.decode("utf-8"), 0.0
            except UnicodeDecodeError:
                pass
            for true in TRUE:
                if true != codec:
                    yield codecs.charmap_decode(raw, "strict", _READ[true])[0], self.even

    def options(self, word: str) -> tuple[str, list[tuple[str, float, bool]]]:
        """The word with all escapes resolved, and the texts that can be reached and are cheaper enough, the cheapest first:
        text, how much cheaper it is, and whether the corpus must have its words.

        Writing and reading anew, and resolving escapes, are the edges. Resolving escapes alone undoes no wrong reading,
        so a text counts only behind a step of the other kind, and is held against the word in its best escaped form.
        """
        plain, start = word, self.cost(word)
        while (further := unescaped(plain)) is not None:
            plain, start = further, min(start, self.cost(further))
        limit = start - self.margin
        heap, seen, found, left = [(self.cost(word), 0, word, 0.0, False)], {(word, False), (plain, True)}, [], self.expansions
        while heap and left:
            own, depth, text, paid, read = heapq.heappop(heap)
            left -= 1
            if (resolved := unescaped(text)) is not None and (resolved, read) not in seen:
                seen.add((resolved, read))
                cost = self.cost(resolved) + paid
                if read and cost < limit:
                    found.append((cost, resolved, paid))
                heapq.heappush(heap, (cost, depth, resolved, paid, read))
            for other, price in self._next(text):
                if (other, True) in seen:
                    continue
                seen.add((other, True))
                cost = self.cost(other) + paid + price
                if cost < limit:
                    found.append((cost, other, paid + price))
                # Only what became no dearer can be on the way of a wrong reading that was undone.
                if depth + 1 < self.depth and cost <= own:
                    heapq.heappush(heap, (cost, depth + 1, other, paid + price, True))
        # Where only escapes hide characters beyond ASCII, one-byte steps say nothing: each such escape was written on purpose.
        found = sorted((f for f in found if not (f[2] and word.isascii())), key=lambda f: f[0])
        return plain, [(text, start - cost, paid > 0) for cost, text, paid in found]


def choose(plain: str, options: list, counts: dict[str, int]) -> tuple[str, float] | None:
    """The cheapest option of which the corpus, where it must, has all words that are not plain ASCII, more often than
    those of the word itself. Single letters are no words."""

    def least(text: str) -> int | None:
        return min((counts.get(c, 0) if len(c) > 1 else 0 for c in cores_of(text)), default=None)

    for fixed, gain, must in options:
        if not must or (own := least(fixed)) is None or own > max(1, 2 * (least(plain) or 0)):
            return fixed, gain
    return None


class Repairer:
    """Looks words up in ``fixes`` ({word: [(fixed, gain)]}) and puts texts together again."""

    def __init__(self, fixes: dict[str, list[tuple[str, float]]], most: int = 300_000):
        self.fixes, self.most = fixes, most
        self.known: dict[str, tuple[str, float]] = {}

    def word(self, word: str) -> tuple[str, float]:
        """The restored word and its gain; the word and 0 if there is no way back. Where the whole has none, its parts are looked at."""
        if (fix := self.fixes.get(word)) is not None:
            return fix[0]
        found = self.known.get(word)
        if found is None:
            out, at, gain = [], 0, 0.0
            for m in parts_of(word):
                fixed, won = self.word(m[0])
                out += [word[at : m.start()], fixed]
                gain, at = max(gain, won), m.end()
            found = ("".join([*out, word[at:]]), gain) if gain else (word, 0.0)
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = found
        return found

    def text(self, text: str | None) -> tuple[str | None, bool]:
        """The restored text and whether any passage is garbled, restorable or not. Other texts come back unchanged."""
        if not text:
            return text, False
        out, at, garbled = [], 0, False
        if not text.isascii() or "&" in text or "\\u" in text:
            found = [(m, *self.word(m[0])) for m in suspects(text)]
            # A lone character says little by itself; it counts where a word of the same text is garbled.
            garbled = any(gain and len(m[0].strip(_EDGES)) > 1 for m, _, gain in found)
            for m, fixed, gain in found if garbled else ():
                if gain:
                    out += [text[at : m.start()], fixed]
                    at = m.end()
            garbled = garbled or "�" in text
        if not garbled and "?" in text:
            m = _LOST.search(text)
            garbled = m is not None and not (m[0] == "?" and _LINK.search(text, max(0, m.start() - 40), m.end() + 20))
        return "".join([*out, text[at:]]) if at else text, garbled


def model_of(found: Counter) -> tuple[Counter, Counter]:
    """Counts of neighbouring characters, and of words in lower case, over counted words that are not plain ASCII."""
    pairs, words = Counter(), Counter()
    for word, n in found.items():
        for pair in pairs_of(word):
            pairs[pair] += n
        for core in cores_of(word):
            words[core] += n
    return pairs, words


def corpus_model(df: DataFrame, text: str = "text") -> DataFrame:
    """``kind``, ``key`` and ``n``: counts of neighbouring characters (pair) and of words (core) that are not plain ASCII, and
    the words and parts to be searched (word). Each task adds up its own before anything is shuffled."""

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            asked: set[str] = set()
            for t in batch.column(0).to_pylist():
                if t and (not t.isascii() or "&" in t or "\\u" in t):
                    if not t.isascii():
                        found.update(_WORD.findall(t))
                    asked |= searched(t)
            pairs, words = model_of(found)
            rows = [*(("pair", a, n) for a, n in pairs.items()), *(("core", a, n) for a, n in words.items()), *(("word", a, 1) for a in asked)]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "key", "n"])

    return df.select(text).mapInArrow(count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def fixes_of(model: DataFrame) -> DataFrame:
    """``word``, ``fixed`` and ``gain`` of the words of a corpus model that have a way back.

    The pairs of characters reach the driver: there are no more than the square of the characters below U+2600 and of the
    blocks above. Words and their counts stay distributed.
    """
    rows = model.where("kind = 'pair'").select("key", "n").toArrow()
    counts = model.sparkSession.sparkContext.broadcast(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))
    option = pa.list_(pa.struct([("fixed", pa.string()), ("gain", pa.float64()), ("must", pa.bool_())]))

    def search(batches):
        searcher = Searcher(counts.value)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for word in batch.column(0).to_pylist():
                plain, found = searcher.options(word)
                if found:
                    out[0].append(word)
                    out[1].append(plain)
                    out[2].append([dict(zip(("fixed", "gain", "must"), f)) for f in found])
                    must = any(f[2] for f in found)
                    out[3].append(sorted({c for t in (plain, *(f[0] for f in found if f[2])) for c in cores_of(t)}) if must else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), option, pa.list_(pa.string())))], names=["word", "plain", "options", "cores"])

    found = cut_lineage(model.where("kind = 'word'").select("key").mapInArrow(search, "word string, plain string, options array<struct<fixed:string,gain:double,must:boolean>>, cores array<string>"))
    have = model.where("kind = 'core'").select(F.col("key").alias("core"), "n")
    counted = found.select("word", F.explode("cores").alias("core")).join(have, "core").groupBy("word").agg(F.collect_list(F.struct("core", "n")).alias("counts"))

    def decide(batches):
        for batch in batches:
            rows = []
            for word, plain, options, own in zip(*(c.to_pylist() for c in batch.columns)):
                fix = choose(plain, [(o["fixed"], o["gain"], o["must"]) for o in options], {c["core"]: c["n"] for c in own or ()})
                if fix:
                    rows.append((word, *fix))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64()))], names=["word", "fixed", "gain"])

    return found.join(counted, "word", "left").select("word", "plain", "options", "counts").mapInArrow(decide, "word string, fixed string, gain double")


def repair(df: DataFrame, key: str = "chunk_key", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``key``, ``garbled`` and ``restored`` of each row.

    Null texts stay null, empty and blank ones as they are; none is garbled. Repeated rows stay. Where a passage cannot be
    restored it stays as it is, and the row is still marked. Two passes over the text; what is shuffled are distinct words
    that are not plain ASCII. Fixes are broadcast up to ``broadcast_rows``; beyond, each text gets its own by a join.
    """
    fixes = cut_lineage(fixes_of(cut_lineage(corpus_model(df, text))))
    src, shared = with_own(df.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_t", fixes, searched, broadcast_rows)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        common = Repairer(shared.value) if shared is not None else None
        for batch in batches:
            texts, own = batch.column(1).to_pylist(), batch.column(2).to_pylist() if common is None else ()
            results = [common.text(t) for t in texts] if common is not None else [Repairer(by_word(o)).text(t) for t, o in zip(texts, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g for _, g in results], pa.bool_()), pa.array([t for t, _ in results], pa.string())], names=[key, "garbled", "restored"])

    return src.select("_k", "_t", "_own").mapInArrow(run, f"`{key}` {kind}, garbled boolean, restored string")
