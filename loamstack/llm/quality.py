"""Per-document text quality statistics (problem 10).

Statistics of each text are computed in one pass. For each language, mean and covariance of prose are estimated robustly:
documents are taken as prose at first where most of their characters stand in lines of running text, and then, again and
again, where their distance from the last estimate is small. The squared Mahalanobis distance of a document from the prose
of its language splits into one contribution for each statistic; documents beyond the limit are not natural prose.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.session import cut_lineage

STATS = ["log_words", "mean_word_len", "symbol_ratio", "digit_ratio", "upper_ratio", "punct_lines", "common_share", "distinct_share", "running_share"]
#: Squared distance beyond which a document is no prose: seven standard deviations.
LIMIT = 49.0

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"\S+")
_ENDS = (".", "!", "?", "…", "”", "\"", "»", "。", "!", "?")
_STOP = re.compile(r"[.!?…][”\"»)’']*(?=\s|$)")
_ITEM = re.compile(r"^\s*(?:[-*+•·–‣◦]|\(?[0-9]{1,4}[.)\]]|\(?[a-zA-Z][.)]|[IVXLivxl]{1,6}[.)]|\|)\s*(?:\[[ xX]\]\s*)?")
_COMMENT = re.compile(r"^\s*(?://|#|--|/\*)\s?\S")
_CODE = re.compile(r"[{};]\s*$|^\s*(?:def|class|fn|pub|let|const|struct|impl|import|from|return|for|if|elif|while|echo|self|done|fi|else)\b.*[:;{(=\[]|\w\(.*\)|[=!<>]=|->|=>|\$\w|::")


_ASCII = re.compile("[\x00-\x7f]+")
_LETTERS, _DIGITS, _CAPITALS = (signs.encode() for signs in (string.ascii_letters, string.digits, string.ascii_uppercase))


@lru_cache(maxsize=4)
def _union(lists: tuple[frozenset[str], ...]) -> frozenset[str]:
    return frozenset().union(*lists)


def running_chars(text: str, common: frozenset[str]) -> int:
    """Characters that stand in running text.

    Lines are joined over soft wraps into blocks. A block is running text if function words make up a fair share of its
    words and it reads on over some length; items of lists, rows of tables, log lines, code and its comments do not.
    """
    total = 0
    block: list[str] = []

    def close() -> None:
        nonlocal total
        if block:
            joined = " ".join(block)
            if _is_running(joined, common):
                total += len(joined)
            block.clear()

    lines = text.split("\n")
    for i, line in enumerate(lines):
        if not line.strip():
            close()
            continue
        item, code = _ITEM.match(line), _CODE.search(line)
        if _COMMENT.match(line):
            close()
            continue
        if item or (code and not _is_running(line, common, strict=True)):
            close()
            # A list's item counts if it is running text by itself; a comment in code does not.
            if item and not code and _is_running(line[item.end() :], common, strict=True):
                total += len(line)
            continue
        if block and (block[-1].rstrip().endswith(_ENDS) and len(block[-1]) < 40 or len(block[-1]) > 200):
            close()
        block.append(line.strip())
    close()
    return total


def _is_running(text: str, common: frozenset[str], strict: bool = False) -> bool:
    words = _WORD.findall(text)
    tokens = len(_TOKEN.findall(text))
    if len(words) < (5 if strict else 4) or tokens == 0:
        return False
    hits = sum(map(common.__contains__, map(str.lower, words)))
    letters = sum(map(len, words))
    return hits / len(words) >= 0.16 and letters >= 0.6 * len(text) and (not strict or bool(_STOP.search(text)))


def statistics(text: str, common: dict[str, frozenset[str]], lang: str | None) -> tuple:
    """Language, number of words and the values of STATS of a text that is not blank.

    The language is the one of which most words are common words; a known ``lang`` wins ties.
    """
    words = _WORD.findall(text.lower())
    n = len(words)
    counts = Counter(words)
    hits = {code: sum(counts[w] for w in own & counts.keys()) for code, own in common.items()}
    best = max(sorted(hits), key=lambda c: (hits[c], c == lang), default="")
    every = _union(tuple(common.values()))
    visible = "".join(text.split()) or " "
    # ASCII is counted by deleting, which takes a fraction of the time of asking every character.
    raw = visible.encode("ascii", "ignore")
    other = "" if len(raw) == len(visible) else _ASCII.sub("", visible)
    letters = len(raw) - len(raw.translate(None, _LETTERS)) + sum(map(str.isalpha, other))
    digits = len(raw) - len(raw.translate(None, _DIGITS)) + sum(map(str.isdigit, other))
    upper = len(raw) - len(raw.translate(None, _CAPITALS)) + sum(map(str.isupper, other))
    lines = [x for x in text.split("\n") if x.strip()]
    size = len(visible)
    return (
        best or lang or "", n, math.log1p(n), sum(map(len, words)) / n if n else 0.0, (size - letters - digits) / size, digits / size, upper / max(letters, 1),
        sum(x.rstrip().endswith(_ENDS) for x in lines) / max(len(lines), 1), (hits[best] / n if n else 0.0) if hits else 0.0,
        len(counts) / math.sqrt(n) if n else 0.0, min(1.0, running_chars(text, every) / max(len(text.strip()), 1)),
    )


def describe(df: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, ``lang``, ``n_words`` and STATS of each row; nulls for null, empty and blank texts.

    ``words``: (lang, word), the common words; this table is broadcast and must not exceed 100,000 rows. A lang is taken
    without case and region. Repeated rows stay. One pass without a shuffle.
    """
    rows = words.where("lang is not null and word is not null").select(F.lower("lang"), F.lower("word")).distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 common words")
    lists: dict[str, set[str]] = {}
    for code, word in rows:
        lists.setdefault(code, set()).add(word)
    common = {code: frozenset(own) for code, own in lists.items()}
    names = ["lang", "n_words", *STATS]
    kinds = [pa.string(), pa.int64(), *[pa.float64()] * len(STATS)]

    def run(batches):
        for batch in batches:
            done = [
                statistics(t, common, code) if t and t.strip() else (None,) * len(names)
                for t, code in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in done], k) for i, k in enumerate(kinds))], names=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, lang string, n_words bigint, " + ", ".join(f"{s} double" for s in STATS)
    return df.select(F.col(key), F.col(text), F.lower(F.substring(F.trim(F.col(lang)), 1, 2))).mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    """Languages and STATS of the rows of a batch; NaN where there are none."""
    return batch.column("lang").to_pylist(), np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS]).astype(float)


def contributions(langs: list, x: np.ndarray, model: dict) -> np.ndarray:
    """Each statistic's part of the squared Mahalanobis distance from the prose of the row's language."""
    out = np.full(x.shape, np.nan)
    codes = np.array([code if code in model else "" for code in langs], dtype=object)
    for code in set(codes):
        rows = codes == code
        mean, inverse = model[code]
        apart = x[rows] - mean
        out[rows] = apart * (apart @ inverse)
    return out


def _moments(stats: DataFrame, model: dict, keep: float) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Number, mean and covariance of STATS by language over what counts as prose; tasks send sums only."""
    d = len(STATS)

    def sums(batches):
        for batch in batches:
            langs, x = _matrix(batch)
            # Running text only starts the estimate; from then on the distance chooses.
            good = contributions(langs, x, model).sum(1) <= keep if model else x[:, STATS.index("running_share")] > 0.5
            codes = np.array([c or "" for c in langs], dtype=object)
            rows = []
            for code in set(codes[good]):
                own = x[good & (codes == code)]
                values = [len(own), *own.sum(0), *(own.T @ own).ravel()]
                rows += [(code, i, float(v)) for i, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.float64()))], names=["lang", "i", "v"])

    found: dict[str, np.ndarray] = {}
    for code, i, v in stats.where("lang is not null").mapInArrow(sums, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v")).collect():
        found.setdefault(code, np.zeros(1 + d + d * d))[i] = v
    out = {}
    for code, v in found.items():
        n, mean = int(v[0]), v[1 : 1 + d] / v[0]
        out[code] = (n, mean, v[1 + d :].reshape(d, d) / v[0] - np.outer(mean, mean))
    return out


# A statistic's least standard deviation, so that one that hardly varies in prose does not decide alone.
LEAST = np.array([1.0, 0.35, 0.02, 0.02, 0.02, 0.15, 0.04, 1.0, 0.12])


# Where a corpus has no prose at all: what prose has.
TYPICAL = np.array([5.0, 4.8, 0.03, 0.01, 0.03, 0.8, 0.4, 5.0, 0.98])


def fit_prose(stats: DataFrame, rounds: int = 3, keep: float = 24.0, least: int = 20) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and inverse covariance of prose by language (as many rows as there are languages). '' stands for all languages.

    ``rounds`` of choosing the rows nearer than ``keep`` and estimating again. Languages of fewer than ``least`` prose
    documents have the estimate of all.
    """
    model: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(rounds):
        found = _moments(stats, model, keep)
        if not found:
            break
        n = sum(x[0] for x in found.values())
        mean = sum(x[0] * x[1] for x in found.values()) / n
        cov = sum(x[0] * (x[2] + np.outer(x[1] - mean, x[1] - mean)) for x in found.values()) / n
        ready = {"": (mean, cov)} | {code: (m, c) for code, (k, m, c) in found.items() if k >= least}
        model = {code: (m, np.linalg.inv(c + np.diag(LEAST**2))) for code, (m, c) in ready.items()}
    return model or {"": (TYPICAL, np.diag(1 / LEAST**2))}


def assess(df: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", limit: float = LIMIT) -> DataFrame:
    """STATS of each row, the squared ``distance`` from prose, each statistic's part of it (``d_...``), and ``prose``.

    A text is not natural prose if its distance is over ``limit``; nothing else decides. Null, empty and blank texts have nulls and are no case of either. Repeated rows stay; an empty table gives
    no rows.
    """
    stats = cut_lineage(describe(df, words, key, text, lang))
    model = fit_prose(stats)

    def judge(batches):
        for batch in batches:
            langs, x = _matrix(batch)
            parts = contributions(langs, x, model)
            far = parts.sum(1)
            prose = far <= limit
            blank = np.array([code is None for code in langs])
            floats = [pa.array(c, pa.float64(), mask=blank) for c in (far, *parts.T)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *floats, pa.array(prose, pa.bool_(), mask=blank)], names=[*batch.schema.names, "distance", *(f"d_{s}" for s in STATS), "prose"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields)
    return stats.mapInArrow(judge, f"{schema}, distance double, " + ", ".join(f"d_{s} double" for s in STATS) + ", prose boolean")
