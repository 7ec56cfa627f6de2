"""Turning texts into unit vectors. The model is pluggable; the default needs no weights."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions.text import tokens
from loamstack.schemas import DIMS

_TOKEN = re.compile(r"[^\W_]+")
BATCH = 128


class Embedder(Protocol):
    """What an embedder must offer. It is sent to the workers, so it should load its model when first used."""

    dims: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of ``dims`` values a text; no rows for no texts."""


@lru_cache(maxsize=200_000)
def bucket(term: str, dims: int) -> tuple[int, int]:
    """Dimension and sign of a term, from its MD5, so that SQL can compute the same."""
    digest = hashlib.md5(term.encode()).hexdigest()  # noqa: S324
    return int(digest[:8], 16) % dims, 1 if int(digest[8], 16) % 2 == 0 else -1


class HashedWords:
    """Signed counts of hashed terms, scaled to unit length. A text without terms has a zero vector."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            for term in _TOKEN.findall((text or "").lower()):
                if len(term.encode()) < 40:
                    at, sign = bucket(term, self.dims)
                    row[at] += sign
        return normalise(out)


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens whose mask is 1: (texts, tokens, dims) and (texts, tokens) to (texts, dims)."""
    return (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)


def normalise(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


class OnnxModel:
    """Slot for a sentence model in ONNX form with a tokenizer file; token vectors are pooled by their mask."""

    def __init__(self, model: str, tokenizer: str, dims: int = DIMS, max_tokens: int = 256):
        self.model, self.tokenizer, self.dims, self.max_tokens = model, tokenizer, dims, max_tokens
        self._loaded = None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            words = Tokenizer.from_file(self.tokenizer)
            words.enable_truncation(self.max_tokens)
            words.enable_padding()
            self._loaded = (words, onnxruntime.InferenceSession(self.model))
        if not texts:
            return np.empty((0, self.dims))
        words, session = self._loaded
        coded = words.encode_batch(texts)
        ids, mask, kinds = (np.array([getattr(c, a) for c in coded], dtype=np.int64) for a in ("ids", "attention_mask", "type_ids"))
        values = {"input_ids": ids, "attention_mask": mask, "token_type_ids": kinds}
        hidden = session.run(None, {i.name: values[i.name] for i in session.get_inputs()})[0]
        return normalise(masked_mean(hidden, mask))


def embed_rows(df: DataFrame, embedder: Embedder, keys: list[str], text: str = "text", batch: int = BATCH, done=None) -> DataFrame:
    """``keys`` and ``embedding`` of each row, in batches of ``batch`` texts; the model is loaded once a worker.

    ``done``: an accumulator that is told of the rows of each batch; it counts those of repeated tasks again.
    """

    def run(batches):
        for rows in batches:
            texts = [t or "" for t in rows.column(len(keys)).to_pylist()]
            parts = [embedder.embed(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            flat = np.concatenate(parts).astype(np.float32).ravel() if parts else np.empty(0, np.float32)
            offsets = pa.array(np.arange(len(texts) + 1) * embedder.dims, pa.int32())
            if done is not None:
                done.add(len(texts))
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[*keys, "embedding"])

    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text)).mapInArrow(run, f"{names}, embedding array<float>")


def hashed_parts(df: DataFrame, key: str, text: str = "text", dims: int = DIMS) -> DataFrame:
    """The default embedding as rows of ``key``, ``bucket`` and ``weight`` (9 decimals), by JVM functions only."""
    digest = F.md5(F.col("term").cast("binary"))
    at = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int")
    sign = F.when(F.pmod(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int"), F.lit(2)) == 0, 1).otherwise(-1)
    counts = df.select(key, F.explode(tokens(F.col(text))).alias("term")).select(key, at.alias("bucket"), sign.alias("sign")).groupBy(key, "bucket").agg(F.sum("sign").alias("n")).where("n <> 0")
    length = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("length"))
    return counts.join(length, key).select(key, "bucket", F.round(F.col("n") / F.col("length"), 9).alias("weight"))
