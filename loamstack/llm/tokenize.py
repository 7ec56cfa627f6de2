"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8)."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.llm.bpe import Encoder, StreamDecoder, read_ranks

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"


_sent: set[tuple[str, str]] = set()


def _send(spark: SparkSession, path: str) -> None:
    """Send the vocabulary file to the executors, once an application, for those that do not have it at its path."""
    mark = (spark.sparkContext.applicationId, path)
    if mark not in _sent and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _sent.add(mark)


def _found(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder a Python worker, so that its states serve all tasks the worker runs."""
    return Encoder(_found(path))


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(_found(path)).items()}


@lru_cache(maxsize=2)
def _library(path: str):
    """A function from texts to lists of ids, of a vocabulary that a public library reads."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=_found(path)).encode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_found(path))
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """``key`` and ``ids`` of each row, without special tokens.

    Null and empty texts have an empty list. Strings that look like special tokens are ordinary text. A null key stays.
    Repeated rows stay; other columns are dropped. One pass over the text, no shuffle: each row is independent.

    ``ranks`` names a rank file (.tiktoken), which the transducer reads. Vocabularies of other kinds (.json, .model) split
    and normalise in their own ways and go through the library they belong to.
    """
    path = os.path.join(folder, ranks)
    _send(df.sparkSession, path)
    if not ranks.endswith(".tiktoken"):
        return _by_library(df, key, text, path)

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            packed = [encoder.packed(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            flat = np.frombuffer(b"".join(packed), dtype=np.int32)
            ids = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """As ``encode``, with the number of ids (``n_tokens``) instead of the ids and the columns ``keep`` beside it."""
    path = os.path.join(folder, ranks)
    _send(df.sparkSession, path)
    names = [key, *keep]

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            counts = pa.array([len(encoder.packed(t)) // 4 for t in batch.column(len(names)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], counts], names=[*names, "n_tokens"])

    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return df.select(*names, F.col(text)).mapInArrow(run, f"{schema}, n_tokens bigint")


def _by_library(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    def run(batches):
        encode_all = _library(path)
        for batch in batches:
            ids = encode_all([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i if t else [] for i, t in zip(ids, batch.column(1).to_pylist())], pa.list_(pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """``key`` and ``text`` of each row of ids of a rank file, by an incremental UTF-8 decoder.

    Null ids give a null text, no ids an empty one. Bytes that make no character become U+FFFD; an id the vocabulary does
    not have fails. Repeated rows stay.
    """
    path = os.path.join(folder, ranks)
    _send(df.sparkSession, path)

    def run(batches):
        tokens = _tokens(path)
        for batch in batches:
            texts = []
            for own in batch.column(1).to_pylist():
                stream = StreamDecoder(tokens)
                texts.append(None if own is None else stream.feed(own) + stream.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
