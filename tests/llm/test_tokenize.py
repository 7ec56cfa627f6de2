"""Encoding against two libraries, and the streaming decoder."""

import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstack.llm.bpe import SPLIT, Encoder, StreamDecoder, read_ranks
from loamstack.llm.tokenize import TOKENIZERS, count_tokens, decode, encode

RANKS = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary here")
HARD = ["", " ", "   x", "a  b", "a \n b", "\n\n x", "x\n\n  y \t z", "don't we'll 'S", "<|endoftext|> text", "नमस्ते दुनिया", "👨‍👩‍👧 family", "\x00\x01\x1c a", "a\x00b c", "x" * 5000, "ab" * 3000, " " * 3000 + "end", "1234567890 12 3", "é\xa0€ \xa0x", "\u3000wide\u2003space"]


@pytest.fixture(scope="module")
def own():
    return Encoder(RANKS)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(own, reference, text):
    assert own.encode(text) == reference(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("  \n\tabcdeeinorstxyz'.,1")), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(own, reference, text):
    assert own.encode(text) == reference(text)


def test_small_state_limit(reference):
    from loamstack.llm.bpe import Transducer, read_ranks

    t = Transducer(read_ranks(RANKS), max_states=50)
    for word in (" tokenization", " internationalisation", "zzzzqqqq", " the"):
        assert t.encode(word.encode()) == reference(word)


def test_decoder_gives_whole_characters(own):
    decoder = StreamDecoder(own.transducer.tokens)
    text = "naïve 👨‍👩‍👧 नम"
    parts = [decoder.feed([i]) for i in own.encode(text)]
    assert "".join(parts) + decoder.close() == text and "�" not in "".join(parts)
    assert decoder.feed(own.encode("👨")[:1]) == "" and decoder.close() == "�"


def test_rows(spark, reference):
    rows = [(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'s' as source")
    found = [(r["doc_id"], list(r["ids"])) for r in encode(df).collect()]
    assert sorted(found, key=str) == sorted([(k, reference(t or "")) for k, t in rows], key=str)
    assert sorted(r["n_tokens"] for r in count_tokens(df, keep=("source",)).collect()) == [0, 0, 1, 2, 2]
    assert encode(df.limit(0)).count() == 0


NAMES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


@pytest.mark.parametrize("name", NAMES)
def test_other_vocabularies(spark, name):
    if not os.path.exists(os.path.join(TOKENIZERS, name)):
        pytest.skip("no such vocabulary here")
    texts = ["Hello <|endoftext|> world", "Größe été 猫 𝒳", None, "", "  a  b\n"]
    rows = [r["ids"] for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks=name).orderBy("doc_id").collect()]
    assert rows[2] == rows[3] == [] and all(rows[i] for i in (0, 1, 4))
    if name.endswith(".tiktoken"):
        own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=read_ranks(os.path.join(TOKENIZERS, name)), special_tokens={})
        assert rows == [own.encode_ordinary(t or "") for t in texts]
    elif name == "byte_bpe_50k.json":
        assert rows == [r["ids"] for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_decoding(spark):
    texts = ["Größe été 猫 𝒳 " * 50, "", "a\x00b"]
    coded = encode(spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string"))
    assert [r["text"] for r in decode(coded).orderBy("doc_id").collect()] == [*texts, ""]
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None
