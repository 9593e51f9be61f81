import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausemill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
V = bpe.vocabulary(PATH)
T = Tokenizer.from_file(PATH)


def ids(text):
    return [i for block in bpe.encode(V, text) for i in block]


def streamed(text, size):
    e = bpe.Encoder(V)
    out = []
    for i in range(0, len(text), size):
        out += e.feed(text[i : i + size])
    return out + e.finish()


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_as_the_library(text):
    assert ids(text) == T.encode(text, add_special_tokens=False).ids
    d = bpe.Decoder(V)
    assert "".join(d.feed([i]) for i in ids(text)) + d.finish() == T.decode(ids(text), skip_special_tokens=False)


@given(st.text(alphabet=" \n\t'slrevLa1é½_.", max_size=40), st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_blocks_of_any_size_give_the_same(text, size):
    assert streamed(text, size) == T.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ["a", "ab", "the", " ", " \n", "=-", "12", "éß", "abcdefghijklmnopqrstuvwxyz", "ethanio"])
def test_long_runs_as_the_library(alphabet):
    r = random.Random(alphabet)
    text = "x" + "".join(r.choice(alphabet) for _ in range(6000)) + " end"
    expected = T.encode(text, add_special_tokens=False).ids
    assert ids(text) == expected
    assert streamed(text, 100) == expected


def test_run_windows_are_stable():
    r = random.Random(3)
    words = [b.decode() for b in V.bytes if b.isalpha() and b.isascii()]
    for _ in range(20):
        data = "".join(r.choice(words) for _ in range(900)).encode()[:4000]
        run = bpe.Run(V)
        assert run.push(data) + run.finish() == V.merged(data)


def test_added_tokens_and_lookahead():
    text = "a<|endoftext|>b <|endoftext|><|endoftext|>"
    assert ids(text) == T.encode(text, add_special_tokens=False).ids
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"ab", b"c")]) == 3 + 2
    assert V.lookahead < 2000


def test_nulls_empties_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (None, None, 3), (2, "", 4)], "doc_id long, text string, ids int")
    rows = bpe.round_trip(docs, PATH).collect()
    assert [r.n_tokens for r in rows] == [2, 2, 0, 0]
    back = bpe.texts(bpe.token_ids(docs, PATH), PATH).collect()
    assert [r.text for r in back] == ["a b", "a b", "", ""]
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_every_text_is_fed(monkeypatch):
    """Short or long, all characters go through the transducer."""
    fed = []
    feed = bpe.Encoder.feed
    monkeypatch.setattr(bpe.Encoder, "feed", lambda self, text: (fed.append(len(text)), feed(self, text))[1])
    for text in ("a", "two words", "x" * 700, "word " * 20_000):
        fed.clear()
        assert ids(text) == T.encode(text, add_special_tokens=False).ids
        assert sum(fed) == len(text) and max(fed) <= bpe.BLOCK_CHARS


def test_memory_is_constant_on_a_text_without_end():
    """What the encoder holds doesn't grow while 5 MB go through."""
    e, block, most = bpe.Encoder(V), "a run that goes on and on, word by word. " * 250 + "z" * 2000, 0
    for _ in range(100_000_000 // len(block) // 20):
        e.feed(block)
        most = max(most, len(e.tail) + (len(e.run.data) if e.run else 0))
    assert most < 4 * V.lookahead + bpe.LONG_PIECE
