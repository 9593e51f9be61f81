"""Substring dedup of bytes and of words against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.llm import repeats, rlz, run_index
from clausemill.llm.queries import op1_run_length_index, op2_relative_lz

SMALL = "/root/testdata/sf0.001"


def covered(sequences, width):
    """Which symbols are covered by a window that also starts earlier; sequences in order of their ids."""
    seen, out = set(), []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            w = tuple(s[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        out.append(gone)
    return out


def brute_bytes(docs):
    docs = sorted(docs, key=lambda d: d[0])
    texts = [(t or "").encode() for _, t in docs]
    out = {}
    for (i, _), t, gone in zip(docs, texts, covered(texts, 100)):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


def brute_words(docs):
    docs = sorted(docs, key=lambda d: d[0])
    texts = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    out = {}
    for (i, _), t, gone in zip(docs, texts, covered(texts, 20)):
        out[i] = (len(t), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(t, gone) if not g).encode()).hexdigest())
    return out


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def collection(seed):
    """Passages shared in part, runs of one letter, periods, copies, a frequent phrase in many contexts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [prose(r.randint(15, 90)) for _ in range(8)]
    phrase = prose(9)
    docs = [(1, ""), (2, None), (3, "x" * 950), (4, "ab" * 300 + " " + "x" * 120), (5, "one two three " * 40), (6, "\x0b\x0c\x1c  ")]
    for i in range(7, 60):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages)
            cut = r.randint(0, len(p) // 2)
            parts += [prose(r.randint(0, 30)), r.choice([p, p[cut:], p[: len(p) - cut], phrase, prose(4) + phrase + prose(4)])]
        docs.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    docs += [(60, docs[10][1]), (61, docs[20][1] + " tail"), (62, docs[20][1] + docs[20][1])]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sizes", [(repeats.INDEX_BYTES, repeats.GROUP_BYTES, repeats.FEW), (20000, 1 << 20, 3), (2000, 5000, 3)])
def test_made_up_collections(spark, seed, sizes):
    """Small sizes: groups are split inside tasks and go through further rounds."""
    docs = collection(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert by_id(run_index.remove_repeats(df, *sizes)) == brute_bytes(docs)
    assert by_id(rlz.remove_repeats(df, *sizes)) == brute_words(docs)


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(op2_relative_lz(spark, SMALL)) == brute_words(docs)
    assert by_id(op1_run_length_index(spark, SMALL)) == brute_bytes(docs)


@pytest.mark.parametrize("module", [rlz, run_index])
def test_nulls_repeated_rows_and_other_columns(spark, module):
    text = " ".join(f"word{i} and" for i in range(40))
    rows = [(None, text, "a", 1), (3, text, "b", 2), (3, text, "c", 3), (4, None, "d", 4), (5, "", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string, a int")
    found = sorted(((r[0] is not None, r[0] or 0), r[1], r[2]) for r in module.remove_repeats(df).collect())
    n = found[0][1]
    assert found == [((False, 0), n, 0), ((True, 3), n, n), ((True, 3), n, n), ((True, 4), 0, 0), ((True, 5), 0, 0)]
    assert module.remove_repeats(df.limit(0)).count() == 0


def naive_suffix_array(texts):
    """Each end is a letter of its own, below all others and in the texts' order."""
    flat = [x for i, t in enumerate(texts) for x in [*((1, c) for c in t), (0, i)]]
    return sorted(range(len(flat)), key=lambda i: flat[i:])


@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=5), st.lists(st.integers(1, 4), max_size=20))
@settings(max_examples=200, deadline=None)
def test_run_length_index(texts, query):
    offsets = np.cumsum([0, *map(len, texts)])
    letters = np.array([c for t in texts for c in t], np.int64)
    ends = offsets[1:] + np.arange(len(texts))
    text = np.zeros(len(letters) + len(texts), np.int64)
    text[np.setdiff1d(np.arange(len(text)), ends)] = letters
    assert run_index.suffix_array(text, ends).tolist() == naive_suffix_array(texts)
    length, place = run_index.RunLengthIndex(letters, offsets).matching_statistics(np.array(query, np.int64), np.array([0, len(query)]))
    inside = lambda w: any(t[i : i + len(w)] == w for t in texts for i in range(len(t)))
    for i, (n, p) in enumerate(zip(length.tolist(), place.tolist())):
        assert n == max(k for k in range(len(query) - i + 1) if k == 0 or inside(query[i : i + k]))
        assert n == 0 or text[p : p + n].tolist() == query[i : i + n]


@given(st.lists(st.tuples(st.integers(0, 1), st.lists(st.integers(1, 3), max_size=9)), min_size=1, max_size=5), st.lists(st.integers(1, 4), min_size=1, max_size=15), st.integers(0, 1))
@settings(max_examples=200, deadline=None)
def test_longest_factors(texts, query, own):
    texts.sort(key=lambda t: t[0])
    offsets = np.cumsum([0, *(len(t) for _, t in texts)])
    block = rlz.ReferenceBlock(np.array([c for _, t in texts for c in t], np.uint64), offsets, np.array([g for g, _ in texts]))
    hit = block.factors(np.array(query, np.uint64), np.array([0, len(query)]), np.array([own]), 3)
    inside = lambda w: any(g == own and t[i : i + len(w)] == w for g, t in texts for i in range(len(t)))
    for i, h in enumerate(hit.tolist()):
        assert h == (i + 3 <= len(query) and inside(query[i : i + 3]))


def test_a_text_longer_than_a_step(spark):
    r = random.Random(9)
    prose = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60_000))
    docs = [(1, prose), (2, "x " + prose[1000:300_000] + " y"), (3, prose[:5000] + prose[:5000])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(prose) > repeats.STEP_BYTES
    assert by_id(run_index.remove_repeats(df)) == brute_bytes(docs)
    assert by_id(rlz.remove_repeats(df)) == brute_words(docs)


def test_words_that_collide_in_any_rolling_hash(spark):
    """Two documents share 19 words; the last ones are a Thue-Morse word of 2,048 letters and its complement."""
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    shared = [f"word{i}" for i in range(19)]
    docs = [(1, " ".join([*shared, "".join("ab"[b] for b in morse)])), (2, " ".join([*shared, "".join("ba"[b] for b in morse)])), (3, " ".join([*shared, "".join("ba"[b] for b in morse)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by_id(rlz.remove_repeats(df)) == brute_words(docs)


@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: b.translate(None, b" \t\n\x0b\x0c\r")), max_size=30))
@settings(max_examples=200, deadline=None)
def test_word_hashes_tell_words_apart(found):
    found = [w for w in found if w] + [b"\0", b"\0\0", b"a", b"a\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"abcdefghabcdefgh", b"abcdefghabcdefghi"]
    data = np.frombuffer(b" ".join(found), np.uint8)
    hashes, _, starts, ends = rlz.words(data, np.array([0, len(data)]))
    own = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert own == found and len(set(hashes.tolist())) == len(set(own))
