"""Fuzzy ratios against plain dynamic programming."""

from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.functions import similarity as s


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


letters = st.text(alphabet="abc ", max_size=12)


@given(letters, letters)
@settings(max_examples=300, deadline=None)
def test_ratio(a, b):
    assert s.lcs(a, b) == lcs(a, b) and s.ratio(a, b) == ratio(a, b)


@given(letters, letters)
@settings(max_examples=300, deadline=None)
def test_partial_ratio(a, b):
    short, long_ = sorted((a, b), key=len)
    if len(a) == len(b):
        short, long_ = a, b
    if not short:
        expected = 100.0 if not long_ else 0.0
    else:
        m = len(short)
        expected = max(ratio(short, long_[max(0, i) : i + m]) for i in range(1 - m, len(long_)))
    assert abs(s.partial_ratio(a, b) - expected) < 1e-9


def test_long_terms_take_the_same_windows():
    term, text = "abcde " * 12, "xx" + "abcdf " * 14 + "yy"
    m = len(term)
    assert len(term) > 60
    assert abs(s.partial_ratio(term, text) - max(ratio(term, text[max(0, i) : i + m]) for i in range(1 - m, len(text)))) < 1e-9


@given(letters, letters)
@settings(max_examples=300, deadline=None)
def test_token_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    both, one, two = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
    if not x or not y:
        expected = 0.0
    elif both and (not one or not two):
        expected = 100.0
    else:
        p, q = f"{both} {one}".strip(), f"{both} {two}".strip()
        expected = max([ratio(p, q)] + ([ratio(both, p), ratio(both, q)] if both else []))
    assert abs(s.token_set_ratio(a, b) - expected) < 1e-9
