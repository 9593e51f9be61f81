"""Indel similarity of strings: 200 * LCS / (lengths), in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows of Python integers."""
    if not a or not b:
        return 0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial_ratio(term: str, text: str) -> float:
    """The best ratio of the shorter string and a window of its length in the longer one, windows that
    stand over at its ends included."""
    if len(term) > len(text):
        term, text = text, term
    m, n = len(term), len(text)
    if m == 0:
        return 100.0 if n == 0 else 0.0
    if term in text:
        return 100.0
    if m > 60:
        windows = [text[max(0, i) : i + m] for i in range(1 - m, n)]
        return max(ratio(term, w) for w in windows)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = {c: sum(1 << i for i, x in enumerate(term) if x == c) for c in set(term)}
    bits = np.zeros(n + 2 * (m - 1), np.uint64)
    for c, b in letters.items():
        bits[m - 1 : m - 1 + n][codes == ord(c)] = b
    full = np.uint64((1 << m) - 1)
    row = np.full(n + m - 1, full)
    with np.errstate(over="ignore"):
        for j in range(m):
            hit = row & bits[j : j + n + m - 1]
            row = ((row + hit) | (row - hit)) & full
    common = m - np.bitwise_count(row).astype(np.int64)
    start = np.arange(1 - m, n)
    size = np.minimum(start + m, n) - np.maximum(start, 0)
    return float((200.0 * common / (m + size)).max())


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words and the common words with either side's others."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(sorted(s)) for s in (x - y, y - x))
    if both and (not one or not two):
        return 100.0
    with_one, with_two = f"{both} {one}".strip(), f"{both} {two}".strip()
    found = [ratio(with_one, with_two)]
    if both:
        found += [ratio(both, with_one), ratio(both, with_two)]
    return max(found)


@pandas_udf(DoubleType())
def partial_ratio_udf(term: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(a or "", b or "") for a, b in zip(term, text, strict=True)])
