"""Column functions on text: tokens, trigrams, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscores of any alphabet.
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def joined(*parts: Column, separator: str = " ") -> Column:
    """The parts that aren't empty."""
    return F.concat_ws(separator, *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


#: Letters from which on a word's trigrams are put together of its letters: substring() walks the word anew for each.
LONG = 64


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, two blanks before and one after each."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    letters = lambda w: F.concat(F.array(F.lit(" "), F.lit(" ")), F.regexp_extract_all(w, F.lit("."), F.lit(0)), F.array(F.lit(" ")))
    built = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.concat(a[i], a[i + 1], a[i + 2]))
    grams = lambda w: F.when(F.length(w) < LONG, cut(w)).otherwise(F.flatten(F.transform(F.array(letters(w)), built)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
