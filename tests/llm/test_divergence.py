import random
import re
from collections import Counter, defaultdict

from clausemill.llm import divergence

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(docs):
    """docs: (text, lang, source)"""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in held.keys() | {g[0] for g in counts}:
        kept = [t for t, d in held[lang].items() if d >= 3]
        sources = [s for la, s in counts if la == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            found = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]}
            found["term"] = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in found.items():
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(sorted(rows), 1) if part == "pair" or i <= 200]
    return sorted(out)


def found(spark, docs, extra=""):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs] if extra else docs, "text string, lang string, source string" + extra)
    return sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_plain_python(spark):
    r = random.Random(3)
    words = [*"abcdefgh", "Été", "été", "ÉTÉ", "x1y", "don't", "日本", "𝒳𝒴"]
    docs = [(" ".join(r.choices(words, k=r.randrange(40))), r.choice(["en", "fr", None]), r.choice(["s1", "s2", "S2", None, "é"])) for _ in range(80)]
    docs += docs[:10] + [(None, "en", "s9"), ("", "de", "s1"), ("one two", "de", "s2"), ("1 2 3", "xx", "only")]
    assert found(spark, docs) == plainly(docs)


def test_more_terms_than_are_ranked(spark):
    docs = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)), "en", "a")] * 3 + [("other words only", "en", "b")] * 3
    got = found(spark, docs)
    assert got == plainly(docs)
    assert sum(r[2] == "term" and r[1] == "a" for r in got) == 200


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    docs = [("a b", "en", "x"), ("a b", "en", "y"), ("a", "en", "y")]
    assert found(spark, docs, ", term int, n long") == plainly(docs)


def test_a_long_text(spark):
    docs = [("word " * 200_000 + "other", "en", "x")] + [("word other", "en", "y")] * 3
    assert found(spark, docs) == plainly(docs)
