"""Source divergence audit: how each source of a language departs from the other sources and from the language.

Relational steps: matches are exploded and counted by language, source and term, groups meet the kept vocabulary so that
zeros count, sources of a language meet on its terms, sums and ranks follow. The matches of a partition are counted
where they are read, before anything moves. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: In lower-cased UTF-8 bytes: runs of ASCII letters and of what isn't ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: A language keeps the terms of at least so many of its documents.
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Counters that a task holds before it hands them on.
HELD = 300_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, source, term, n (occurrences), d (documents), as often as HELD counters are full."""
    names = ["lang", "source", "term", "n", "d"]
    uses, holders, held = defaultdict(Counter), defaultdict(Counter), 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), count in uses.items():
            docs, size = holders[lang, source], len(count)
            alike = lambda x, size=size: pa.array([x], pa.string()).take(pa.array([0] * size, pa.int32()))
            yield pa.RecordBatch.from_arrays([alike(lang), alike(source), pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64()), pa.array([docs[t] for t in count], pa.int64())], names)

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            terms = TERM.findall(text.as_buffer().to_pybytes().translate(_LOWER))
            count = uses[lang, source]
            before = len(count)
            count.update(terms)
            holders[lang, source].update(set(terms))
            held += len(count) - before
            if held > HELD:
                yield from out()
                uses, holders, held = defaultdict(Counter), defaultdict(Counter), 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, d: one row or more for each term of each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counted, "lang string, source string, term string, n long, d long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in decimals so that no count is too large."""
    over = (count + 1).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, (total + terms).cast("decimal(27,0)"))


def departure(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part pair has a row for each other source of the language: how far the group's shares of the kept terms are from that
    source's. Part term has the TOP_TERMS terms that the group uses most above its language. Null texts, languages and
    sources count as ''; a language without kept terms has pairs of value 0; rows that repeat count each; ties go by the
    item's bytes; an empty table gives no rows. Only text, lang and source are read. Texts of any length are counted
    whole.
    """
    tables = Tables(docs.sparkSession)
    # one shuffle, by language and term: the counts of a term's sources are together from here on
    each = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    held = F.map_from_entries(F.collect_list(F.struct("source", "n")))  # at most a language's sources
    vocabulary = each.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("all_n"), held.alias("held")).where(F.col("d") >= LEAST_DOCUMENTS)
    vocabulary = tables.write("vocabulary", vocabulary.select("lang", "term", "all_n", "held", F.monotonically_increasing_id().alias("id")))

    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    used = vocabulary.select("lang", F.explode("held").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    every = docs.select(name("lang"), name("source")).distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = tables.write("groups", every.select("lang", "source", zero("group_n"), zero("v"), zero("lang_n"), F.monotonically_increasing_id().alias("gid")))

    # each group meets each kept term of its language, zeros included, and the groups of a term meet each other
    n = F.coalesce(F.try_element_at("held", "source"), F.lit(0).cast("long"))
    dense = vocabulary.join(groups, "lang").select("id", "gid", share(n, F.col("group_n"), F.col("v")).alias("p")).repartition("id")
    other = dense.select("id", F.col("gid").alias("other"), F.col("p").alias("q"))
    sums = dense.join(other, "id").where(F.col("gid") != F.col("other")).groupBy("gid", "other").agg(F.sum(departure(F.col("p"), F.col("q"))).alias("value"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("other"))
    pairs = groups.select("lang", "source", "gid").join(others, "lang").where(F.col("gid") != F.col("other")).join(sums, ["gid", "other"], "left")
    pairs = pairs.select("lang", "source", "item", zero("value"))

    p, q = share(F.col("n"), F.col("group_n"), F.col("v")), share(F.col("all_n"), F.col("lang_n"), F.col("v"))
    terms = vocabulary.select("lang", "term", "all_n", F.explode("held").alias("source", "n")).join(groups, ["lang", "source"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", departure(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    named = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value"]
    return pairs.select(*named("pair"), rank).unionAll(terms.select(*named("term"), rank).where(F.col("rank") <= TOP_TERMS))
