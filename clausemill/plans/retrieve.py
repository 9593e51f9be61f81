"""The retrieval plan: five signals over what a question may search, fused, cut and filled, and a trace of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.operators import fusion, fuzzy, retrieval
from clausemill.sources import indexes
from clausemill.sources.derived import Views

CANDIDATES, TOP = 40, 20
ORDER = ["fts_bm25", "vector", "fuzzy", "heading", "fts"]
LEAST_FUZZY, LEAST_PROXY = 40, 15
#: Rows of each signal in a trace, and characters of a text in it.
TRACED, PREVIEW = 10, 160
#: Excluded ids that are broadcast, at most; more meet their chunks by a shuffle.
FEW = 2_000_000


def corpus(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id"), retrieval.search_text().alias("content"))


def query_vectors(v: Views) -> DataFrame:
    """The vectors with the questions' numbers stand for theirs."""
    asked = F.broadcast(v.queries.select("query_id"))  # a batch of questions
    return v.embeddings.join(asked, F.col("vec_id") == F.col("query_id")).select("query_id", F.lit(0).alias("term_pos"), F.col("embedding").alias("vector"))


def chunk_vectors(v: Views) -> DataFrame:
    return v.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, computed once, in a folder that driver and executors share."""
    path = indexes.new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Words:
    """What the words of a batch count in chunks, and what all words count, from one splitting of the chunks for several
    signals; counted: for several attempts. gone(query_id, chunk_id): chunks that a question doesn't search, of an only
    attempt, which meet the chunks by the hint."""

    def __init__(self, chunks: DataFrame, queries: DataFrame, counted: bool = False, gone: DataFrame | None = None, hint: str = "broadcast"):
        asked = retrieval.words_asked(retrieval.clean_terms(queries, "rephrased_query", "term1", "term2"))
        rows = _kept(retrieval.word_rows(chunks, asked, gone, hint), "words")
        self.frequencies = rows.where("chunk_id IS NOT NULL" + (" AND out IS NULL" if gone is not None else "")).select("chunk_id", "dl", "word", "tf", "in_text")
        counts = retrieval.counts_of(rows)
        self.counts = _kept(counts, "counts") if counted else counts


class Retrieval:
    """Signals of a batch of questions.

    chunks: what the questions may search. vectors(query_id, term_pos, vector): of the questions that have one; for a
    question whose vectors find nothing, the words' similarity stands in for them, in the same plan. exclude(query_id,
    chunk_id): what an earlier attempt found, which is searched no more. words: those of the same chunks and questions, where
    an earlier attempt has them.
    """

    def __init__(self, chunks: DataFrame, queries: DataFrame, embeddings: DataFrame, vectors: DataFrame, exclude: DataFrame | None = None, top: int = TOP, candidates: int = CANDIDATES, words: Words | None = None):
        self.chunks, self.queries, self.embeddings, self.vectors, self.top, self.candidates = chunks, queries, embeddings, vectors, top, candidates
        self.words = words
        pool = chunks.agg(F.count("*").alias("pool"))
        self.gone = None
        sizes = queries.select("query_id").crossJoin(F.broadcast(pool)).withColumn("gone", F.lit(0).cast("long"))
        if exclude is not None:
            self.gone = _kept(exclude.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select("query_id", "chunk_id").distinct(), "excluded")
            counts = self.gone.groupBy("query_id").agg(F.count("*").alias("n"))
            sizes = sizes.drop("gone").join(F.broadcast(counts), "query_id", "left").withColumn("gone", F.coalesce("n", F.lit(0).cast("long"))).drop("n")
        #: query_id, pool, gone, fetch: how many rows a signal hands on
        sizes = sizes.withColumn("fetch", F.least(F.greatest(F.lit(candidates), F.lit(top) + F.col("gone")), F.col("pool") - F.col("gone")))
        found = sizes.toArrow()  # a row for each question of the batch
        self.sizes = sizes.sparkSession.createDataFrame(found)
        n = found["gone"].to_pylist()
        self.most, self.hint = max(n, default=0), "broadcast" if sum(n) <= FEW else "shuffle_hash"

    def _cut(self, ranked: DataFrame) -> DataFrame:
        """query_id, chunk_id, score, rank without what is excluded, ranked anew and cut."""
        if self.gone is not None:
            ranked = ranked.join(self.gone, ["query_id", "chunk_id"], "left_anti")
            ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        cut = ranked.join(F.broadcast(self.sizes.select("query_id", "fetch")), "query_id").where("rank <= fetch")
        return cut.select("query_id", "chunk_id", (F.col("score") if "score" in ranked.columns else F.lit(None)).cast("double").alias("score"), "rank")

    def signals(self, names: Sequence[str] = ORDER) -> DataFrame:
        """query_id, signal, chunk_id, score, rank: found once, as what selects, fills and traces reads them again"""
        found = [getattr(self, f"_{name}")().select("query_id", F.lit(name).alias("signal"), "chunk_id", "score", "rank") for name in names]
        return _kept(reduce(DataFrame.unionAll, found), "signals")

    @property
    def many(self) -> int:
        return max(self.candidates, self.top + self.most)

    def _counted(self) -> Words:
        if self.words is None:
            self.words = Words(self.chunks, self.queries, gone=self.gone, hint=self.hint)
        return self.words

    def _terms(self) -> DataFrame:
        return retrieval.clean_terms(self.queries, "term1", "term2")

    def _own_words(self) -> DataFrame:
        return retrieval.clean_terms(self.queries, "rephrased_query")

    def _fts_bm25(self) -> DataFrame:
        ask, words = retrieval.clean_terms(self.queries, "rephrased_query", "term1", "term2"), self._counted()
        return self._cut(fusion.ranked(retrieval.bm25(corpus(self.chunks), ask, self.gone, words.counts, words.frequencies), "fts_bm25", self.many))

    def _vector(self) -> DataFrame:
        held = self.embeddings.join(self.chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        near = _kept(self._cut(retrieval.vectors(held, self.vectors, self.many)), "near")
        alone = self._own_words().join(F.broadcast(near.select("query_id").distinct()), "query_id", "left_anti")
        limit = self.many + self.most
        return near.unionByName(self._cut(fusion.ranked(fuzzy.token_set(corpus(self.chunks), alone, LEAST_PROXY, limit), "vector", limit)))

    def _fuzzy(self) -> DataFrame:
        limit = self.many + self.most
        return self._cut(fusion.ranked(fuzzy.partial(corpus(self.chunks), self._terms(), LEAST_FUZZY, limit), "fuzzy", limit))

    def _heading(self) -> DataFrame:
        names = retrieval.clean_terms(self.queries, "heading1", "heading2")
        return self._cut(fusion.ranked(retrieval.heading_sum(self.chunks, names), "heading", self.many + self.most))

    def _fts(self) -> DataFrame:
        # a question without terms is searched by its own words
        none = self._own_words().join(F.broadcast(self._terms().select("query_id").distinct()), "query_id", "left_anti")
        return self._cut(retrieval.any_word_of(self._counted().frequencies, self._terms().unionByName(none), self.many))

    def selected(self, signals: DataFrame) -> DataFrame:
        """query_id, chunk_id, score, rank: the best by fused rank, then what the first two signals have beyond them."""
        head = fusion.fused(signals, self.top, order=ORDER)
        rest = [signals.where(F.col("signal") == name) for name in ORDER[:2]]
        filled = fusion.fill(head, rest, self.top)
        return filled.join(head.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "score", "rank")

    def trace(self, signals: DataFrame, selected: DataFrame) -> DataFrame:
        """query_id, signal, rank, score and a summary of the chunk: the first rows of each signal and all that are selected."""
        both = signals.where(F.col("rank") <= TRACED).unionByName(selected.withColumn("signal", F.lit("selected")))
        text = F.coalesce("text", F.lit(""))
        long_ = F.length(text) > PREVIEW
        # a few rows for each question of the batch
        rows = self.chunks.withColumnRenamed("id", "chunk_id").join(F.broadcast(both), "chunk_id")
        summary = [
            "chunk_id", "clause_number", "heading", "page_number", "chunk_index", F.length(text).alias("text_chars"),
            F.concat(F.substring(text, 1, PREVIEW), F.when(long_, "\u2026").otherwise("")).alias("text_preview"),
        ]
        return rows.select("query_id", "signal", "rank", F.round("score", 6).alias("score"), *summary)

    def counts(self, signals: DataFrame, selected: DataFrame) -> DataFrame:
        """A row for each question: its pool, what was excluded, rows by signal, where vectors came from, rows returned."""
        n = lambda name: F.count(F.when(F.col("signal") == name, 1)).alias(f"n_{name}")
        by = signals.groupBy("query_id").agg(*[n(name) for name in ORDER])
        own = self.vectors.select("query_id").distinct().withColumn("own", F.lit(True))
        taken = selected.groupBy("query_id").agg(F.count("*").alias("returned"))
        every = self.sizes.join(by, "query_id", "left").join(own, "query_id", "left").join(taken, "query_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        source = F.when(F.col("own"), "vectors").otherwise("proxy").alias("vector_source")
        return every.select("query_id", F.col("pool").alias("chunk_pool"), (F.col("pool") - F.col("gone")).alias("search_pool"), F.col("gone").alias("excluded_count"), *[zero(f"n_{x}") for x in ORDER], source, zero("returned"))


def with_rows(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id, score, clause_number, heading: ids first, their rows last."""
    rows = chunks.select(F.col("id").alias("chunk_id"), "clause_number", "heading")
    # a few rows for each question of the batch
    return rows.join(F.broadcast(selected), "chunk_id").select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"), "clause_number", "heading")


def retrieve(v: Views, chunks: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    r = Retrieval(chunks, queries, chunk_vectors(v), query_vectors(v), top=top)
    return with_rows(r.selected(r.signals()), chunks)
