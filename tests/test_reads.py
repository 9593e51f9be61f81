"""How often the retrieval queries read their chunks, and BM25 over parts of a corpus."""

from clausemill.operators import fuzzy, retrieval
from clausemill.plans import catalog, retrieve
from clausemill.plans.retrieval_queries import _ask
from clausemill.sources.derived import Views

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_two_signals_read_chunks_three_times(spark):
    assert plan(catalog.QUERIES["R12_retrieve_two_signals"](spark, SMALL)).count("Relation [doc_id") == 3


def test_proxy_reads_chunks_once(spark):
    assert plan(catalog.QUERIES["R3_vector_proxy"](spark, SMALL)).count("Relation [doc_id") == 1


def test_trace_finds_words_without_its_chunks(spark):
    """The frequencies of the batch's words are there before the plan."""
    v = Views(spark, SMALL)
    r = retrieve.Retrieval(v.chunks, v.queries, retrieve.chunk_vectors(v), retrieve.query_vectors(v))
    assert "lower(coalesce(text" not in plan(r.signals(["fts"]))


def test_excluding_searches_nothing_fuzzily(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "partial", lambda *_: 1 / 0)
    catalog.QUERIES["R12_excluding"](spark, SMALL)


def test_excluding_splits_its_chunks_once(spark, monkeypatch):
    """Frequencies and the vocabulary's counts are there before BM25 is planned, less what is excluded, and the signals before
    the fusion."""
    monkeypatch.setattr(retrieval, "_counted", lambda *_: 1 / 0)
    assert "Relation [doc_id" not in plan(catalog.QUERIES["R12_excluding"](spark, SMALL))


def test_excluded_ids_meet_their_chunks_by_either_join(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, catalog.QUERIES["R12_excluding"](spark, SMALL).collect()))
    few = rows()
    monkeypatch.setattr(retrieve, "FEW", 0)
    assert few and rows() == few


def test_trace_splits_its_chunks_once_and_reads_them_for_its_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_counted", lambda *_: 1 / 0)
    assert plan(catalog.QUERIES["R12_trace"](spark, SMALL)).count("Relation [doc_id") == 1


def test_headings_lower_no_more_than_the_texts_start(spark):
    """The start is that of the lowered text, also where a sigma stands last in it."""
    texts = ["x" * 199 + "\u03a3y needle", "x" * 194 + "needle", "x" * 195 + "NEEDLE", "\u0130" * 97 + "needle", "x" * 199 + "\u03a3"]
    chunks = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], "id long, text string, heading string, clause_number string")
    needles = spark.createDataFrame([(1, 0, "needle"), (2, 0, "\u03c3"), (3, 0, "\u03c2")], "query_id long, term_pos int, term string")
    found = {(r.query_id, r.chunk_id) for r in retrieval.heading_sum(chunks, needles).collect()}
    assert found == {(1, 1), (1, 3), (2, 0), (3, 4)}
    start = plan(retrieval.heading_sum(chunks, needles)).replace(" ", "")
    assert "lower(coalesce(text" not in start


def test_a_retry_counts_the_vocabulary_once(spark, monkeypatch):
    calls, count = [], retrieval.word_counts
    monkeypatch.setattr(retrieval, "word_counts", lambda c: calls.append(1) or count(c))
    catalog.QUERIES["R12_retry"](spark, SMALL)
    assert len(calls) == 1


def test_bm25_without_some_chunks_is_that_of_the_rest(spark):
    v = Views(spark, SMALL)
    corpus = retrieve.corpus(v.chunks).cache()
    gone = [(q, c) for q in range(0, 8, 2) for c in range(q, 200, 3)]
    exclude = spark.createDataFrame(gone, "query_id long, chunk_id long")
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in df.collect())
    want = []
    for q in (0, 1, 2):
        mine = corpus.where(~corpus.chunk_id.isin([c for x, c in gone if x == q]))
        want += rows(retrieval.bm25(mine, _ask(v).where(f"query_id = {q}")))
    found = [rows(retrieval.bm25(corpus, _ask(v), exclude, counts, tf).where("query_id < 3")) for counts, tf in ((None, None), (retrieval.word_counts(corpus), retrieval.chunk_frequencies(v.chunks, retrieval.words_asked(_ask(v)))))]
    assert want and found == [want, want]
