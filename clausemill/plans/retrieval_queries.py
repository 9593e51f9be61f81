"""Signals, fusion and retrieval over the derived chunks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausemill.functions.text import joined
from clausemill.operators import fusion, fuzzy, retrieval
from clausemill.sources import indexes

from . import retrieve
from .registry import query

W = r"[\p{L}\p{N}_]+"
_T2 = "(SELECT query_id, 0 AS term_pos, trim(heading1) AS term FROM queries UNION ALL SELECT query_id, 1, trim(heading2) FROM queries)"
_TERMS = "(SELECT query_id, 0 AS term_pos, trim(term1) AS term FROM queries UNION ALL SELECT query_id, 1, trim(term2) FROM queries)"
_ASK = "(SELECT query_id, 0 AS term_pos, trim(rephrased_query) AS term FROM queries UNION ALL SELECT query_id, 1, trim(term1) FROM queries UNION ALL SELECT query_id, 2, trim(term2) FROM queries)"


def _bm25_sql(corpus: str, terms: str) -> str:
    return f"""corp AS ({corpus}), wd AS (SELECT chunk_id, regexp_extract_all(lower(content), '{W}') AS ws FROM corp),
      sz AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM wd),
      tf AS (SELECT chunk_id, dl, word, count(*) AS tf FROM (SELECT chunk_id, len(ws) AS dl, unnest(ws) AS word FROM wd) GROUP BY ALL),
      idf AS (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT word, count(*) AS df FROM tf GROUP BY word), sz),
      mn AS (SELECT avg(idf) AS m FROM idf),
      ask AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(term), '{W}')) AS word FROM {terms} WHERE term <> '') GROUP BY ALL),
      bm AS (SELECT query_id, chunk_id, sum(times * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
             FROM ask JOIN idf USING (word) JOIN tf USING (word), mn, sz GROUP BY query_id, chunk_id)"""


_CORPUS = "SELECT id AS chunk_id, concat_ws(' ', nullif(text, ''), nullif(heading, ''), nullif(clause_number, '')) AS content FROM chunks"
_RANK = "(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id))::INT AS rank"


def _ask(v):
    return retrieval.clean_terms(v.queries, "rephrased_query", "term1", "term2")


def _names(v):
    return retrieval.clean_terms(v.queries, "heading1", "heading2")


def _terms(v):
    return retrieval.clean_terms(v.queries, "term1", "term2")


_R1 = f"WITH {_bm25_sql(_CORPUS, _ASK)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} FROM bm WHERE score > 0) WHERE rank <= 40"


@query("R1_bm25", _R1)
def _(v):
    return fusion.ranked(retrieval.bm25(retrieve.corpus(v.chunks), _ask(v)), "bm25", 40).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("A24_bm25_statistics", rf"WITH t AS (SELECT id, regexp_extract_all(lower(text), '{W}') AS w FROM chunks), d AS (SELECT word, count(DISTINCT id) AS df FROM (SELECT id, unnest(w) AS word FROM t) GROUP BY word) SELECT (SELECT count(*) FROM t) AS n, (SELECT round(avg(len(w)), 6) FROM t) AS avgdl, count(*) AS words, max(df) AS most, round(avg(ln((SELECT count(*) FROM t) - df + 0.5) - ln(df + 0.5)), 6) AS mean_idf FROM d")
def _(v):
    from clausemill.functions.text import tokens

    t = v.chunks.select("id", tokens(F.col("text")).alias("w"))
    d = t.select("id", F.explode("w").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("df"))
    n = t.agg(F.count("*").alias("n"), F.round(F.avg(F.size("w")), 6).alias("avgdl"))
    j = d.crossJoin(F.broadcast(n))  # one row
    return j.groupBy("n", "avgdl").agg(F.count("*").alias("words"), F.max("df").alias("most"), F.round(F.avg(F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), 6).alias("mean_idf"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


_R2 = f"SELECT query_id, chunk_id, rank FROM (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, (row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COS}, 9) DESC, a.vec_id))::INT AS rank FROM embeddings a JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT query_id FROM queries)) b ON true WHERE a.vec_id IN (SELECT id FROM chunks)) WHERE rank <= 20"


@query("R2_vector", _R2)
def _(v):
    e = v.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding").join(v.chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return retrieval.vectors(e, retrieve.query_vectors(v), 20)


@query("T1_top_k", f"SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings a JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) b ON true ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 10")
def _(v):
    from clausemill.functions.text import cosine

    q = v.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = v.embeddings.crossJoin(F.broadcast(q)).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("s"))  # one row
    return s.orderBy(F.desc(F.round("s", 9)), "vec_id").limit(max(10, 1)).select("vec_id", F.round("s", 6).alias("similarity"))


@query("T2_at_least_one", "SELECT id FROM chunks ORDER BY id LIMIT 1")
def _(v):
    return v.chunks.select("id").orderBy("id").limit(max(0, 1))


@query("R3_vector_proxy")
def _(v):
    return fusion.ranked(fuzzy.token_set(retrieve.corpus(v.chunks), _ask(v), 15, 20), "proxy", 20)


@query("R4_fuzzy")
def _(v):
    return fusion.ranked(fuzzy.partial(retrieve.corpus(v.chunks), _terms(v), 40, 20), "fuzzy", 20)


_H_SUM = f"""SELECT query_id, id AS chunk_id, sum(CASE WHEN lower(trim(clause_number)) <> '' AND (lower(trim(clause_number)) = lower(term) OR starts_with(lower(trim(clause_number)), lower(term) || '.') OR starts_with(lower(term), lower(trim(clause_number)))) THEN 100
    WHEN contains(lower(trim(heading)), lower(term)) THEN 80 WHEN contains(substring(lower(text), 1, 200), lower(term)) THEN 20 ELSE 0 END)::BIGINT AS score FROM chunks JOIN {_T2} t ON term <> '' GROUP BY query_id, id"""


@query("R5_heading", f"SELECT * FROM ({_H_SUM}) WHERE score > 0")
def _(v):
    return retrieval.heading_sum(v.chunks, _names(v))


@query("A27_heading_sum", f"SELECT query_id, max(score) AS best, count(*) AS n FROM ({_H_SUM}) WHERE score > 0 GROUP BY query_id")
def _(v):
    return retrieval.heading_sum(v.chunks, _names(v)).groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))


_WORDS = f"SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY chunk_id))::INT AS rank FROM (SELECT query_id, id AS chunk_id FROM chunks JOIN (SELECT query_id, regexp_extract_all(lower(trim(term1)), '{W}') AS asked FROM queries) q ON list_has_any(regexp_extract_all(lower(text), '{W}'), asked))"


@query("R6_any_word", f"SELECT * FROM ({_WORDS}) WHERE rank <= 40")
def _(v):
    return retrieval.any_word(v.chunks, retrieval.clean_terms(v.queries, "term1"), 40)


@query("R16_user_text_search", f"SELECT * FROM ({_WORDS.replace('FROM chunks JOIN', 'FROM (SELECT c.* FROM chunks c JOIN docs d ON d.id = c.document_id WHERE d.user_id = 3) c JOIN')}) WHERE rank <= 10")
def _(v):
    mine = v.chunks.join(v.docs.where("user_id = 3").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return retrieval.any_word(mine, retrieval.clean_terms(v.queries, "term1"), 10)


_R7 = f"""WITH q AS (SELECT query_id, list_distinct(list_concat(regexp_extract_all(lower(trim(term1)), '{W}'), regexp_extract_all(lower(trim(term2)), '{W}'))) AS asked FROM queries),
    c AS (SELECT id, regexp_extract_all(lower(heading), '{W}') AS a, regexp_extract_all(lower(clause_number), '{W}') AS b, regexp_extract_all(lower(text), '{W}') AS c FROM chunks),
    w AS (SELECT query_id, id AS chunk_id, list_transform(asked, lambda x: CASE WHEN list_contains(a, x) THEN 1.0 WHEN list_contains(b, x) THEN 0.4 WHEN list_contains(c, x) THEN 0.2 ELSE 0 END) AS ws FROM c, q WHERE len(asked) > 0)
    SELECT query_id, chunk_id, round(list_sum(ws), 6)::DOUBLE AS score FROM w WHERE len(list_filter(ws, lambda x: x = 0)) = 0"""


@query("R7_weighted_match", _R7)
def _(v):
    return retrieval.weighted_match(v.chunks, _terms(v)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _gram_sql(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


_OV = lambda a, b: f"(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))))"


def _trig_sql(text: str) -> str:
    return f"""g AS (SELECT id, {_gram_sql("heading || ' ' || clause_number")} AS head, {_gram_sql(text)} AS body FROM chunks),
    tg AS (SELECT query_id, term_pos, {_gram_sql("term")} AS gr FROM {_TERMS} WHERE term <> ''),
    ts AS (SELECT query_id, term_pos, id AS chunk_id, greatest({_OV("head", "gr")}, {_OV("body", "gr")}) AS score FROM g, tg)"""


_TRIG = _trig_sql("substring(text, 1, 2000)")


@query("R8_trigram", f"WITH {_TRIG} SELECT query_id, term_pos, chunk_id, round(score, 6) AS score FROM ts WHERE score >= 0.3")
def _(v):
    return retrieval.trigram(v.chunks, _terms(v)).select("query_id", "term_pos", "chunk_id", F.round("score", 6).alias("score"))


@query("A26_best_over_terms", f"WITH {_TRIG} SELECT query_id, chunk_id, round(max(score), 6) AS score FROM ts WHERE score >= 0.3 GROUP BY query_id, chunk_id")
def _(v):
    s = retrieval.trigram(v.chunks, _terms(v))
    return fusion.best_score(s).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("U8_best_score", f"WITH {_TRIG} SELECT query_id, count(*) AS n, round(sum(best), 6) AS total FROM (SELECT query_id, chunk_id, max(score) AS best FROM ts WHERE score >= 0.3 GROUP BY ALL) GROUP BY query_id")
def _(v):
    return fusion.best_score(retrieval.trigram(v.chunks, _terms(v))).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


_HF = f"""hs AS (SELECT query_id, term_pos, id AS chunk_id, CASE WHEN lower(clause_number) = lower(term) THEN 100 WHEN lower(clause_number) LIKE lower(term) || '.%' THEN 95 WHEN lower(term) LIKE lower(clause_number) || '.%' THEN 90
    WHEN lower(heading) LIKE '%' || lower(term) || '%' THEN 80 WHEN lower(substring(text, 1, 200)) LIKE '%' || lower(term) || '%' THEN 20 ELSE 0 END AS score FROM chunks JOIN {_T2} t ON term <> '')"""
_CONCAT = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, term_pos ORDER BY score DESC, chunk_id) AS tr FROM hs WHERE score > 0), f AS (SELECT query_id, chunk_id, min({'p': term_pos, 'r': tr}) AS seen FROM r WHERE tr <= 40 GROUP BY query_id, chunk_id), l AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY seen, chunk_id))::INT AS rank FROM f)"


def _per_term(v):
    w = Window.partitionBy("query_id", "term_pos").orderBy(F.desc("score"), "chunk_id")
    return retrieval.heading_first(v.chunks, _names(v)).withColumn("rank", F.row_number().over(w)).where("rank <= 40")


@query("R10_heading_first_match", f"WITH {_HF} SELECT * FROM hs WHERE score > 0")
def _(v):
    return retrieval.heading_first(v.chunks, _names(v))


for _name, _cut in (("R9_per_term_lists", 40), ("W2_first_seen", 25)):

    @query(_name, f"WITH {_HF}, {_CONCAT} SELECT * FROM l WHERE rank <= {_cut}")
    def _(v, cut=_cut):
        return fusion.concatenated(_per_term(v), cut)


_SIG = """sg AS (SELECT id % 5 AS query_id, 'a' AS signal, 1 AS place, id AS chunk_id, (row_number() OVER (PARTITION BY id % 5 ORDER BY id))::INT AS rank FROM chunks WHERE id % 3 = 0
    UNION ALL SELECT id % 5, 'b', 2, id, (row_number() OVER (PARTITION BY id % 5 ORDER BY page_number, id))::INT FROM chunks WHERE id % 2 = 0
    UNION ALL SELECT id % 5, 'c', 3, id, (row_number() OVER (PARTITION BY id % 5 ORDER BY id DESC))::INT FROM chunks),
    s AS (SELECT * FROM sg WHERE rank <= 40), fu AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min({'p': place, 'r': rank}) AS first FROM s GROUP BY query_id, chunk_id),
    fr AS (SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, chunk_id))::INT AS rank FROM fu)"""


def _signals(v):
    q = F.col("id") % 5
    one = lambda name, df, *order: df.select(q.alias("query_id"), F.lit(name).alias("signal"), F.col("id").alias("chunk_id"), F.row_number().over(Window.partitionBy(q).orderBy(*order)).alias("rank"))
    return one("a", v.chunks.where("id % 3 = 0"), "id").unionAll(one("b", v.chunks.where("id % 2 = 0"), "page_number", "id")).unionAll(one("c", v.chunks, F.desc("id"))).where("rank <= 40")


@query("W1_rank_in_signal", f"WITH {_SIG} SELECT query_id, signal, chunk_id, rank FROM s")
def _(v):
    return _signals(v)


@query("A25_rrf_sum", f"WITH {_SIG} SELECT query_id, chunk_id, round(score, 9) AS score FROM fu")
def _(v):
    return fusion.rrf(_signals(v), order=["a", "b", "c"]).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("R11_rrf_fusion", f"WITH {_SIG} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM fr WHERE rank <= 12")
def _(v):
    return fusion.fused(_signals(v), 12, order=["a", "b", "c"]).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("T10_parcels", f"WITH {_SIG} SELECT query_id, chunk_id, (rank - 1) // 5 AS parcel FROM fr WHERE rank <= 12")
def _(v):
    return fusion.fused(_signals(v), 12, order=["a", "b", "c"]).select("query_id", "chunk_id", fusion.parcel(F.col("rank")).alias("parcel"))


@query("T9_trace_summary", f"WITH {_SIG} SELECT s.query_id, s.signal, s.rank, s.chunk_id, substring(c.text, 1, 160) AS preview FROM s JOIN chunks c ON c.id = s.chunk_id WHERE s.rank <= 10")
def _(v):
    text = v.chunks.select(F.col("id").alias("chunk_id"), F.substring("text", 1, 160).alias("preview"))
    return _signals(v).where("rank <= 10").join(text, "chunk_id").select("query_id", "signal", "rank", "chunk_id", "preview")


_MERGE = "(SELECT query_id, chunk_id, min({'s': src, 'r': r}) AS seen FROM ({u}) GROUP BY query_id, chunk_id)"


def _merge_sql(lists: list[str], limit: int) -> str:
    u = " UNION ALL ".join(f"SELECT query_id, chunk_id, {i} AS src, rank AS r FROM ({x})" for i, x in enumerate(lists))
    return f"SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY seen, chunk_id))::INT AS rank FROM {_MERGE.replace('{u}', u)}) WHERE rank <= {limit}"


for _name, _lists, _limit in (
    ("T7_fill_slots", [("c", 4), ("a", 40), ("b", 40)], 30),
    ("U3_evidence_merge", [("b", 6), ("c", 10), ("a", 12)], 20),
    ("U4_candidate_union", [("a", 40), ("b", 40), ("c", 40)], 100),
):

    @query(_name, f"WITH {_SIG} " + _merge_sql([f"SELECT query_id, chunk_id, rank FROM s WHERE signal = ''{x}'' AND rank <= {n}".replace("''", "'") for x, n in _lists], _limit))
    def _(v, lists=_lists, limit=_limit):
        s = _signals(v)
        return fusion.merge_lists([s.where((F.col("signal") == x) & (F.col("rank") <= n)) for x, n in lists], limit)


@query("T3_fetch_limit", "SELECT k, least(greatest(40, k + 7), 200)::BIGINT AS fetch FROM (VALUES (5::BIGINT), (35), (190), (400)) t(k)")
def _(v):
    k = v.spark.createDataFrame([(5,), (35,), (190,), (400,)], "k long")
    return k.select("k", F.least(F.greatest(F.lit(40), F.col("k") + 7), F.lit(200)).alias("fetch"))


@query("T4_table_fetch_limit", "SELECT k, least(greatest(3 * k, 20), 60)::BIGINT AS fetch FROM (VALUES (5::BIGINT), (12), (30)) t(k)")
def _(v):
    k = v.spark.createDataFrame([(5,), (12,), (30,)], "k long")
    return k.select("k", F.least(F.greatest(F.col("k") * 3, F.lit(20)), F.lit(60)).alias("fetch"))


@query("R12_retrieve")
def _(v):
    return retrieve.retrieve(v, v.chunks, v.queries)


def _retry(v):
    """A second attempt: what the first selected is excluded, and half of the questions have no vector."""
    words = retrieve.Words(v.chunks, v.queries, counted=True)
    first = retrieve.Retrieval(v.chunks, v.queries, retrieve.chunk_vectors(v), retrieve.query_vectors(v), words=words)
    found = first.selected(first.signals()).select("query_id", "chunk_id").collect()  # a request's ids: at most TOP for each question
    gone = v.spark.createDataFrame(found, "query_id long, chunk_id long")
    return retrieve.Retrieval(v.chunks, v.queries, retrieve.chunk_vectors(v), retrieve.query_vectors(v).where("query_id % 2 = 0"), exclude=gone, words=words)


@query("R12_retry")
def _(v):
    r = _retry(v)
    return retrieve.with_rows(r.selected(r.signals()), v.chunks)


@query("R12_trace")
def _(v):
    r = retrieve.Retrieval(v.chunks, v.queries, retrieve.chunk_vectors(v), retrieve.query_vectors(v))
    signals = r.signals()
    return r.trace(signals, r.selected(signals))


_POOL = f"""gone AS (SELECT query_id, id AS chunk_id FROM queries JOIN chunks ON chunks.id % 11 = query_id), corp AS ({_CORPUS}),
    sizes AS (SELECT query_id, pool, gone, least(greatest(40, 20 + gone), pool - gone) AS most_rows FROM (SELECT query_id, (SELECT count(*) FROM chunks) AS pool, (SELECT count(*) FROM gone g WHERE g.query_id = q.query_id) AS gone FROM queries q)),
    wd AS (SELECT query_id, chunk_id, regexp_extract_all(lower(content), '{W}') AS ws FROM (SELECT query_id, chunk_id, content FROM corp, (SELECT query_id FROM queries) qs) ANTI JOIN gone USING (query_id, chunk_id)),
    sz AS (SELECT query_id, count(*) AS n, avg(len(ws)) AS avgdl FROM wd GROUP BY query_id),
    tf AS (SELECT query_id, chunk_id, dl, word, count(*) AS tf FROM (SELECT query_id, chunk_id, len(ws) AS dl, unnest(ws) AS word FROM wd) GROUP BY ALL),
    idf AS (SELECT query_id, word, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT query_id, word, count(*) AS df FROM tf GROUP BY ALL) JOIN sz USING (query_id)),
    mn AS (SELECT query_id, avg(idf) AS m FROM idf GROUP BY query_id),
    ask AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(term), '{W}')) AS word FROM {_ASK} WHERE term <> '') GROUP BY ALL),
    bm AS (SELECT query_id, chunk_id, sum(times * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM ask JOIN idf USING (query_id, word) JOIN tf USING (query_id, word) JOIN mn USING (query_id) GROUP BY ALL),
    vc AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COS}, 9) DESC, a.vec_id) AS r FROM embeddings a JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT query_id FROM queries)) b ON true WHERE a.vec_id IN (SELECT id FROM chunks)),
    hd AS (SELECT query_id, chunk_id, score FROM ({_H_SUM}) WHERE score > 0),
    wo AS ({_WORDS.replace("[' || '", "").replace("regexp_extract_all(lower(trim(term1)), '" + W + "') AS asked", "list_concat(regexp_extract_all(lower(trim(term1)), '" + W + "'), regexp_extract_all(lower(trim(term2)), '" + W + "')) AS asked")}),
    most AS (SELECT greatest(40, 20 + max(gone)) AS most FROM sizes),
    lists AS (SELECT query_id, 1 AS place, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM bm WHERE score > 0
        UNION ALL SELECT query_id, 2, chunk_id, r FROM vc, most WHERE r <= most
        UNION ALL SELECT query_id, 4, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM hd
        UNION ALL SELECT query_id, 5, chunk_id, rank FROM wo, most WHERE rank <= most),
    cut AS (SELECT query_id, place, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY r) AS rank FROM lists ANTI JOIN gone USING (query_id, chunk_id)) JOIN sizes USING (query_id) WHERE rank <= most_rows)"""


def _excluding(v):
    """All signals but the fuzzy one, which SQL can't express, over a pool without some chunks of each question."""
    gone = v.queries.join(v.chunks.select(F.col("id").alias("chunk_id")), F.col("chunk_id") % 11 == F.col("query_id")).select("query_id", "chunk_id")
    r = retrieve.Retrieval(v.chunks, v.queries, retrieve.chunk_vectors(v), retrieve.query_vectors(v), exclude=gone)
    return r, r.signals([name for name in retrieve.ORDER if name != "fuzzy"])


@query("R12_excluding", f"WITH {_POOL}, f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min({{'p': place, 'r': rank}}) AS first FROM cut GROUP BY ALL) SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, chunk_id))::INT AS rank FROM f) WHERE rank <= 20")
def _(v):
    r, signals = _excluding(v)
    return r.selected(signals).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("R12_counts", f"WITH {_POOL}, n AS (SELECT query_id, count(*) FILTER (place = 1) AS n_fts_bm25, count(*) FILTER (place = 2) AS n_vector, 0::BIGINT AS n_fuzzy, count(*) FILTER (place = 4) AS n_heading, count(*) FILTER (place = 5) AS n_fts, least(20, count(DISTINCT chunk_id)) AS returned FROM cut GROUP BY query_id) SELECT query_id, pool AS chunk_pool, pool - gone AS search_pool, gone AS excluded_count, n_fts_bm25, n_vector, n_fuzzy, n_heading, n_fts, 'vectors' AS vector_source, returned FROM sizes JOIN n USING (query_id)")
def _(v):
    r, signals = _excluding(v)
    return r.counts(signals, r.selected(signals))


@query("R12_retrieve_two_signals", f"WITH {_bm25_sql(_CORPUS, _ASK)}, hd AS ({_H_SUM}), s AS (SELECT query_id, chunk_id, 1 AS place, rank FROM (SELECT *, {_RANK} FROM bm WHERE score > 0) WHERE rank <= 40 UNION ALL SELECT query_id, chunk_id, 2, rank FROM (SELECT *, {_RANK} FROM hd WHERE score > 0) WHERE rank <= 40), f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min({{'p': place, 'r': rank}}) AS first FROM s GROUP BY ALL) SELECT query_id, chunk_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, chunk_id))::INT AS rank FROM f) WHERE rank <= 12")
def _(v):
    one = fusion.ranked(retrieval.bm25(retrieve.corpus(v.chunks), _ask(v)), "bm25", 40)
    two = fusion.ranked(retrieval.heading_sum(v.chunks, _names(v)), "heading", 40)
    return fusion.fused(one.unionByName(two), 12, order=["bm25", "heading"]).select("query_id", "chunk_id", "rank")


#: Phrases and the terms that a search for them also tries.
SYNONYMS = {
    "barriers or enclosures": ["barriers", "enclosures", "protection barriers", "protective enclosures", "IPXXB", "IP2X", "IP4X", "degree of protection", "live parts inside", "behind barriers"],
    "protection by barriers": ["barriers", "enclosures", "protection barriers", "protective enclosures", "IPXXB", "IP2X", "IP4X", "degree of protection"],
    "barriers enclosures": ["barriers", "enclosures", "protection barriers", "protective enclosures", "IPXXB", "IP2X", "IP4X"],
    "barriers": ["barriers", "enclosures", "protection barriers", "protective enclosures", "IPXXB", "IP2X", "IP4X", "degree of protection"],
    "enclosures": ["enclosures", "barriers", "protection barriers", "protective enclosures", "IPXXB", "IP2X", "IP4X", "degree of protection"],
    "live parts": ["live parts", "energized parts", "electrical parts", "conductive parts", "inside enclosures", "behind barriers"],
    "automatic disconnection": ["automatic disconnection", "RCD", "residual current device", "earth leakage", "protection by automatic disconnection"],
    "circuit breaker": ["circuit breaker", "MCB", "miniature circuit breaker", "overcurrent protection", "moulded-case circuit-breakers"],
    "earthing": ["earthing", "grounding", "earth connection", "protective conductor", "earth electrode"],
    "protection": ["protection", "protective", "safety", "barriers", "enclosures", "automatic disconnection", "earthing"],
}
_PHRASES = ["what protection do live parts need", "earthing of a circuit breaker", "barriers or enclosures", "clause 2.4.3 earthing", "3.1 and 5.2"]
_ASKED = "(VALUES " + ", ".join(f"({i}::BIGINT, '{p}')" for i, p in enumerate(_PHRASES)) + ") p(query_id, phrase)"
_SYN = "(VALUES " + ", ".join(f"({i}, '{k}', {j}, '{x}')" for i, (k, xs) in enumerate(SYNONYMS.items()) for j, x in enumerate(xs)) + ") s(i, k, j, x)"


def _phrases(v):
    return v.spark.createDataFrame(list(enumerate(_PHRASES)), "query_id long, phrase string")


@query("R13_term_expansion", f"""WITH e AS (SELECT query_id, 0 AS a, 0 AS b, phrase AS term FROM {_ASKED} UNION ALL SELECT query_id, 1 + i, j, x FROM {_ASKED}, {_SYN} WHERE contains(lower(phrase), k)
    UNION ALL SELECT query_id, 1000, n, w FROM (SELECT query_id, unnest(range(len(ws))) AS n, unnest(ws) AS w FROM (SELECT query_id, regexp_split_to_array(trim(lower(phrase)), '\\s+') AS ws FROM {_ASKED})) WHERE length(w) > 3),
    f AS (SELECT query_id, term, min({{'a': a, 'b': b}}) AS place FROM e GROUP BY query_id, term) SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS pos FROM f""")
def _(v):
    p = _phrases(v).select("query_id", F.posexplode(retrieval.expanded(F.col("phrase"), SYNONYMS)).alias("pos", "term"))
    return p.select("query_id", "term", F.col("pos").cast("long").alias("pos"))


_NUM = f"(SELECT query_id, unnest(range(len(ns))) AS tier, unnest(ns) AS n FROM (SELECT query_id, regexp_extract_all(lower(phrase), '(?:clause\\s+)?(\\d+(?:\\.\\d+)*)', 1) AS ns FROM {_ASKED}))"


@query("R14_clause_number_search", f"WITH h AS (SELECT query_id, tier, id FROM {_NUM} JOIN chunks ON contains(lower(text), n)) SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM h) WHERE tier = best) WHERE k <= 10")
def _(v):
    n = _phrases(v).select("query_id", F.posexplode(retrieval.clause_numbers(F.col("phrase"))).alias("tier", "n"))
    h = v.chunks.select("id", F.lower("text").alias("t")).crossJoin(F.broadcast(n)).where(F.contains("t", "n"))
    first = h.withColumn("best", F.min("tier").over(Window.partitionBy("query_id"))).where("tier = best")
    return first.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where("k <= 10").select("query_id", "id")


@query("R15_ilike_ladder", "WITH q AS (SELECT query_id, term1, substring(term1, 1, 3) AS short FROM queries), a AS (SELECT query_id, 0 AS tier, id FROM q JOIN chunks ON id % 10 = 3 AND contains(lower(text), lower(term1))), b AS (SELECT query_id, 1, id FROM q JOIN chunks ON contains(lower(heading), lower(term1))), c AS (SELECT query_id, 2, id FROM q JOIN (SELECT * FROM chunks ORDER BY chunk_index LIMIT 500) c ON contains(lower(text), lower(short))), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) SELECT query_id, tier, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM (SELECT DISTINCT *, min(tier) OVER (PARTITION BY query_id) AS best FROM u) WHERE tier = best) WHERE k <= 10")
def _(v):
    q = F.broadcast(v.queries.select("query_id", F.lower("term1").alias("t"), F.lower(F.substring("term1", 1, 3)).alias("s")))
    has = lambda df, column, term: df.select("id", F.lower(column).alias("c")).crossJoin(q).where(F.contains("c", term)).select("query_id", "id")
    return retrieval.tiers([has(v.chunks.where("id % 10 = 3"), "text", "t"), has(v.chunks, "heading", "t"), has(v.chunks.orderBy("chunk_index").limit(500), "text", "s")], 10)


_TCORPUS = "SELECT id AS chunk_id, concat_ws(' ', nullif(table_number, ''), nullif(title, ''), nullif(source_clause_number, ''), nullif(text, '')) AS content FROM tables"


def _tables(v):
    return v.tables.withColumn("clause_number", F.lit(None).cast("string")).withColumn("heading", F.lit(None).cast("string"))


@query("R17_table_bm25", f"WITH {_bm25_sql(_TCORPUS, _ASK)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} FROM bm WHERE score > 0) WHERE rank <= 20")
def _(v):
    corpus = _tables(v).select(F.col("id").alias("chunk_id"), retrieval.table_text().alias("content"))
    return fusion.ranked(retrieval.bm25(corpus, _ask(v)), "bm25", 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_TH = f"SELECT query_id, id AS chunk_id, sum(CASE WHEN lower(trim(table_number)) <> '' AND (contains(lower(trim(table_number)), lower(term)) OR contains(lower(term), lower(trim(table_number)))) THEN 120 WHEN contains(lower(trim(coalesce(title, ''))), lower(term)) THEN 90 WHEN contains(lower(term), 'table') AND trim(table_number) <> '' THEN 70 WHEN contains(substring(lower(text), 1, 300), lower(term)) THEN 25 ELSE 0 END)::BIGINT AS score FROM tables JOIN {_T2} t ON term <> '' GROUP BY query_id, id"


@query("R18_table_heading", f"SELECT * FROM ({_TH}) WHERE score > 0")
def _(v):
    return retrieval.table_heading(v.tables, _names(v))


@query("R19_table_fuzzy")
def _(v):
    corpus = _tables(v).select(F.col("id").alias("chunk_id"), retrieval.table_text().alias("content"))
    return fusion.ranked(fuzzy.partial(corpus, _terms(v), 35, 20), "fuzzy", 20)


@query("R20_table_retry", f"WITH {_bm25_sql(_TCORPUS, _ASK)}, th AS ({_TH}), s AS (SELECT query_id, chunk_id, 1 AS place, rank FROM (SELECT *, {_RANK} FROM bm WHERE score > 0) WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 2, rank FROM (SELECT *, {_RANK} FROM th WHERE score > 0) WHERE rank <= 20), f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min({{'p': place, 'r': rank}}) AS first FROM s WHERE chunk_id % 5 <> 0 GROUP BY ALL) SELECT query_id, chunk_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, chunk_id))::INT AS rank FROM f) WHERE rank <= 12")
def _(v):
    corpus = _tables(v).select(F.col("id").alias("chunk_id"), retrieval.table_text().alias("content"))
    one = fusion.ranked(retrieval.bm25(corpus, _ask(v)), "bm25", 20)
    two = fusion.ranked(retrieval.table_heading(v.tables, _names(v)), "heading", 20)
    return fusion.fused(one.unionByName(two).where("chunk_id % 5 <> 0"), 12, order=["bm25", "heading"]).select("query_id", "chunk_id", "rank")


_LABEL = """CASE WHEN trim(table_number) <> '' AND NOT contains(lower(coalesce(nullif(trim(coalesce(title, '')), ''), 'Table')), lower(trim(table_number))) THEN
    CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(table_number) || ' — ' || trim(title) ELSE trim(table_number) END ELSE coalesce(nullif(trim(coalesce(title, '')), ''), 'Table') END"""


@query("R21_table_as_clause", f"SELECT id, coalesce(nullif(trim(table_number), ''), nullif(trim(source_clause_number), ''), 'Table') AS clause_number, {_LABEL} AS heading FROM tables")
def _(v):
    number, heading = retrieval.table_as_clause(F.col("table_number"), F.col("title"), F.col("source_clause_number"))
    return v.tables.select("id", number.alias("clause_number"), heading.alias("heading"))


@query("R22_table_layout", "SELECT id, CASE WHEN is_shared_library AND id % 2 = 1 THEN 'standard_tables' ELSE 'embedded_chunks' END AS layout FROM docs")
def _(v):
    return v.docs.select("id", F.when(F.col("is_shared_library") & (F.col("id") % 2 == 1), "standard_tables").otherwise("embedded_chunks").alias("layout"))


@query("U12_pool", "SELECT 'standard' AS kind, id FROM tables UNION ALL SELECT 'embedded', id FROM chunks WHERE id % 23 = 0")
def _(v):
    return v.tables.select(F.lit("standard").alias("kind"), "id").unionByName(v.chunks.where("id % 23 = 0").select(F.lit("embedded").alias("kind"), "id"), allowMissingColumns=True)


_LINE = "CASE WHEN trim(table_number) <> '' AND trim(coalesce(title, '')) <> '' THEN trim(table_number) || ' — ' || trim(title) WHEN trim(table_number) <> '' THEN trim(table_number) ELSE trim(title) END || CASE WHEN source_clause_number IS NOT NULL THEN ' (clause ' || source_clause_number || ')' ELSE '' END"


@query("R23_table_catalog", f"SELECT id, {_LINE} AS line FROM tables ORDER BY id LIMIT 40")
def _(v):
    return v.tables.orderBy("id").limit(40).select("id", retrieval.catalog_line(F.col("table_number"), F.col("title"), F.col("source_clause_number")).alias("line"))


@query("R24_clause_hints", "SELECT id, clause_number || ' — ' || trim(heading) AS line FROM chunks WHERE document_id = 3 AND trim(heading) <> '' ORDER BY id LIMIT 12")
def _(v):
    c = v.chunks.where("document_id = 3 AND trim(heading) <> ''").orderBy("id").limit(12)
    return c.select("id", retrieval.catalog_line(F.col("clause_number"), F.col("heading"), F.lit(None).cast("string")).alias("line"))


_ATTEMPT = "(SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'insufficient' WHEN 1 THEN 'partial' ELSE 'clear' END AS c1, value AS f1, event_id % 7 AS n1, CASE event_id % 3 WHEN 0 THEN 'insufficient' WHEN 1 THEN 'partial' ELSE 'clear' END AS c2, value * (event_id % 3) AS f2, event_id % 5 AS n2 FROM events)"


def _attempts(v):
    conclusion = lambda m: F.when(F.col("event_id") % m == 0, "insufficient").when(F.col("event_id") % m == 1, "partial").otherwise("clear")
    return v.events.select(F.col("event_id").alias("id"), conclusion(4).alias("c1"), F.col("value").alias("f1"), (F.col("event_id") % 7).alias("n1"), conclusion(3).alias("c2"), (F.col("value") * (F.col("event_id") % 3)).alias("f2"), (F.col("event_id") % 5).alias("n2"))


@query("R26_better_answer", f"SELECT id, CASE WHEN {{'a': (c2 <> 'insufficient')::INT, 'b': f2, 'c': n2}} > {{'a': (c1 <> 'insufficient')::INT, 'b': f1, 'c': n1}} THEN 2 ELSE 1 END AS chosen FROM {_ATTEMPT}")
def _(v):
    weight = lambda i: F.struct((F.col(f"c{i}") != "insufficient").cast("int").alias("a"), F.col(f"f{i}").alias("b"), F.col(f"n{i}").alias("c"))
    return _attempts(v).select("id", F.when(weight(2) > weight(1), 2).otherwise(1).alias("chosen"))


@query("F25_retry_triggers", f"SELECT id, c1 = 'insufficient' AS insufficient, n1 >= 0.75 * 6 AND f1 >= 20 AS strong, c1 = 'insufficient' AND NOT (n1 >= 0.75 * 6 AND f1 >= 20) AS retry FROM {_ATTEMPT}")
def _(v):
    strong = (F.col("n1") >= 0.75 * 6) & (F.col("f1") >= 20)
    short = F.col("c1") == "insufficient"
    return _attempts(v).select("id", short.alias("insufficient"), strong.alias("strong"), (short & ~strong).alias("retry"))


@query("R27_heading_merge", "WITH e AS (SELECT query_id, 0 AS a, heading1 AS t FROM queries UNION ALL SELECT query_id, 1, heading2 FROM queries UNION ALL SELECT query_id, 2, term1 FROM queries UNION ALL SELECT query_id, 3, heading1 FROM queries), f AS (SELECT query_id, t, min(a) AS a FROM e GROUP BY ALL) SELECT query_id, string_agg(t, '|' ORDER BY a) AS headings FROM f GROUP BY query_id")
def _(v):
    return v.queries.select("query_id", F.array_join(F.array_distinct(F.concat(F.array("heading1", "heading2"), F.array("term1"), F.array("heading1"))), "|").alias("headings"))


@query("R28_text_builders", "SELECT id, concat_ws(' ', nullif(text, ''), nullif(heading, ''), nullif(clause_number, '')) AS search_text, concat_ws(chr(10), nullif(clause_number, ''), nullif(heading, ''), nullif(text, '')) AS embed_text FROM chunks")
def _(v):
    return v.chunks.select("id", retrieval.search_text().alias("search_text"), joined(F.col("clause_number"), F.col("heading"), F.col("text"), separator="\n").alias("embed_text"))


@query("R29_cache_keys", "SELECT query_id, substring(sha256(concat_ws(chr(10), 'src1', lower(trim(rephrased_query)), 'v1')), 1, 40) AS answer_key, substring(sha256('{\"fts\":\"' || term1 || '\",\"q\":\"' || rephrased_query || '\"}'), 1, 24) AS retrieval_key FROM queries")
def _(v):
    answer = F.substring(F.sha2(F.concat_ws("\n", F.lit("src1"), F.lower(F.trim("rephrased_query")), F.lit("v1")), 256), 1, 40)
    body = F.concat(F.lit('{"fts":"'), F.col("term1"), F.lit('","q":"'), F.col("rephrased_query"), F.lit('"}'))
    return v.queries.select("query_id", answer.alias("answer_key"), F.substring(F.sha2(body, 256), 1, 24).alias("retrieval_key"))


@query("R30_cache_invalidation", "SELECT key FROM (SELECT 'retrieval:v1:' || (id % 50) || ':' || id AS key FROM chunks) WHERE NOT starts_with(key, 'retrieval:v1:7:')")
def _(v):
    key = F.concat_ws(":", F.lit("retrieval:v1"), (F.col("id") % 50).cast("string"), F.col("id").cast("string"))
    return v.chunks.select(key.alias("key")).where(~F.col("key").startswith("retrieval:v1:7:"))


# -- by the persisted indexes: the same rows, read from the folders of the terms or lists asked for; R8 over whole texts --

_built: dict[tuple[str, str, str], tuple[str, tuple]] = {}


def _index(v, kind):
    """The index over the tables of v as they are now: each call reads what it is over, and an index that was built from other
    rows in this session is left for a new one. Trigrams are those of whole texts."""
    if kind is indexes.Postings:
        rows = v.chunks.select("id", "text", "heading", "clause_number")
    else:
        rows = v.embeddings.join(v.chunks.select(F.col("id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "embedding")
    key = (v.spark.sparkContext.applicationId, v.sf_dir, kind.__name__)
    over = tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())
    if key not in _built or _built[key][1] != over:
        path = indexes.new_folder(v.spark, kind.__name__.lower())
        if kind is indexes.Postings:
            kind(v.spark, path, None).append(rows)
        else:
            kind(v.spark, path).build(rows, LISTS)
        _built[key] = path, over
    return kind(v.spark, _built[key][0])


#: Lists of the inverted file, and how many of them a question reads.
LISTS, PROBES = 100, 75


@query("R1_by_postings", _R1)
def _(v):
    return fusion.ranked(_index(v, indexes.Postings).bm25(_ask(v)), "bm25", 40).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("R6_by_postings", f"SELECT * FROM ({_WORDS}) WHERE rank <= 40")
def _(v):
    return _index(v, indexes.Postings).any_word(retrieval.clean_terms(v.queries, "term1"), 40)


@query("R7_by_postings", _R7)
def _(v):
    return _index(v, indexes.Postings).weighted_match(_terms(v)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("R8_by_postings", f"WITH {_trig_sql('text')} SELECT query_id, term_pos, chunk_id, round(score, 6) AS score FROM ts WHERE score >= 0.3")
def _(v):
    return _index(v, indexes.Postings).trigram(_terms(v)).select("query_id", "term_pos", "chunk_id", F.round("score", 6).alias("score"))


@query("R2_all_lists", _R2)
def _(v):
    return _index(v, indexes.Vectors).search(retrieve.query_vectors(v), 20, LISTS)


@query("R2_by_lists")
def _(v):
    return _index(v, indexes.Vectors).search(retrieve.query_vectors(v), 20, PROBES)
