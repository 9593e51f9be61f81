"""The SQL functions, called from SQL."""

from clausemill.sources import sql_functions

from .account_queries import _PAID, _TRIAL, AS_OF
from .registry import query
from .retrieval_queries import W, _gram_sql


def _sql(v, text: str):
    sql_functions.register(v.spark, {name: getattr(v, name) for name in sql_functions.TABLES}, "fn_")
    v.profiles.createOrReplaceTempView("fn_profiles")
    return v.spark.sql(text)


#: What the calls below see and ask for.
_SEEN = "d.status = 'ready_for_search' AND (d.user_id = 3 OR coalesce(d.is_shared_library, false) OR d.company_id IN (SELECT company_id FROM memberships WHERE user_id = 3 AND status = 'active'))"
_VISIBLE = f"(SELECT c.* FROM chunks c JOIN docs d ON d.id = c.document_id WHERE {_SEEN})"
_TERM = "(SELECT min(term1) FROM queries)"


def _first(v) -> str:
    return v.queries.agg({"term1": "min"}).first()[0].replace("'", "''")


#: All documents that the user may see.
_ALL = "CAST(NULL AS ARRAY<BIGINT>)"


@query("FN_has_active_subscription", f"SELECT p.id AS user_id, a.plan IS NOT NULL OR t.trial IS NOT NULL AS has_active FROM profiles p LEFT JOIN {_PAID} a ON a.user_id = p.id LEFT JOIN {_TRIAL} t ON t.user_id = p.id")
def _(v):
    return _sql(v, f"SELECT id AS user_id, has_active_subscription(id, TIMESTAMP '{AS_OF}') AS has_active FROM fn_profiles")


@query("FN_access_level", f"SELECT p.id AS user_id, CASE WHEN a.plan = 'professional' THEN 'professional' WHEN a.plan IS NOT NULL THEN 'individual' WHEN t.trial THEN 'trial' ELSE 'free' END AS access_level FROM profiles p LEFT JOIN {_PAID} a ON a.user_id = p.id LEFT JOIN {_TRIAL} t ON t.user_id = p.id")
def _(v):
    return _sql(v, f"SELECT id AS user_id, get_user_access_level(id, TIMESTAMP '{AS_OF}') AS access_level FROM fn_profiles")


@query("FN_document_stats", "SELECT p.id AS user_id, count(d.id) AS total_documents, count(*) FILTER (d.status = 'pending_admin_review') AS pending_documents, count(*) FILTER (d.status = 'ready_for_search') AS completed_documents, coalesce(sum(refined_chunk_count), 0)::BIGINT AS total_chunks FROM profiles p LEFT JOIN docs d ON d.user_id = p.id GROUP BY p.id")
def _(v):
    return _sql(v, "SELECT p.id AS user_id, s.* FROM fn_profiles p, LATERAL get_document_stats(p.id) s")


@query("FN_search_fts", f"""WITH t AS (SELECT id, regexp_extract_all(lower(coalesce(heading, '')), '{W}') AS a, regexp_extract_all(lower(coalesce(clause_number, '')), '{W}') AS b, regexp_extract_all(lower(coalesce(text, '')), '{W}') AS c, list_distinct(regexp_extract_all(lower({_TERM}), '{W}')) AS asked FROM {_VISIBLE}),
    w AS (SELECT id, asked, list_transform(asked, lambda x: CASE WHEN list_contains(a, x) THEN 1.0 WHEN list_contains(b, x) THEN 0.4 WHEN list_contains(c, x) THEN 0.2 ELSE 0 END) AS ws FROM t)
    SELECT id AS chunk_id, round(list_sum(ws), 6)::DOUBLE AS rank FROM w WHERE len(asked) > 0 AND len(list_filter(ws, lambda x: x = 0)) = 0 ORDER BY rank DESC, id LIMIT 40""")
def _(v):
    return _sql(v, f"SELECT chunk_id, round(rank, 6) AS rank FROM search_chunks_fts(3L, {_ALL}, '{_first(v)}')")


@query("FN_search_trgm", f"""WITH g AS (SELECT id, {_gram_sql("heading || ' ' || clause_number")} AS h, {_gram_sql("substring(text, 1, 2000)")} AS x, {_gram_sql(_TERM)} AS t FROM {_VISIBLE}),
    s AS (SELECT id, greatest(len(list_intersect(h, t))::DOUBLE / len(list_distinct(list_concat(h, t))), len(list_intersect(x, t))::DOUBLE / len(list_distinct(list_concat(x, t)))) AS s FROM g)
    SELECT id AS chunk_id, round(s, 6) AS similarity FROM s WHERE s >= 0.3 ORDER BY round(s, 9) DESC, id LIMIT 25""")
def _(v):
    return _sql(v, f"SELECT chunk_id, round(similarity, 6) AS similarity FROM search_chunks_trgm(3L, {_ALL}, '{_first(v)}', p_limit => 25)")


@query("FN_search_heading", f"""SELECT * FROM (SELECT id AS chunk_id, CASE WHEN lower(clause_number) = n THEN 100 WHEN lower(clause_number) LIKE n || '.%' THEN 95 WHEN n LIKE lower(clause_number) || '.%' THEN 90
    WHEN contains(lower(heading), n) THEN 80 WHEN contains(lower(substring(text, 1, 200)), n) THEN 20 ELSE 0 END AS score FROM {_VISIBLE}, (SELECT '3.4' AS n)) WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 40""")
def _(v):
    return _sql(v, f"SELECT * FROM search_chunks_heading(3L, {_ALL}, ' 3.4 ')")


@query("FN_search_vector", f"""SELECT c.id AS chunk_id, c.document_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS similarity, c.heading FROM embeddings e JOIN {_VISIBLE} c ON c.id = e.vec_id, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q
    WHERE c.jurisdiction IS NULL OR c.jurisdiction IN ('NSW', 'BOTH') ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 9) DESC, c.id LIMIT 10""")
def _(v):
    vector = "array(" + ", ".join(f"{float(x)!r}D" for x in v.embeddings.where("vec_id = 0").first().embedding) + ")"  # one vector of a question
    return _sql(v, f"SELECT chunk_id, document_id, round(similarity, 6) AS similarity, heading FROM search_chunks_vector({vector}, p_user_id => 3L, p_jurisdiction => 'NSW')")
