"""Scalar and table functions that SQL can call, over views of the library's tables.

register(spark, tables) names the tables as temporary views and the functions over them. A function's body is SQL that
Spark puts in place of the call, so a call in a query over many users is one plan of joins, not a call for each. Times
are a parameter that is now unless given. A list of documents narrows what is searched; null searches all that the user
may see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables that the functions read, by the names of their views.
TABLES = ("chunks", "docs", "memberships", "embeddings", "user_subscriptions", "redemptions")

_NOW = "p_now TIMESTAMP DEFAULT current_timestamp()"
_PAID = "s.user_id = p_user_id AND s.status = 'active' AND s.current_period_end > p_now"
_TRIAL = "r.user_id = p_user_id AND r.is_active AND r.access_granted_until > p_now AND NOT r.expired"
_WHO = "p_user_id BIGINT, p_document_ids ARRAY<BIGINT>"
_HOW = "p_codebook STRING DEFAULT NULL, p_limit INT DEFAULT 40"
#: A user's own documents, the shared library's, and those of companies the user has an active seat in.
_SEATS = "LEFT JOIN (SELECT DISTINCT company_id, user_id FROM {memberships} WHERE status = 'active') m ON m.company_id = d.company_id AND m.user_id = p_user_id"
_SEEN = "d.status = 'ready_for_search' AND (d.user_id = p_user_id OR coalesce(d.is_shared_library, false) OR m.user_id IS NOT NULL)"
_WORDS = r"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+', 0)"
_GRAMS = r"""array_distinct(flatten(transform(filter(split(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> ''),
             w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"""
_ALIKE = "(size(array_intersect({a}, {b})) / greatest(size(array_union({a}, {b})), 1))"


def _ranked(select: str, order: str, columns: str) -> str:
    """The first p_limit rows, one at least; ties by chunk."""
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order} DESC, chunk_id) AS place FROM ({select}) x) y WHERE place <= greatest(p_limit, 1)"


def definitions(view: dict[str, str]) -> dict[str, str]:
    """name -> parameters, kind of result and body, over views of these names."""
    seats = _SEATS.format(**view)
    visible = f"""SELECT c.* FROM {view["chunks"]} c JOIN {view["docs"]} d ON d.id = c.document_id {seats}
        WHERE {_SEEN} AND (p_document_ids IS NULL OR array_contains(p_document_ids, c.document_id)) AND (p_codebook IS NULL OR c.codebook = p_codebook)"""
    asked = _WORDS.format(x="p_query")
    best = "CASE WHEN array_contains(a, w) THEN 1.0D WHEN array_contains(b, w) THEN 0.4D WHEN array_contains(c, w) THEN 0.2D ELSE 0.0D END"
    fts = f"""SELECT chunk_id, aggregate(transform(asked, w -> {best}), 0.0D, (x, y) -> x + y) AS rank FROM (
        SELECT id AS chunk_id, {_WORDS.format(x="heading")} AS a, {_WORDS.format(x="clause_number")} AS b, {_WORDS.format(x="text")} AS c, array_distinct({asked}) AS asked FROM ({visible}) v) t
        WHERE size(asked) > 0 AND forall(asked, w -> {best} > 0)"""
    head, body, term = _GRAMS.format(x="concat(coalesce(heading, ''), ' ', coalesce(clause_number, ''))"), _GRAMS.format(x="left(text, 2000)"), _GRAMS.format(x="p_term")
    trgm = f"""SELECT chunk_id, greatest({_ALIKE.format(a="h", b="t")}, {_ALIKE.format(a="x", b="t")}) AS similarity FROM (
        SELECT id AS chunk_id, {head} AS h, {body} AS x, {term} AS t FROM ({visible}) v) g WHERE greatest({_ALIKE.format(a="h", b="t")}, {_ALIKE.format(a="x", b="t")}) >= 0.3"""
    n = "lower(trim(coalesce(p_needle, '')))"
    number = "lower(coalesce(clause_number, ''))"
    rules = f"""CASE WHEN {number} = {n} THEN 100 WHEN {number} LIKE concat({n}, '.%') THEN 95 WHEN {n} LIKE concat({number}, '.%') THEN 90
        WHEN lower(coalesce(heading, '')) LIKE concat('%', {n}, '%') THEN 80 WHEN lower(left(coalesce(text, ''), 200)) LIKE concat('%', {n}, '%') THEN 20 ELSE 0 END"""
    heading = f"SELECT * FROM (SELECT id AS chunk_id, {rules} AS score FROM ({visible}) v WHERE {n} <> '') s WHERE score > 0"
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"
    cosine = f"{dot('e.embedding', 'p_query_embedding')} / sqrt({dot('e.embedding', 'e.embedding')} * {dot('p_query_embedding', 'p_query_embedding')})"
    vector = f"""SELECT c.id AS chunk_id, c.document_id, {cosine} AS similarity, c.text, c.clause_number, c.heading, c.page_number, c.codebook, c.jurisdiction
        FROM {view["embeddings"]} e JOIN {view["chunks"]} c ON c.id = e.vec_id JOIN {view["docs"]} d ON d.id = c.document_id {seats}
        WHERE {_SEEN.replace("d.user_id = p_user_id", "p_user_id IS NULL OR d.user_id = p_user_id")} AND (p_document_id IS NULL OR c.document_id = p_document_id)
        AND (p_codebook IS NULL OR c.codebook = p_codebook) AND (p_jurisdiction IS NULL OR c.jurisdiction IS NULL OR c.jurisdiction IN (p_jurisdiction, 'BOTH'))"""
    n_of = lambda s: f"count_if(status = '{s}')"
    return {
        "has_active_subscription": f"(p_user_id BIGINT, {_NOW}) RETURNS BOOLEAN RETURN (SELECT count(*) > 0 FROM {view['user_subscriptions']} s WHERE {_PAID}) OR (SELECT count(*) > 0 FROM {view['redemptions']} r WHERE {_TRIAL})",
        "get_user_access_level": f"""(p_user_id BIGINT, {_NOW}) RETURNS STRING RETURN coalesce(
            (SELECT CASE WHEN min_by(s.plan_name, s.id) = 'professional' THEN 'professional' WHEN count(*) > 0 THEN 'individual' END FROM {view["user_subscriptions"]} s WHERE {_PAID}),
            (SELECT CASE WHEN count(*) > 0 THEN 'trial' END FROM {view["redemptions"]} r WHERE {_TRIAL}), 'free')""",
        "get_document_stats": f"""(p_user_id BIGINT) RETURNS TABLE (total_documents BIGINT, pending_documents BIGINT, completed_documents BIGINT, total_chunks BIGINT) RETURN
            SELECT count(*), {n_of("pending_admin_review")}, {n_of("ready_for_search")}, coalesce(sum(refined_chunk_count), 0) FROM {view["docs"]} WHERE user_id = p_user_id""",
        "search_chunks_fts": f"({_WHO}, p_query STRING, {_HOW}) RETURNS TABLE (chunk_id BIGINT, rank DOUBLE) RETURN {_ranked(fts, 'round(rank, 9)', 'chunk_id, rank')}",
        "search_chunks_trgm": f"({_WHO}, p_term STRING, {_HOW}) RETURNS TABLE (chunk_id BIGINT, similarity DOUBLE) RETURN {_ranked(trgm, 'round(similarity, 9)', 'chunk_id, similarity')}",
        "search_chunks_heading": f"({_WHO}, p_needle STRING, {_HOW}) RETURNS TABLE (chunk_id BIGINT, score INT) RETURN {_ranked(heading, 'score', 'chunk_id, score')}",
        "search_chunks_vector": f"""(p_query_embedding ARRAY<DOUBLE>, p_user_id BIGINT DEFAULT NULL, p_document_id BIGINT DEFAULT NULL, p_limit INT DEFAULT 10, p_codebook STRING DEFAULT NULL, p_jurisdiction STRING DEFAULT NULL)
            RETURNS TABLE (chunk_id BIGINT, document_id BIGINT, similarity DOUBLE, text STRING, clause_number STRING, heading STRING, page_number INT, codebook STRING, jurisdiction STRING)
            RETURN {_ranked(vector, "round(similarity, 9)", "chunk_id, document_id, similarity, text, clause_number, heading, page_number, codebook, jurisdiction")}""",
    }


def register(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Names the TABLES as views, each with the prefix, and the functions over them; the functions' names."""
    view = {name: f"{prefix}{name}" for name in TABLES}
    for name in TABLES:
        tables[name].createOrReplaceTempView(view[name])
    found = definitions(view)
    for name, text in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")
    return list(found)
