"""Visibility and scope."""

from pyspark.sql import functions as F

from clausemill.operators import access

from .registry import query

_SEAT = "EXISTS (SELECT 1 FROM memberships m WHERE m.company_id = d.company_id AND m.user_id = {u} AND m.status = 'active')"
_SEE = "(d.user_id = {u} OR coalesce(d.is_shared_library, false) OR (d.company_id IS NOT NULL AND " + _SEAT + "))"


@query("F1_visible_chunks", f"SELECT c.id, c.document_id FROM chunks c JOIN docs d ON d.id = c.document_id WHERE d.status = 'ready_for_search' AND {_SEE.format(u=3)} AND c.document_id IN (1, 2, 3, 7, 9, 12, 13, 14, 15, 21, 28, 33) AND c.codebook = 'src1'")
def _(v):
    return access.visible_chunks(v.chunks, v.docs, v.memberships, 3, [1, 2, 3, 7, 9, 12, 13, 14, 15, 21, 28, 33], "src1").select("id", "document_id")


_EMB = "(SELECT vec_id AS chunk_id, embedding, vec_id % 10 AS user_id FROM embeddings)"


def _embeddings(v):
    return v.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", (F.col("vec_id") % 10).alias("user_id"))


@query("F2_visible_embeddings", f"SELECT e.chunk_id, c.document_id, c.codebook, c.jurisdiction, c.clause_number FROM {_EMB} e JOIN chunks c ON c.id = e.chunk_id JOIN docs d ON d.id = c.document_id WHERE d.status = 'ready_for_search' AND (e.user_id = 3 OR coalesce(d.is_shared_library, false) OR (d.company_id IS NOT NULL AND {_SEAT.format(u=3)})) AND (c.jurisdiction IS NULL OR c.jurisdiction IN ('NSW', 'BOTH'))")
def _(v):
    return access.visible_embeddings(_embeddings(v), v.chunks, v.docs, v.memberships, user_id=3, jurisdiction="NSW").drop("embedding")


@query("F3_single_document", f"SELECT d.id AS document_id, d.codebook, d.codebook IS DISTINCT FROM 'src1' AS codebook_mismatch FROM docs d WHERE d.id = 21 AND d.status = 'ready_for_search' AND {_SEE.format(u=4)}")
def _(v):
    return access.single_document(v.docs, v.memberships, 4, 21, "src1")


_SCOPE = """
    WITH r AS (SELECT * FROM docs WHERE status = 'ready_for_search'), u AS (
      SELECT id, 0 AS source FROM r WHERE user_id = 3
      UNION ALL SELECT id, 1 FROM r WHERE company_id IN (SELECT company_id FROM memberships WHERE user_id = 3 AND status = 'active')
      UNION ALL SELECT id, 2 FROM r WHERE is_shared_library),
    f AS (SELECT id, min(source) AS source FROM u GROUP BY id)
    SELECT id AS document_id, source, (row_number() OVER (ORDER BY source, id))::INT AS position FROM f"""


@query("F4_document_scope", _SCOPE)
def _(v):
    return access.document_scope(v.docs, v.memberships, 3)


@query("U1_scope_union", _SCOPE.replace("AS position FROM f", "AS position FROM f WHERE source >= 0"))
def _(v):
    return access.document_scope(v.docs, v.memberships, 3)


@query("F5_design_documents", "SELECT id FROM docs WHERE coalesce(is_shared_library, false) OR user_id = 4 OR company_id = 2")
def _(v):
    return v.docs.where(F.coalesce("is_shared_library", F.lit(False)) | (F.col("user_id") == 4) | (F.col("company_id") == 2)).select("id")


@query("F6_clause_prefix", "SELECT c.id, c.document_id, c.clause_number, c.jurisdiction, c.codebook, c.page_number, 1.0::DOUBLE AS similarity_score FROM chunks c JOIN docs d ON d.id = c.document_id WHERE c.user_id = 3 AND d.status = 'ready_for_search' AND (c.jurisdiction IS NULL OR c.jurisdiction IN ('VIC', 'BOTH')) AND c.clause_number LIKE '4.%' ORDER BY c.chunk_index LIMIT 10")
def _(v):
    return access.by_prefix(v.chunks, v.docs, 3, jurisdiction="VIC", prefix="4.")


@query("F7_row_policies", f"SELECT d.id FROM docs d WHERE {_SEE.format(u=7)}")
def _(v):
    return access.SecureView(7, v.memberships, v.profiles).documents(v.docs).select("id")


@query("F8_table_like_chunks", "SELECT id FROM chunks WHERE lower(concat_ws(' ', trim(clause_number), trim(heading))) LIKE '%table%' OR json_extract_string(metadata, '$.is_table') = 'true'")
def _(v):
    return v.chunks.where(access.is_table_like(F.col("clause_number"), F.col("heading"), F.col("metadata"))).select("id")


_RANKED = "(SELECT id % 5 AS query_id, id AS chunk_id, (row_number() OVER (PARTITION BY id % 5 ORDER BY page_number, id))::INT AS rank FROM chunks)"


def _ranked(v):
    from pyspark.sql import Window

    q = F.col("id") % 5
    return v.chunks.select(q.alias("query_id"), F.col("id").alias("chunk_id"), F.row_number().over(Window.partitionBy(q).orderBy("page_number", "id")).alias("rank"))


@query("F9_exclude_with_limit", f"SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id))::INT AS rank FROM {_RANKED} WHERE chunk_id % 3 <> 0) WHERE rank <= 12")
def _(v):
    gone = v.chunks.where("id % 3 = 0").select((F.col("id") % 5).alias("query_id"), F.col("id").alias("chunk_id"))
    return access.without(_ranked(v), gone, 12)


@query("F27_staff", "SELECT id, role FROM profiles WHERE role IN ('admin', 'engineer', 'inspector')")
def _(v):
    return access.staff_only(v.profiles).select("id", "role")


@query("J1_embedding_chunk_document", f"SELECT e.chunk_id, c.document_id, d.status FROM {_EMB} e JOIN chunks c ON c.id = e.chunk_id JOIN docs d ON d.id = c.document_id")
def _(v):
    c = v.chunks.select(F.col("id").alias("chunk_id"), "document_id")
    return _embeddings(v).join(c, "chunk_id").join(v.docs.select(F.col("id").alias("document_id"), "status"), "document_id").select("chunk_id", "document_id", "status")


@query("J2_chunk_document", "SELECT c.id, d.filename FROM chunks c JOIN docs d ON d.id = c.document_id")
def _(v):
    return v.chunks.select("id", "document_id").join(v.docs.select(F.col("id").alias("document_id"), "filename"), "document_id").select("id", "filename")


@query("J3_chunk_in_visible", f"SELECT id, clause_number FROM chunks WHERE id IN (SELECT c.id FROM chunks c JOIN docs d ON d.id = c.document_id WHERE d.status = 'ready_for_search' AND {_SEE.format(u=5)})")
def _(v):
    ids = access.visible_chunks(v.chunks, v.docs, v.memberships, 5).select("id")
    return v.chunks.select("id", "clause_number").join(ids, "id", "left_semi")


@query("J4_existence_join", f"SELECT d.id FROM docs d WHERE d.user_id = 6 OR coalesce(d.is_shared_library, false) OR {_SEAT.format(u=6)}")
def _(v):
    seats = access.active_companies(v.memberships, 6).withColumn("seat", F.lit(True))
    return v.docs.join(seats, "company_id", "left").where((F.col("user_id") == 6) | F.coalesce("is_shared_library", F.lit(False)) | F.coalesce("seat", F.lit(False))).select("id")


@query("R25_visible_count", f"SELECT count(*) AS visible, count(*) >= 500 AS use_index FROM chunks c JOIN docs d ON d.id = c.document_id WHERE d.status = 'ready_for_search' AND {_SEE.format(u=3)}")
def _(v):
    return access.visible_chunks(v.chunks, v.docs, v.memberships, 3).agg(F.count("*").alias("visible"), (F.count("*") >= 500).alias("use_index"))


@query("J23_orphan_chunks", "SELECT document_id, count(*) AS chunks_count FROM chunks WHERE document_id NOT IN (SELECT id FROM docs WHERE id % 4 <> 1) GROUP BY document_id")
def _(v):
    kept = v.docs.where("id % 4 <> 1").select(F.col("id").alias("document_id"))
    return v.chunks.join(kept, "document_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("chunks_count"))


@query("A16_orphan_chunk_counts", "SELECT document_id, count(*) AS chunks_count FROM chunks WHERE document_id NOT IN (SELECT id FROM docs WHERE id % 3 <> 1) GROUP BY document_id ORDER BY chunks_count DESC, document_id")
def _(v):
    kept = v.docs.where("id % 3 <> 1").select(F.col("id").alias("document_id"))
    return v.chunks.join(kept, "document_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("chunks_count")).orderBy(F.desc("chunks_count"), "document_id")


@query("U6_id_difference", "SELECT DISTINCT document_id FROM chunks EXCEPT SELECT id FROM docs WHERE id % 2 = 0")
def _(v):
    return v.chunks.select("document_id").distinct().join(v.docs.where("id % 2 = 0").select(F.col("id").alias("document_id")), "document_id", "left_anti")
