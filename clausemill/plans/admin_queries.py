"""Registry, overview, orphans, aggregates, pages and sorts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausemill.operators import admin
from clausemill.sources.derived import AS_OF

from .registry import query

_REGISTRY = """WITH q AS (SELECT document_id, arg_max(status, id) AS queue_status, arg_max(priority, id) AS queue_priority FROM admin_queue GROUP BY document_id)
    SELECT d.id, d.user_id, d.filename, d.status, p.email AS owner_email, p.role AS owner_role, queue_status, queue_priority,
      d.filename || '::' || coalesce(d.file_size, 0) AS duplicate_key, count(*) OVER (PARTITION BY d.filename, coalesce(d.file_size, 0)) AS duplicate_count,
      count(*) OVER (PARTITION BY d.user_id, d.filename) AS version_count, (row_number() OVER (PARTITION BY d.user_id, d.filename ORDER BY d.created_at DESC, d.id))::INT AS version_place
    FROM docs d LEFT JOIN profiles p ON p.id = d.user_id LEFT JOIN q ON q.document_id = d.id"""


def _sub(name, columns):
    @query(name, f"SELECT {columns} FROM ({_REGISTRY})")
    def _(v):
        return admin.registry(v.docs, v.profiles, v.admin_queue).select(*[c.strip() for c in columns.split(",")])


_sub("B22_document_registry", "id, user_id, filename, status, owner_email, owner_role, queue_status, queue_priority, duplicate_key, duplicate_count, version_count, version_place")
_sub("J18_registry_joins", "id, owner_email, queue_status, queue_priority")
_sub("J19_related_documents", "id, duplicate_count, version_count")
_sub("W4_version_order", "id, user_id, filename, version_place")
_sub("W5_duplicate_count", "id, duplicate_key, duplicate_count")


@query("A4_registry_summary", """WITH g AS (SELECT count(*) AS n FROM docs GROUP BY filename, coalesce(file_size, 0) HAVING count(*) > 1)
    SELECT count(*) AS total_documents, count(DISTINCT user_id) AS unique_users, count(*) FILTER (status = 'ready_for_search') AS ready_documents, count(*) FILTER (status <> 'ready_for_search') AS pending_documents,
      (SELECT count(*) FROM g) AS duplicate_groups, (SELECT greatest(0, coalesce(sum(n), 0) - count(*)) FROM g)::BIGINT AS total_duplicates FROM docs""")
def _(v):
    return admin.registry_summary(v.docs)


@query("A1_document_stats", "SELECT user_id, count(*) AS total_documents, count(*) FILTER (status = 'pending_admin_review') AS pending_documents, count(*) FILTER (status = 'ready_for_search') AS completed_documents, coalesce(sum(refined_chunk_count), 0)::BIGINT AS total_chunks FROM docs GROUP BY user_id")
def _(v):
    n = lambda s: F.count_if(F.col("status") == s)
    return v.docs.groupBy("user_id").agg(F.count("*").alias("total_documents"), n("pending_admin_review").alias("pending_documents"), n("ready_for_search").alias("completed_documents"), F.coalesce(F.sum("refined_chunk_count"), F.lit(0)).alias("total_chunks"))


@query("A3_admin_counts", "SELECT (SELECT count(*) FROM profiles) AS total_users, (SELECT count(*) FROM docs) AS total_documents, (SELECT count(*) FROM docs WHERE status = 'pending') AS pending_literal, (SELECT count(*) FROM docs WHERE status = 'pending_admin_review') AS pending_admin_review, (SELECT count(*) FROM docs WHERE status = 'ready_for_search') AS completed_documents, (SELECT count(*) FROM chunks) AS total_chunks")
def _(v):
    d = v.docs.agg(F.count("*").alias("total_documents"), F.count_if(F.col("status") == "pending").alias("pending_literal"), F.count_if(F.col("status") == "pending_admin_review").alias("pending_admin_review"), F.count_if(F.col("status") == "ready_for_search").alias("completed_documents"))
    return v.profiles.agg(F.count("*").alias("total_users")).crossJoin(d).crossJoin(v.chunks.agg(F.count("*").alias("total_chunks")))  # one row each


_STATS = "(SELECT user_id, count(*) AS document_count, coalesce(sum(chunk_count), 0)::BIGINT AS chunk_count, max(coalesce(updated_at, created_at)) AS last_activity, array_to_string(list_sort(list_distinct(list(status))), ',') AS statuses FROM docs WHERE user_id IS NOT NULL GROUP BY user_id)"


@query("A5_user_document_stats", f"SELECT * FROM {_STATS}")
def _(v):
    return admin.user_document_stats(v.docs)


_OVERVIEW = f"""SELECT coalesce(a.id, s.user_id) AS user_id, CASE WHEN a.id IS NOT NULL THEN coalesce(a.email, p.email) ELSE coalesce(p.email, 'user:' || substring(s.user_id::VARCHAR, 1, 8) || '@unknown') END AS email,
      coalesce(p.full_name, CASE WHEN a.id IS NOT NULL THEN coalesce(a.meta_name, split_part(a.email, '@', 1)) ELSE 'User ' || substring(s.user_id::VARCHAR, 1, 8) END) AS full_name, coalesce(p.role, 'user') AS role,
      coalesce(document_count, 0) AS document_count, coalesce(chunk_count, 0) AS chunk_count, coalesce(last_activity, last_sign_in_at, a.created_at) AS last_activity, coalesce(statuses, '') AS statuses
    FROM auth_users a FULL OUTER JOIN {_STATS} s ON s.user_id = a.id LEFT JOIN profiles p ON p.id = coalesce(a.id, s.user_id)"""


@query("B23_project_overview", _OVERVIEW)
def _(v):
    return admin.overview(v.auth_users, v.profiles, v.docs)


@query("J20_overview_join", f"SELECT user_id, role, document_count FROM ({_OVERVIEW})")
def _(v):
    return admin.overview(v.auth_users, v.profiles, v.docs).select("user_id", "role", "document_count")


@query("A6_overview_totals", f"SELECT count(*) AS total_users, sum(document_count)::BIGINT AS total_documents, sum(chunk_count)::BIGINT AS total_chunks, count(*) FILTER (document_count > 0) AS active_users FROM ({_OVERVIEW})")
def _(v):
    return admin.overview(v.auth_users, v.profiles, v.docs).agg(F.count("*").alias("total_users"), F.sum("document_count").alias("total_documents"), F.sum("chunk_count").alias("total_chunks"), F.count_if(F.col("document_count") > 0).alias("active_users"))


_USERS = """SELECT coalesce(p.id, s.user_id) AS user_id, CASE WHEN p.id IS NOT NULL THEN coalesce(p.email, '') ELSE 'User ID: ' || substring(s.user_id::VARCHAR, 1, 8) || '...' END AS email,
    CASE WHEN p.id IS NOT NULL THEN coalesce(p.full_name, '') ELSE 'Document Uploader (' || substring(s.user_id::VARCHAR, 1, 8) || ')' END AS full_name, coalesce(document_count, 0) AS document_count, coalesce(total_size, 0)::BIGINT AS total_size
    FROM (SELECT * FROM profiles WHERE id % 2 = 0) p FULL OUTER JOIN (SELECT user_id, count(*) AS document_count, sum(coalesce(file_size, 0)) AS total_size FROM docs GROUP BY user_id) s ON s.user_id = p.id"""


def _users(v):
    return admin.users_with_documents(v.profiles.where("id % 2 = 0"), v.docs)


@query("J21_users_with_documents", _USERS)
def _(v):
    return _users(v)


@query("A7_user_totals", f"SELECT user_id, document_count, total_size FROM ({_USERS})")
def _(v):
    return _users(v).select("user_id", "document_count", "total_size")


@query("T6_users_page", f"SELECT user_id, document_count FROM ({_USERS}) ORDER BY document_count DESC, user_id LIMIT 10 OFFSET 5")
def _(v):
    return _users(v).select("user_id", "document_count").orderBy(F.desc("document_count"), "user_id").offset(5).limit(10)


@query("T11_users_by_count", f"SELECT user_id, document_count FROM ({_USERS}) ORDER BY document_count DESC, user_id")
def _(v):
    return _users(v).select("user_id", "document_count").orderBy(F.desc("document_count"), "user_id")


@query("A9_codebook_averages", "SELECT codebook, count(*) AS documents, floor(sum(chunk_count) / count(*) + 0.5)::BIGINT AS avg_chunks FROM docs GROUP BY codebook")
def _(v):
    return v.docs.groupBy("codebook").agg(F.count("*").alias("documents"), F.floor(F.sum("chunk_count") / F.count("*") + 0.5).alias("avg_chunks"))


@query("A10_user_activity", "SELECT p.id AS user_id, coalesce(d.n, 0) AS documents, coalesce(c.n, 0) AS chunks, d.last_document FROM profiles p LEFT JOIN (SELECT user_id, count(*) AS n, max(created_at) AS last_document FROM docs GROUP BY user_id) d ON d.user_id = p.id LEFT JOIN (SELECT user_id, count(*) AS n FROM chunks GROUP BY user_id) c ON c.user_id = p.id")
def _(v):
    d = v.docs.groupBy("user_id").agg(F.count("*").alias("documents"), F.max("created_at").alias("last_document"))
    c = v.chunks.groupBy("user_id").agg(F.count("*").alias("chunks"))
    j = v.profiles.select(F.col("id").alias("user_id")).join(d, "user_id", "left").join(c, "user_id", "left")
    return j.select("user_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "last_document")


@query("A11_status_breakdown", "SELECT user_id, status, count(*) AS n FROM docs GROUP BY user_id, status")
def _(v):
    return v.docs.groupBy("user_id", "status").agg(F.count("*").alias("n"))


@query("A17_user_detail", "SELECT user_id, count(*) AS total, count(*) FILTER (status = 'ready_for_search') AS ready, count(*) FILTER (is_shared_library) AS shared, sum(file_size)::BIGINT AS bytes FROM docs GROUP BY user_id")
def _(v):
    return v.docs.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ready_for_search").alias("ready"), F.count_if("is_shared_library").alias("shared"), F.sum("file_size").alias("bytes"))


@query("A33_grade_summary", "SELECT CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS grade, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def _(v):
    j = v.labels.join(v.documents.select("doc_id", "n_chars"), "doc_id")
    return j.groupBy(F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("A34_catalog_readiness", "SELECT codebook, bool_or(status = 'ready_for_search') AS ready, bool_or(status IN ('pdf_processing', 'admin_processing')) AS processing FROM docs GROUP BY codebook")
def _(v):
    return v.docs.groupBy("codebook").agg(F.bool_or(F.col("status") == "ready_for_search").alias("ready"), F.bool_or(F.col("status").isin("pdf_processing", "admin_processing")).alias("processing"))


_BUCKET = """CASE WHEN storage_url LIKE '%/storage/v1/object/%' THEN split_part(split_part(storage_url, '/storage/v1/object/', 2), '/', 2) END"""
_PATH = """CASE WHEN storage_url LIKE '%/storage/v1/object/%' THEN array_to_string(string_split(split_part(split_part(storage_url, '/storage/v1/object/', 2), '?', 1), '/')[3:], '/') END"""


@query("B25_storage_path", f"SELECT id, {_BUCKET} AS bucket, {_PATH} AS path FROM docs")
def _(v):
    bucket, path = admin.object_path(F.col("storage_url"))
    return v.docs.select("id", bucket.alias("bucket"), path.alias("path"))


_ORPHANS = f"SELECT bucket, path FROM storage_objects o WHERE path LIKE 'uploads/%' AND NOT EXISTS (SELECT 1 FROM docs WHERE {_BUCKET} = o.bucket AND {_PATH} = o.path)"
_ARTEFACTS = "SELECT bucket, path FROM storage_objects o WHERE path LIKE 'benchmarks/%/benchmark_qna.json' AND path NOT IN (SELECT 'benchmarks/' || user_id || '/' || id || '/benchmark_qna.json' FROM docs)"


@query("J24_orphan_objects", _ORPHANS)
def _(v):
    return admin.orphan_objects(v.storage_objects, v.docs).select("bucket", "path")


@query("F24_orphan_artefacts", _ARTEFACTS)
def _(v):
    return admin.orphan_artefacts(v.storage_objects, v.docs).select("bucket", "path")


@query("B24_orphan_summary", f"SELECT 'object' AS kind, path AS name, 1::BIGINT AS n FROM ({_ORPHANS}) UNION ALL SELECT 'artefact', path, 1 FROM ({_ARTEFACTS}) UNION ALL SELECT 'chunks', document_id::VARCHAR, count(*) FROM chunks WHERE document_id NOT IN (SELECT id FROM docs WHERE id % 5 <> 0) GROUP BY document_id")
def _(v):
    one = admin.orphan_objects(v.storage_objects, v.docs).select(F.lit("object").alias("kind"), F.col("path").alias("name"), F.lit(1).cast("long").alias("n"))
    two = admin.orphan_artefacts(v.storage_objects, v.docs).select(F.lit("artefact").alias("kind"), F.col("path").alias("name"), F.lit(1).cast("long").alias("n"))
    kept = v.docs.where("id % 5 <> 0").select(F.col("id").alias("document_id"))
    three = v.chunks.join(kept, "document_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("n")).select(F.lit("chunks").alias("kind"), F.col("document_id").cast("string").alias("name"), "n")
    return one.unionAll(two).unionAll(three)


_CATALOG = """SELECT e.codebook, d.id AS document_id, d.status, coalesce(c.n, 0) AS chunk_count, coalesce(t.n, 0) AS table_count, coalesce(m.n, 0) AS embedding_count, coalesce(d.status = 'ready_for_search' AND c.n > 0, false) AS ready, coalesce(d.status IN ('pdf_processing', 'admin_processing'), false) AS processing
    FROM (SELECT DISTINCT codebook FROM chunks) e LEFT JOIN (SELECT codebook, min(id) AS id, arg_min(status, id) AS status FROM docs WHERE is_shared_library GROUP BY codebook) d ON d.codebook = e.codebook
    LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id) c ON c.document_id = d.id LEFT JOIN (SELECT document_id, count(*) AS n FROM tables GROUP BY document_id) t ON t.document_id = d.id
    LEFT JOIN (SELECT vec_id // 4 AS document_id, count(*) AS n FROM embeddings GROUP BY vec_id // 4) m ON m.document_id = d.id"""


def _catalog(v):
    e = v.chunks.select("codebook").distinct()
    d = v.docs.where("is_shared_library").groupBy("codebook").agg(F.min("id").alias("document_id"), F.min_by("status", "id").alias("status"))
    n = lambda df, key, name: df.groupBy(key.alias("document_id")).agg(F.count("*").alias(name))
    j = e.join(d, "codebook", "left")
    for df, key, name in ((v.chunks, F.col("document_id"), "chunk_count"), (v.tables, F.col("document_id"), "table_count"), (v.embeddings, F.floor(F.col("vec_id") / 4), "embedding_count")):
        j = j.join(n(df, key, name), "document_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return j.select("codebook", "document_id", "status", "chunk_count", "table_count", "embedding_count", yes((F.col("status") == "ready_for_search") & (F.col("chunk_count") > 0)).alias("ready"), yes(F.col("status").isin("pdf_processing", "admin_processing")).alias("processing"))


@query("J27_library_counts", _CATALOG)
def _(v):
    return _catalog(v)


@query("B26_library_catalog", f"SELECT codebook, ready, processing, chunk_count + table_count AS items FROM ({_CATALOG})")
def _(v):
    return _catalog(v).select("codebook", "ready", "processing", (F.col("chunk_count") + F.col("table_count")).alias("items"))


@query("B27_document_tables", "SELECT document_id, id, table_number, title FROM tables ORDER BY document_id, table_number, id")
def _(v):
    return v.tables.select("document_id", "id", "table_number", "title").orderBy("document_id", "table_number", "id")


@query("B28_shared_documents", "SELECT id FROM docs WHERE is_shared_library AND codebook = 'src7' AND status = 'ready_for_search'")
def _(v):
    return v.docs.where("is_shared_library AND codebook = 'src7' AND status = 'ready_for_search'").select("id")


@query("B29_catalogue_filter", "SELECT DISTINCT codebook FROM chunks WHERE discipline = 'de' AND codebook LIKE 'src1%'")
def _(v):
    return v.chunks.where((F.col("discipline") == "de") & F.col("codebook").startswith("src1")).select("codebook").distinct()


@query("T5_queue_page", "SELECT id, priority FROM admin_queue ORDER BY priority DESC, created_at, id LIMIT 20 OFFSET 10")
def _(v):
    return v.admin_queue.orderBy(F.desc("priority"), "created_at", "id").offset(10).limit(20).select("id", "priority")


@query("T12_chunk_page", "SELECT document_id, page, id, clause_number FROM (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) - 1) // 5 AS page FROM chunks)")
def _(v):
    at = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "id")) - 1
    return v.chunks.select("document_id", F.floor(at / 5).alias("page"), "id", "clause_number")


@query("S4_paged_scan", "SELECT id, chunk_index FROM chunks ORDER BY chunk_index, id")
def _(v):
    return v.chunks.select("id", "chunk_index").orderBy("chunk_index", "id")


@query("S5_ordered_scan", "SELECT document_id, id, page_number FROM chunks ORDER BY document_id, page_number, id")
def _(v):
    return v.chunks.select("document_id", "id", "page_number").orderBy("document_id", F.asc_nulls_last("page_number"), "id")


@query("S6_table_scan", "SELECT id, table_number FROM tables ORDER BY table_number, id")
def _(v):
    return v.tables.select("id", "table_number").orderBy("table_number", "id")


@query("S7_fetch_in_order", "SELECT c.id, r.rank, c.heading FROM chunks c JOIN (SELECT id + 7 AS id, id AS rank FROM chunks WHERE id % 50 = 0) r USING (id) ORDER BY r.rank")
def _(v):
    wanted = v.chunks.where("id % 50 = 0").select((F.col("id") + 7).alias("id"), F.col("id").alias("rank"))
    return v.chunks.select("id", "heading").join(wanted, "id").select("id", "rank", "heading").orderBy("rank")


@query("F22_catalog_leftovers", "SELECT DISTINCT codebook FROM chunks WHERE codebook NOT IN (SELECT codebook FROM docs WHERE is_shared_library) AND codebook NOT IN ('src0', 'src1') AND codebook LIKE '%1%'")
def _(v):
    shared = v.docs.where("is_shared_library").select("codebook")
    return v.chunks.select("codebook").distinct().join(shared, "codebook", "left_anti").where(~F.col("codebook").isin("src0", "src1") & F.col("codebook").contains("1"))


@query("J10_not_exists", "SELECT c.id FROM companies c WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.company_id = c.id AND d.status = 'pdf_processing')")
def _(v):
    busy = v.docs.where("status = 'pdf_processing'").select(F.col("company_id").alias("id"))
    return v.companies.join(busy, "id", "left_anti").select("id")


@query("F23_user_options", "SELECT id FROM (SELECT * FROM profiles ORDER BY created_at DESC, id LIMIT 15) WHERE lower(email) LIKE '%u1%' OR lower(full_name) LIKE '%u1%'")
def _(v):
    # the limit comes before the search
    newest = v.profiles.orderBy(F.desc("created_at"), "id").limit(15)
    return newest.where(F.lower("email").contains("u1") | F.lower("full_name").contains("u1")).select("id")


@query("J11_seed_catalog", "SELECT r_name, t.slug FROM region CROSS JOIN (VALUES ('codes'), ('standards')) t(slug) WHERE r_regionkey < 3")
def _(v):
    kinds = v.spark.createDataFrame([("codes",), ("standards",)], "slug string")
    return v.region.where("r_regionkey < 3").select("r_name").crossJoin(F.broadcast(kinds))  # two fixed rows


@query("S24_seed_upsert", "SELECT slug, max(position) AS position FROM (SELECT r_name AS slug, 1 AS position FROM region UNION ALL SELECT * FROM (VALUES ('ASIA', 9), ('ANTARCTICA', 7)) t(slug, position)) GROUP BY slug")
def _(v):
    seed = v.spark.createDataFrame([("ASIA", 9), ("ANTARCTICA", 7)], "slug string, position int")
    both = v.region.select(F.col("r_name").alias("slug"), F.lit(1).alias("position")).unionAll(seed)
    return both.groupBy("slug").agg(F.max("position").alias("position"))


@query("J12_update_from", "SELECT d.id, coalesce(d.company_id, m.company_id) AS company_id FROM docs d LEFT JOIN (SELECT user_id, min(company_id) AS company_id FROM memberships WHERE status = 'active' GROUP BY user_id) m ON m.user_id = d.user_id")
def _(v):
    m = v.memberships.where("status = 'active'").groupBy("user_id").agg(F.min("company_id").alias("new"))
    return v.docs.join(m, "user_id", "left").select("id", F.coalesce("company_id", "new").alias("company_id"))


@query("J13_delete_using", "SELECT id FROM chunks WHERE document_id NOT IN (SELECT id FROM docs WHERE status = 'pdf_processing')")
def _(v):
    gone = v.docs.where("status = 'pdf_processing'").select(F.col("id").alias("document_id"))
    return v.chunks.join(gone, "document_id", "left_anti").select("id")


@query("S18_replace_cascade", "SELECT 'chunks' AS kind, count(*) AS left_ FROM chunks WHERE document_id <> 12 UNION ALL SELECT 'tables', count(*) FROM tables WHERE document_id <> 12 UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id // 4 <> 12")
def _(v):
    gone = v.docs.where("id = 12").select(F.col("id").alias("document_id"))
    left = lambda kind, df: df.join(gone, "document_id", "left_anti").agg(F.count("*").alias("left_")).select(F.lit(kind).alias("kind"), "left_")
    return left("chunks", v.chunks).unionAll(left("tables", v.tables)).unionAll(left("embeddings", v.embeddings.select(F.floor(F.col("vec_id") / 4).alias("document_id"))))


@query("S17_upsert", "SELECT chunk_id, arg_max(model, version) AS model FROM (SELECT vec_id AS chunk_id, 'a' AS model, 0 AS version FROM embeddings UNION ALL SELECT vec_id, 'b', 1 FROM embeddings WHERE vec_id % 3 = 0) GROUP BY chunk_id")
def _(v):
    from clausemill.sources.sinks import upserted

    old = v.embeddings.select(F.col("vec_id").alias("chunk_id"), F.lit("a").alias("model"))
    new = v.embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("chunk_id"), F.lit("b").alias("model"))
    return upserted(old, new, ["chunk_id"])


@query("U2_retry_merge", "SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY src, r, chunk_id))::INT AS rank FROM (SELECT query_id, chunk_id, min(src) AS src, arg_min(r, src) AS r FROM (SELECT id % 4 AS query_id, id AS chunk_id, 0 AS src, id AS r FROM chunks WHERE id % 6 = 0 UNION ALL SELECT id % 4, id, 1, 1000000000 - id FROM chunks WHERE id % 4 < 3) GROUP BY query_id, chunk_id)) WHERE rank <= 30")
def _(v):
    from clausemill.operators.fusion import merge_lists

    second = v.chunks.where("id % 6 = 0").select((F.col("id") % 4).alias("query_id"), F.col("id").alias("chunk_id"), F.col("id").alias("rank"))
    first = v.chunks.where("id % 4 < 3").select((F.col("id") % 4).alias("query_id"), F.col("id").alias("chunk_id"), (1000000000 - F.col("id")).alias("rank"))
    return merge_lists([second, first], 30)


@query("X12_cache_ttl", f"SELECT id FROM admin_queue WHERE TIMESTAMP '{AS_OF}' < created_at + INTERVAL 32 DAY")
def _(v):
    from clausemill.operators.accounts import at

    return v.admin_queue.where(at(AS_OF) < F.col("created_at") + F.expr("INTERVAL 32 DAYS")).select("id")


@query("V17_unique_constraints", "SELECT 'table_number' AS what, count(*) AS n FROM (SELECT document_id, table_number FROM tables GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'seat', count(*) FROM (SELECT company_id, user_id FROM memberships GROUP BY ALL HAVING count(*) > 1)")
def _(v):
    n = lambda what, df, *keys: df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n("table_number", v.tables, "document_id", "table_number").unionAll(n("seat", v.memberships, "company_id", "user_id"))


@query("V18_domain_constraints", "SELECT id, status FROM user_subscriptions WHERE status NOT IN ('active', 'trialing', 'past_due', 'canceled', 'cancelled')")
def _(v):
    return v.user_subscriptions.where(~F.col("status").isin("active", "trialing", "past_due", "canceled", "cancelled")).select("id", "status")


@query("C37_codebook_inheritance", "SELECT c.id, coalesce(nullif(trim(CASE WHEN c.id % 3 = 0 THEN ' ' ELSE c.codebook END), ''), d.codebook, 'AS3000') AS codebook FROM chunks c LEFT JOIN (SELECT * FROM docs WHERE id % 4 <> 0) d ON d.id = c.document_id")
def _(v):
    c = v.chunks.select("id", "document_id", F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("codebook")).alias("own"))
    d = v.docs.where("id % 4 <> 0").select(F.col("id").alias("document_id"), F.col("codebook").alias("inherited"))
    return c.join(d, "document_id", "left").select("id", F.coalesce(F.nullif(F.trim("own"), F.lit("")), "inherited", F.lit("AS3000")).alias("codebook"))


@query("X9_conversation_touch", "SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) AS messages FROM conversations GROUP BY conv_id")
def _(v):
    return v.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("messages"))


@query("U13_client_documents", "SELECT id FROM (SELECT DISTINCT id, created_at FROM docs WHERE (user_id = 3 OR company_id = 1) AND status <> 'failed' AND lower(filename) LIKE '%1%') ORDER BY created_at DESC, id")
def _(v):
    mine = v.docs.where("user_id = 3").unionAll(v.docs.where("company_id = 1")).dropDuplicates(["id"])
    return mine.where((F.col("status") != "failed") & F.lower("filename").contains("1")).orderBy(F.desc("created_at"), "id").select("id")
