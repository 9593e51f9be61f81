"""Registry, overview, orphan and catalogue views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READY = "ready_for_search"
PENDING = ("pending_admin_review", "admin_processing", "pending")


def registry(docs: DataFrame, profiles: DataFrame, queue: DataFrame) -> DataFrame:
    """One row for each document with its owner, its last queue entry, copies and versions.

    Copies share name and size whoever owns them; versions share owner and name.
    """
    owner = profiles.select(F.col("id").alias("user_id"), F.col("email").alias("owner_email"), F.col("role").alias("owner_role"))
    last = queue.groupBy("document_id").agg(F.max_by(F.struct("status", "priority"), "id").alias("q"))
    last = last.select(F.col("document_id").alias("id"), F.col("q.status").alias("queue_status"), F.col("q.priority").alias("queue_priority"))
    size = F.coalesce("file_size", F.lit(0))
    copies = F.count("*").over(Window.partitionBy("filename", size))
    version = Window.partitionBy("user_id", "filename")
    place = F.row_number().over(version.orderBy(F.desc("created_at"), "id"))
    d = docs.withColumn("duplicate_key", F.concat_ws("::", "filename", size.cast("string"))).withColumn("duplicate_count", copies)
    d = d.withColumn("version_count", F.count("*").over(version)).withColumn("version_place", place)
    return d.join(owner, "user_id", "left").join(last, "id", "left").select(
        "id", "user_id", "filename", "status", "owner_email", "owner_role", "queue_status", "queue_priority", "duplicate_key", "duplicate_count", "version_count", "version_place"
    )


def registry_summary(docs: DataFrame) -> DataFrame:
    groups = docs.groupBy("filename", F.coalesce("file_size", F.lit(0)).alias("size")).agg(F.count("*").alias("n")).where("n > 1")
    copies = groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("copies"))
    ready = F.col("status") == READY
    whole = docs.agg(F.count("*").alias("total_documents"), F.count_distinct("user_id").alias("unique_users"), F.count_if(ready).alias("ready_documents"), F.count_if(~ready | F.col("status").isNull()).alias("pending_documents"))
    # two rows of counts
    return whole.crossJoin(copies).select("total_documents", "unique_users", "ready_documents", "pending_documents", "duplicate_groups", F.greatest(F.lit(0), F.col("copies") - F.col("duplicate_groups")).alias("total_duplicates"))


def user_document_stats(docs: DataFrame) -> DataFrame:
    return docs.where("user_id IS NOT NULL").groupBy("user_id").agg(
        F.count("*").alias("document_count"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count"),
        F.max(F.coalesce("updated_at", "created_at")).alias("last_activity"),
        F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"),
    )


def overview(auth_users: DataFrame, profiles: DataFrame, docs: DataFrame) -> DataFrame:
    """Users of the sign-in table and users that only own documents."""
    stats = user_document_stats(docs)
    a = auth_users.select(F.col("id").alias("user_id"), F.col("email").alias("auth_email"), F.col("meta_name"), F.col("created_at").alias("auth_created"), "last_sign_in_at", F.lit(True).alias("known"))
    p = profiles.select(F.col("id").alias("user_id"), "email", "full_name", "role", F.col("created_at").alias("profile_created"))
    j = a.join(stats, "user_id", "full_outer").join(p, "user_id", "left")
    known = F.coalesce("known", F.lit(False))
    email = F.when(known, F.coalesce("auth_email", "email")).otherwise(F.coalesce("email", F.concat(F.lit("user:"), F.substring(F.col("user_id").cast("string"), 1, 8), F.lit("@unknown"))))
    name = F.coalesce("full_name", F.when(known, F.coalesce("meta_name", F.split_part("auth_email", F.lit("@"), F.lit(1)))).otherwise(F.concat(F.lit("User "), F.substring(F.col("user_id").cast("string"), 1, 8))))
    return j.select(
        "user_id",
        email.alias("email"),
        name.alias("full_name"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("document_count", F.lit(0)).alias("document_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("last_activity", "last_sign_in_at", "auth_created").alias("last_activity"),
        F.coalesce("statuses", F.lit("")).alias("statuses"),
    )


def users_with_documents(profiles: DataFrame, docs: DataFrame) -> DataFrame:
    stats = docs.groupBy("user_id").agg(F.count("*").alias("document_count"), F.sum(F.coalesce("file_size", F.lit(0))).alias("total_size"))
    j = profiles.select(F.col("id").alias("user_id"), "email", "full_name", F.lit(True).alias("known")).join(stats, "user_id", "full_outer")
    short = F.substring(F.col("user_id").cast("string"), 1, 8)
    return j.select(
        "user_id",
        F.when(F.col("known"), F.coalesce("email", F.lit(""))).otherwise(F.concat(F.lit("User ID: "), short, F.lit("..."))).alias("email"),
        F.when(F.col("known"), F.coalesce("full_name", F.lit(""))).otherwise(F.concat(F.lit("Document Uploader ("), short, F.lit(")"))).alias("full_name"),
        F.coalesce("document_count", F.lit(0)).alias("document_count"),
        F.coalesce("total_size", F.lit(0)).alias("total_size"),
    )


def object_path(url: Column) -> tuple[Column, Column]:
    """Bucket and path of a storage URL, null for other URLs."""
    rest = F.split_part(F.split_part(F.trim(url), F.lit("/storage/v1/object/"), F.lit(2)), F.lit("?"), F.lit(1))
    parts = F.filter(F.split(rest, "/"), lambda x: x != "")
    signed = F.coalesce(F.get(parts, 0).isin("public", "sign", "authenticated"), F.lit(False)) & (F.size(parts) >= 3)
    ok = F.contains(url, F.lit("/storage/v1/object/")) & (F.size(parts) >= 2)
    bucket = F.when(ok, F.when(signed, F.get(parts, 1)).otherwise(F.get(parts, 0)))
    path = F.when(ok, F.when(signed, F.array_join(F.slice(parts, 3, 1 << 20), "/")).otherwise(F.array_join(F.slice(parts, 2, 1 << 20), "/")))
    return bucket, path


def orphan_objects(objects: DataFrame, docs: DataFrame) -> DataFrame:
    """Uploads that no document refers to."""
    bucket, path = object_path(F.col("storage_url"))
    used = docs.select(bucket.alias("bucket"), path.alias("path")).where("path IS NOT NULL").distinct()
    return objects.where(F.col("path").startswith("uploads/")).join(used, ["bucket", "path"], "left_anti")


def orphan_artefacts(objects: DataFrame, docs: DataFrame) -> DataFrame:
    """Benchmark files of which the document is gone."""
    expected = docs.select(F.concat_ws("/", F.lit("benchmarks"), "user_id", "id", F.lit("benchmark_qna.json")).alias("path"))
    return objects.where(F.col("path").startswith("benchmarks/") & F.col("path").endswith("/benchmark_qna.json")).join(expected, "path", "left_anti")
