"""Who may see what: visibility predicates and document scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READY = "ready_for_search"
STAFF = ("admin", "engineer", "inspector")


def active_companies(memberships: DataFrame, user_id) -> DataFrame:
    """company_id of the companies in which the user has an active seat."""
    return memberships.where((F.col("user_id") == user_id) & (F.col("status") == "active")).select("company_id").distinct()


def visible_documents(docs: DataFrame, memberships: DataFrame, user_id) -> DataFrame:
    """Ready documents that the user owns, that are shared, or that belong to a company of theirs."""
    seats = active_companies(memberships, user_id).withColumn("seat", F.lit(True))
    own = (F.col("user_id") == user_id) | F.coalesce("is_shared_library", F.lit(False)) | F.coalesce("seat", F.lit(False))
    return docs.where(F.col("status") == READY).join(seats, "company_id", "left").where(own).select(*docs.columns)


def visible_chunks(chunks: DataFrame, docs: DataFrame, memberships: DataFrame, user_id, document_ids: Sequence | None = None, codebook: str | None = None) -> DataFrame:
    """Chunks of visible documents; a parameter that is None doesn't restrict."""
    out = chunks
    if document_ids is not None:
        out = out.where(F.col("document_id").isin(list(document_ids)))
    if codebook is not None:
        out = out.where(F.col("codebook") == codebook)
    ids = visible_documents(docs, memberships, user_id).select(F.col("id").alias("document_id"))
    return out.join(ids, "document_id", "left_semi")


def visible_embeddings(embeddings: DataFrame, chunks: DataFrame, docs: DataFrame, memberships: DataFrame, user_id=None, document_id=None, codebook=None, jurisdiction=None) -> DataFrame:
    """Embeddings with their chunks; here ownership is that of the embedding's row."""
    d = docs.where(F.col("status") == READY).select(F.col("id").alias("document_id"), "is_shared_library", "company_id")
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "codebook", "jurisdiction", "clause_number")
    out = embeddings.select("chunk_id", "embedding", F.col("user_id").alias("owner")).join(c, "chunk_id").join(d, "document_id")
    if user_id is not None:
        seats = active_companies(memberships, user_id).withColumn("seat", F.lit(True))
        out = out.join(seats, "company_id", "left").where((F.col("owner") == user_id) | F.coalesce("is_shared_library", F.lit(False)) | F.coalesce("seat", F.lit(False)))
    if document_id is not None:
        out = out.where(F.col("document_id") == document_id)
    if codebook is not None:
        out = out.where(F.col("codebook") == codebook)
    if jurisdiction is not None:
        out = out.where(F.col("jurisdiction").isNull() | F.col("jurisdiction").isin(jurisdiction, "BOTH"))
    return out.select("chunk_id", "document_id", "codebook", "jurisdiction", "clause_number", "embedding")


def document_scope(docs: DataFrame, memberships: DataFrame, user_id, codebook: str | None = None) -> DataFrame:
    """document_id, source, position: own, then company, then shared ready documents, each id once."""
    ready = docs.where(F.col("status") == READY)
    if codebook is not None:
        ready = ready.where(F.col("codebook") == codebook)
    parts = [
        ready.where(F.col("user_id") == user_id).select("id", F.lit(0).alias("source")),
        ready.join(active_companies(memberships, user_id), "company_id", "left_semi").select("id", F.lit(1).alias("source")),
        ready.where("is_shared_library").select("id", F.lit(2).alias("source")),
    ]
    first = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("id").agg(F.min("source").alias("source"))
    # the ids that one user sees, ordered: a small set
    return first.select(F.col("id").alias("document_id"), "source", F.row_number().over(Window.orderBy("source", "id")).alias("position"))


def single_document(docs: DataFrame, memberships: DataFrame, user_id, document_id, codebook: str | None = None) -> DataFrame:
    """The document if it may be searched; another codebook only warns."""
    one = visible_documents(docs.where(F.col("id") == document_id), memberships, user_id)
    warns = F.lit(False) if codebook is None else ~F.col("codebook").eqNullSafe(codebook)
    return one.select(F.col("id").alias("document_id"), "codebook", warns.alias("codebook_mismatch"))


def by_prefix(chunks: DataFrame, docs: DataFrame, user_id, codebook=None, jurisdiction=None, prefix=None, limit: int = 10) -> DataFrame:
    """The oldest search helper: prefix of the clause number, constant score, order of the chunks."""
    out = chunks.where(F.col("user_id") == user_id).join(docs.where(F.col("status") == READY).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    if codebook is not None:
        out = out.where(F.col("codebook") == codebook)
    if jurisdiction is not None:
        out = out.where(F.col("jurisdiction").isNull() | F.col("jurisdiction").isin(jurisdiction, "BOTH"))
    if prefix is not None:
        out = out.where(F.col("clause_number").startswith(prefix))
    return out.orderBy("chunk_index").limit(limit).select("id", "document_id", "clause_number", "jurisdiction", "codebook", "page_number", F.lit(1.0).alias("similarity_score"))


class SecureView:
    """Row policies of one user over tables of the library."""

    def __init__(self, user_id, memberships: DataFrame, profiles: DataFrame):
        self.user_id, self.memberships, self.profiles = user_id, memberships, profiles

    def own(self, df: DataFrame, column: str = "user_id") -> DataFrame:
        return df.where(F.col(column) == self.user_id)

    def staff(self, df: DataFrame) -> DataFrame:
        """All rows for staff, none for others."""
        role = self.profiles.where((F.col("id") == self.user_id) & F.col("role").isin(*STAFF)).select(F.lit(1).alias("one")).limit(1)
        return df.withColumn("one", F.lit(1)).join(F.broadcast(role), "one", "left_semi").drop("one")

    def documents(self, docs: DataFrame) -> DataFrame:
        """Own, shared, or of a company with a seat; staff see all."""
        seats = active_companies(self.memberships, self.user_id).withColumn("seat", F.lit(True))
        mine = (F.col("user_id") == self.user_id) | F.coalesce("is_shared_library", F.lit(False)) | F.coalesce("seat", F.lit(False))
        return docs.join(seats, "company_id", "left").where(mine).select(*docs.columns).unionAll(self.staff(docs)).distinct()


def is_table_like(clause: Column, heading: Column, metadata: Column) -> Column:
    both = F.lower(F.concat_ws(" ", F.trim(F.coalesce(clause, F.lit(""))), F.trim(F.coalesce(heading, F.lit("")))))
    return both.contains("table") | F.coalesce(F.get_json_object(metadata, "$.is_table") == "true", F.lit(False))


def without(ranked: DataFrame, excluded: DataFrame, limit: int) -> DataFrame:
    """ranked(query_id, chunk_id, rank) without the excluded (query_id, chunk_id), ranked anew, cut."""
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    left = ranked.join(excluded, ["query_id", "chunk_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def staff_only(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("role").isin(*STAFF))
