"""Tables of a clause library derived from the star-schema test tables.

Each view is one SELECT that Spark and DuckDB read alike: arithmetic on keys, substrings and splits, no clock.
AS_OF is the fixed present of every expiry rule.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"
#: Questions of a batch, the feature of the retrieval queries: each question of a batch meets all chunks.
QUESTIONS = 8

VIEWS: dict[str, str] = {
    "chunks": """
        SELECT doc_id AS id, CAST((doc_id - doc_id % 4) / 4 AS BIGINT) AS document_id, doc_id % 10 AS user_id, doc_id AS chunk_index, text,
               split_part(substring(text, 1, 60), chr(10), 1) AS heading,
               concat(CAST(doc_id % 9 + 1 AS STRING), '.', CAST(doc_id % 7 + 1 AS STRING), '.', CAST(doc_id % 5 + 1 AS STRING)) AS clause_number,
               CAST(n_chars % 40 + 1 AS INT) AS page_number,
               CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NSW' WHEN 2 THEN 'BOTH' ELSE 'VIC' END AS jurisdiction,
               source AS codebook, lang AS discipline,
               CASE WHEN doc_id % 23 = 0 THEN '{"is_table": true}' ELSE '{"k": 1}' END AS metadata
        FROM documents""",
    "docs": """
        SELECT k AS id, k % 10 AS user_id, CASE WHEN k % 3 = 0 THEN k % 25 END AS company_id, k % 7 = 0 AS is_shared_library,
               CASE WHEN k % 11 = 0 THEN 'pdf_processing' WHEN k % 13 = 0 THEN 'pending_admin_review' ELSE 'ready_for_search' END AS status,
               concat('file', CAST(k % 17 AS STRING), '.pdf') AS filename, (k % 17) * 1000 + k % 2 AS file_size,
               concat('src', CAST(k % 20 AS STRING)) AS codebook,
               CASE k % 4 WHEN 0 THEN concat('https://h.example/storage/v1/object/public/documents/uploads/', CAST(k AS STRING), '/f.pdf?x=1')
                          WHEN 1 THEN concat('https://h.example/storage/v1/object/sign/library/uploads/', CAST(k AS STRING), '.pdf')
                          WHEN 2 THEN concat('s3://gateway/', CAST(k AS STRING)) END AS storage_url,
               CAST(DATE '2024-01-01' + CAST(k % 30 AS INT) AS TIMESTAMP) AS created_at,
               CASE WHEN k % 5 <> 0 THEN CAST(DATE '2024-01-02' + CAST(k % 28 AS INT) AS TIMESTAMP) END AS updated_at,
               n AS chunk_count, n AS refined_chunk_count
        FROM (SELECT CAST((doc_id - doc_id % 4) / 4 AS BIGINT) AS k, count(*) AS n FROM documents GROUP BY CAST((doc_id - doc_id % 4) / 4 AS BIGINT)) t""",
    "companies": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'pending' WHEN 2 THEN 'active' ELSE 'inactive' END AS status,
               CAST(n_nationkey + 1 AS BIGINT) AS owner_user_id, CAST(3 + n_nationkey * 20 AS BIGINT) AS max_seats, concat('JOIN', CAST(n_nationkey AS STRING)) AS join_code,
               CAST(n_nationkey % 2 AS BIGINT) AS partner_id, CASE WHEN n_nationkey = 1 THEN 'sub1' END AS subscription_id,
               CAST(DATE '2024-01-10' + CAST(n_nationkey * 4 AS INT) AS TIMESTAMP) AS created_at
        FROM nation""",
    "memberships": """
        SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS company_id, c_custkey AS user_id,
               CASE WHEN c_custkey % 5 = 0 THEN 'removed' ELSE 'active' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 'owner' ELSE 'member' END AS role,
               CASE WHEN c_custkey % 4 <> 1 THEN CAST(DATE '2024-01-01' + CAST(c_custkey % 25 AS INT) AS TIMESTAMP) END AS joined_at
        FROM customer""",
    "profiles": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 6 <> 5 THEN concat('u', CAST(c_custkey AS STRING), '@mail.example') END AS email,
               CASE WHEN c_custkey % 4 <> 3 THEN c_name END AS full_name,
               CASE c_custkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'engineer' ELSE 'user' END AS role,
               CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS BIGINT) END AS company_id,
               CASE c_custkey % 3 WHEN 0 THEN 'professional' ELSE 'sole' END AS account_type,
               CASE c_custkey % 4 WHEN 0 THEN 'passcode' WHEN 1 THEN 'stripe' WHEN 2 THEN 'company' END AS subscription_source,
               CASE WHEN c_custkey % 4 = 0 THEN CAST(DATE '2024-01-20' + CAST(c_custkey % 25 AS INT) AS TIMESTAMP) END AS access_expires_at,
               CASE WHEN c_custkey % 7 <> 6 THEN 5 - c_custkey % 7 END AS documents_remaining,
               CAST(DATE '2023-12-01' + CAST(c_custkey % 400 AS INT) AS TIMESTAMP) AS created_at
        FROM customer""",
    "auth_users": """
        SELECT c_custkey AS id, concat('u', CAST(c_custkey AS STRING), '@mail.example') AS email,
               CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN concat('Meta ', c_name) END AS meta_name,
               CAST(DATE '2023-11-01' + CAST(c_custkey % 400 AS INT) AS TIMESTAMP) AS created_at,
               CASE WHEN c_custkey % 2 = 0 THEN CAST(DATE '2024-01-15' + CAST(c_custkey % 10 AS INT) AS TIMESTAMP) END AS last_sign_in_at
        FROM customer""",
    "user_subscriptions": """
        SELECT o_orderkey AS id, o_custkey % 25 AS user_id, CASE WHEN o_orderkey % 5 <> 4 THEN concat('sub', CAST(o_orderkey AS STRING)) END AS stripe_subscription_id,
               CASE o_orderkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'past_due' WHEN 4 THEN 'suspended' ELSE 'active' END AS status,
               CASE o_orderkey % 3 WHEN 0 THEN 'professional' WHEN 1 THEN 'individual_monthly' ELSE 'starter_pack' END AS plan_name,
               CAST(o_orderkey % 50 AS DOUBLE) AS plan_price, 'AUD' AS currency, concat('cus', CAST(o_custkey % 25 AS STRING)) AS stripe_customer_id,
               CASE WHEN o_orderkey % 7 <> 0 THEN CAST(DATE '2024-01-01' + CAST(o_orderkey % 20 AS INT) AS TIMESTAMP) END AS current_period_start,
               CASE WHEN o_orderkey % 7 <> 1 THEN CAST(DATE '2024-01-15' + CAST(o_orderkey % 40 AS INT) AS TIMESTAMP) END AS current_period_end,
               o_orderkey % 9 = 0 AS cancel_at_period_end,
               CASE WHEN o_orderkey % 2 = 0 THEN 5 + o_orderkey % 4 END AS max_documents, CASE WHEN o_orderkey % 2 = 1 THEN 50 END AS max_questions,
               o_orderkey % 8 AS documents_uploaded, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 60 END AS questions_asked,
               CAST(DATE '2023-12-01' + CAST(o_orderkey % 60 AS INT) AS TIMESTAMP) AS created_at,
               CASE WHEN o_orderkey % 4 <> 2 THEN CAST(DATE '2024-01-03' + CAST(o_orderkey % 20 AS INT) AS TIMESTAMP) END AS updated_at
        FROM orders WHERE o_orderkey % 4 < 2""",
    "subscriptions": """
        SELECT concat('sub', CAST(o_orderkey AS STRING)) AS id, o_custkey % 25 AS user_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'canceled' WHEN 2 THEN 'trialing' ELSE 'past_due' END AS status,
               CASE WHEN o_orderkey % 6 <> 5 THEN concat('price', CAST(o_orderkey % 30 AS STRING)) END AS price_id,
               CAST(DATE '2024-01-05' + CAST(o_orderkey % 20 AS INT) AS TIMESTAMP) AS current_period_start,
               CAST(DATE '2024-02-05' + CAST(o_orderkey % 20 AS INT) AS TIMESTAMP) AS current_period_end,
               CASE WHEN o_orderkey % 3 = 0 THEN true END AS cancel_at_period_end,
               CASE WHEN o_orderkey % 5 = 0 THEN 20 END AS max_documents, CASE WHEN o_orderkey % 5 = 1 THEN 100 END AS max_questions,
               CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 11 END AS documents_uploaded, CAST(NULL AS BIGINT) AS questions_asked,
               CAST(DATE '2023-12-10' + CAST(o_orderkey % 45 AS INT) AS TIMESTAMP) AS created
        FROM orders WHERE o_orderkey % 4 BETWEEN 1 AND 2""",
    "prices": """
        SELECT concat('price', CAST(p_partkey AS STRING)) AS id, concat('prod', CAST(p_partkey % 5 AS STRING)) AS product_id,
               CAST(p_size * 100 AS BIGINT) AS unit_amount, CASE p_partkey % 2 WHEN 0 THEN 'month' ELSE 'year' END AS billing_interval
        FROM part""",
    "products": """
        SELECT concat('prod', CAST(r_regionkey AS STRING)) AS id, r_name AS name, concat('Plan ', r_name) AS description FROM region""",
    "customers": """
        SELECT c_custkey AS id, concat('stripe', CAST(c_custkey AS STRING)) AS stripe_customer_id FROM customer""",
    "codes": """
        SELECT p_partkey AS id, concat('CODE', CAST(p_partkey AS STRING)) AS code, p_partkey % 6 <> 5 AS is_active, CAST(1 + p_partkey % 4 AS BIGINT) AS max_uses,
               CASE WHEN p_partkey % 5 = 0 THEN CAST(DATE '2024-01-20' AS TIMESTAMP) WHEN p_partkey % 5 = 1 THEN CAST(DATE '2024-03-01' AS TIMESTAMP) END AS valid_until,
               CASE WHEN p_partkey % 7 = 0 THEN CAST(DATE '2024-01-12' AS TIMESTAMP) END AS valid_from, CAST(1 + p_partkey % 3 AS INT) AS duration_months, CAST(7 * (1 + p_partkey % 4) AS INT) AS duration_days
        FROM part""",
    "redemption_attempts": """
        SELECT event_id AS id, concat(CASE WHEN event_id % 3 = 0 THEN ' code' ELSE 'CODE' END, CAST(event_id % 45 AS STRING), ' ') AS code, user_id, ts
        FROM events""",
    "redemptions": """
        SELECT event_id AS id, event_id % 40 AS code_id, user_id % 25 AS user_id, event_id % 4 <> 3 AS is_active, event_id % 9 = 0 AS expired,
               CAST(DATE '2024-01-22' + CAST(event_id % 20 AS INT) AS TIMESTAMP) AS access_granted_until FROM events""",
    "job_events": """
        SELECT event_id AS seq, CAST((event_id - event_id % 8) / 8 AS BIGINT) AS job_id, CAST((event_id - event_id % 8) / 8 % 50 AS BIGINT) AS document_id, CAST((event_id - event_id % 8) / 8 % 40 AS BIGINT) AS user_id, ts,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS event
        FROM events""",
    "admin_queue": """
        SELECT event_id AS id, event_id % 60 AS document_id, event_type AS status, CAST(event_id % 5 AS INT) AS priority, ts AS created_at FROM events""",
    "storage_objects": """
        SELECT 'documents' AS bucket, concat('uploads/', CAST(k AS STRING), '/f.pdf') AS path, k * 10 AS size FROM (SELECT DISTINCT doc_id % 80 AS k FROM documents) t
        UNION ALL
        SELECT 'documents' AS bucket, concat('benchmarks/', CAST(k % 10 AS STRING), '/', CAST(k AS STRING), CASE WHEN k % 3 = 0 THEN '/other.json' ELSE '/benchmark_qna.json' END) AS path, k AS size
        FROM (SELECT DISTINCT doc_id % 80 AS k FROM documents) t""",
    "tables": """
        SELECT doc_id AS id, CAST((doc_id - doc_id % 4) / 4 AS BIGINT) AS document_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'Table ' ELSE '' END, CAST(doc_id % 9 + 1 AS STRING), '.', CAST(doc_id % 4 + 1 AS STRING)) AS table_number,
               CASE WHEN doc_id % 4 <> 1 THEN substring(text, 1, CAST(10 + doc_id % 30 AS INT)) END AS title,
               CASE WHEN doc_id % 5 <> 2 THEN concat(CAST(doc_id % 9 + 1 AS STRING), '.', CAST(doc_id % 7 + 1 AS STRING)) END AS source_clause_number,
               text, doc_id AS ord, CAST(doc_id % 12 + 1 AS INT) AS page_start, CAST(doc_id % 12 + 1 + doc_id % 3 AS INT) AS page_end, CAST(doc_id % 7 AS DOUBLE) * 10 AS y0
        FROM documents""",
    "queries": f"""
        SELECT item_id AS query_id, concat_ws(' ', split_part(text, ' ', 1), split_part(text, ' ', 2), split_part(text, ' ', 3)) AS rephrased_query,
               split_part(text, ' ', 4) AS term1, split_part(text, ' ', 5) AS term2,
               concat(CAST(item_id % 9 + 1 AS STRING), CASE WHEN item_id % 2 = 0 THEN concat('.', CAST(item_id % 7 + 1 AS STRING)) ELSE '' END) AS heading1, split_part(text, ' ', 1) AS heading2
        FROM benchmark WHERE item_id < {QUESTIONS}""",
    "clauses": """
        SELECT doc_id AS ord, CAST((doc_id - doc_id % 4) / 4 AS BIGINT) AS document_id, concat('c', CAST(doc_id AS STRING)) AS clause_id,
               CASE WHEN doc_id % 11 = 0 THEN CAST(doc_id % 9 + 1 AS STRING) WHEN doc_id % 4 = 0 THEN concat(CAST(doc_id % 9 + 1 AS STRING), '.', CAST(doc_id % 7 + 1 AS STRING))
                    ELSE concat(CAST(doc_id % 9 + 1 AS STRING), '.', CAST(doc_id % 7 + 1 AS STRING), '.', CAST(doc_id % 5 + 1 AS STRING)) END AS clause_number,
               CASE WHEN doc_id % 13 = 0 THEN 'Scope .......... 12' WHEN doc_id % 17 = 0 THEN 'TABLE 3 COPYRIGHT' ELSE substring(text, 1, 40) END AS title,
               CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS body,
               CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 11 = 0 THEN 1 ELSE 3 END AS level,
               CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 30 END AS INT) AS page_start, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 30 END + doc_id % 2 AS INT) AS page_end,
               CASE WHEN doc_id % 5 = 0 THEN concat('c', CAST(doc_id % 97 AS STRING)) WHEN doc_id % 19 = 0 THEN 'gone' END AS parent_clause_id,
               CASE doc_id % 5 WHEN 0 THEN CAST(doc_id % 9 + 1 AS STRING) WHEN 1 THEN '77.7' END AS parent_clause_number, doc_id % 10 < 6 AS has_parent, doc_id % 7 = 0 AS has_notes
        FROM documents""",
    "items": """
        SELECT event_id AS ord, CAST((event_id - event_id % 30) / 30 AS BIGINT) AS project, concat('r', CAST(event_id % 40 AS STRING)) AS requirement_id,
               CASE event_id % 9 WHEN 0 THEN 'Fire Detection & Alarm' WHEN 1 THEN 'Occupant Warning' WHEN 2 THEN 'Emergency Lighting' WHEN 3 THEN 'Smoke control' WHEN 4 THEN 'Rooftop solar PV' WHEN 5 THEN 'General Electrical Design'
                    WHEN 6 THEN 'Maximum demand and supply' WHEN 7 THEN 'Acoustic treatment rooms' ELSE 'Earthing and bonding' END AS domain,
               CASE event_type WHEN 'signup' THEN 'compliant' WHEN 'view' THEN 'Conditional' WHEN 'click' THEN 'needs_code' WHEN 'purchase' THEN 'conflict' ELSE 'other' END AS status,
               concat(CASE event_id % 4 WHEN 0 THEN 'Show on drawings and schedules ' WHEN 1 THEN 'Check clearance, to be confirmed ' WHEN 2 THEN 'Coordinate with the builder ' ELSE 'Subject to review ' END, CAST(event_id % 13 AS STRING)) AS summary,
               CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('e', CAST(event_id % 7 AS STRING)) ELSE concat('e', CAST(event_id % 5 AS STRING), '; e', CAST(event_id % 7 AS STRING), ';e1 ; ') END AS evidence,
               CAST(event_id % 5 AS INT) AS section, concat(CASE event_id % 5 WHEN 0 THEN 'AS 1670.4 warning' WHEN 1 THEN 'AS3000' WHEN 2 THEN ' NCC2022 ' WHEN 3 THEN 'AS3000' ELSE 'AS 2293' END) AS label
        FROM events""",
    "pieces": """
        SELECT doc_id AS id, CAST((doc_id - doc_id % 40) / 40 AS BIGINT) AS document_id, CAST(doc_id % 9 AS INT) AS k, CASE doc_id % 9 WHEN 0 THEN 'AS_NZS' WHEN 1 THEN 'ISO' WHEN 2 THEN 'IEC' WHEN 3 THEN 'ASTM' WHEN 4 THEN 'NFPA' WHEN 5 THEN 'API' WHEN 6 THEN 'IEEE' WHEN 7 THEN 'NBN' ELSE 'NCC' END AS family,
               CASE doc_id % 8 WHEN 0 THEN concat('2. ', CAST(doc_id % 6 AS STRING), '. 2') WHEN 1 THEN concat('*2, ', CAST(doc_id % 7 AS STRING), '.1') WHEN 2 THEN concat('4.', CAST(doc_id % 5 AS STRING)) WHEN 3 THEN 'Appendix A'
                    WHEN 4 THEN '(a)' WHEN 5 THEN 'iv' WHEN 6 THEN concat('C', CAST(doc_id % 4 AS STRING), 'P', CAST(doc_id % 5 AS STRING)) ELSE CAST(doc_id % 30 AS STRING) END AS number,
               CASE doc_id % 9 WHEN 0 THEN 'TABLE 4.1' WHEN 1 THEN concat('Table C', CAST(doc_id % 12 AS STRING)) WHEN 2 THEN 'D12(A)' WHEN 3 THEN 'J.l' WHEN 4 THEN 'Table H7D2_8' WHEN 5 THEN '' WHEN 6 THEN 'Appendix B.2'
                    WHEN 7 THEN concat('table 3.', CAST(doc_id % 4 AS STRING), ' (continued)') ELSE concat('3.6.', CAST(doc_id % 3 AS STRING)) END AS table_number,
               CASE doc_id % 6 WHEN 0 THEN '12-14' WHEN 1 THEN CAST(doc_id % 40 AS STRING) WHEN 2 THEN 'x' WHEN 3 THEN '-3' WHEN 4 THEN NULL ELSE ' 9 - 10' END AS page,
               CASE doc_id % 7 WHEN 0 THEN 'ncc 2022 volume three' WHEN 1 THEN 'AS3000' WHEN 2 THEN 'NBN_SDU guide' WHEN 3 THEN 'NFPA 70' WHEN 4 THEN 'NCC2022_VOL1!' WHEN 5 THEN 'IEC 60364' ELSE 'Housing Provisions 2019' END AS label,
               concat(CASE doc_id % 4 WHEN 0 THEN 'The ' WHEN 1 THEN 'General ' WHEN 2 THEN 'Scope ' ELSE 'Where ' END, substring(replace(text, chr(10), ' '), 1, CAST(3 + doc_id % 120 AS INT))) AS title,
               concat(substring(text, 1, CAST(40 + doc_id % 200 AS INT)), CASE doc_id % 5 WHEN 0 THEN ' COPYRIGHT ** end' WHEN 1 THEN ' unless approved by NSW' WHEN 2 THEN concat(' see Table ', CAST(doc_id % 9 AS STRING), '.1') WHEN 3 THEN ' Scope ..... 12' ELSE ' Figure 3' END) AS body
        FROM documents""",
    "heads": """
        SELECT id, family, CASE id % 11 WHEN 0 THEN concat(number, ' ', title) WHEN 1 THEN concat('3.2.', CAST(id % 5 AS STRING), ' General requirements') WHEN 2 THEN concat('Section ', CAST(id % 4 AS STRING), '.2 - MDF room ', CAST(id % 30 AS STRING))
                    WHEN 3 THEN 'Annex B (normative) Test methods' WHEN 4 THEN concat('C', CAST(id % 4 AS STRING), 'P1 Health impacts') WHEN 5 THEN concat('Requirement R-', CAST(id % 20 AS STRING), ' Pit location setback') WHEN 6 THEN 'H1-4.2.12 Footing and slab'
                    WHEN 7 THEN concat('2. 4. ', CAST(id % 6 AS STRING), ' Protective devices') WHEN 8 THEN 'Part 3 Conduits' WHEN 9 THEN 'NSW 4.2.8 Vapour barriers' ELSE 'Section B - Structure' END AS line FROM (
        SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN 'AS_NZS' WHEN 1 THEN 'ISO' WHEN 2 THEN 'IEC' WHEN 3 THEN 'ASTM' WHEN 4 THEN 'NFPA' WHEN 5 THEN 'API' WHEN 6 THEN 'IEEE' WHEN 7 THEN 'NBN' ELSE 'NCC' END AS family,
               concat(CAST(doc_id % 9 AS STRING), '.', CAST(doc_id % 4 AS STRING)) AS number, concat('The ', substring(replace(text, chr(10), ' '), 1, CAST(3 + doc_id % 150 AS INT))) AS title FROM documents) t""",
    "grids": """
        SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN concat('MODAL_P', CAST(doc_id % 12 AS STRING), '_1') WHEN 1 THEN '' ELSE concat(CAST(doc_id % 9 + 1 AS STRING), '.', CAST(doc_id % 4 AS STRING)) END AS table_number,
               CAST((doc_id - doc_id % 8) / 8 AS INT) AS page, CASE doc_id % 7 WHEN 0 THEN 'COPYRIGHT' ELSE concat(split_part(text, ' ', 1), '|', split_part(text, ' ', 2), '|', CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'c' END) END AS header,
               CASE WHEN doc_id % 7 IN (0, 3) THEN '' WHEN doc_id % 11 = 0 THEN 'same x|same x|1;other y|other y|2;third z|third z|3;fourth w|fourth w|4' WHEN doc_id % 13 = 0 THEN '1.4.16 term|a;1.4.17 word|b;1.4.18 name|c'
                    ELSE concat(split_part(text, ' ', 3), '|', CAST(doc_id % 10 AS STRING), '|', CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE split_part(text, ' ', 4) END, ';x|', CAST(doc_id % 3 AS STRING), '|', split_part(text, ' ', 5)) END AS data
        FROM documents""",
    "boxes": """
        SELECT doc_id AS id, CAST((doc_id - doc_id % 25) / 25 AS INT) AS page, CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'element' END AS kind, CAST(doc_id * 37 % 500 AS DOUBLE) AS x0, CAST(doc_id * 53 % 700 AS DOUBLE) AS y0,
               CAST(doc_id * 37 % 500 + 20 + doc_id % 200 AS DOUBLE) AS x1, CAST(doc_id * 53 % 700 + 10 + doc_id % 90 AS DOUBLE) AS y1, CASE WHEN doc_id % 3 = 0 THEN concat('Table ', CAST(doc_id % 9 AS STRING), '.1 Sizes') ELSE split_part(text, ' ', 1) END AS text
        FROM documents""",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Views:
    """The test tables and the derived views of one folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            used = {t: getattr(self, t) for t in TABLES if f" {t} " in VIEWS[name] + " " or VIEWS[name].rstrip().endswith(f" {t}") or f" {t})" in VIEWS[name] or f" {t}\n" in VIEWS[name]}
            text = VIEWS[name].replace("{", "{{").replace("}", "}}")
            for t in used:
                text = _table_reference(text, t)
            return self.spark.sql(text, **used)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def _table_reference(text: str, table: str) -> str:
    import re

    return re.sub(rf"\bFROM {table}\b", f"FROM {{{table}}}", text)


def with_views(sql: str) -> str:
    """DuckDB's form of a query over the views: those it names come first."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    body = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    if not used:
        return sql
    s = sql.strip()
    return f"WITH {body}, {s[5:]}" if s[:5].upper() == "WITH " else f"WITH {body} {s}"
