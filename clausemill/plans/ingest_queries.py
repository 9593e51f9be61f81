"""Uploaded rows, page texts, splits, checks before ingest, and what is written out."""

from pyspark.sql import functions as F

from clausemill.functions import structure as st
from clausemill.functions.notes import with_notes
from clausemill.sources import exports, ingest

from .registry import query

_c = F.col
_ROWS = "(SELECT id AS ord, CASE WHEN k = 4 THEN '' ELSE number END AS clause_number, CASE WHEN k % 3 = 0 THEN '' ELSE replace(body, chr(10), ' ') END AS body, CASE k WHEN 1 THEN '[\"first\", \"\", \"second\"]' WHEN 2 THEN 'plain note' END AS notes, title AS heading, page FROM pieces)"


def _rows(v):
    notes = F.when(_c("k") == 1, '["first", "", "second"]').when(_c("k") == 2, "plain note")
    return v.pieces.select(_c("id").alias("ord"), F.when(_c("k") == 4, "").otherwise(_c("number")).alias("clause_number"), F.when(_c("k") % 3 == 0, "").otherwise(F.replace("body", F.lit("\n"), F.lit(" "))).alias("body"), notes.alias("notes"), _c("title").alias("heading"), "page")


@query("S1_clause_csv", f"SELECT ord AS chunk_index, concat(trim(body), CASE WHEN starts_with(notes, '[') THEN concat(chr(10), chr(10), 'NOTES:', chr(10), '- first', chr(10), '- second') WHEN notes IS NOT NULL THEN concat(chr(10), chr(10), 'NOTES:', chr(10), '- ', notes) ELSE '' END) AS text, clause_number, trim(heading) AS heading, TRY_CAST(CASE WHEN regexp_matches(trim(string_split(page, '-')[1]), '^[0-9]{{1,9}}$') THEN trim(string_split(page, '-')[1]) END AS INT) AS page_number, CASE WHEN clause_number = '' THEN '' ELSE 'AS3000:' || clause_number END AS record_id FROM {_ROWS} WHERE trim(body) <> '' OR notes IS NOT NULL OR clause_number <> ''")
def _(v):
    return ingest.clause_rows(_rows(v), "as3000")


@query("S2_json_chunks", "SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY id) - 1)::INT AS chunk_index, number AS clause_number, title AS text FROM pieces")
def _(v):
    chunk = F.to_json(F.array_sort(F.collect_list(F.struct("id", _c("number").alias("clause_number"), _c("title").alias("text")))))
    whole = v.pieces.groupBy("document_id").agg(chunk.alias("json"))
    each = whole.select("document_id", F.posexplode(F.from_json("json", "array<struct<clause_number:string,text:string>>")).alias("chunk_index", "c"))
    return each.select("document_id", "chunk_index", "c.clause_number", "c.text")




@query("S3_table_csv", "WITH t AS (SELECT id AS ord, (id - id % 16) / 16 AS g, concat('Table ', CAST((id - id % 16) / 16 AS BIGINT), '.', k % 3) AS canon, trim(title) AS title, trim(left(label, 4)) AS text, concat(k % 2) AS src FROM pieces), f AS (SELECT *, coalesce(text <> lag(text) OVER (PARTITION BY canon ORDER BY ord), true) AS fresh FROM t) SELECT canon AS table_number, arg_max(title, {'l': length(title), 'o': -ord}) AS title, string_agg(text, concat(chr(10), chr(10)) ORDER BY ord) FILTER (fresh) AS text, CASE WHEN count(DISTINCT src) = 1 THEN min(src) ELSE concat(arg_min(src, ord), '; ', CASE arg_min(src, ord) WHEN '0' THEN '1' ELSE '0' END) END AS source_clause_number FROM f GROUP BY canon")
def _(v):
    group = F.floor(_c("id") / 16).cast("string")
    number = F.concat(F.when(_c("id") % 2 == 0, "Table ").otherwise(""), group, F.lit("."), (_c("k") % 3).cast("string"))
    return ingest.table_rows(v.pieces.select(_c("id").alias("ord"), number.alias("table_number"), "title", F.substring("label", 1, 4).alias("text"), F.concat(F.lit("Clause "), (_c("k") % 2).cast("string")).alias("clause_reference")))


_PAGES = "(SELECT id AS document_id, (id * 7 % 700 + 1)::BIGINT AS pages FROM pieces)"


def _documents(v):
    return v.pieces.select(_c("id").alias("document_id"), (_c("id") * 7 % 700 + 1).alias("pages"))


@query("S21_page_splits", f"SELECT document_id, c AS chunk_index, c * size + 1 AS page_start, least(pages, (c + 1) * size) AS page_end, least(pages, (c + 1) * size) - c * size AS page_count FROM (SELECT document_id, pages, CASE WHEN pages > 100 THEN 93 ELSE pages END AS size, unnest(range(0, CASE WHEN pages > 100 THEN ceil(pages / 93)::BIGINT ELSE 1 END)) AS c FROM {_PAGES})")
def _(v):
    return ingest.splits(_documents(v))


@query("S22_split_estimate", f"SELECT document_id, n AS chunks, round(n * 0.056, 3) AS cost, round(n * 12.0, 1) AS seconds FROM (SELECT document_id, CASE WHEN pages > 100 THEN ceil(pages / 93)::BIGINT ELSE 1 END AS n FROM {_PAGES})")
def _(v):
    return ingest.split_estimate(_documents(v))


@query("S23_merged_chunks", f"SELECT document_id, count(*) AS things, sum(page)::BIGINT AS pages FROM (SELECT document_id, c * size + 1 + k AS page FROM (SELECT document_id, CASE WHEN pages > 100 THEN 93 ELSE pages END AS size, unnest(range(0, CASE WHEN pages > 100 THEN ceil(pages / 93)::BIGINT ELSE 1 END)) AS c FROM {_PAGES}), range(0, 2) r(k)) GROUP BY document_id")
def _(v):
    parts = ingest.splits(_documents(v)).select("document_id", "page_start", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"))
    return ingest.merged_chunks(parts).groupBy("document_id").agg(F.count("*").alias("things"), F.sum("page").cast("long").alias("pages"))


_PT = "(SELECT CAST((doc_id - doc_id % 15) / 15 AS BIGINT) AS document_id, doc_id % 15 + 1 AS page, CASE WHEN doc_id % 15 < doc_id % 4 * 5 THEN text ELSE ' ' END AS text FROM documents)"


def _page_texts(v):
    text = F.when(_c("doc_id") % 15 < _c("doc_id") % 4 * 5, _c("text")).otherwise(" ")
    return v.documents.select(F.floor(_c("doc_id") / 15).alias("document_id"), (_c("doc_id") % 15 + 1).alias("page"), text.alias("text"))


_STATS = f"SELECT document_id, count(*) AS sampled, sum(length(trim(text)))::BIGINT AS chars, round(avg(length(trim(text))), 6) AS avg_chars FROM {_PT} WHERE page <= 10 GROUP BY document_id"


def _stats(v):
    n = F.length(F.trim("text"))
    return _page_texts(v).where("page <= 10").groupBy("document_id").agg(F.count("*").alias("sampled"), F.sum(n).cast("long").alias("chars"), F.round(F.avg(n), 6).alias("avg_chars"))


@query("A30_text_layer", _STATS)
def _(v):
    return _stats(v)


@query("F18_scanned_gate", f"SELECT document_id, avg_chars > 100 AS accepted FROM ({_STATS})")
def _(v):
    return _stats(v).select("document_id", (_c("avg_chars") > 100).alias("accepted"))


@query("F19_preflight", f"SELECT document_id, CASE WHEN avg_chars < 25 THEN 'skip' ELSE 'remote' END AS route FROM ({_STATS})")
def _(v):
    return _stats(v).select("document_id", F.when(_c("avg_chars") < 25, "skip").otherwise("remote").alias("route"))


@query("S9_page_text", f"SELECT document_id, string_agg(trim(regexp_replace(text, '[ \\t]+', ' ', 'g')), chr(12) ORDER BY page) AS text FROM {_PT} GROUP BY document_id")
def _(v):
    pages = F.array_sort(F.collect_list(F.struct("page", F.trim(st.sanitized(_c("text"))).alias("x"))))
    return _page_texts(v).groupBy("document_id").agg(F.array_join(F.transform(pages, lambda p: p["x"]), "\f").alias("text"))


_ASKS = "(SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'd1' ELSE ' ' END AS document_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'AS3000' END AS codebook, CASE WHEN event_id % 7 = 0 THEN ' a ' ELSE event_type END AS question, event_id % 11 = 0 AS skip, CASE event_id % 3 WHEN 0 THEN 'insufficient_evidence' WHEN 1 THEN 'permitted' ELSE 'Error ' END AS conclusion, repeat('x', (event_id % 60)::INT) AS markdown FROM events)"
_OK = "trim(document_id) = '' AND trim(codebook) <> '' AND length(trim(question)) >= 3 AND NOT skip"


def _asks(v):
    n = _c("event_id")
    return v.events.select(n.alias("id"), F.when(n % 4 == 0, "d1").otherwise(" ").alias("document_id"), F.when(n % 5 == 0, "").otherwise("AS3000").alias("codebook"), F.when(n % 7 == 0, " a ").otherwise(_c("event_type")).alias("question"), (n % 11 == 0).alias("skip"), F.when(n % 3 == 0, "insufficient_evidence").when(n % 3 == 1, "permitted").otherwise("Error ").alias("conclusion"), F.repeat(F.lit("x"), (n % 60).cast("int")).alias("markdown"))


def _cacheable():
    return (F.trim("document_id") == "") & (F.trim("codebook") != "") & (F.length(F.trim("question")) >= 3) & ~_c("skip")


@query("F20_cacheable_asks", f"SELECT id FROM {_ASKS} WHERE {_OK}")
def _(v):
    return _asks(v).where(_cacheable()).select("id")


@query("F21_storable_answers", f"SELECT id FROM {_ASKS} WHERE {_OK} AND lower(trim(conclusion)) NOT IN ('insufficient_evidence', 'error') AND length(trim(markdown)) >= 40")
def _(v):
    return _asks(v).where(_cacheable() & ~F.lower(F.trim("conclusion")).isin("insufficient_evidence", "error") & (F.length(F.trim("markdown")) >= 40)).select("id")


@query("F26_degraded_rows", "SELECT document_id, sum(hits)::BIGINT AS unknown, count(*) AS lines, sum(hits) >= 5 AND sum(hits) / count(*) >= 0.02 AS degraded FROM (SELECT document_id, len(regexp_extract_all(CASE WHEN k < 3 THEN 'Unknown ' || title ELSE title END, '\\bUnknown\\b')) AS hits FROM pieces WHERE trim(title) <> '') GROUP BY document_id")
def _(v):
    text = F.when(_c("k") < 3, F.concat(F.lit("Unknown "), "title")).otherwise(_c("title"))
    t = v.pieces.where(F.trim("title") != "").select("document_id", F.regexp_count(text, F.lit(st.edged(r"\bUnknown\b"))).alias("hits"))
    total = F.sum("hits")
    return t.groupBy("document_id").agg(total.cast("long").alias("unknown"), F.count("*").alias("lines"), ((total >= 5) & (total / F.count("*") >= 0.02)).alias("degraded"))


@query("F29_verbatim_snippets", "SELECT id, instr(body, snippet) AS at FROM (SELECT id, body, CASE WHEN k % 2 = 0 THEN substring(body, 5, 20) ELSE title || '?' END AS snippet FROM pieces) WHERE instr(body, snippet) > 0")
def _(v):
    t = v.pieces.select("id", "body", F.when(_c("k") % 2 == 0, F.substring("body", 5, 20)).otherwise(F.concat("title", F.lit("?"))).alias("snippet"))
    return t.select("id", F.instr("body", _c("snippet")).cast("long").alias("at")).where("at > 0")


@query("C21_merged_notes", "SELECT document_id, count(*) AS notes FROM (SELECT DISTINCT document_id, lower(trim(label)) AS x FROM pieces WHERE NOT regexp_matches(trim(label), '(?i)^NOTES?:?$')) GROUP BY document_id")
def _(v):
    t = v.pieces.where(~F.trim("label").rlike("(?i)^NOTES?:?$")).select("document_id", F.lower(F.trim("label")).alias("x")).distinct()
    return t.groupBy("document_id").agg(F.count("*").alias("notes"))


@query("C3_family_fixes", "SELECT id, CASE family WHEN 'AS_NZS' THEN regexp_replace(x, '(?m)^\\*+\\s*', '', 'g') WHEN 'ISO' THEN regexp_replace(x, '(?m)^Clause\\s+', '', 'g') WHEN 'IEC' THEN regexp_replace(x, '(?m)^Clause\\s+', '', 'g') WHEN 'IEEE' THEN regexp_replace(x, '(?m)^Clause\\s+', '', 'g') WHEN 'ASTM' THEN regexp_replace(x, '(?m)^Section\\s+', '', 'g') WHEN 'API' THEN regexp_replace(x, '(?m)^Section\\s+', '', 'g') WHEN 'NFPA' THEN regexp_replace(x, '(?m)^Section\\s+', '', 'g') WHEN 'NBN' THEN regexp_replace(x, '(?m)^SECTION\\s+', 'Section ', 'g') ELSE x END AS value FROM (SELECT id, family, regexp_replace(concat(CASE id % 3 WHEN 0 THEN '* ' WHEN 1 THEN 'Clause ' ELSE 'Section ' END, number, chr(10), 'SECTION 4'), '(\\d)\\s*,\\s*(\\d)', '\\1.\\2', 'g') AS x FROM pieces)")
def _(v):
    head = F.when(_c("id") % 3 == 0, "* ").when(_c("id") % 3 == 1, "Clause ").otherwise("Section ")
    return v.pieces.select("id", st.family_fixes(F.concat(head, "number", F.lit("\nSECTION 4")), _c("family")).alias("value"))


# -- what is written out ------------------------------------------------------------------------------


@query("S11_normalized_text", "SELECT ord, concat('[CLAUSE]', chr(10), 'Number: ', clause_number, chr(10), 'Title: ', title, chr(10), CASE WHEN parent_clause_number IS NULL THEN '' ELSE concat('Parent: ', parent_clause_number, chr(10)) END, 'Level: ', level, chr(10), 'Pages: ', page_start, '-', page_end, chr(10), 'Confidence: high', chr(10), chr(10), 'Body:', chr(10), body) AS block FROM clauses")
def _(v):
    parent = F.when(_c("parent_clause_number").isNull(), "").otherwise(F.concat(F.lit("Parent: "), "parent_clause_number", F.lit("\n")))
    text = lambda c: _c(c).cast("string")
    return v.clauses.select("ord", F.concat(F.lit("[CLAUSE]\nNumber: "), "clause_number", F.lit("\nTitle: "), "title", F.lit("\n"), parent, F.lit("Level: "), text("level"), F.lit("\nPages: "), text("page_start"), F.lit("-"), text("page_end"), F.lit("\nConfidence: high\n\nBody:\n"), "body").alias("block"))


@query("S14_json_rows", "SELECT id, json_object('number', table_number, 'page', page_start)::VARCHAR AS json FROM tables WHERE title IS NULL UNION ALL SELECT id, json_object('number', table_number, 'page', page_start, 'sized', length(title))::VARCHAR FROM tables WHERE title IS NOT NULL")
def _(v):
    return v.tables.select("id", F.to_json(F.struct(_c("table_number").alias("number"), _c("page_start").alias("page"), F.length("title").alias("sized"))).alias("json"))


@query("S15_yaml_rows", "SELECT id, concat('  - table_number: \"', table_number, '\"', chr(10), '    page: ', page_start, chr(10), '    description: |', chr(10), '      ', table_number, ' (', coalesce(nullif(regexp_replace(title, '\\s', ' ', 'g'), ''), 'Untitled'), ') specifies technical requirements.') AS yaml FROM tables")
def _(v):
    title = F.coalesce(F.nullif(F.regexp_replace("title", r"\s", " "), F.lit("")), F.lit("Untitled"))
    return v.tables.select("id", F.concat(F.lit('  - table_number: "'), "table_number", F.lit('"\n    page: '), _c("page_start").cast("string"), F.lit("\n    description: |\n      "), "table_number", F.lit(" ("), title, F.lit(") specifies technical requirements.")).alias("yaml"))


@query("S16_library_export", "SELECT id, codebook || ':' || clause_number AS record_id, coalesce(json_extract_string(metadata, '$.k'), '') AS level, CASE WHEN json_extract_string(metadata, '$.is_table') = 'true' THEN 'table' ELSE 'clause' END AS kind FROM chunks")
def _(v):
    field = lambda n: F.get_json_object("metadata", n)
    return v.chunks.select("id", F.concat_ws(":", "codebook", "clause_number").alias("record_id"), F.coalesce(field("$.k"), F.lit("")).alias("level"), F.when(field("$.is_table") == "true", "table").otherwise("clause").alias("kind"))


_PARENT = "array_to_string(string_split(clause_number, '.')[1:len(string_split(clause_number, '.')) - 1], '.')"


@query("S12_clause_export", f"SELECT 'NCC_2022_VOL3:' || clause_number AS id, clause_number, title AS heading, body, CASE WHEN has_notes THEN concat('first', chr(10), 'second') ELSE '' END AS notes, '' AS exceptions, level, {_PARENT} AS parent_number, CASE WHEN {_PARENT} = '' THEN '' ELSE 'NCC_2022_VOL3:' || {_PARENT} END AS parent_id, CASE WHEN page_start = 0 OR page_end = 0 THEN '' WHEN page_start = page_end THEN page_start::VARCHAR ELSE concat(page_start, '-', page_end) END AS page, 'high' AS confidence, false AS appendix_flag, true AS embeddable, ord % 8 = 0 OR length(trim(body)) < 10 AS is_heading_only, false AS had_duplicate_merge, '[]' AS source_rows, 'NCC_2022_VOL3' AS codebook FROM clauses")
def _(v):
    notes = F.when(_c("has_notes"), F.array(F.lit("first"), F.lit("second")))
    return exports.clauses(v.clauses.withColumns({"notes": notes, "exceptions": F.lit(None).cast("array<string>"), "confidence": F.lit("high"), "has_body": _c("ord") % 8 != 0}), "NCC 2022 Vol3")


_BARE = "trim(regexp_replace(table_number, '^(?i)table\\s+', ''))"


@query("S13_table_export", f"WITH t AS (SELECT *, {_BARE} AS bare, CASE WHEN id % 4 = 0 THEN source_clause_number END AS pr, CASE WHEN id % 4 = 1 THEN '7.2' END AS pn, CASE WHEN id % 3 = 0 THEN 'Described.' END AS de FROM tables), c AS (SELECT *, coalesce(pn, pr, bare) AS cid, coalesce(pr, pn, bare) AS ref FROM t) SELECT 'Vol2' AS volume, string_split(bare, '.')[1] AS part_code, string_split(bare, '.')[1] AS section_code, table_number AS table_id, 'table' AS unit_type, coalesce(title, '') AS table_title, concat(coalesce(de, concat(table_number, ' (', coalesce(nullif(title, ''), 'Untitled'), ') contains technical specifications.')), CASE WHEN id % 5 = 0 THEN concat(chr(10), chr(10), 'Notes:', chr(10), 'n1', chr(10), 'n2') ELSE '' END) AS table_content, 1 AS content_part, 1 AS content_parts_total, '' AS called_in, 'Clause ' || ref AS clause_reference, 'NCC 2022 vol2' AS source, '' AS context, 1 AS clause_count, cid AS first_clause_id, cid AS last_clause_id, 'false' AS archived, '' AS state_territory, 'tables.json' AS source_file, 'NCC 2022' AS version FROM c")
def _(v):
    k = _c("id")
    some = {
        "parent_reference": F.when(k % 4 == 0, _c("source_clause_number")),
        "parent_number": F.when(k % 4 == 1, "7.2"),
        "description": F.when(k % 3 == 0, "Described."),
        "footer_notes": F.when(k % 5 == 0, F.array(F.lit("n1"), F.lit(" "), F.lit(" n2 "))),
    }
    return exports.tables(v.tables.withColumns(some), "NCC 2022 vol2", "NCC 2022")


@query("C20_footer_notes")
def _(v):
    below = F.element_at(F.array(*map(F.lit, ["NOTES:\n1. First note\ngoes on\n(a) Second", "EXCEPTIONS\n1) One case\n2) Another case", "NOTE - A single note.\nCOPYRIGHT\nnot this", "nothing below"])), (_c("id") % 4 + 1).cast("int"))
    page = F.concat_ws("\n", F.lit("TABLE 77.7\nNOTES\n1. Of another table"), F.concat(F.lit("Table "), F.regexp_replace("table_number", "Table ", "")), "text", below, F.lit("TABLE 88.8\nNOTES\n1. Of the next table"))
    return with_notes(v.tables, page, _c("table_number"), _c("title")).select("id", F.posexplode_outer("notes").alias("place", "note")).where("place IS NOT NULL")
