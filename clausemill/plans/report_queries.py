"""Answers and design reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausemill.functions import reports as r
from clausemill.operators import reports as rp

from .registry import query

_c = F.col


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _unique(x: str) -> str:
    """Distinct values of a list in their order."""
    return f"list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN list_position({x}, {x}[i]) = i THEN {x}[i] END), lambda v: v IS NOT NULL)"


_IDS = "list_filter(list_transform(string_split(evidence, ';'), lambda x: trim(x)), lambda x: x <> '')"
_S0 = "lower(trim(status))"
_STATUS = f"(CASE WHEN {_S0} = 'compliant' THEN 'applies' WHEN {_S0} = 'non_compliant' THEN 'conflict' WHEN {_S0} = 'not_assessed' THEN 'conditional' WHEN {_S0} IN ('conflict', 'applies', 'conditional', 'needs_code', 'not_applicable') THEN {_S0} ELSE 'conditional' END)"
_TOK = f"list_filter(list_distinct(string_split(trim(regexp_replace(lower(domain), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) > 2 AND NOT list_contains({_list(r.STOP_WORDS)}, w))"
_BOTH = _TOK.replace("lower(domain)", "lower(concat(domain, ' ', label))")
_AS4 = "contains(regexp_replace(lower(label), '[^a-z0-9]+', '', 'g'), '16704')"
_TOPIC = "(CASE WHEN len({t}) = 0 THEN 'general' WHEN {a} AND (NOT list_has_any({t}, {d}) OR list_has_any({t}, {x})) OR list_has_any({t}, {w}) THEN 'ewis_warning' ".format(t=_BOTH, a=_AS4, d=_list(r.DETECTION_ONLY), x=_list(r.WARNING_WORDS), w=_list(r.WARNING_FIRST)) + " ".join(f"WHEN list_has_any({_BOTH}, {_list(words)}) THEN '{k}'" for k, words in r.TOPICS.items()) + f" ELSE array_to_string(list_sort({_BOTH})[1:5], ' ') END)"
_RANK = "CASE status " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in r.STATUS_RANK.items()) + " ELSE 0 END"
_M = f"""t AS (SELECT project, ord, domain, {_STATUS} AS status, summary, label, {_unique(_IDS)} AS ids, {_TOPIC} AS topic FROM items),
    g AS (SELECT project, topic, min(ord) AS first, arg_max(status, {{'r': {_RANK}, 'o': -ord}}) AS status, flatten(list(ids ORDER BY ord)) AS all_ids, arg_max(summary, {{'r': {_RANK}, 'n': len(ids), 'l': length(summary), 'o': -ord}}) AS summary, list(trim(label) ORDER BY ord) AS all_labels FROM t GROUP BY project, topic),
    m AS (SELECT project, topic, first, status, ({_unique('all_ids')})[1:12] AS ids, summary, ({_unique('all_labels')})[1:8] AS labels FROM g)"""
_GROUP = "coalesce(" + ", ".join(f"CASE WHEN list_contains({_list(g)}, topic) THEN '{g[0]}' END" for g in r.SUPERSEDED) + ", topic)"
_KEPT = f"k AS (SELECT * FROM m x WHERE status <> 'needs_code' OR NOT EXISTS (SELECT 1 FROM m y WHERE y.project = x.project AND y.status IN ('applies', 'conditional', 'conflict') AND len(y.ids) > 0 AND {_GROUP.replace('topic', 'y.topic')} = {_GROUP.replace('topic', 'x.topic')}))"
_ORD = "o AS (SELECT k.*, row_number() OVER (PARTITION BY k.project ORDER BY CASE WHEN topic = 'ewis_warning' AND a.anchor IS NOT NULL THEN a.anchor ELSE first END, CASE WHEN topic = 'ewis_warning' AND a.anchor IS NOT NULL THEN 1 ELSE 0 END)::INT AS place FROM k LEFT JOIN (SELECT project, first AS anchor FROM k WHERE topic = 'fire_detection') a ON a.project = k.project)"


@query("U9_clean_list", f"SELECT ord, array_to_string(({_unique(_IDS)})[1:2], ',') AS ids FROM items")
def _(v):
    return v.items.select("ord", F.array_join(r.cleaned(F.split("evidence", ";"), 2), ",").alias("ids"))


@query("G14_topics", f"SELECT ord, {_TOPIC} AS topic FROM items")
def _(v):
    return v.items.select("ord", r.topic(_c("domain"), _c("label")).alias("topic"))


@query("U7_token_overlap", f"SELECT ord, len(list_intersect({_TOK}, ['smoke', 'solar', 'fire', 'bonding', 'lighting'])) AS n FROM items")
def _(v):
    return v.items.select("ord", F.size(F.array_intersect(r.domain_tokens(_c("domain")), F.array(*map(F.lit, ["smoke", "solar", "fire", "bonding", "lighting"])))).cast("long").alias("n"))


@query("G13_status", f"SELECT ord, CASE WHEN {_STATUS} = 'applies' AND evidence = '' THEN 'conditional' ELSE {_STATUS} END AS status FROM items")
def _(v):
    s = r.status(_c("status"))
    return v.items.select("ord", F.when((s == "applies") & (_c("evidence") == ""), "conditional").otherwise(s).alias("status"))


@query("G15_weights", f"SELECT ord, ({_RANK.replace('status', _STATUS)})::INT AS rank, len({_unique(_IDS)}) AS evidence, length(summary) AS size FROM items")
def _(v):
    t = rp.with_topics(v.items)
    return t.select("ord", r.status_rank(_c("status")).alias("rank"), F.size("ids").cast("long").alias("evidence"), F.length("summary").cast("long").alias("size"))


@query("G12_uncertain", f"SELECT ord, len(list_filter({_list(r.UNCERTAIN)}, lambda m: contains(lower(summary), m))) > 0 AS value FROM items")
def _(v):
    return v.items.select("ord", r.uncertain(_c("summary")).alias("value"))


def _score(k: str, x: str = "summary") -> str:
    return f"len(list_filter({_list(r.SCOPE_HINTS[k])}, lambda h: contains(lower({x}), h)))"


def _scope_sql(x: str) -> str:
    most = "greatest(" + ", ".join(_score(k, x) for k in r.SCOPE_HINTS) + ")"
    return f"CASE WHEN {most} = 0 THEN 'design_checks' " + " ".join(f"WHEN {_score(k, x)} = {most} THEN '{k}'" for k in r.SCOPE_HINTS) + " END"


@query("G9_scope_class", f"SELECT ord, {_scope_sql('summary')} AS scope FROM items")
def _(v):
    return v.items.select("ord", r.scope_of(_c("summary")).alias("scope"))


_TEXTS = "(SELECT project AS id, string_agg(CASE ord % 6 WHEN 0 THEN 'Drawings and schedules:' WHEN 3 THEN 'Coordination:' ELSE '- ' || summary END, chr(10) ORDER BY ord) AS text FROM items GROUP BY project)"
_HEAD = "CASE WHEN line = 'Drawings and schedules:' THEN 'deliverables' WHEN line = 'Coordination:' THEN 'coordination' END"
_SL = f"l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM {_TEXTS}), a AS (SELECT *, {_HEAD} AS head, coalesce(last_value({_HEAD} IGNORE NULLS) OVER (PARTITION BY id ORDER BY i), 'design_checks') AS above FROM l), b AS (SELECT id, i, CASE WHEN above = 'design_checks' THEN {_scope_sql('line')} ELSE above END AS scope, substring(line, 3, 240) AS item FROM a WHERE head IS NULL), s AS (SELECT id, scope, list(item ORDER BY i) AS x FROM b GROUP BY id, scope)"


def _texts(v):
    line = F.when(_c("ord") % 6 == 0, "Drawings and schedules:").when(_c("ord") % 6 == 3, "Coordination:").otherwise(F.concat(F.lit("- "), "summary"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("x")))), lambda s: s["x"]), "\n")
    return v.items.groupBy(_c("project").alias("id")).agg(whole.alias("text"))


@query("G10_scope_from_text", f"WITH {_SL} SELECT id, scope, array_to_string(({_unique('x')})[1:8], '|') AS lines FROM s")
def _(v):
    return rp.scope_lines(_texts(v)).select("id", "scope", F.array_join("lines", "|").alias("lines"))


@query("G11_flat_scope", f"WITH {_SL} SELECT id, unnest(list_transform(({_unique('x')})[1:8], lambda y: concat(CASE scope " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in r.SCOPES.items()) + " END, ': ', y))) AS action FROM s")
def _(v):
    names = F.create_map(*[F.lit(x) for kv in r.SCOPES.items() for x in kv])
    return rp.scope_lines(_texts(v)).select("id", F.explode("lines").alias("line"), names[_c("scope")].alias("n")).select("id", F.concat_ws(": ", "n", "line").alias("action"))


@query("A28_merged_items", f"WITH {_M} SELECT project, topic, first, status, array_to_string(ids, ',') AS ids, summary, array_to_string(labels, ',') AS labels FROM m")
def _(v):
    return rp.merged(v.items).withColumns({"ids": F.array_join("ids", ","), "labels": F.array_join("labels", ",")})


@query("W13_first_appearance", f"WITH {_M} SELECT project, topic, row_number() OVER (PARTITION BY project ORDER BY first)::INT AS place FROM m")
def _(v):
    return rp.merged(v.items).select("project", "topic", F.row_number().over(Window.partitionBy("project").orderBy("first")).alias("place"))


@query("U11_superseded", f"WITH {_M}, {_KEPT} SELECT project, topic, status FROM k")
def _(v):
    return rp.without_superseded(rp.merged(v.items)).select("project", "topic", "status")


@query("G18_special_row", f"WITH {_M}, {_KEPT}, {_ORD} SELECT project, topic, place FROM o")
def _(v):
    return rp.ordered(rp.without_superseded(rp.merged(v.items)), "fire_detection", "ewis_warning").select("project", "topic", "place")


def _final(v):
    return rp.ordered(rp.without_superseded(rp.merged(v.items)), "fire_detection", "ewis_warning")


_REPORT = "concat('# Design planning report', chr(10), chr(10), string_agg(concat('- **', topic, '** (', status, '): ', summary), chr(10) ORDER BY place))"


@query("G20_report_markdown", f"WITH {_M}, {_KEPT}, {_ORD} SELECT project, {_REPORT} AS markdown FROM o GROUP BY project")
def _(v):
    return rp.report(_final(v))


@query("G21_final_report", f"WITH {_M}, {_KEPT}, {_ORD} SELECT o.project, count(*) AS topics, count(*) FILTER (status = 'needs_code') AS open, length({_REPORT})::BIGINT AS size FROM o GROUP BY o.project")
def _(v):
    t = _final(v)
    n = t.groupBy("project").agg(F.count("*").alias("topics"), F.count_if(_c("status") == "needs_code").alias("open"))
    return n.join(rp.report(t), "project").select("project", "topics", "open", F.length("markdown").cast("long").alias("size"))


_W = "w AS (SELECT project, CASE WHEN ord % 2 = 0 THEN '' ELSE 'written ' || (ord % 5) END AS text, topic FROM t WHERE ord % 7 <> 0)"


@query("J35_aligned_items", f"WITH {_M}, {_W} SELECT w.project, w.topic, coalesce(m.status, 'conditional') AS status, coalesce(nullif(trim(text), ''), m.summary) AS summary, true AS written FROM w LEFT JOIN m USING (project, topic) UNION ALL SELECT project, topic, status, summary, false FROM m WHERE status <> 'needs_code' AND NOT EXISTS (SELECT 1 FROM w WHERE w.project = m.project AND w.topic = m.topic)")
def _(v):
    w = v.items.where("ord % 7 <> 0").select("project", "ord", "domain", "label", F.when(_c("ord") % 2 == 0, "").otherwise(F.concat(F.lit("written "), (_c("ord") % 5).cast("string"))).alias("summary"))
    return rp.aligned(w, rp.merged(v.items))


@query("G19_written_topics", f"WITH {_M}, {_W} SELECT project, count(DISTINCT topic) AS topics FROM w GROUP BY project")
def _(v):
    return v.items.where("ord % 7 <> 0").groupBy("project").agg(F.countDistinct(r.topic(_c("domain"), _c("label"))).alias("topics"))


@query("G17_collected_sources", "SELECT project, id, label FROM (SELECT project, trim(x) AS id, label, row_number() OVER (PARTITION BY project, trim(x) ORDER BY ord, i) AS n FROM (SELECT project, ord, label, unnest(string_split(evidence, ';')) AS x, unnest(range(len(string_split(evidence, ';')))) AS i FROM items) WHERE trim(x) <> '') WHERE n = 1")
def _(v):
    each = v.items.select("project", "ord", "label", F.posexplode(F.split("evidence", ";")).alias("i", "x")).withColumn("id", F.trim("x")).where("id <> ''")
    return each.groupBy("project", "id").agg(F.min_by("label", F.struct("ord", "i")).alias("label"))


@query("G23_section_label", f"SELECT project, CASE WHEN len(u) = 0 THEN 'Selected codes' WHEN len(u) <= 4 THEN array_to_string(u, ' · ') ELSE concat(array_to_string(u[1:3], ' · '), ' + ', len(u) - 3, ' more') END AS label FROM (SELECT project, {_unique('x')} AS u FROM (SELECT project, list(CASE WHEN ord % 7 = 0 THEN 'X' || (ord % 3) ELSE trim(label) END ORDER BY ord) AS x FROM items GROUP BY project))")
def _(v):
    label = F.when(_c("ord") % 7 == 0, F.concat(F.lit("X"), (_c("ord") % 3).cast("string"))).otherwise(_c("label"))
    lists = v.items.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", label.alias("x")))), lambda s: s["x"]).alias("x"))
    return lists.select("project", r.section_label(_c("x")).alias("label"))


@query("G22_citation", "SELECT id, concat(concat_ws(' — ', codebook, nullif(trim(clause_number), ''), CASE WHEN trim(heading) <> '' AND lower(trim(heading)) <> lower(trim(clause_number)) THEN trim(heading) END), ', p. ', page_number) AS value FROM chunks")
def _(v):
    return v.chunks.select("id", r.citation(_c("codebook"), _c("clause_number"), _c("heading"), _c("page_number")).alias("value"))


@query("G2_citation_lines", "SELECT ord, CASE WHEN claim = '' AND ref = '' THEN NULL WHEN claim = '' THEN '- **' || coalesce(nullif(ref, ''), 'Clause') || '**' ELSE '- **' || coalesce(nullif(ref, ''), 'Clause') || '** - ' || claim END AS line FROM (SELECT ord, CASE WHEN ord % 4 = 0 THEN '' ELSE trim(summary) END AS claim, trim(string_split(evidence, ';')[1]) AS ref FROM items)")
def _(v):
    return v.items.select("ord", r.citation_line(F.when(_c("ord") % 4 == 0, "").otherwise(_c("summary")), F.split("evidence", ";")[0]).alias("line"))


_REFS = "list(trim(x) ORDER BY src, ord, i) AS x FROM (SELECT project, 0 AS src, ord, unnest(string_split(evidence, ';')) AS x, unnest(range(len(string_split(evidence, ';')))) AS i FROM items UNION ALL SELECT project, 1, ord, label, 0 FROM items UNION ALL SELECT project, 2, ord, requirement_id, 0 FROM items WHERE ord % 30 < 3) WHERE trim(x) <> '' GROUP BY project"


def _refs(v):
    cited = v.items.select("project", F.lit(0).alias("src"), "ord", F.posexplode(F.split("evidence", ";")).alias("i", "x"))
    more = v.items.select("project", F.lit(1).alias("src"), "ord", F.lit(0).alias("i"), _c("label").alias("x"))
    rest = v.items.where("ord % 30 < 3").select("project", F.lit(2).alias("src"), "ord", F.lit(0).alias("i"), _c("requirement_id").alias("x"))
    all_ = cited.unionAll(more).unionAll(rest)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("src", "ord", "i", "x"))), lambda s: s["x"])
    return all_.groupBy("project").agg(r.cleaned(lists, 1_000_000).alias("refs"))


for _name in ("U10_reference_union", "G3_sources_index"):
    _out = "array_to_string({u}, ',')" if _name[0] == "U" else "concat('answer', chr(10), chr(10), '**Sources / citations**', chr(10), chr(10), array_to_string({u}, chr(10)))"

    @query(_name, f"SELECT project, {_out.format(u=_unique('x'))} AS refs FROM (SELECT project, {_REFS})")
    def _(v, index=_name[0] == "G"):
        refs = F.concat(F.lit("answer\n\n**Sources / citations**\n\n"), F.array_join("refs", "\n")) if index else F.array_join("refs", ",")
        return _refs(v).select("project", refs.alias("refs"))


_MD = "concat('**Conditions**', chr(10), chr(10), CASE WHEN ord % 3 = 0 THEN '- None' ELSE summary END, chr(10), '**Other**', chr(10), summary)"


@query("G5_empty_sections", f"SELECT ord, trim(regexp_replace(regexp_replace({_MD}, '(?i)\\*\\*(Conditions|Exceptions|Required Actions)\\*\\*\\s*\\n+\\s*[-•]?\\s*None\\s*(\\n|$)', '', 'g'), '\\n\\s*[-•]\\s*None\\s*\\n', chr(10), 'g')) AS value FROM items")
def _(v):
    md = F.concat(F.lit("**Conditions**\n\n"), F.when(_c("ord") % 3 == 0, "- None").otherwise(_c("summary")), F.lit("\n**Other**\n"), "summary")
    return v.items.select("ord", r.without_empty_sections(md).alias("value"))


def _bullets_sql(title: str, x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN '' ELSE concat(chr(10), chr(10), '**{title}**', chr(10), chr(10), array_to_string(list_transform({x}, lambda y: '- ' || y), chr(10))) END"


_CONC = "CASE ord % 4 WHEN 0 THEN 'permitted' WHEN 1 THEN 'not_permitted' WHEN 2 THEN 'depends' ELSE 'insufficient_evidence' END"
_OUT = "CASE c " + " ".join(f"WHEN '{k}' THEN concat('**Outcome:** {t}', chr(10), chr(10))" for k, t in r.OUTCOMES.items()) + " ELSE '' END"
_ANS = f"concat(CASE WHEN c = 'insufficient_evidence' THEN concat('**Insufficient evidence in the supplied clauses**', chr(10), chr(10), summary) ELSE concat('**Practitioner summary**', chr(10), chr(10), {_OUT}, summary, {_bullets_sql('What the cited clauses require', 'ids')}, {_bullets_sql('Required actions or sequencing', 'acts')}) END, CASE WHEN len(ids) = 0 THEN '' ELSE concat(chr(10), chr(10), '**Sources / citations**', chr(10), chr(10), array_to_string(ids, chr(10))) END)"
_ANSWERS = f"SELECT ord, project, {_ANS} AS markdown FROM (SELECT ord, project, summary, {_CONC} AS c, {_unique(_IDS)} AS ids, CASE WHEN ord % 5 = 0 THEN [] ELSE [domain] END AS acts FROM items)"


def _answers(v):
    k = _c("ord") % 4
    conclusion = F.when(k == 0, "permitted").when(k == 1, "not_permitted").when(k == 2, "depends").otherwise("insufficient_evidence")
    ids = r.cleaned(F.split("evidence", ";"), 1_000_000)
    acts = F.when(_c("ord") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("domain"))
    return v.items.select("ord", "project", r.answer(conclusion, _c("summary"), ids, acts, ids).alias("markdown"))


@query("G1_answer_markdown", f"SELECT ord, markdown FROM ({_ANSWERS})")
def _(v):
    return _answers(v).select("ord", "markdown")


@query("G4_candidates", f"SELECT project, string_agg(concat('**Candidate ', chr(64 + n::INT), '**', chr(10), chr(10), markdown), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY n) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ord) AS n FROM ({_ANSWERS})) WHERE n <= 4 GROUP BY project")
def _(v):
    t = _answers(v).withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("ord"))).where("n <= 4")
    card = F.concat(F.lit("**Candidate "), F.char(_c("n") + 64), F.lit("**\n\n"), "markdown")
    return t.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", card.alias("c")))), lambda s: s["c"]), "\n\n---\n\n").alias("markdown"))


@query("G6_parcel_merge", f"SELECT project, array_to_string({_unique('x')}, ',') AS cited, coalesce(conclusion, 'depends') AS conclusion, 'medium' AS confidence FROM (SELECT project, flatten(list({_IDS} ORDER BY ord)) AS x, max(CASE WHEN ord % 97 = 0 THEN 'permitted' END) AS conclusion FROM items GROUP BY project)")
def _(v):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", r.cleaned(F.split("evidence", ";"), 1_000_000).alias("x")))), lambda s: s["x"])
    t = v.items.groupBy("project").agg(F.array_distinct(F.flatten(ids)).alias("x"), F.max(F.when(_c("ord") % 97 == 0, "permitted")).alias("c"))
    return t.select("project", F.array_join("x", ",").alias("cited"), F.coalesce("c", F.lit("depends")).alias("conclusion"), F.lit("medium").alias("confidence"))


@query("G7_gaps", "SELECT project, string_agg(trim(summary), '|' ORDER BY ord) AS gaps FROM items WHERE ord % 4 = 3 GROUP BY project")
def _(v):
    t = v.items.where("ord % 4 = 3").groupBy("project").agg(F.array_sort(F.collect_list(F.struct("ord", F.trim("summary").alias("x")))).alias("g"))
    return t.select("project", F.array_join(F.transform("g", lambda s: s["x"]), "|").alias("gaps"))


@query("G8_recommended_codes", "SELECT project, code FROM (SELECT project, code, row_number() OVER (PARTITION BY project ORDER BY first) AS n FROM (SELECT project, upper(trim(label)) AS code, min(ord) AS first FROM items WHERE upper(trim(label)) NOT IN (SELECT upper(codebook) FROM docs) AND ord % 30 < 20 GROUP BY ALL)) WHERE n <= 3")
def _(v):
    t = v.items.where("ord % 30 < 20").select("project", F.upper(F.trim("label")).alias("code"), "ord").groupBy("project", "code").agg(F.min("ord").alias("first"))
    t = t.join(v.docs.select(F.upper("codebook").alias("code")).distinct(), "code", "left_anti")
    return t.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("first"))).where("n <= 3").select("project", "code")


@query("G16_evidence_compaction", "SELECT project, id, substring(text, 1, 400) AS text FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY label, k) AS total FROM (SELECT project, label, ord AS id, repeat(summary, 20) AS text, row_number() OVER (PARTITION BY project, label ORDER BY ord) AS k FROM items) WHERE k <= 3) WHERE total <= 8")
def _(v):
    k = F.row_number().over(Window.partitionBy("project", "label").orderBy("ord"))
    t = v.items.withColumn("k", k).where("k <= 3").withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("label", "k"))).where("n <= 8")
    return t.select("project", _c("ord").alias("id"), F.substring(F.repeat("summary", 20), 1, 400).alias("text"))


_REQ = "(SELECT ord AS id, CASE WHEN ord % 50 = 0 THEN [] ELSE list_filter([trim(label), concat('src-', ord % 30)], lambda x: x <> '') END AS sources FROM items)"
_ROUTED = f"q AS (SELECT id, CASE WHEN len(sources) = 0 THEN NULL ELSE list_transform(sources, lambda s: regexp_replace(upper(s), '[^A-Z0-9]', '', 'g')) END AS codes FROM {_REQ}), n AS (SELECT DISTINCT id, unnest(codes) AS code FROM q WHERE codes IS NOT NULL), rt AS (SELECT n.id, d.id AS document_id FROM n JOIN docs d ON regexp_replace(upper(d.codebook), '[^A-Z0-9]', '', 'g') = code UNION ALL SELECT q.id, d.id FROM q, docs d WHERE codes IS NULL)"


def _requirements(v):
    named = F.array("label", F.concat(F.lit("src-"), (_c("ord") % 30).cast("string")))
    return v.items.select(_c("ord").alias("id"), F.when(_c("ord") % 50 == 0, F.array().cast("array<string>")).otherwise(named).alias("sources"))


@query("J34_routing", f"WITH {_ROUTED} SELECT id, document_id FROM rt")
def _(v):
    return rp.routed(_requirements(v), v.docs.select(_c("id").alias("document_id"), "codebook"))


@query("A29_scope_estimate", f"WITH {_ROUTED}, c AS (SELECT count(*) AS requirements, sum(greatest(1, coalesce(n, 0)))::BIGINT AS calls FROM q LEFT JOIN (SELECT id, count(*) AS n FROM rt GROUP BY id) USING (id)) SELECT *, CASE WHEN calls > 72 THEN 'block' WHEN calls > 40 THEN 'warn' ELSE 'ok' END AS level FROM c")
def _(v):
    return rp.scope_estimate(_requirements(v), v.docs.select(_c("id").alias("document_id"), "codebook"))


@query("F28_discipline", "SELECT id, CASE lower(trim(string_split(x, '/')[1])) WHEN 'fire' THEN 'fire' WHEN 'hydraulic' THEN 'hydraulics' WHEN 'hydraulics' THEN 'hydraulics' WHEN 'plumbing' THEN 'hydraulics' WHEN 'mechanical' THEN 'mechanical' ELSE 'electrical' END AS value FROM (SELECT id, CASE k WHEN 0 THEN 'Fire / alarms' WHEN 1 THEN 'plumbing' WHEN 2 THEN ' Mechanical/x' WHEN 3 THEN NULL ELSE label END AS x FROM pieces)")
def _(v):
    x = F.when(_c("k") == 0, "Fire / alarms").when(_c("k") == 1, "plumbing").when(_c("k") == 2, " Mechanical/x").when(_c("k") == 3, None).otherwise(_c("label"))
    return v.pieces.select("id", r.discipline(x).alias("value"))
