"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_recipes, credentials, divergence, langid, packing, quality, rlz, run_index, simhash, tensor_minhash, topk, turns
from .common import documents, fold_remainder

TOKENIZER = "byte_bpe_50k.json"
#: CRC-32 of the ASCII text `key` in DuckDB's SQL, which has no function for it: eight shifts for each byte.
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda acc, b: "
    "list_reduce(list_prepend(xor(acc, b), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"
)


def op1_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.remove_repeats(documents(spark, sf_dir))


def op2_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.remove_repeats(documents(spark, sf_dir))


def op3_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold_remainder(F.col("doc_id"), 4) == 2
    filters = langid.fit(docs.where(~held_out))
    return langid.predict(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op5_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(documents(spark, sf_dir))


def _op5_sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = dict(zip(credentials.KINDS, [credentials.ASSIGN, credentials.ACCESS, credentials.HEX, credentials.LOGIN, credentials.OPAQUE, credentials.ENDPOINT], strict=True))
    each = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, unnest(range(len(m))) AS i, unnest(m) AS hit, unnest(g[1:len(m)]) AS gap FROM (SELECT doc_id, regexp_extract_all(s, {q(p)}, 0) AS m, "
        f"list_transform(regexp_split_to_array(s, {q(p)}), lambda x: length(x)) AS g FROM t) WHERE len(m) > 0"
        for i, p in enumerate(patterns.values())
    )
    has = lambda *k: "coalesce(bool_or(kind IN (" + ", ".join(str(credentials.KINDS.index(x)) for x in k) + ")) OVER near, false)"
    spans = lambda where: f"coalesce(string_agg(name || ':' || s0 || ':' || e0, ',' ORDER BY s0, kind, e0) FILTER ({where}), '')"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents), each_ AS ({each}),
        placed AS (SELECT *, sum(gap + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e0 FROM each_),
        long_ AS (SELECT doc_id, kind, e0 - length(hit) AS s0, e0, {[*credentials.KINDS]}[kind + 1] AS name FROM placed
            WHERE CASE kind WHEN 0 THEN length(regexp_extract(hit, {q(credentials.ASSIGN)}, 2)) >= 8 WHEN 1 THEN length(hit) >= 16 WHEN 4 THEN length(hit) = 40 ELSE true END),
        flags AS (SELECT *, {has("access", "login")} AS identity_, {has("assign", "hex", "opaque")} AS secret_ FROM long_
            WINDOW near AS (PARTITION BY doc_id ORDER BY s0 RANGE BETWEEN {credentials.SCOPE} PRECEDING AND {credentials.SCOPE} FOLLOWING)),
        kept AS (SELECT * FROM flags WHERE CASE kind WHEN 3 THEN secret_ WHEN 4 THEN identity_ WHEN 5 THEN identity_ AND secret_ ELSE true END)
        SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               sha256({spans("kind < 3")}) AS base_sha256, {spans("kind IS NOT NULL")} AS spans
        FROM documents LEFT JOIN kept USING (doc_id) GROUP BY doc_id
    """


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(*quality.labelled(docs, labels, lambda doc_id: fold_remainder(doc_id, 5) != 0))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", (fold_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.exact_duplicates(documents(spark, sf_dir))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op9_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op10_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_duplicates(documents(spark, sf_dir))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _op12_sql() -> str:
    """The same by a recursive query: a step for each turn, with the cheapest (cost, audit, lines) for each state."""
    state = lambda c, a, r: f"{{'c': {c}, 'a': {a}, 'r': {r}}}"
    more = lambda x, c, a, r="''": state(f"{x}.c + {c}", f"{x}.a || {a}", f"{x}.r || {r}")
    first = lambda *xs: f"list_min([{', '.join(xs)}])"
    never = state("1000000000", "''", "''")
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    put = lambda x, r=user: more(x, 2, "'I'", r)
    both = lambda x: more(x, 4, "'II'", f"{user} || {assistant}")
    closed = f"s0, s1, {first('s2', put('s0'), put('s1'), put('s3'))} AS s2, {first('s3', put('s2', assistant), both('s0'), both('s1'))} AS s3"
    gone = lambda i: more(f"s{i}", 3, "'D'")
    extra = "(fault = 'truncated')::BIGINT"
    line = lambda role: f"{role} || ':' || text || chr(10)"
    edit = lambda x, initial, role: f"CASE WHEN initial = '{initial}' THEN {more(x, extra, chr(39) + 'K' + chr(39), line('role'))} ELSE {more(x, '2 + ' + extra, chr(39) + 'R' + chr(39), line(chr(39) + role + chr(39)))} END"
    step = lambda i, new: f"CASE WHEN fault IN ('blank', 'duplicate') THEN {gone(i)} ELSE {first(gone(i), new)} END AS s{i}"
    kept = f"CASE WHEN initial = 's' THEN {more('s0', extra, chr(39) + 'K' + chr(39), line('role'))} ELSE {never} END"
    steps = ", ".join([f"{gone(0)} AS s0", step(1, kept), step(2, edit(first("s0", "s1", "s3"), "u", "user")), step(3, edit("s2", "a", "assistant"))])
    return rf"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
        crc AS (SELECT *, {CRC32} % 20 AS kind FROM k),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn, regexp_replace(text, '[ 	-
]+$', '') AS trimmed, left(role, 1) AS initial FROM d),
        f AS (SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                     lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM o),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
        walk AS (SELECT conv_id, 0::BIGINT AS rn, {state("0::BIGINT", "''", "''")} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM c
                 UNION ALL SELECT conv_id, rn, {steps} FROM (SELECT w.conv_id, f.rn, fault, initial, role, text, {closed.replace("s0, s1,", "w.s0, w.s1,", 1)} FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.rn = w.rn + 1)),
        last_ AS (SELECT conv_id, rn, {first("s0", "s3")} AS s FROM (SELECT conv_id, rn, {closed} FROM walk))
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(s.c, 0) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(left(s.r, length(s.r) - 1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN last_ l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.rn = c.n
    """.replace("SELECT conv_id, coalesce(gaps", "SELECT e.conv_id, coalesce(gaps")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES = {
    "op1_run_length_index": op1_run_length_index,
    "op2_relative_lz": op2_relative_lz,
    "op3_language_bitmask": op3_language_bitmask,
    "op4_swap_packing": op4_swap_packing,
    "op5_credential_linking": op5_credential_linking,
    "op6_quality_ftrl": op6_quality_ftrl,
    "op7_chunk_recipe_dedup": op7_chunk_recipe_dedup,
    "op8_bpe_transducer": op8_bpe_transducer,
    "op9_threshold_topk": op9_threshold_topk,
    "op10_simhash_pigeonhole": op10_simhash_pigeonhole,
    "op11_tensor_minhash": op11_tensor_minhash,
    "op12_turn_repair": op12_turn_repair,
    "op13_source_divergence": op13_source_divergence,
}

SQL = {
    "op2_relative_lz": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20),
        h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM p),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM h WHERE n > 1),
        g AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
        SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
               sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(coalesce(js, []), j)), lambda j: w[j]), ' ')) AS kept_sha256
        FROM t LEFT JOIN g USING (doc_id)
    """,
    "op5_credential_linking": _op5_sql(),
    "op7_chunk_recipe_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(s) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY s)
    """,
    "op9_threshold_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5
    """,
    "op11_tensor_minhash": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                                     ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM t),
        u AS (SELECT g, min(doc_id) AS d, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
        e AS (SELECT d, n, unnest(g) AS x FROM u),
        p AS (SELECT a.d AS a, b.d AS b FROM e a JOIN e b ON a.x = b.x AND a.d < b.d AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
              GROUP BY a.d, a.n, b.d, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT d, d AS c FROM u UNION SELECT l.b, r.c FROM r JOIN l ON r.d = l.a),
        m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
        SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
        FROM s LEFT JOIN u ON s.g = u.g LEFT JOIN m ON u.d = m.d
    """,
    "op12_turn_repair": _op12_sql(),
    "op13_source_divergence": r"""
        WITH t AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT DISTINCT lang, source FROM t),
        df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM t) GROUP BY ALL HAVING count(*) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM t) SEMI JOIN df USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
        d AS (SELECT g.lang, g.source, df.term, coalesce(n, 0) AS n FROM g JOIN df USING (lang) LEFT JOIN c USING (lang, source, term)),
        s AS (SELECT lang, source, term, n,
                     1 + 1000000000 * (n + 1)::HUGEINT // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
                     1 + 1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 1)::HUGEINT // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM d JOIN v USING (lang)),
        x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM s WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 200
    """,
}
