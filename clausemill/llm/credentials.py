"""Secret scans with multipart credential linking, in DataFrame functions alone.

Three kinds of finding stand by themselves: assigned secrets, access identifiers and hexadecimal keys.
Three more are weak: account names, opaque 40-character tokens and endpoints. A weak candidate is reported
only if the parts that complete it start in its scope, SCOPE code points to either side in the same
document. The interval join is a range window over each document's parts in order of their starts, so it
makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside

#: The patterns of the base findings and the least length of what they must match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that are long enough
LEAST = {"assign": 8, "access": 16}

LOGIN = r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
OPAQUE = r"[A-Za-z0-9/+=]{40,}"  # kept if exactly 40 long
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+"""
KINDS = ["assign", "access", "hex", "login", "opaque", "endpoint"]
BASE = KINDS[:3]
SCOPE = 256


def _found(text: Column, pattern: str, when: Column | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if when is None else F.when(when, found).otherwise(F.array().cast("array<string>"))


def _parts(kind: str, pattern: str) -> Column:
    """Each match of the kind with the length of the gap before it; what stands between matches is what
    splitting at them leaves."""
    matches = F.col(f"m_{kind}")
    gaps = F.transform(F.split(F.col("text"), pattern, -1), F.length)
    return F.when(
        F.size(matches) > 0,
        F.zip_with(
            F.sequence(F.lit(0), F.size(matches) - 1),
            matches,
            lambda i, m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.element_at(gaps, i + 1).alias("gap"), m.alias("hit")),
        ),
    ).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,hit:string>>"))


def find_parts(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """uid, the columns to carry, kind, hit, start, end: a row for each match, and one with null kind for each document
    without any. Positions are code points, the end exclusive."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(*carry, text.alias("text"), F.monotonically_increasing_id().alias("uid"))
    second = first.withColumns(
        {
            "m_assign": _found(F.col("text"), ASSIGN),
            "m_access": _found(F.col("text"), ACCESS, F.col("text").contains("AKIA")),
            "m_hex": _found(F.col("text"), HEX),
            "m_login": _found(F.col("text"), LOGIN),
        }
    )
    # what can't be completed in the whole document isn't looked for
    identified = F.size("m_access") + F.size("m_login") > 0
    third = second.withColumns({"m_opaque": _found(F.col("text"), OPAQUE, identified), "m_endpoint": _found(F.col("text"), ENDPOINT, identified)})
    patterns = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, LOGIN, OPAQUE, ENDPOINT], strict=True))
    each = third.select("uid", *carry, F.explode_outer(F.concat(*[_parts(k, p) for k, p in patterns.items()])).alias("x"))
    w = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = each.select("uid", *carry, "x.*").repartition("uid").withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(w))
    return rows.select("uid", *carry, "kind", "hit", (F.col("end") - F.length("hit")).alias("start"), "end")


def _is(*kinds: str) -> Column:
    return F.col("kind").isin([KINDS.index(k) for k in kinds])


def link(parts: DataFrame, scope: int = SCOPE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The parts to report: all base ones long enough, and weak ones that are completed in their scope."""
    long_enough = (
        F.when(_is("assign"), F.length(F.regexp_extract("hit", ASSIGN, 2)) >= LEAST["assign"])
        .when(_is("access"), F.length("hit") >= LEAST["access"])
        .when(_is("opaque"), F.length("hit") == 40)
        .otherwise(F.lit(True))
    )
    # a part that is too short turns into a row without finding, so that its document stays
    kept = parts.select("uid", *carry, F.when(long_enough, F.col("kind")).alias("kind"), "start", "end")
    near = Window.partitionBy("uid").orderBy("start").rangeBetween(-scope, scope)
    seen = {k: F.coalesce(F.max(F.when(_is(k), 1)).over(near), F.lit(0)) == 1 for k in KINDS}
    identity, secret = seen["access"] | seen["login"], seen["assign"] | seen["hex"] | seen["opaque"]
    linked = kept.withColumn(
        "reported",
        F.when(_is(*BASE), True).when(_is("login"), secret).when(_is("opaque"), identity).when(_is("endpoint"), identity & secret).otherwise(F.lit(False)),
    )
    return linked.select("uid", *carry, F.when(F.col("reported"), F.col("kind")).alias("kind"), "start", "end")


def scan(docs: DataFrame, scope: int = SCOPE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """uid, the columns to carry, spans array<struct<start, kind, end>> in order, one row for each row of docs.

    Null and empty texts have no spans. Rows that repeat an id are scanned each by itself. Parts that start together
    are in the order of their kinds. A text of any length is scanned whole; its parts are one partition of a window. An
    empty table gives no rows. Only doc_id and text are read.
    """
    spans = F.array_sort(F.filter(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))), lambda x: x.isNotNull()))
    return link(find_parts(docs, carry), scope, carry).groupBy("uid", *carry).agg(spans.alias("spans"))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans"""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda x: x["kind"] < len(BASE))
    return scan(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(spans).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs(doc_id, text, n_chars, ...) with every reported span replaced by the mask and n_chars anew, other
    columns as they were. Spans that overlap are replaced as one. Null texts stay null; rows that repeat an id and a text
    get the same text; an empty table gives no rows. docs needs doc_id and text."""
    mine = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("content"))
    spans = scan(mine.select("doc_id", "text", "content"), carry=("doc_id", "content")).where(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id").alias("of"), F.col("content").alias("of_content"), "spans").dropDuplicates(["of", "of_content"])
    spans = beside(spans, F.size("spans") + 1)  # so that texts needn't move
    joined = mine.join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("of_content")), "left")
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.when(x["start"] >= acc["at"], F.struct(F.concat(acc["out"], gap, F.lit(mask)).alias("out"), x["end"].alias("at"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))
        )

    clean = F.aggregate("spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.col("spans").isNull(), text).otherwise(clean)
    changed = joined.select("row", new.alias("new"))  # columns of docs stay inside the row, whatever their names
    own = lambda c: F.col("row").getField(c).alias(c)
    return changed.select(*[F.col("new").alias("text") if c == "text" else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else own(c) for c in docs.columns])
