"""Footer notes of tables from the text of their page, as a fold over the lines below the table.

A table's stretch of the page goes from where its number or title stands to the next table's heading. In it, what is below
NOTES (or EXCEPTIONS, if there are no notes) is read line by line: a line that begins an item closes the one before,
others go on with it, and a heading of something else ends the notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings, beginnings of items, and limits.
NEXT_TABLE = r"(?imU)^\s*TABLE\s+\S+"
NOTES = r"(?iU)\bNOTES?\b"
NOTES_HEAD = r"(?iU)^NOTES?\b\s*[:\-–—]?\s*"
EXCEPTIONS = r"(?iU)\bEXCEPTIONS?\b"
EXCEPTIONS_LINE = r"(?iU)^EXCEPTIONS?\b"
STOP = r"(?iU)^(?:(?:TABLE|FIGURE|CLAUSE)\s+\S+|APPENDIX|NOTE|SOURCE)$"
COPYRIGHT = r"(?iU)^COPYRIGHT\b"
ITEM = r"(?iU)^(?:\(\d{1,3}\)|\d{1,3}\s*[.):]|\([a-z]\)|[a-z]\s*[.):])"
LONGEST, MOST, LEAST_TITLE, TITLE = 260, 60, 8, 80


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _quoted(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _step(s: Column, line: Column, are_notes: Column) -> Column:
    """The state (items, open, done) after a line: closed items, the one that lines still join, whether it is over."""

    def state(items: Column, open_: Column, done: Column | bool = False) -> Column:
        return F.struct(items.alias("items"), open_.alias("open"), (F.lit(done) if isinstance(done, bool) else done).alias("done"))

    some = (F.size(s["items"]) > 0) | (s["open"] != "")
    full = are_notes & (F.size(s["items"]) >= MOST)
    stops = are_notes & some & (line.rlike(STOP) | line.rlike(COPYRIGHT))
    says = (F.length(line) <= LONGEST) & line.rlike("[A-Za-z]")
    return (
        F.when(s["done"], s)
        .when(stops, state(s["items"], s["open"], True))
        .when(are_notes & line.rlike(EXCEPTIONS_LINE), state(F.concat(_closed(s), F.array(line)), F.lit("")))
        .when(line.rlike(ITEM), state(_closed(s), line))
        .when(s["open"] != "", state(s["items"], F.concat_ws(" ", s["open"], line), full))
        .otherwise(state(s["items"], F.when(says, line).otherwise(""), full))
    )


def _closed(s: Column) -> Column:
    return F.when(s["open"] == "", s["items"]).otherwise(F.concat(s["items"], F.array(s["open"])))


def with_notes(tables: DataFrame, page: Column, number: Column, title: Column, name: str = "notes") -> DataFrame:
    """tables with the notes of each as a column of that name, each once, in their order. Each step is a column of its
    own, so that none is worked out twice; they stand beside the row, so that its columns may have any names.

    A table whose number or title isn't on the page has none, so that it doesn't take another's; the whole page is read
    for one without both."""
    t = tables.select(F.struct("*").alias("row"), F.regexp_replace(F.coalesce(page, F.lit("")), r"\r\n?", "\n").alias("text"), _stripped(F.regexp_replace(_stripped(F.coalesce(number, F.lit(""))), r"(?iU)^table\s+", "")).alias("label"), _stripped(F.coalesce(title, F.lit(""))).alias("name"))
    text, label = F.col("text"), F.col("label")
    has_label, has_name = label != "", F.length("name") >= LEAST_TITLE
    ways = [
        (has_label, F.concat(F.lit(r"(?iU)\bTABLE\s+"), _quoted(label), F.lit(r"\b"))),
        (has_label, F.concat(F.lit(r"(?iU)\bTABLE"), _quoted(label), F.lit(r"\b"))),
        (has_name, F.concat(F.lit("(?iu)"), _quoted(F.substring("name", 1, TITLE)))),
    ]
    found = F.coalesce(*[F.when(has, F.nullif(F.regexp_instr(text, pattern), F.lit(0))) for has, pattern in ways])
    t = t.withColumn("at", F.when(has_label | has_name, found).otherwise(F.lit(1)))
    t = t.withColumn("end", F.regexp_instr(F.substr(text, F.col("at") + 1), F.lit(NEXT_TABLE)))
    own = F.when(F.col("end") > 0, F.substr(text, F.col("at"), F.col("end"))).otherwise(F.substr(text, F.col("at")))
    t = t.select("row", F.coalesce(own, F.lit("")).alias("own"))
    t = t.select("row", "own", F.regexp_instr("own", F.lit(NOTES)).alias("notes"), F.regexp_instr("own", F.lit(EXCEPTIONS)).alias("exceptions"))
    are_notes = F.col("notes") > 0
    below = F.when(are_notes, F.substr("own", "notes")).when(F.col("exceptions") > 0, F.substr("own", "exceptions")).otherwise(F.lit(""))
    t = t.select("row", are_notes.alias("are_notes"), F.transform(F.split(below, "\n"), _stripped).alias("lines"))
    are_notes, head = F.col("are_notes"), F.element_at("lines", 1)
    nothing = F.array().cast("array<string>")
    first = F.when(are_notes, F.array(_stripped(F.regexp_replace(head, NOTES_HEAD, "")))).otherwise(nothing)
    rest = F.filter(F.concat(first, F.slice("lines", F.lit(2), F.greatest(F.size("lines"), F.lit(1)))), lambda x: x != "")
    start = F.struct(F.when(are_notes | (head == ""), nothing).otherwise(F.array(head)).alias("items"), F.lit("").alias("open"), F.lit(False).alias("done"))
    t = t.select("row", F.aggregate(rest, start, lambda s, line: _step(s, line, are_notes), _closed).alias("found"))
    t = t.select("row", F.filter(F.transform("found", lambda x: _stripped(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "").alias("clean"))
    t = t.select("row", "clean", F.transform("clean", F.lower).alias("low"))
    return t.select("row.*", F.filter("clean", lambda x, i: F.array_position("low", F.lower(x)) == i + 1).alias(name))
