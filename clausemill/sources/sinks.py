"""Writers of the library's files and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of several, any one of the newest."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__v")))).where("__n = 1").drop("__v", "__n")


def clause_block(number: Column, title: Column, parent: Column, level: Column, pages: Column, confidence: Column, body: Column) -> Column:
    """The text form of a clause."""
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = [F.lit("[CLAUSE]"), F.concat(F.lit("Number: "), e(number)), F.concat(F.lit("Title: "), e(title)), F.concat(F.lit("Parent: "), e(parent)), F.concat(F.lit("Level: "), e(level)), F.concat(F.lit("Pages: "), e(pages)), F.concat(F.lit("Confidence: "), e(confidence)), F.concat(F.lit("Body: "), e(body)), F.lit("-" * 80)]
    return F.concat_ws("\n", *lines)


def write_clauses_csv(clauses: DataFrame, path: str) -> None:
    clauses.write.mode("overwrite").csv(path, header=True)


def write_tables_csv(tables: DataFrame, path: str) -> None:
    tables.write.mode("overwrite").csv(path, header=True, quoteAll=True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder for each codebook, so that a search in one reads no other."""
    chunks.write.mode("overwrite").partitionBy("codebook").parquet(path)


def json_rows(df: DataFrame) -> DataFrame:
    """value: each row as JSON without null fields."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def yaml_text(title: Column, fields: dict[str, Column]) -> Column:
    """A flat YAML mapping; null fields are left out."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), *[F.concat(F.lit(f"{k}: "), quoted(c)) for k, c in fields.items()])
