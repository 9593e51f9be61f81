"""Runs a query and its SQL twin over the same tables and compares the rows."""

import datetime
import glob
import math
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, dict):
        return sorted((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bytearray):
        return bytes(value)
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def differences(spark, sf_dir, query, sql):
    """'' if query and SQL give the same columns and rows, else the first that differ."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = rows(names, found.fetchall())
    if mine == theirs:
        return ""
    odd = next(((a, b) for a, b in zip(mine, theirs) if a != b), "the shorter is the head of the longer")
    return f"{len(mine)} and {len(theirs)} rows: {str(odd)[:600]}"
