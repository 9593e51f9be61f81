"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles, so that a worker's arrays stay small.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local session (tests, one machine) gets a
    temporary one; a cluster's executors couldn't share it, so there it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clausemill-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write df once to the cluster's checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """What runs inside hands Python at most so many rows at once: whole texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Tables:
    """Intermediate tables, written as Parquet to the shared folder: columns compressed, read as any table, and gone when
    they are dropped, which a checkpoint isn't."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        made = self.paths.setdefault(name, [])
        path = f"{self.folder}/{name}-{len(made)}"
        made.append(path)
        with small_batches(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        context = self.spark.sparkContext
        for made in [path for name in names for path in self.paths.pop(name)]:
            path = context._jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def beside(df: DataFrame, values: Column | None = None, bound: int = 500_000) -> DataFrame:
    """df settled, and marked for a broadcast only if its rows (or the sum of values) have been counted and are at most
    bound; beyond that it is joined by a shuffle. Rows have fixed-width columns, or arrays that values counts."""
    df = settle(df)
    counted = df.agg(F.coalesce(F.sum(F.lit(1) if values is None else values), F.lit(0))).first()[0]
    return F.broadcast(df) if counted <= bound else df


def together(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, in no more partitions than a shuffle makes, so that unions of unions don't add up."""
    parts = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reduce(DataFrame.unionAll, tables).coalesce(parts)


def fold_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo mod; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with at most `limit` bytes; a longer
    row comes alone. Null texts count as empty. Offsets start at 0 and have one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(offs, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
