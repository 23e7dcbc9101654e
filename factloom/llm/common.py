"""Shared folders, written intermediate tables and Arrow helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into numpy arrays at once (a longer text goes alone).
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests, local mode) a temporary folder is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from ``columns`` (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def attach(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, *, limit: int = 100_000, least: int = 10_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and in ``weight`` how many rows of ``left`` have it.

    Keys with total / limit rows or more (``total``: rows of ``left``, at least ``least``) are ``limit`` at most by
    that number, so they are broadcast and their rows stay where they are; the others are shuffled, and no task
    gets more rows of one key than that. ``right`` is a table, as it is asked first whether it has such keys: without
    one this is a plain join, whose plan and threads cost the driver far less.
    """
    bound = max(least, total // limit)
    if total < bound or (right.agg(F.max(weight)).first()[0] or 0) < bound:
        return left.join(right, on)
    hot = right.where(F.col(weight) >= bound)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(weight) < bound), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``size`` bytes of UTF-8 text; nulls are empty.

    ``offsets`` has one entry more than the run has rows and starts at 0.
    """
    array = batch.column(batch.schema.get_field_index(column))
    array = array.cast(pa.large_string()) if array.null_count == 0 else array.cast(pa.large_string()).fill_null("")
    n = len(array)
    if n == 0:
        return
    _, offset_buffer, data_buffer = array.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64, n + 1 + array.offset)[array.offset :]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
