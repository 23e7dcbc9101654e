"""Tables written to the folder that driver and executors share: they cut the lineage of driver loops."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set only where it is unset and master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a table in the shared folder in buckets by a column: what joins or groups by that doesn't move it again."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def local(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A table of a few rows as a local relation: the optimiser sees its size and folds what is done with it."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kind)
