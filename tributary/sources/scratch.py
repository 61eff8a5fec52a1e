"""Where queries that write files and read them again put them, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast if its rows take at most so many bytes as text; it is joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; without one, in a temporary folder in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tributary-")
    return f"{where.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str, *texts: str) -> DataFrame:
    """df written as a table in the shared folder and read back; its rows and the bytes of its columns texts are counted as they are written, for sized()."""
    path, seen = new_path(df.sparkSession, tag), Observation()
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(length).alias("bytes")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at, out._rows, out._bytes = path, seen.get.get("rows") or 0, seen.get.get("bytes") or 0
    return out


def small(table: DataFrame, *columns: str) -> bool:
    """Whether columns of numbers, or of texts that were counted, of a table made by kept() take at most BROADCAST_BYTES."""
    return table._rows * (16 + 8 * len(columns)) + table._bytes <= BROADCAST_BYTES


def sized(table: DataFrame, *columns: str) -> DataFrame:
    """The columns of a table made by kept(), with a broadcast hint if they are small."""
    out = table.select(*columns)
    return F.broadcast(out) if small(table, *columns) else out


def removed(*tables: DataFrame) -> None:
    """Delete tables made by kept() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
