"""What the training-data operators share: words, shared scratch tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

#: The six ASCII white space characters that end a word; nothing else does.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast if its rows, as Spark would hold them, take at most so many bytes; it is joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACE; an empty array for null or blank text."""
    body = F.btrim(text, F.lit(SPACE))
    return F.when(body.isNull() | (body == ""), F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and no other character changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: what a lambda captures from outside is otherwise computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one in local mode; on a cluster that raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as Spark holds it, at least."""
    row = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema:
        if (more := _bytes(f.dataType, F.col(f"`{f.name}`"))) is not None:
            row = row + F.coalesce(more, F.lit(0))
    return row


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation.

    The bytes of its rows are summed as they are written, for small().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.sum(_row_bytes(df)).alias("bytes")).write.option("compression", "zstd").parquet(path)  # the default codec keeps its buffers outside the heap
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at, out._bytes = path, seen.get.get("bytes") or 0
    return out


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables stored within send at most so many rows at once to Python: what a worker holds is that many texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables made by stored() that nothing reads any more."""
    for df in tables:
        spark, at = df.sparkSession, getattr(df, "_stored_at", None)
        if not at:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(kind: DataType, value: Column) -> Column | None:
    """Bytes of a column's value beyond the eight that each column takes in a row; None where it takes no more."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.octet_length(value) + 16
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (LongType, IntegerType, DoubleType)):
        return 8 * F.size(value) + 32
    if isinstance(kind, (StructType, ArrayType, MapType)):
        return F.octet_length(F.to_json(value)) * 4 + 64
    return None


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a table made by stored(), with a broadcast hint if its rows take at most so many bytes, else as it is."""
    return F.broadcast(df) if df._bytes <= most else df
