"""Tables over pairs of counts as packed files: a row for each (i, j) with i + j at most n, a row of big-endian float32, found by its place.

A file holds one combination of parameters, which its name spells: `gamma0_0.990_xi0_0.10_alpha0_1.00_beta0_1.00.bin`. Row (i, j) stands at
i * (2 n + 3 - i) / 2 + j, so a reader that knows the counts seeks to it. Files are written and read by Spark tasks, one a file when written, one
a range of rows when read; equality of `i` in a filter narrows the range that is read.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

NAME = re.compile(r"gamma0_([0-9.]+)_xi0_([0-9.]+)_alpha0_([0-9.]+)_beta0_([0-9.]+)\.bin")
PARAMETERS = ("gamma", "xi", "alpha0", "beta0")
SCHEMA = "gamma double, xi double, alpha0 double, beta0 double, i int, j int, values array<float>"
#: Rows of one task of a reader.
RANGE = 100_000


def place(i: int, j: int, n: int) -> int:
    """The row of (i, j)."""
    return i * (2 * n + 3 - i) // 2 + j


def rows_of(n: int) -> int:
    return (n + 1) * (n + 2) // 2


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")


def write(rows: DataFrame, folder: str, n: int, depth: int) -> DataFrame:
    """Pack rows (SCHEMA, each i + j <= n exactly once for each combination, values of depth + 1 numbers) into files; lazily, name, rows and bytes of each.

    A file is written whole by one task, from rows that Spark sorts and that stream through it. A missing or repeated row, a null and a wrong number of values
    raise, and leave no file of that name.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(folder)
        fs.create_dir(base)
        out, at, due = None, None, 0

        def close() -> pd.DataFrame:
            out.close()
            if due != rows_of(n):
                raise ValueError(f"{at}: {due} rows, {rows_of(n)} are due")
            fs.move(f"{base}/.{at}.part", f"{base}/{at}")
            return pd.DataFrame({"name": [at], "rows": [due], "bytes": [4 * due * (depth + 1)]})

        for batch in batches:
            for name, own in batch.groupby("name", sort=False):
                if name != at:
                    if at is not None:
                        yield close()
                    at, due = name, 0
                    out = fs.open_output_stream(f"{base}/.{at}.part")
                cells = np.stack(own["values"].to_list())
                if cells.shape[1] != depth + 1 or np.isnan(cells).any() or not (own["place"].to_numpy() == np.arange(due, due + len(own))).all():
                    raise ValueError(f"{name}: rows near {due} are missing, repeated or not whole")
                out.write(cells.astype(">f4").tobytes())
                due += len(own)
        if at is not None:
            yield close()

    name = F.format_string("gamma0_%.3f_xi0_%.2f_alpha0_%.2f_beta0_%.2f.bin", *PARAMETERS)
    placed = rows.select(name.alias("name"), place_of(F.col("i"), F.col("j"), n).alias("place"), F.col("values").cast("array<float>").alias("values"))
    return placed.repartition("name").sortWithinPartitions("name", "place").mapInPandas(pack, "name string, rows long, bytes long")


def place_of(i: Column, j: Column, n: int) -> Column:
    i = i.cast("long")
    return F.shiftright(i * (2 * n + 3 - i), 1) + j


def from_text(lines: DataFrame, params: tuple[float, float, float, float], n: int) -> DataFrame:
    """SCHEMA from lines of comma-separated numbers: place (the line's number from 0) and value; a line is a row of the table."""
    line = F.col("place").cast("long")
    # the row's i is the number of whole columns before it: the root of a quadratic, corrected by one where rounding misses
    guess = F.floor((2 * n + 3 - F.sqrt(F.lit(float((2 * n + 3) ** 2)) - 8 * line)) / 2)
    start = lambda i: place_of(i, F.lit(0), n)
    i = F.when(start(guess + 1) <= line, guess + 1).when(start(guess) > line, guess - 1).otherwise(guess)
    fixed = [F.lit(float(v)).alias(p) for p, v in zip(PARAMETERS, params, strict=True)]
    values = F.transform(F.split(F.trim("value"), r",\s*"), lambda v: v.cast("float")).alias("values")
    return lines.select(line.alias("place"), i.alias("i"), values).select(*fixed, F.col("i").cast("int"), (F.col("place") - start(F.col("i"))).cast("int").alias("j"), "values")


def lookup(states: DataFrame, folder: str, n: int, depth: int) -> DataFrame:
    """states (PARAMETERS, i, j; equal ones count once) with values, each row found by a seek; those without a file have no row.

    Counts beyond n are scaled to it with their share, as the tables' programme says. Tasks take states by file, in the order of their places.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(folder)
        at, file, width = None, None, depth + 1
        for batch in batches:
            found = []
            for name, spot in zip(batch["name"], batch["place"]):
                if name != at:
                    if file is not None:
                        file.close()
                    there = fs.get_file_info(f"{base}/{name}").type == pa.fs.FileType.File
                    at, file = name, fs.open_input_file(f"{base}/{name}") if there else None
                if file is not None:
                    file.seek(4 * spot * width)
                found.append(None if file is None else np.frombuffer(file.read(4 * width), ">f4").astype("f4"))
            yield batch.assign(values=found)[[*PARAMETERS, "i", "j", "values"]]
        if file is not None:
            file.close()

    keys = states.select(*PARAMETERS, F.col("i").cast("int"), F.col("j").cast("int")).distinct()
    total = F.col("i") + F.col("j")
    scaled = F.when(total > n, F.floor(F.col("i") / total * n + 0.5)).otherwise(F.col("i")).cast("int")
    rest = F.when(total > n, n - scaled).otherwise(F.col("j"))
    name = F.format_string("gamma0_%.3f_xi0_%.2f_alpha0_%.2f_beta0_%.2f.bin", *PARAMETERS)
    placed = keys.select("*", name.alias("name"), place_of(scaled, rest, n).alias("place"))
    lots = placed.repartition("name", F.floor(F.col("place") / RANGE)).sortWithinPartitions("name", "place")
    return lots.mapInPandas(find, SCHEMA).filter("values IS NOT NULL")


def parameters(folder: str) -> list[tuple[float, ...]]:
    """PARAMETERS of every file in the folder, in order."""
    fs, base = _open(folder)
    return sorted(tuple(map(float, m.groups())) for info in fs.get_file_info(pa.fs.FileSelector(base)) if (m := NAME.fullmatch(info.base_name)))


class _Rows(InputPartition):
    def __init__(self, path: str, params: tuple[float, ...], low: int, high: int):
        self.path, self.params, self.low, self.high = path, params, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.n, self.depth = options["path"], int(options["n"]), int(options["depth"])
        self.only: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("i",):
                self.only = int(f.value)
            else:
                yield f

    def partitions(self) -> list[_Rows]:
        fs, base = _open(self.folder)
        low, high = 0, rows_of(self.n)
        if self.only is not None:
            low, high = (place(self.only, 0, self.n), place(self.only + 1, 0, self.n)) if 0 <= self.only <= self.n else (0, 0)
        out = []
        for info in fs.get_file_info(pa.fs.FileSelector(base)):
            if not (m := NAME.fullmatch(info.base_name)):
                continue
            if info.size != 4 * rows_of(self.n) * (self.depth + 1):
                raise ValueError(f"{info.base_name} has {info.size} bytes; n = {self.n} and depth = {self.depth} make {4 * rows_of(self.n) * (self.depth + 1)}")
            params = tuple(map(float, m.groups()))
            out += [_Rows(posixpath.join(base, info.base_name), params, at, min(at + RANGE, high)) for at in range(low, high, RANGE)]
        return out

    def read(self, part: _Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partition at all
            return
        fs, _ = _open(self.folder)
        width = self.depth + 1
        with fs.open_input_file(part.path) as file:
            file.seek(4 * part.low * width)
            values = np.frombuffer(file.read(4 * (part.high - part.low) * width), ">f4").astype("f4")
        starts = np.array([place(i, 0, self.n) for i in range(self.n + 2)])
        rows = np.arange(part.low, part.high)
        i = np.searchsorted(starts, rows, side="right") - 1
        j = rows - starts[i]
        columns = [pa.array(np.full(len(rows), p)) for p in part.params] + [pa.array(x.astype("i4")) for x in (i, j)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, width, dtype="i4")), pa.array(values))
        yield pa.RecordBatch.from_arrays([*columns, lists], [c.split()[0] for c in SCHEMA.split(", ")])


class TriangularSource(DataSource):
    """spark.read.format("triangular").option("n", ..).option("depth", ..).load(folder); files of other names are left alone."""

    @classmethod
    def name(cls) -> str:
        return "triangular"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read(spark: SparkSession, folder: str, n: int, depth: int) -> DataFrame:
    """The folder's tables as SCHEMA. Filters reach the source only with the session's switch for Python sources, which is set here."""
    spark.dataSource.register(TriangularSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("triangular").option("n", n).option("depth", depth).load(folder)
