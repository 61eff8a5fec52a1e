"""Harvesting of a paged listing of records as a stream that resumes: each response names the next by a token, and a stream's offset is the number of responses read.

Responses are recorded files, one a token: `start.xml` first, then `<token>.xml`, until one has an empty token or the file is not there yet. The chain is followed by the driver, which reads no more
than each response's token; the records themselves are read by tasks, one a response. A response that is no listing gives one row without a record, and does not end the stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tributary.sources.scratch import new_path

SCHEMA = "page long, token string, place int, record string"
TOKEN = re.compile(r"<resumptionToken[^>]*>([^<]*)</resumptionToken>")
RECORD = re.compile(r"<record>.*?</record>", re.S)
#: Bytes at the end of a response in which its token stands; all of it is read where it does not.
TAIL = 4096
START = "start"
#: Records of a response that write() makes.
PER_PAGE = 100


def _file(folder: str, token: str) -> tuple[pa.fs.FileSystem, str]:
    fs, base = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    return fs, f"{base}/{re.sub(r'[^A-Za-z0-9-]', '_', token)}.xml"


def _next(folder: str, token: str) -> str | None:
    """The token that a response names, '' at the end of the listing, None if the response is not there."""
    fs, path = _file(folder, token)
    info = fs.get_file_info(path)
    if info.type != pa.fs.FileType.File:
        return None
    with fs.open_input_file(path) as file:
        for start in sorted({max(0, info.size - TAIL), 0}, reverse=True):
            file.seek(start)
            if found := TOKEN.findall(file.read().decode("utf-8", "replace")):
                return found[-1].strip()
    return ""


class _Page(InputPartition):
    def __init__(self, page: int, token: str):
        self.page, self.token = page, token


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.tokens = options["path"], [START]  # of the responses that are known to come, in order

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def _upto(self, pages: int | None = None) -> int:
        """Follows the chain to so many responses, or as far as there are any; how many are there."""
        while self.tokens[-1] and (pages is None or len(self.tokens) <= pages):
            then = _next(self.folder, self.tokens[-1])
            if then is None:
                break
            self.tokens.append(then)
        return len(self.tokens) - 1

    def latestOffset(self) -> dict:
        return {"pages": self._upto()}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        self._upto(end["pages"])
        return [_Page(i, self.tokens[i]) for i in range(start["pages"], end["pages"])]

    def read(self, part: _Page | None) -> Iterator[tuple]:
        if part is None:
            return
        fs, path = _file(self.folder, part.token)
        with fs.open_input_file(path) as file:
            text = file.read().decode("utf-8", "replace")
        for i, record in enumerate(RECORD.findall(text) or [None]):
            yield part.page, part.token, i, record

    def commit(self, end: dict) -> None:
        """Recorded responses stay."""


class HarvestSource(DataSource):
    """spark.readStream.format("harvest").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def stream(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(HarvestSource)
    return spark.readStream.format("harvest").load(folder)


def parsed(rows: DataFrame) -> DataFrame:
    """page, aid, area, day and words of the records: deleted ones and those without an id go, a set's name ends at its colon, dates that are none are null."""
    schema = "header struct<identifier: string, datestamp: string, setSpec: string, _status: string>, metadata struct<abstract: string>"
    r = rows.filter("record IS NOT NULL").select("page", F.from_xml("record", schema).alias("r")).select("page", "r.*")
    live = r.filter("header.identifier IS NOT NULL AND coalesce(header._status, '') <> 'deleted'")
    return live.select(
        "page", F.col("header.identifier").alias("aid"), F.element_at(F.split("header.setSpec", ":"), 1).alias("area"), F.expr("try_to_date(header.datestamp, 'yyyy-MM-dd')").alias("day"), F.col("metadata.abstract").alias("abstract"),
    )


def harvested(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """Read what responses there are, add them to the table in `to`, and give the whole table. Called again, it goes on behind what it has.

    A batch that is run again after a failure writes its own folder again, so nothing is lost or doubled.
    """
    out = parsed(stream(spark, folder)).writeStream.foreachBatch(partial(_write, to)).option("checkpointLocation", f"{to}-offsets").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema("page long, aid string, area string, day date, abstract string").parquet(f"{to}/*")


def _write(to: str, rows: DataFrame, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{to}/{number}")


def record(rows: DataFrame, folder: str, per_page: int = PER_PAGE) -> int:
    """Write rows (place from 0 without gaps, aid, area, day, status, abstract) as responses of per_page records each; how many. Tasks write whole responses."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.sax.saxutils import escape

        held: list[str] = []
        at = None

        def flush(final: bool = False) -> pd.DataFrame:
            fs, path = _file(folder, START if at == 0 else f"p{at}")
            fs.create_dir(path.rpartition("/")[0])
            with fs.open_output_stream(path) as out:
                out.write(f"<OAI-PMH><ListRecords>{''.join(held)}<resumptionToken>{'' if final else f'p{at + 1}'}</resumptionToken></ListRecords></OAI-PMH>".encode())
            held.clear()
            return pd.DataFrame({"page": [at]})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.page != at and held:
                    yield flush()
                at = r.page
                status = ' status="deleted"' if r.status == "deleted" else ""
                text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", r.abstract or "")
                held.append(f"<record><header{status}><identifier>{r.aid}</identifier><datestamp>{r.day}</datestamp><setSpec>{escape(r.area or '')}:x</setSpec></header><metadata><abstract>{escape(text)}</abstract></metadata></record>")
                last = r.last
            if held and last == at and len(held) == r.size:
                yield flush(final=True)
        if held:
            yield flush(final=last == at)

    n = rows.count()
    pages = rows.withColumn("page", F.floor(F.col("place") / per_page)).withColumn("last", F.lit((n - 1) // per_page)).withColumn("size", F.lit(n - (n - 1) // per_page * per_page))
    return pages.repartition("page").sortWithinPartitions("page", "place").mapInPandas(write, "page long").count()
