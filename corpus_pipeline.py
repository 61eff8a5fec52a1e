"""A training corpus from `documents`: bad text, repeated lines and near copies go, sources are mixed, and what remains is tokenised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import bpe, line_dedup, mixing, near_dedup, quality
from tributary.llm.common import stored, table

#: In this order; each function takes (spark, docs, sf_dir) and its result is written and read again as the next one's docs.
STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", line_dedup.stage),
    ("near dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("byte-level bpe", bpe.stage),
]

#: Line and near dedup, the mixture's hash order and BPE have no SQL form; tests/llm/test_pipeline.py holds run() against brute force, row by row, on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
