"""Named queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tributary.operators import bandits, clustering, factors, feedback, kernels, sampling, scoring, similarity, utility
from tributary.plans import catalogue, dialect, lists, neighbours, platform, profiles, records, texts, updates
from tributary.sources import exchange
from tributary.streaming import base_lists, incremental

QUERIES = catalogue.QUERIES | platform.QUERIES | records.QUERIES | updates.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: partial(dialect.run, q) for name, q in QUERIES.items()}
    for module in (kernels, bandits, clustering, factors, feedback, sampling, scoring, similarity, exchange, incremental, base_lists, lists, neighbours, profiles, texts, utility):
        out |= module.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: dialect.text(q) for name, q in QUERIES.items()}
    for module in (factors, sampling, scoring, similarity, exchange, incremental, base_lists, lists, neighbours):
        out |= module.oracle_sql()
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.flagship(spark, sf_dir)
