"""Row numbers over a whole table without one task that sorts it, and the samples made from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.plans import dialect

#: Ranges that the order is cut into.
RANGES = 256


def _range_of(value: Column, cuts: list) -> Column:
    """The number of cuts at or below value; null is in range 0. A balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(cuts[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(cuts))


def numbered(df: DataFrame, order: str, name: str = "rn", *ties: str) -> DataFrame:
    """df with name: each row's place from 1 in the ascending order of a column of numbers, which with the columns ties are unique.

    The column's approximate quantiles (RANGES at most, taken over all rows) cut it into ranges; rows are numbered in their range, from
    the number of rows in lower ranges on. So no task holds more than about a RANGES-th of the rows.
    """
    cuts = df.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10_000).alias("q")).first().q or []
    return numbered_in_ranges(df, order, _range_of(F.col(order), sorted(set(cuts))), name, *ties)


def numbered_in_ranges(df: DataFrame, order: str, ranges: Column, name: str = "rn", *ties: str) -> DataFrame:
    """As numbered, with ranges given: a column that never falls as the order rises and has few values."""
    placed = df.withColumn("_range", ranges)
    # a row a range
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_range", before.alias("_before")))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(order, *ties))
    return placed.withColumn("_here", here).join(offsets, "_range").withColumn(name, F.col("_here") + F.col("_before")).drop("_range", "_here", "_before")


def systematic_sample(spark: SparkSession, sf_dir: str, every: int = 10, after: int = 3) -> DataFrame:
    """One action in every, after the first few."""
    act = dialect.run(dialect.Query("SELECT id FROM act"), spark, sf_dir)
    return numbered(act, "id").filter((F.col("rn") > after) & ((F.col("rn") - after) % every == 0)).select("id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"systematic_sample": systematic_sample}


def oracle_sql() -> dict[str, str]:
    sql = "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM act) x WHERE rn > 3 AND (rn - 3) % 10 = 0"
    return {"systematic_sample": dialect.text(dialect.Query(sql))}
