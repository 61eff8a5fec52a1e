"""Operator 4, mixing: temperature weights of sources by bisection, realised as budgeted permutations of hashed blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import small, stored, table, words

#: A source's documents are cut into so many blocks by the leading bits of a hash, so that the place of the budget's end is found from sums.
BLOCK_BITS = 10
#: No source is passed over more often than this.
MAX_REPEAT = 2.0
#: The target entropy lies this far between that of the sources' own shares and that of equal ones.
TOWARDS_EQUAL = 0.5
SEED = 4
#: Distinct source sizes up to which the bisection runs on the driver; beyond, each step is a job over the stored sizes.
DRIVER_SIZES = 100_000


def moments(sizes: list[tuple[int, int]], alpha: float) -> tuple[float, float]:
    """Sum of n * t**alpha and of n * t**alpha * ln(t**alpha) over (t, n): sources of t tokens, n of them. From these follows the entropy."""
    z = math.fsum(n * t**alpha for t, n in sizes)
    return z, math.fsum(n * t**alpha * alpha * math.log(t) for t, n in sizes)


def bisected(low: float, high: float, above: Callable[[float], bool], steps: int = 50) -> float:
    """The point in [low, high] up to which above holds, it being true below that point and false beyond."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) else (low, mid)
    return low


def exponent(sizes: DataFrame, max_repeat: float, towards_equal: float) -> float:
    """The exponent in [0, 1] whose weights reach the target entropy, or as near as max_repeat allows. sizes: t and n, t > 0."""
    few = sizes.limit(DRIVER_SIZES + 1).count() <= DRIVER_SIZES
    local = [(r.t, r.n) for r in sizes.collect()] if few else []

    def both(alpha: float) -> tuple[float, float]:
        if few:
            return moments(local, alpha)
        p = F.pow(F.col("t").cast("double"), F.lit(alpha))
        return tuple(sizes.agg(F.sum(F.col("n") * p), F.sum(F.col("n") * p * alpha * F.ln("t"))).first())

    def entropy(alpha: float) -> float:
        z, m = both(alpha)
        return math.log(z) - m / z

    k, least, most = sizes.agg(F.sum("n"), F.min("t"), F.max("t")).first()
    if not k or least == most:
        return 1.0
    target = (1 - towards_equal) * entropy(1.0) + towards_equal * math.log(k)
    by_entropy = bisected(0.0, 1.0, lambda a: entropy(a) >= target)
    # a source of t tokens is passed (most / t) ** (1 - alpha) times when the largest is passed once
    by_repeat = bisected(0.0, 1.0, lambda a: (most / least) ** (1 - a) > max_repeat)
    return max(by_entropy, by_repeat)


def mixture(docs: DataFrame, max_repeat: float = MAX_REPEAT, towards_equal: float = TOWARDS_EQUAL, seed: int = SEED) -> DataFrame:
    """docs with n_tokens, block, weight (of the source) and copies: how often the mixture holds the row.

    Tokens are words. The budget passes the largest source exactly once, so that no document is lost; a source with weight w gets
    floor(w * budget) tokens: whole passes, then a last one over its documents in the order of a seeded hash, block by block, as long
    as the budget lasts. Rows with equal hash (identical doc_id and text) stand or fall together. Null is a source of its own. Sources
    without tokens have weight 0 and are passed once. Clashing column names of docs give way.
    """
    plain = docs.drop(*[c for c in ("n_tokens", "block", "weight", "copies", "_h", "_source") if c in docs.columns])
    tokens = F.size(words(F.col("text"))).cast("long")
    order = F.xxhash64(F.lit(seed), "source", "doc_id", "text")
    block = F.shiftrightunsigned(F.col("_h"), 64 - BLOCK_BITS).cast("int")
    rows = stored(plain.select("source", order.alias("_h"), tokens.alias("n_tokens")).withColumn("block", block), "sizes")
    sources = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("t")), "sources")
    sizes = stored(sources.filter("t > 0").groupBy("t").agg(F.count("*").alias("n")), "source-sizes")
    alpha = exponent(sizes, max_repeat, towards_equal)
    most, z = sizes.agg(F.max("t"), F.sum(F.col("n") * F.pow(F.col("t").cast("double"), F.lit(alpha)))).first()
    most, z = most or 1, z or 1.0
    budget = most / (most**alpha / z)
    weight = F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(alpha)) / z).otherwise(F.lit(0.0))
    quota = F.floor(weight * budget * (1 + 1e-12))
    plan = sources.select("source", "t", weight.alias("weight"), quota.alias("quota"))
    plan = plan.withColumn("passes", F.when(F.col("t") > 0, F.expr("quota div t")).otherwise(F.lit(1).cast("long")))
    plan = small(stored(plan.withColumn("left", F.col("quota") - F.col("passes") * F.col("t")), "plan")).withColumnRenamed("source", "_source")
    same = lambda df: df["source"].eqNullSafe(plan["_source"])
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("b"))
    upto = sums.withColumn("after", F.sum("b").over(Window.partitionBy("source").orderBy("block")))
    last = upto.join(plan, same(upto)).filter("t > 0 AND after > left AND after - b <= left")
    # the first such block is the one in which the budget ends; blocks without tokens add none
    last = stored(last.groupBy("_source").agg(F.min(F.struct("block", (F.col("left") - F.col("after") + F.col("b")).alias("room"))).alias("e")).select("_source", "e.block", "e.room"), "ends")
    inside = rows.join(small(last).withColumnRenamed("block", "_block"), rows["source"].eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    running = F.sum("n_tokens").over(Window.partitionBy("_source").orderBy("_h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inside.withColumn("sum", running).groupBy("_source", "_block").agg(F.max(F.when(F.col("sum") <= F.col("room"), F.col("_h"))).alias("cut"))
    cuts = small(stored(plan.join(cut.withColumnRenamed("_source", "_s"), plan["_source"].eqNullSafe(F.col("_s")), "left").drop("_s"), "cuts")).withColumnRenamed("_source", "_key")
    out = plain.withColumn("n_tokens", tokens).withColumn("_h", order).withColumn("block", block)
    out = out.join(cuts, out["source"].eqNullSafe(F.col("_key")), "left")
    extra = (F.col("block") < F.col("_block")) | ((F.col("block") == F.col("_block")) & (F.col("_h") <= F.col("cut")))
    copies = F.col("passes") + F.when(extra, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).drop("_h", "_key", "t", "quota", "passes", "left", "_block", "cut")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(docs).select("doc_id", "source", "n_tokens", "block", F.round("weight", 9).alias("weight"), "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture holds it."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    return mixture(packed).select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
