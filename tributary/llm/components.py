"""Distributed union-find: connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import drop_stored, small, stored


def _stars(edges: DataFrame) -> bool:
    """Whether each node above its root points to exactly one node, and roots to none: the fixed point."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("u", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up > 0 AND down > 0").limit(1).count()


def _joined(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows with the m of their v. least is a table, so that the join deals both sides out anew and AQE can split a hub's rows; a small one is broadcast."""
    return rows.join(small(least), "v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "least")
    out = stored(_joined(both, least).filter("u > v AND u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "large")
    drop_stored(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("v").agg(F.min("u").alias("m")), "least")
    moved = _joined(edges, least).filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    out = stored(moved.union(least.select("v", F.col("m").alias("u"))).distinct(), "small")
    drop_stored(least)
    return out


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node that it reaches.

    Nodes are longs. Null ends and self-links join nothing; repeated links count once; no links give no
    rows. Every round reads and writes tables in the shared folder; no join hangs on the partitioning of an aggregate, so the skew join
    can spread a hub of any degree. Rounds grow with the logarithm of the longest chain; running out of them raises.
    """
    edges = stored(
        links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(),
        "edges",
    )
    for _ in range(most_rounds):
        if _stars(edges):
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
                edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            )
        grown = _large_star(edges)
        drop_stored(edges)
        edges = _small_star(grown)
        drop_stored(grown)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


#: Members of one hand in dealt_pairs.
HAND = 8


def dealt_pairs(rest: DataFrame, node: str, step: int) -> DataFrame:
    """Pairs a < b of nodes: members of a bucket, dealt at random into hands of about HAND, each with its hand's first if of another component.

    rest: bucket, node, comp and n, the bucket's number of members. So the members of any bucket meet in linear work and no
    task holds a bucket; each step deals anew.
    """
    order = F.xxhash64(F.col(node), F.lit(step))
    hands = rest.select("bucket", node, "comp", "n").withColumn("hand", F.pmod(F.xxhash64(F.col(node), F.lit(step), F.lit("hand")), F.ceil(F.col("n") / HAND)))
    first = hands.groupBy("bucket", "hand").agg(F.min(order).alias("front"))
    lead = hands.join(first, ["bucket", "hand"]).filter(order == F.col("front")).select("bucket", "hand", F.col(node).alias("other"), F.col("comp").alias("other_comp"))
    met = hands.join(lead, ["bucket", "hand"]).filter("comp <> other_comp")
    return met.select(F.least(node, "other").alias("a"), F.greatest(node, "other").alias("b")).distinct()
