"""Truncated singular values of the user x article matrix, models on it, and profiles moved by feedback."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.query_syntax import parse, predicate
from tributary.operators import kernels, similarity
from tributary.plans import dialect
from tributary.plans.profiles import acted_vectors
from tributary.plans.vectors import by_user
from tributary.sources.scratch import BROADCAST_BYTES, kept, new_path, sized


def _kept(df: DataFrame, tag: str) -> DataFrame:
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def singular(cells: DataFrame, k: int = 5, rounds: int = 12) -> tuple[np.ndarray, DataFrame]:
    """The k largest singular values of a 0/1 matrix and its right vectors (col, x0 .. ), by subspace iteration on AᵀA.

    cells: row, col, distinct. A round is two joins and two aggregations of narrow rows; only the k x k products of the vectors come to
    the driver. The start is made of hashes, so results repeat; k columns are made orthogonal each round by a Cholesky factor.
    """
    xs = [f"x{i}" for i in range(k)]
    start = [(F.pmod(F.xxhash64("col", F.lit(i)), F.lit(2001)) / 1000.0 - 1).alias(x) for i, x in enumerate(xs)]
    v = cells.select("col").distinct().select("col", *start)
    values = np.zeros(k)
    for _ in range(rounds):
        # the products of the columns, k x k numbers
        v = _kept(v, "vectors")
        got = v.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in xs for b in xs]).first()
        gram = np.array([float(x or 0) for x in got]).reshape(k, k)
        values = np.sqrt(np.sqrt(np.maximum(np.sort(np.linalg.eigvalsh(gram))[::-1], 0)))
        rank = int((np.linalg.eigvalsh(gram) > 1e-12 * max(1.0, np.trace(gram))).sum())
        if rank < k:
            gram = gram + np.eye(k) * 1e-12 * max(1.0, np.trace(gram))
        turn = np.linalg.inv(np.linalg.cholesky(gram)).T
        v = v.select("col", *[sum((F.col(a) * float(turn[i, j]) for i, a in enumerate(xs)), F.lit(0.0)).alias(b) for j, b in enumerate(xs)])
        u = cells.join(v, "col").groupBy("row").agg(*[F.sum(x).alias(x) for x in xs])
        v = cells.join(u, "row").groupBy("col").agg(*[F.sum(x).alias(x) for x in xs])
    return values, v


def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The singular values of who looked at what."""
    cells = _kept(dialect.run(dialect.Query("SELECT DISTINCT uid AS row, aid AS col FROM act WHERE kind IN ('view', 'click') AND aid IS NOT NULL"), spark, sf_dir), "cells")
    values, _ = singular(cells)
    return spark.createDataFrame([(i, round(float(s), 4)) for i, s in enumerate(values)], "place int, value double")


def rocchio_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after feedback: each term's weight plus the coefficients of the list's articles times their vectors; negative terms stay."""
    pages = dialect.run(dialect.Query("SELECT uid, aid, 1 / (1 + ln(rn)) AS g FROM ranked_page WHERE aid IS NOT NULL"), spark, sf_dir)
    moved = kernels.feedback_lists(spark, sf_dir).filter("rho <> 0").select("uid", "aid", F.col("rho").alias("g"))
    weighed = by_user(kept(pages.unionByName(moved), "pages")).join(sized(acted_vectors(spark, sf_dir), "aid", "term", "x"), "aid")
    return weighed.groupBy("part", "uid", "term").agg(F.round(F.sum(F.col("g") * F.col("x")), 6).alias("w1")).drop("part")


def similarity_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's expected approval from those of similar articles: similarity-weighted mean of votes, and the votes' weight in millionths."""
    votes = dialect.run(dialect.Query("SELECT aid AS b, sum(CASE WHEN op >= 100 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN op >= 100 OR op < 0 THEN 1 ELSE 0 END) AS n FROM act WHERE aid IS NOT NULL GROUP BY aid"), spark, sf_dir)
    # only articles with votes are partners, so no other pairs are made
    votes = kept(votes.filter("n > 0"), "votes")
    vectors = similarity.grouped(spark, sf_dir)
    known = kept(vectors.join(sized(votes, "b"), F.col("aid") == F.col("b"), "left_semi").select("grp", "term", F.col("aid").alias("b"), F.col("x").alias("y")), "voted")
    other = F.broadcast(known) if known._rows * 48 <= BROADCAST_BYTES else known
    pairs = vectors.join(other, ["grp", "term"]).filter("aid <> b").groupBy(F.col("aid").alias("a"), "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("s"))
    near = pairs.filter(F.col("s") >= similarity.LEAST).join(sized(votes, "b", "up", "n"), "b")
    # whole millionths: sums do not depend on their order
    weight = F.round(F.col("s") * 1_000_000).cast("long")
    sums = near.groupBy("a").agg(F.sum(weight * F.col("up")).alias("up"), F.sum(weight * F.col("n")).alias("weight"))
    return sums.select(F.col("a").alias("aid"), F.round(F.col("up") / F.col("weight"), 6).alias("p"), "weight")


SEARCHES = ("the of thing", '"in the"', "stat* category:en", "category:de.src1 und")


def query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that meet each of some queries; all queries in one pass over the texts."""
    rows = dialect.run(dialect.Query("SELECT aid, cat, coalesce(body, '') AS body FROM article"), spark, sf_dir)
    met = F.array(*[F.when(predicate(parse(q), {"article": F.col("body")}, F.col("cat")), F.lit(q)) for q in SEARCHES])
    return rows.select("aid", F.explode(F.array_compact(met)).alias("query"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (singular_values, rocchio_profiles, similarity_priors, query_search)}


PADDED = r"concat(' ', @REALL(lower(coalesce(body, '')), '[^\p{L}\p{Nd}]+', ' '), ' ')"


def oracle_sql() -> dict[str, str]:
    priors = f"""SELECT z.a AS aid, round(sum(m * up) / CAST(sum(m * n) AS DOUBLE), 6) AS p, CAST(sum(m * n) AS BIGINT) AS weight FROM (SELECT a, b, CAST(round(s * 1000000) AS BIGINT) AS m FROM ({similarity.PAIRS}) y WHERE s >= {similarity.LEAST}) z
        JOIN (SELECT aid, sum(CASE WHEN op >= 100 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN op >= 100 OR op < 0 THEN 1 ELSE 0 END) AS n FROM act GROUP BY aid) w ON z.b = w.aid WHERE n > 0 GROUP BY z.a"""
    search = f"""SELECT aid, '{SEARCHES[0]}' AS query FROM t WHERE words LIKE '% thing %'
        UNION ALL SELECT aid, '{SEARCHES[1]}' FROM t WHERE words LIKE '% in the %' UNION ALL SELECT aid, '{SEARCHES[2]}' FROM t WHERE words LIKE '% stat%' AND cat LIKE 'en%'
        UNION ALL SELECT aid, '{SEARCHES[3]}' FROM t WHERE words LIKE '% und %' AND cat LIKE 'de.src1%'"""
    return {
        "similarity_priors": dialect.text(dialect.Query(priors)),
        "query_search": dialect.text(dialect.Query(search, f"t AS (SELECT aid, cat, {PADDED} AS words FROM article)")),
    }
