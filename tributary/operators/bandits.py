"""Tables of the bandit programmes, lists from them, lookups that interpolate, and Poisson factors of users."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators.kernels import digamma, index_of, stopping_means_at
from tributary.operators.sampling import numbered
from tributary.plans import catalogue, dialect
from tributary.sources import triangular
from tributary.sources.scratch import kept, new_path, sized

#: Observations and steps of cost of the table of forwarding costs; the cost of a user's time; articles in a list.
HORIZON, GRID, COST, MOST = 1000, 100, 0.05, 100
#: Programmes solved side by side; bounds memory, not results.
AT_ONCE = 256
#: Discount, places and shares of the packed tables.
GAMMA, DEPTH, SHARES = 0.99, 10, (0.05, 0.2, 0.5, 0.8, 1.0)
#: The grid of the table of indices.
AXES = {"gamma": (0.5, 0.8, 0.9, 0.95), "beta": (1.0, 2.0, 5.0, 10.0, 20.0), "alpha": (1.0, 2.0, 5.0, 10.0, 20.0)}


def forwarding_costs(discount: float, horizon: int = HORIZON, grid: int = GRID) -> Iterable[tuple[int, np.ndarray]]:
    """(n, costs) for n = horizon to 0 observations: for each number of successes the share of costs 0, 1 / grid, ... 1 at which an item that
    began as Beta(1, 1) is still worth showing. After the last observation the choice holds for ever, and a cost of 0 counts for nothing."""
    cost = np.arange(1, grid + 1)[:, None] / grid
    gain = (1 + np.arange(horizon + 1)) / (2 + horizon) - cost
    yield horizon, (gain > 0).sum(axis=0) / grid
    value = np.maximum(gain, 0) / (1 - discount)
    for n in range(horizon - 1, -1, -1):
        mean = (1 + np.arange(n + 1)) / (2 + n)
        gain = mean - cost + discount * ((1 - mean) * value[:, : n + 1] + mean * value[:, 1 : n + 2])
        yield n, (1 + (gain > 0).sum(axis=0)) / grid
        value = np.maximum(gain, 0)


def costs_of(states: DataFrame, horizon: int = HORIZON, grid: int = GRID) -> DataFrame:
    """gamma, alpha, beta, cost of the distinct states (alpha and beta of horizon observations at most). A task solves the table of a discount and hands on the rows asked for."""

    def solve(asked: pd.DataFrame) -> pd.DataFrame:
        discount = asked.gamma.iloc[0]
        by = {n: x for n, x in asked.groupby(asked.alpha + asked.beta - 2)}
        return pd.concat([by[n].assign(cost=costs[by[n].alpha - 1]) for n, costs in forwarding_costs(discount, horizon, grid) if n in by])

    # a number of partitions, as so few bytes would else go to one task
    asked = states.select(F.col("gamma").cast("double"), "alpha", "beta").distinct().repartition(states.sparkSession.sparkContext.defaultParallelism, "gamma")
    return asked.groupBy("gamma").applyInPandas(solve, "gamma double, alpha long, beta long, cost double")


def stopping_means(totals: DataFrame, cost: float = COST, horizon: int = HORIZON) -> DataFrame:
    """gamma, total, mu: the mean from which an item with so many counts behind it, prior ones included, is worth showing at the cost."""

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                b = batch.iloc[i : i + AT_ONCE]
                yield b.assign(mu=stopping_means_at(b.total.to_numpy(float), b.gamma.to_numpy(), cost, horizon))

    asked = totals.select(F.col("gamma").cast("double"), F.col("total").cast("long")).distinct()
    # a number of partitions, as so few bytes would else go to one task; by the columns themselves it can fall together with distinct()'s
    return asked.repartition(totals.sparkSession.sparkContext.defaultParallelism, F.xxhash64("gamma", "total")).mapInPandas(solve, "gamma double, total long, mu double")


def admitted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's list: the newest MOST articles of those categories of theirs whose mean reaches the stopping mean at COST, by descending forwarding cost.

    Counts are those of alpha_beta. Beyond the horizon of the table of forwarding costs the mean stands for the cost. A category's newest MOST articles can fill a
    list alone, so no others meet its users: each category brings the ascending numbers of its articles in one row, and a user takes the least MOST of theirs. Ties go by a hash.
    """
    volumes = dialect.run(dialect.Query("SELECT cat, 1 - 1 / (12.0 * greatest(1, round(count(*) / 13.0)) + 1) AS gamma FROM article GROUP BY cat"), spark, sf_dir)
    users = dialect.run(catalogue.QUERIES["alpha_beta"], spark, sf_dir).join(volumes, "cat").withColumns({"gamma": F.col("gamma").cast("double"), "total": F.col("alpha") + F.col("beta")})
    users = kept(users, "states")
    mean = F.col("alpha") / F.col("total")
    means = kept(stopping_means(users), "means")
    worth = kept(users.join(sized(means, "gamma", "total", "mu"), ["gamma", "total"]).filter(mean >= F.col("mu")).drop("mu"), "worth")
    costs = kept(costs_of(worth.filter(F.col("total") <= HORIZON + 2)), "costs")
    admitted = worth.join(sized(costs, "gamma", "alpha", "beta", "cost"), ["gamma", "alpha", "beta"], "left").select("uid", "cat", F.coalesce("cost", mean).alias("cost"))
    seen = dialect.run(dialect.Query("SELECT r.aid, r.cat, max(a.id) AS last_id FROM article r LEFT JOIN act a ON r.aid = a.aid GROUP BY r.aid, r.cat"), spark, sf_dir)
    newest = [F.desc_nulls_last("last_id"), F.col("aid")]
    fresh = kept(seen.withColumn("place", F.row_number().over(Window.partitionBy("cat").orderBy(*newest))).filter(F.col("place") <= MOST).select("aid", "cat", "last_id"), "fresh", "cat")
    # newest first by one number: articles with actions by their last, then the others
    acted, others = fresh.filter("last_id IS NOT NULL").select("aid", "cat", (-F.col("last_id")).alias("at")), fresh.filter("last_id IS NULL").select("aid", "cat", F.col("aid").alias("at"))
    acted, others = numbered(acted, "at", "n", "aid"), numbered(others, "at", "n").withColumn("n", F.col("n") + fresh._rows)
    placed = kept(acted.union(others).select("aid", "cat", "n"), "placed", "cat")
    heads = kept(placed.groupBy("cat").agg(F.array_sort(F.collect_list("n")).alias("numbers")), "heads")
    heads._bytes = placed._bytes + 8 * placed._rows
    own = admitted.repartition("uid").join(sized(heads, "cat", "numbers"), "cat").groupBy("uid").agg(F.collect_list(F.struct("cost", "numbers")).alias("own"))
    width = F.size("own")
    # a number and the place of its category in one
    marked = F.flatten(F.transform("own", lambda x, i: F.transform(x["numbers"], lambda v: v * width + i)))
    least = F.transform(F.slice(F.sort_array(marked), 1, MOST), lambda v: F.struct(F.call_function("div", v, width).alias("n"), F.get(F.col("own")["cost"], (v % width).cast("int")).alias("cost")))
    listed = own.select("uid", F.inline(least)).join(sized(placed, "n", "aid"), "n")
    by = Window.partitionBy("uid").orderBy(F.desc("cost"), F.md5(F.concat_ws("/", "uid", "aid")), "aid")
    return listed.select("uid", "aid", F.row_number().over(by).alias("rn"), "cost")


def queue_table(spark: SparkSession, horizon: int, depth: int, grid: int = GRID) -> DataFrame:
    """Rows of triangular.SCHEMA: forwarding costs of the u-th item of a queue, for each share in SHARES. One task solves the programmes of a share.

    The published tables are no part of this library; these stand in for them: an item behind u others, of a category of which a share of the
    time passes without an item, is worth what a programme with the discount GAMMA ** (1 + u * share) says, so that later items and rarer categories learn less.
    """

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for share in batch.xi:
                programmes = [forwarding_costs(GAMMA ** (1 + u * share), horizon, grid) for u in range(depth + 1)]
                for layers in zip(*programmes):
                    n = layers[0][0]
                    costs = np.stack([c for _, c in layers], axis=1).astype("f4")
                    i = np.arange(n + 1)
                    yield pd.DataFrame({"gamma": GAMMA, "xi": share, "alpha0": 1.0, "beta0": 1.0, "i": i.astype("i4"), "j": (n - i).astype("i4"), "values": list(costs)})

    shares = spark.createDataFrame([(x,) for x in SHARES], "xi double").repartition(len(SHARES), "xi")
    return shares.mapInPandas(solve, triangular.SCHEMA)


def queued_lists(spark: SparkSession, sf_dir: str, horizon: int = HORIZON, depth: int = DEPTH, days: int = 90) -> DataFrame:
    """Each user's MOST best articles of their categories of the last days, by the packed tables: at a category's share, interpolated, the user's counts there and the article's place in the category.

    Articles of a category stand newest first, places beyond depth count as depth; of equal scores the newer article is the better, then the lower id.
    The newest MOST + depth of a category can fill a list alone, so no others meet its users.
    """
    folder = new_path(spark, "tables")
    triangular.write(queue_table(spark, horizon, depth), folder, horizon, depth).collect()  # a row a share
    known = sorted({p[1] for p in triangular.parameters(folder)})
    dates = dialect.run(
        dialect.Query(f"SELECT r.aid, r.cat, min(a.t) AS seen FROM article r JOIN act a ON r.aid = a.aid GROUP BY r.aid, r.cat HAVING min(a.t) > @NOW - INTERVAL '{days}' DAY"), spark, sf_dir
    )
    newest = [F.desc("seen"), F.col("aid")]
    ranked = kept(dates.withColumn("place", F.row_number().over(Window.partitionBy("cat").orderBy(*newest))).filter(F.col("place") <= MOST + depth), "newest")
    share = (1 / (1 + F.col("n") / float(days))).alias("share")
    shares = dates.groupBy("cat").agg(F.count("*").alias("n")).select("cat", share)
    low = F.array_max(F.filter(F.array(*map(F.lit, known)), lambda v: v <= F.col("share")))
    high = F.array_min(F.filter(F.array(*map(F.lit, known)), lambda v: v > F.col("share")))
    low, high = F.coalesce(low, F.lit(known[0])), F.coalesce(high, F.lit(known[-1]))
    weight = F.when(high == low, 0.0).otherwise(F.greatest((F.col("share") - low) / (high - low), F.lit(0.0)))
    ends = F.array(F.struct(low.alias("xi"), (1 - weight).alias("w")), F.struct(high.alias("xi"), weight.alias("w")))
    counts = dialect.run(catalogue.QUERIES["alpha_beta"], spark, sf_dir).select("uid", "cat", (F.col("alpha") - 1).cast("int").alias("i"), (F.col("beta") - 1).cast("int").alias("j"))
    states = counts.join(shares, "cat").select("uid", "cat", "i", "j", F.explode(ends).alias("end")).filter("end.w > 0").select("uid", "cat", "i", "j", F.col("end.xi").alias("xi"), F.col("end.w").alias("w"))
    states = kept(states.withColumns({"gamma": F.lit(GAMMA), "alpha0": F.lit(1.0), "beta0": F.lit(1.0)}), "states")
    found = triangular.lookup(states, folder, horizon, depth).select("xi", "i", "j", "values")
    by_place = states.join(found, ["xi", "i", "j"]).select("uid", "cat", F.posexplode("values").alias("u", "value"), "w")
    curves = by_place.groupBy("uid", "cat", "u").agg(F.sum(F.col("value") * F.col("w")).alias("score"))
    placed = ranked.withColumn("u", F.least("place", F.lit(depth)))
    listed = curves.join(placed, ["cat", "u"]).withColumn("score", F.round("score", 6))
    rn = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), *newest))
    return listed.withColumn("rn", rn).filter(F.col("rn") <= MOST).select("uid", "aid", "rn", "score")


def index_table(spark: SparkSession) -> DataFrame:
    """gamma, beta, alpha, value: the index at every point of AXES."""

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            yield b.assign(value=[index_of(x, y, g) for g, y, x in b.itertuples(index=False)])

    points = spark.createDataFrame(list(itertools.product(*AXES.values())), ", ".join(f"{a} double" for a in AXES))
    return points.repartition(*AXES).mapInPandas(solve, "gamma double, beta double, alpha double, value double")


def interpolated(points: DataFrame, table: DataFrame, axes: dict[str, Sequence[float]]) -> DataFrame:
    """points with `value`: linear between the neighbours along each axis in turn, held beyond the ends; null where a coordinate is.

    A point meets the corners of its cell by an equality join; columns of points are kept, with one row out for each row in.
    """
    key = [F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_row"), F.monotonically_increasing_id().alias("_n")]

    def ends(name: str, at: Sequence[float]) -> tuple[Column, Column]:
        x, values = F.col(f"_row.{name}").cast("double"), F.array(*map(F.lit, at))
        low = F.coalesce(F.array_max(F.filter(values, lambda v: v <= x)), F.lit(at[0]))
        high = F.coalesce(F.array_min(F.filter(values, lambda v: v > x)), F.lit(at[-1]))
        weight = F.when(high == low, 0.0).otherwise(F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)))
        return F.array(F.struct(low.alias("v"), (1 - weight).alias("w")), F.struct(high.alias("v"), weight.alias("w"))), x.isNotNull()

    rows = points.select(*key).withColumn("_w", F.lit(1.0))
    for name, at in axes.items():
        corners, known = ends(name, at)
        # the row itself stays where a coordinate is null: it has one corner without a place
        rows = rows.select("_row", "_n", "_w", *[f"_{a}" for a in axes if f"_{a}" in rows.columns], F.explode(F.when(known, corners).otherwise(F.array(F.struct(F.lit(None).cast("double").alias("v"), F.lit(1.0).alias("w"))))).alias("_c"))
        rows = rows.withColumn(f"_{name}", F.col("_c.v")).withColumn("_w", F.col("_w") * F.col("_c.w")).drop("_c").filter("_w > 0")
    grid = table.select(*[F.col(a).alias(f"_{a}") for a in axes], F.col("value").alias("_value"))
    found = rows.join(grid, [f"_{a}" for a in axes], "left").groupBy("_n").agg(F.first("_row").alias("_row"), F.sum(F.col("_w") * F.col("_value")).alias("value"))
    return found.select("_row.*", "value")


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every article from its votes, interpolated in a table over the discount and both counts."""
    points = dialect.run(
        dialect.Query(
            """SELECT r.aid, 1 - 1 / (12.0 * v.m + 1) AS gamma, 1 + coalesce(down, 0) AS beta, 1 + coalesce(up, 0) AS alpha FROM article r LEFT JOIN (SELECT aid,
            sum(CASE WHEN op >= 100 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN op < 0 THEN 1 ELSE 0 END) AS down FROM act GROUP BY aid) n ON r.aid = n.aid
            JOIN (SELECT cat, greatest(1, round(count(*) / 13.0)) AS m FROM article GROUP BY cat) v ON r.cat = v.cat"""
        ),
        spark,
        sf_dir,
    )
    points = points.select("aid", *[F.col(c).cast("double").alias(c) for c in AXES])
    return interpolated(points, index_table(spark), AXES).withColumn("value", F.round("value", 8))


def poisson_update(shape: np.ndarray, rate: np.ndarray, logs: np.ndarray, factor: float = 1e8) -> np.ndarray:
    """The shape of a user's factors after one more article. logs: expected logs of both halves of the article's factors, one row each.

    A softmax with one outcome of weight 1 beside the given ones: an article with negative logs only changes nothing.
    """
    a = digamma(shape) - np.log(rate) + factor * logs
    top = max(0.0, float(a.max()))
    return shape + np.exp(a - top - np.log(np.exp(-top) + np.exp(a - top).sum())).sum(axis=0)


def item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aid and the expectations and expected logs of both halves of its Gamma factors; shapes come from the signs of its embedding, scales are 1."""

    def expect(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            v = np.stack(b.embedding.to_list()).astype(float) if len(b) else np.zeros((0, 1))
            halves = [1 + 10 * np.maximum(s * v, 0) for s in (1, -1)]
            yield pd.DataFrame({"aid": b.aid, "mean": list(halves[0] + halves[1]), "theta_log": list(digamma(halves[0])), "epsilon_log": list(digamma(halves[1]))})

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("aid"), "embedding")
    return rows.mapInPandas(expect, "aid long, mean array<double>, theta_log array<double>, epsilon_log array<double>")


def poisson_users(spark: SparkSession, sf_dir: str, prior: float = 0.1) -> DataFrame:
    """Shape and expectation of each user's factors after the articles they viewed, in order, each article once."""
    items = item_factors(spark, sf_dir)
    totals = items.select(F.posexplode("mean").alias("k", "m")).groupBy("k").agg(F.sum("m").alias("rate")).orderBy("k").collect()  # as many rows as factors
    rate = prior + np.array([r.rate for r in totals])
    views = dialect.run(dialect.Query("SELECT uid, aid, min(id) AS id FROM act WHERE kind IN ('view', 'click') AND aid IS NOT NULL GROUP BY uid, aid"), spark, sf_dir)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shape = np.full(len(rate), prior)
        for r in rows.sort_values("id").itertuples():
            shape = poisson_update(shape, rate, np.stack([r.theta_log, r.epsilon_log]))
        return pd.DataFrame({"uid": key[0], "k": np.arange(len(rate)), "shape": np.round(shape, 6), "x": np.round(shape / rate, 9)})

    return views.join(items.drop("mean"), "aid").groupBy("uid").applyInPandas(fit, "uid long, k int, shape double, x double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (admitted_lists, queued_lists, index_lookup, poisson_users)}
