"""What SQL does not express: sequential list rules, dynamic programmes and iterative fits. Each runs on one bounded group or grid."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.plans import catalogue, dialect

LIST_LENGTH = 200


def gamma(i: int) -> float:
    """The discount of 0-based rank i."""
    return 1 / (1 + math.log(1 + i))


def coin(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) & 1


def team_draft(a: Sequence[int], b: Sequence[int], toss: Callable[[int], int]) -> list[tuple[int, bool, int, int]]:
    """(item, drawn from a, rank in a, rank in b) until either list has nothing new; the side with fewer picks is next, a toss breaks ties."""
    rank_a, rank_b = {x: i for i, x in enumerate(a, 1)}, {x: i for i, x in enumerate(b, 1)}
    out: list[tuple[int, bool, int, int]] = []
    seen: set[int] = set()
    picks = [0, 0]
    while True:
        heads = [next((x for x in side if x not in seen), None) for side in (a, b)]
        if None in heads:
            return out
        from_a = picks[0] < picks[1] or picks[0] == picks[1] and toss(len(out)) == 1
        item = heads[0] if from_a else heads[1]
        picks[not from_a] += 1
        seen.add(item)
        out.append((item, from_a, rank_a.get(item, 0), rank_b.get(item, 0)))


def stable_slots(new: Sequence, old: Sequence) -> list:
    """New items keep their slots; the others' slots are filled by the old list in its order; at least two old items if there are."""
    known, rest, out, used = set(old), list(old), [], 0
    for x in new:
        if x not in known:
            out.append(x)
        elif rest:
            out.append(rest.pop(0))
            used += 1
    if used < 2 and rest:
        out.append(rest.pop(0))
    return out


def stable_merge(new: Sequence, old: Sequence, length: int) -> list:
    """Old items and those that are new, each in their order, in proportion to their numbers."""
    a = list(old)
    b = [x for x in new if x not in set(old)]
    share = len(b) / max(1, len(a) + len(b))
    out, na, nb = [], 0, 0
    while len(out) < length and (na < len(a) or nb < len(b)):
        if na == len(a) or nb < len(b) and nb + 1 <= (na + nb + 1) * share:
            out.append(b[nb])
            nb += 1
        else:
            out.append(a[na])
            na += 1
    return out


def feedback_coefficients(items: Sequence[int], verdicts: dict[int, str], orphan: bool, drop: int = 10) -> tuple[dict[int, float], list[int]]:
    """Coefficient of each item and the corrected order, from a list shown in pairs and the verdicts VIEWED, PROMOTED or DEMOTED."""
    hit = lambda x: verdicts.get(x) in ("VIEWED", "PROMOTED")
    order, rho = list(items), dict.fromkeys(items, 0.0)
    for j in range(1 if orphan else 0, len(order) - 1, 2):
        upper, lower = order[j], order[j + 1]
        if hit(lower) and not hit(upper):
            order[j], order[j + 1] = lower, upper
        elif hit(upper) and not hit(lower):
            step = gamma(j) - gamma(j + 1)
            rho[upper] += step
            rho[lower] += step
    head = [x for x in order if verdicts.get(x) == "PROMOTED"]
    rest = [x for x in order if verdicts.get(x) != "PROMOTED"]
    down = lambda x: verdicts.get(x) == "DEMOTED"
    tail = [x for x in reversed(rest[-drop:]) if down(x)]
    for j in range(len(rest) - 1, -1, -1):
        if j - drop >= 0 and down(rest[j - drop]):
            tail.append(rest[j - drop])
        if not down(rest[j]):
            tail.append(rest[j])
    final = head + tail[::-1]
    for new_rank, x in enumerate(final):
        old_rank = items.index(x)
        if new_rank != old_rank:
            rho[x] += gamma(new_rank) - gamma(old_rank)
    return rho, final


def greedy_utility(linear: np.ndarray, terms: np.ndarray, signs: np.ndarray, most: int = 200) -> list[int]:
    """Order of documents that greedily adds the most: gamma * linear + sum over terms of +-(sqrt(phi + gamma * b) - sqrt(phi))."""
    phi, left, out = np.zeros(terms.shape[1]), list(range(len(linear))), []
    while left and len(out) < most:
        g = gamma(len(out))
        gain = g * linear[left] + ((np.sqrt(phi + g * terms[left]) - np.sqrt(phi)) * signs).sum(axis=1)
        best = left.pop(int(np.argmax(gain)))
        phi += g * terms[best]
        out.append(best)
    return out


def lazy_greedy(linear: np.ndarray, terms: np.ndarray, signs: np.ndarray, most: int = 200) -> tuple[list[int], int]:
    """The order of greedy_utility and the number of gains that it took, far fewer: an item's gain is found anew only while its bound may win.

    What the positive terms add falls as weights are added and places go down, and what the others take away is at most nothing; so the positive part when it was
    last found, plus the linear part there, bounds all later gains. The bounds are a heap; of equal gains the earlier item wins.
    """
    up = signs > 0
    phi, out, taken = np.zeros(terms.shape[1]), [], 0
    heap = [(-np.inf, i) for i in range(len(linear))]
    while heap and len(out) < most:
        g = gamma(len(out))
        best, tried = None, []
        while heap and (best is None or (heap[0][0], heap[0][1]) < best):
            _, i = heapq.heappop(heap)
            rise = np.sqrt(phi + g * terms[i]) - np.sqrt(phi)
            plus = float(rise[up].sum())
            gain = g * float(linear[i]) + float((rise * signs).sum())
            taken += 1
            tried.append((-(g * max(float(linear[i]), 0.0) + plus), i))
            best = min(best or (np.inf, -1), (-gain, i))
        for bound, i in tried:
            if i != best[1]:
                heapq.heappush(heap, (bound - 1e-12, i))
        phi += g * terms[best[1]]
        out.append(best[1])
    return out, taken


def lazy_greedy_cells(items: list[tuple[np.ndarray, np.ndarray]], terms: int, most: int = 200) -> tuple[list[int], int]:
    """lazy_greedy of items (places of terms, weights above 0 there) whose linear part is the sum of their weights, so that a gain takes an item's own terms alone."""
    linear = [float(x.sum()) for _, x in items]
    phi, roots, out, taken = np.zeros(terms), np.zeros(terms), [], 0
    heap = [(-np.inf, i) for i in range(len(items))]
    while heap and len(out) < most:
        g = gamma(len(out))
        best, tried = None, []
        while heap and (best is None or heap[0] < best):
            _, i = heapq.heappop(heap)
            at, x = items[i]
            now = g * x
            now += phi.take(at)
            np.sqrt(now, now)
            now -= roots.take(at)
            gain = g * linear[i] + float(np.add.reduce(now))
            taken += 1
            tried.append((-gain, i))
            best = min(best or (np.inf, -1), (-gain, i))
        for bound, i in tried:
            if i != best[1]:
                heapq.heappush(heap, (bound - 1e-12, i))
        at, x = items[best[1]]
        phi[at] += g * x
        roots[at] = np.sqrt(phi[at])
        out.append(best[1])
    return out, taken


#: Steps of the backward induction.
HORIZON = 1000


def optimal_stopping(alpha: float, beta: float, gamma_: float, cost: float, horizon: int) -> float:
    """Value of going on from Beta(alpha, beta) at the given cost a step, by backward induction over the successes so far."""
    i = np.arange(horizon + 1)
    m = (alpha + i) / (alpha + beta + horizon)
    w = np.maximum((m - cost) / (1 - gamma_), 0)
    for n in range(horizon - 1, -1, -1):
        m = (alpha + i[: n + 1]) / (alpha + beta + n)
        w = np.maximum(m - cost + gamma_ * (m * w[1 : n + 2] + (1 - m) * w[: n + 1]), 0)
    return float(w[0])


def index_of(alpha: float, beta: float, gamma_: float, horizon: int = 200, steps: int = 30) -> float:
    """The cost at which going on is worth nothing: the index of a Beta(alpha, beta) arm."""
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if optimal_stopping(alpha, beta, gamma_, mid, horizon) > 1e-12 else (low, mid)
    return (low + high) / 2


def stopping_mean(alpha: float, beta: float, gamma_: float, cost: float, horizon: int = 300) -> float:
    """Between the largest posterior mean at which one stops and the smallest at which one goes on, for alpha + beta observations."""
    total = alpha + beta
    low, high = 0.0, 1.0
    for _ in range(30):
        mid = (low + high) / 2
        on = optimal_stopping(mid * total, (1 - mid) * total, gamma_, cost, horizon) > 1e-12
        low, high = (low, mid) if on else (mid, high)
    return (low + high) / 2


def stopping_means_at(totals: np.ndarray, gammas: np.ndarray, cost: float, horizon: int) -> np.ndarray:
    """stopping_mean for many totals and discounts side by side.

    A state whose mean stays at the cost or above even if all observations to come fail is never left, so its value is that of going on for ever,
    (mean - cost) / (1 - gamma) at any step: the induction runs over the successes below these states only.
    """
    low, high = np.zeros(len(totals)), np.ones(len(totals))
    for _ in range(30):
        mid = (low + high) / 2
        alpha = mid * totals
        below = int(np.clip(np.ceil(cost * (totals + horizon) - alpha).max(initial=0), 0, horizon))
        up = alpha + np.arange(below + 2)[:, None]
        w = np.maximum((up / (totals + horizon) - cost) / (1 - gammas), 0)
        for n in range(horizon - 1, -1, -1):
            m = up / (totals + n)
            last = min(below, n) + 1
            w[:last] = np.maximum(m[:last] - cost + gammas * (m[:last] * w[1 : last + 1] + (1 - m[:last]) * w[:last]), 0)
            w[below + 1] = (m[below + 1] - cost) / (1 - gammas)
        on = w[0] > 1e-12
        low, high = np.where(on, low, mid), np.where(on, mid, high)
    return (low + high) / 2


def kalman(mu: np.ndarray, sigma: np.ndarray, x: np.ndarray, y: float, noise: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    k = sigma @ x / (x @ sigma @ x + noise**2)
    return mu + k * (y - x @ mu), sigma - np.outer(k, x @ sigma)


def digamma(x: float | np.ndarray) -> float | np.ndarray:
    """Of positive numbers, by the recurrence up to 6, then the asymptotic series."""
    x, shift = np.array(x, float), 0.0
    for _ in range(6):
        low = x < 6
        shift = shift - np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    inv = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def longest_match(tokens: Sequence[str], vocabulary: dict[tuple[str, ...], int], clusters: int) -> list[int]:
    """How often each cluster's entries occur: at each place the longest entry that begins there, then on behind it."""
    counts, longest, i = [0] * clusters, max(map(len, vocabulary), default=0), 0
    while i < len(tokens):
        for n in range(min(longest, len(tokens) - i), 0, -1):
            c = vocabulary.get(tuple(tokens[i : i + n]))
            if c is not None:
                counts[c] += 1
                i += n
                break
        else:
            i += 1
    return counts


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run(dialect.Query(f"SELECT uid, aid, score, rn FROM ranked_page WHERE rn <= {LIST_LENGTH}"), spark, sf_dir)


def team_draft_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's list interleaved with that of the next user."""
    own = _lists(spark, sf_dir)
    both = own.select("uid", "aid", "rn", F.lit(0).alias("side")).union(own.select(F.col("uid") - 1, "aid", "rn", F.lit(1)))

    def draft(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[rows.side == s].sort_values("rn").aid.tolist() for s in (0, 1))
        out = team_draft(a, b, lambda i: coin(f"{key[0]}/{i}"))
        return pd.DataFrame([(key[0], i, *x) for i, x in enumerate(out, 1)], columns=["uid", "rn", "aid", "from_a", "arank", "brank"])

    return both.groupBy("uid").applyInPandas(draft, "uid long, rn int, aid long, from_a boolean, arank int, brank int")


def stable_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of all actions, in the slots and in the proportion that the list of those before the 20th allows."""
    new = _lists(spark, sf_dir).filter("rn <= 20").select("uid", "aid", "rn", F.lit(0).alias("side"))
    old = dialect.run(dialect.Query("SELECT uid, aid, max(id) AS last FROM act WHERE w > 0 AND t < TIMESTAMP '2024-01-20 00:00:00' GROUP BY uid, aid"), spark, sf_dir)
    old = old.withColumn("rn", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("last")))).filter("rn <= 20").select("uid", "aid", "rn", F.lit(1).alias("side"))

    def order(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, o = (rows[rows.side == s].sort_values("rn").aid.tolist() for s in (0, 1))
        made = [("slots", stable_slots(n, o)), ("merge", stable_merge(n, o, len(n)))]
        return pd.DataFrame([(key[0], mode, i, x) for mode, xs in made for i, x in enumerate(xs, 1)], columns=["uid", "mode", "rn", "aid"])

    return new.union(old).groupBy("uid").applyInPandas(order, "uid long, mode string, rn int, aid long")


def feedback_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of each user's list from the verdicts on its items, by the rule of feedback_class: the last judgement, else a view."""
    rows = _lists(spark, sf_dir).join(dialect.run(catalogue.QUERIES["feedback_class"], spark, sf_dir), ["uid", "aid"], "left")

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rn")
        rho, final = feedback_coefficients(rows.aid.tolist(), {a: v for a, v in zip(rows.aid, rows.verdict, strict=True) if v}, coin(f"top{key[0]}") == 1)
        return pd.DataFrame([(key[0], x, i, round(rho[x], 9)) for i, x in enumerate(final, 1)], columns=["uid", "aid", "rn", "rho"])

    return rows.groupBy("uid").applyInPandas(learn, "uid long, aid long, rn int, rho double")


def arm_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index, stopping mean and mean of every distinct pair of counts, each solved by itself over the reference's horizon."""
    arms = dialect.run(dialect.Query("SELECT DISTINCT 1 + up AS alpha, 1 + down AS beta FROM (SELECT aid, sum(CASE WHEN op >= 100 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN op < 0 THEN 1 ELSE 0 END) AS down FROM act GROUP BY aid) x"), spark, sf_dir)

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            pairs = list(zip(b.alpha, b.beta, strict=True))
            yield pd.DataFrame({"alpha": b.alpha.astype("int64"), "beta": b.beta.astype("int64"), "mean": [x / (x + y) for x, y in pairs], "nu": [round(index_of(x, y, 0.9, HORIZON), 5) for x, y in pairs], "mu_star": [round(stopping_mean(x, y, 0.9, 0.5, HORIZON), 5) for x, y in pairs]})

    return arms.select(F.col("alpha").cast("long"), F.col("beta").cast("long")).repartition("alpha", "beta").mapInPandas(solve, "alpha long, beta long, mean double, nu double, mu_star double")


def kalman_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior mean of each user's weights over the embedding of the articles, actions in order; a user's state is 64 x 64 numbers."""
    acts = dialect.run(dialect.Query("SELECT uid, id, aid, op FROM act"), spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("aid"), "embedding")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mu, sigma = np.zeros(64), np.eye(64)
        for x, op in zip(rows.sort_values("id").embedding, rows.sort_values("id").op, strict=True):
            mu, sigma = kalman(mu, sigma, np.asarray(x, float), 1.0 if op > 0 else -1.0)
        return pd.DataFrame([(key[0], len(rows), float(np.linalg.norm(mu)), float(np.trace(sigma)))], columns=["uid", "n", "norm", "trace"])

    return acts.join(vectors, "aid").groupBy("uid").applyInPandas(fit, "uid long, n long, norm double, trace double")


def kmeans_lloyd(spark: SparkSession, sf_dir: str, rounds: int = 5) -> DataFrame:
    """Assignment after some rounds of Lloyd's from the mean of the lowest five ids of each label; a round is an aggregation, centres are k x 64."""
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    first = points.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("rn <= 5")

    def means(assigned: DataFrame) -> list[tuple[int, list[float]]]:
        got = assigned.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
        return sorted((r.label, [p.v for p in r.c]) for r in got.collect())

    assigned = first
    for _ in range(rounds):
        centres = means(assigned)
        distance = [F.struct(F.aggregate(F.zip_with("x", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d).alias("d"), F.lit(k).alias("label")) for k, c in centres]
        assigned = points.select("vec_id", "x", F.array_min(F.array(*distance)).alias("m")).select("vec_id", "x", F.col("m.label").alias("label"), F.col("m.d").alias("d"))
    return assigned.select("vec_id", "label", F.round("d", 6).alias("d"))


def topic_means(spark: SparkSession, sf_dir: str, alpha: float = 0.1) -> DataFrame:
    """Share and expected log share of each term group (first letter) of each document under a symmetric Dirichlet prior."""
    counts = dialect.run(dialect.Query("SELECT aid, substr(term, 1, 1) AS topic, CAST(sum(tf) AS BIGINT) AS c FROM posting WHERE substr(term, 1, 1) IN ('a', 'e', 'i', 'o', 't') GROUP BY aid, substr(term, 1, 1)"), spark, sf_dir)
    total = counts.withColumn("s", F.sum("c").over(Window.partitionBy("aid")) + 5 * alpha).withColumn("a", F.col("c") + alpha)

    @F.pandas_udf("double")
    def psi(x: pd.Series) -> pd.Series:
        return pd.Series(digamma(x.to_numpy()))

    return total.select("aid", "topic", F.round(F.col("a") / F.col("s"), 8).alias("theta"), F.round(psi("a") - psi("s"), 6).alias("log_theta"))


def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster counts of each article by longest match of a small vocabulary of one to three words."""
    entries = {("the",): 0, ("of",): 1, ("of", "the"): 2, ("and", "the"): 3, ("in", "the", "of"): 4, ("in",): 5}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("aid"), F.coalesce("text", F.lit("")).alias("text"))

    @F.pandas_udf("array<int>")
    def match(texts: pd.Series) -> pd.Series:
        import re

        return texts.map(lambda t: longest_match([w for w in re.split(r"[\W_]+", t.lower().strip()) if w], entries, 6))

    return docs.select("aid", match("text").alias("m")).select("aid", *[F.get("m", F.lit(k)).alias(f"c{k}") for k in range(6)])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (team_draft_lists, stable_lists, feedback_lists, arm_indices, kalman_profiles, kmeans_lloyd, topic_means, vocabulary_counts)
    return {f.__name__: f for f in made}
