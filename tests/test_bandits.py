import itertools
import math

import numpy as np
import pytest

from tributary.operators import bandits as b
from tributary.operators import kernels as k
from tributary.plans import catalogue, registry
from tributary.plans.dialect import Query, run

DIR = "/root/testdata/sf0.001"


def test_one_step_of_a_profile():
    # published numbers of a single update: means 0.4, 0.7, a reward of 1.035 at (0.2, 0.8)
    mu, sigma = k.kalman(np.array([0.4, 0.7]), np.array([[0.2, 0.1], [0.1, 0.5]]), np.array([0.2, 0.8]), 1.035)
    assert mu == pytest.approx([0.528108, 1.14838], abs=1e-5)
    assert sigma.ravel() == pytest.approx([0.161081, -0.0362162, -0.0362162, 0.0232432], abs=1e-5)


def test_forwarding_costs_by_recursion():
    horizon, grid, g = 6, 20, 0.8

    def gain(up, n, cost):
        mean = (1 + up) / (2 + (horizon if n == horizon else n))
        if n == horizon:
            return mean - cost
        return mean - cost + g * ((1 - mean) * value(up, n + 1, cost) + mean * value(up + 1, n + 1, cost))

    def value(up, n, cost):
        return max(gain(up, n, cost), 0) / ((1 - g) if n == horizon else 1)

    for n, costs in b.forwarding_costs(g, horizon, grid):
        want = [((n < horizon) + sum(gain(i, n, c / grid) > 0 for c in range(1, grid + 1))) / grid for i in range(n + 1)]
        assert costs == pytest.approx(want)


def test_admitted_lists(spark):
    rows = registry.queries()["admitted_lists"](spark, DIR).collect()
    cats = {r.aid: r.cat for r in run(Query("SELECT aid, cat FROM article"), spark, DIR).collect()}
    n = {c: sum(x == c for x in cats.values()) for c in set(cats.values())}
    gammas = {c: 1 - 1 / (12 * max(1, math.floor(k / 13 + 0.5)) + 1) for c, k in n.items()}
    tables = {g: dict(b.forwarding_costs(g)) for g in set(gammas.values())}
    states = {(r.uid, r.cat): (r.alpha, r.beta) for r in run(catalogue.QUERIES["alpha_beta"], spark, DIR).collect()}
    mus = {(g, t): k.stopping_mean(t / 2, t / 2, g, b.COST, b.HORIZON) for g, t in {(gammas[c], x + y) for (_, c), (x, y) in states.items()}}
    worth = {key for key, (x, y) in states.items() if x / (x + y) >= mus[gammas[key[1]], x + y]}
    assert worth
    lists = {}
    for r in rows:
        key = r.uid, cats[r.aid]
        x, y = states[key]
        assert key in worth and r.cost == pytest.approx(tables[gammas[key[1]]][x + y - 2][x - 1])
        lists.setdefault(r.uid, []).append(r)
    for rs in lists.values():
        rs.sort(key=lambda r: r.rn)
        assert [r.rn for r in rs] == list(range(1, len(rs) + 1)) and len(rs) <= b.MOST
        assert all(x.cost >= y.cost for x, y in itertools.pairwise(rs)) and len({r.aid for r in rs}) == len(rs)
    # the categories of a user that are worth it fill the list, up to its length
    for uid in {u for u, _ in states}:
        assert len(lists.get(uid, [])) == min(b.MOST, sum(n[c] for u, c in worth if u == uid))


def test_stopping_means_by_total(spark):
    totals = spark.createDataFrame([(0.9, 4), (0.9, 4), (0.9, 40), (0.5, 4)], "gamma double, total long")
    got = {(r.gamma, r.total): r.mu for r in b.stopping_means(totals, 0.3, 60).collect()}
    assert got == {(g, t): pytest.approx(k.stopping_mean(t / 2, t / 2, g, 0.3, 60)) for g, t in ((0.9, 4), (0.9, 40), (0.5, 4))}
    # the longer one has looked, and the less the future counts, the nearer to the cost itself
    assert got[0.9, 4] < got[0.9, 40] < 0.3 and got[0.9, 4] < got[0.5, 4] < 0.3


def test_programmes_are_solved_side_by_side_and_in_many_tasks(spark):
    totals, gammas = np.array([4, 21, 40, 400, 21]), np.array([0.5, 0.99, 0.9, 0.98, 0.999])
    for cost, horizon in ((0.05, 200), (0.3, 60), (0.95, 20)):
        want = [k.stopping_mean(t / 2, t / 2, g, cost, horizon) for t, g in zip(totals, gammas)]
        assert k.stopping_means_at(totals, gammas, cost, horizon) == pytest.approx(want, abs=1e-9)
    states = spark.createDataFrame([(1 - 1 / g, 2, n) for g in range(2, 20) for n in range(3, 9)], "gamma double, alpha long, beta long")
    means, costs = b.stopping_means(states.selectExpr("gamma", "alpha + beta AS total"), 0.3, 20), b.costs_of(states, 20)
    for df in (means, costs):
        assert df.selectExpr("spark_partition_id() AS p").distinct().count() > 1
    tables = {1 - 1 / g: dict(b.forwarding_costs(1 - 1 / g, 20)) for g in range(2, 20)}
    assert sorted(costs.collect()) == sorted((r.gamma, r.alpha, r.beta, tables[r.gamma][r.alpha + r.beta - 2][r.alpha - 1]) for r in states.collect())


def test_admitted_lists_take_the_newest(spark):
    got = {}
    for r in registry.queries()["admitted_lists"](spark, DIR).collect():
        got.setdefault(r.uid, set()).add(r.aid)
    seen = run(Query("SELECT r.aid, r.cat, max(a.id) AS last FROM article r LEFT JOIN act a ON r.aid = a.aid GROUP BY r.aid, r.cat"), spark, DIR).collect()
    n = {c: sum(r.cat == c for r in seen) for c in {r.cat for r in seen}}
    states = run(catalogue.QUERIES["alpha_beta"], spark, DIR).collect()
    gammas = np.array([1 - 1 / (12 * max(1, math.floor(n[r.cat] / 13 + 0.5)) + 1) for r in states])
    totals = np.array([r.alpha + r.beta for r in states])
    mus = k.stopping_means_at(totals, gammas, b.COST, b.HORIZON)
    worth = {}
    for r, t, mu in zip(states, totals, mus):
        if r.alpha / t >= mu:
            worth.setdefault(r.uid, set()).add(r.cat)
    order = sorted(seen, key=lambda r: (r.last is None, -(r.last or 0), r.aid))
    assert got == {uid: {r.aid for r in [r for r in order if r.cat in cats][: b.MOST]} for uid, cats in worth.items()}


def test_interpolation_is_linear_along_each_axis(spark):
    axes = {"x": (0.0, 1.0, 3.0), "y": (1.0, 2.0)}
    f = lambda x, y: x * x + 10 * y + x * y
    table = spark.createDataFrame([(x, y, f(x, y)) for x in axes["x"] for y in axes["y"]], "x double, y double, value double")
    points = [(0, 0.0, 1.0), (1, 0.5, 1.25), (2, 2.0, 2.0), (3, -1.0, 9.0), (4, 9.0, 1.5), (5, None, 1.0), (6, 1.0, 1.0), (6, 1.0, 1.0)]
    got = sorted(b.interpolated(spark.createDataFrame(points, "id long, x double, y double"), table, axes).collect(), key=lambda r: r.id)
    assert len(got) == len(points)
    for r in got:
        if r.x is None:
            assert r.value is None
            continue
        y = min(max(r.y, 1.0), 2.0)
        assert r.value == pytest.approx(np.interp(r.x, axes["x"], [f(x, 1.0) * (2 - y) + f(x, 2.0) * (y - 1) for x in axes["x"]]))


def test_poisson_update():
    shape, rate = np.array([0.3, 0.3]), np.array([2.0, 4.0])
    assert b.poisson_update(shape, rate, np.full((2, 2), -0.5)) == pytest.approx(shape)
    assert b.poisson_update(shape, rate, np.array([[0.1, 0.2], [0.3, 0.1]])) == pytest.approx([1.3, 0.3])
    a = np.array([[k.digamma(0.3) - math.log(r) + x for r, x in zip(rate, row, strict=True)] for row in ((0.1, 0.2), (0.3, 0.1))])
    want = shape + (np.exp(a) / (1 + np.exp(a).sum())).sum(axis=0)
    assert b.poisson_update(shape, rate, np.array([[0.1, 0.2], [0.3, 0.1]]), factor=1) == pytest.approx(want)


def test_poisson_users(spark):
    rows = registry.queries()["poisson_users"](spark, DIR).collect()
    sums = {}
    for r in rows:
        sums[r.uid] = sums.get(r.uid, 0) + r.shape - 0.1
    views = run(Query("SELECT uid, count(DISTINCT aid) AS n FROM act JOIN embeddings e ON aid = e.vec_id WHERE kind IN ('view', 'click') GROUP BY uid"), spark, DIR)
    assert {u: round(s) for u, s in sums.items()} == {r.uid: r.n for r in views.collect()}


def test_reordered_profile_by_hand(spark):
    q = lambda sql: run(Query(sql), spark, DIR).collect()
    ranked, scored, vectors = {}, {}, {}
    for r in sorted(q("SELECT uid, aid, rn FROM ranked_page"), key=lambda r: r.rn):
        ranked.setdefault(r.uid, []).append(r.aid)
    for r in q("SELECT uid, aid FROM page_score"):
        scored.setdefault(r.uid, set()).add(r.aid)
    for r in q("SELECT aid, term, x FROM vec"):
        vectors.setdefault(r.aid, []).append((r.term, r.x))
    want = {}
    for uid, own in ranked.items():
        shown = [(i, a) for i, a in enumerate(ranked.get(uid + 1, [])[:20], 1)]
        new = own + [a for _, a in shown if a is not None and a not in scored[uid]]
        phi = {t: [0.0, 0.0] for a in own for t, _ in vectors.get(a, [])}
        for side, items in ((0, shown), (1, list(enumerate(new, 1)))):
            for i, a in items:
                for t, x in vectors.get(a, []):
                    if t in phi:
                        phi[t][side] += x / (1 + math.log(i))
        want |= {(uid, t): (p1 - p0, math.sqrt(p1) - math.sqrt(p0)) for t, (p0, p1) in phi.items()}
    got = {(r.uid, r.term): (r.d1, r.d2) for r in registry.queries()["reordered_profile"](spark, DIR).collect()}
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x], abs=2e-6) for x in want)
