import numpy as np
import pytest

from tributary.operators import kernels, utility
from tributary.plans import registry
from tributary.plans.dialect import Query, run

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(12))
def test_lazy_order_is_the_exhaustive_one(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 80)), int(rng.integers(1, 12))
    linear = rng.normal(size=n) * rng.choice([0, 0.2, 3])
    terms, signs = rng.random((n, k)) * (rng.random((n, k)) < 0.4), rng.choice([1.0, 1.0, -1.0], k)
    order, taken = kernels.lazy_greedy(linear, terms, signs, 50)
    assert order == kernels.greedy_utility(linear, terms, signs, 50)
    assert n <= taken <= n * min(n, 50)


def test_few_gains_are_found_anew():
    rng = np.random.default_rng(3)
    terms = rng.random((300, 40)) * (rng.random((300, 40)) < 0.1)
    order, taken = kernels.lazy_greedy(np.zeros(300), terms, np.ones(40), 200)
    assert len(order) == 200 and taken < 300 * 200 / 4
    assert kernels.lazy_greedy(np.zeros(0), np.zeros((0, 0)), np.zeros(0)) == ([], 0)


def test_lists_of_all_users_match_the_exhaustive_order(spark):
    q = lambda sql: run(Query(sql), spark, DIR).collect()
    vec, profiles = {}, {}
    for r in q("SELECT v.aid, v.term, v.x * sqrt(i.idf) AS z FROM vec v JOIN idf i ON v.term = i.term"):
        vec.setdefault(r.aid, {})[r.term] = r.z
    for r in q("SELECT uid, term, w1 FROM profile"):
        profiles.setdefault(r.uid, {})[r.term] = r.w1
    got = {}
    for r in registry.queries()["greedy_lists"](spark, DIR).collect():
        got.setdefault(r.uid, {})[r.rn] = r.aid
    assert got.keys() == profiles.keys()
    for uid, w in sorted(profiles.items())[:40]:
        s = {a: round(sum(z * w.get(t, 0) for t, z in v.items()), 5) for a, v in vec.items()}
        items = sorted((a for a in s if s[a] > 0), key=lambda a: (-s[a], a))[: utility.CANDIDATES]
        own = [got[uid][i] for i in range(1, len(items) + 1)]
        assert sorted(own) == sorted(items)
        terms = sorted(w)
        b = np.array([[vec[a].get(t, 0) * w[t] for t in terms] for a in items])
        # each pick gains as much as the best one would, to rounding
        phi, left = np.zeros(len(terms)), list(range(len(items)))
        for place, a in enumerate(own[:60]):
            g = kernels.gamma(place)
            gain = g * b[left].sum(axis=1) + (np.sqrt(phi + g * b[left]) - np.sqrt(phi)).sum(axis=1)
            i = items.index(a)
            assert gain[left.index(i)] == pytest.approx(gain.max(), abs=1e-9)
            left.remove(i)
            phi += g * b[i]
