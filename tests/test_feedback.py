import math
from collections import defaultdict

import numpy as np
import pytest

from tributary.operators import feedback as f
from tributary.operators.kernels import coin, feedback_coefficients
from tributary.plans import registry
from tributary.plans.dialect import Query, run

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = run(Query("SELECT v.aid, v.term AS word, v.x, i.idf FROM vec v JOIN idf i ON v.term = i.term"), spark, DIR)
    out, idf = defaultdict(dict), {}
    for r in rows.selectExpr("aid", "xxhash64(word) AS term", "x", "idf").collect():
        out[r.aid][r.term], idf[r.term] = r.x, r.idf
    return out, idf


def test_rebuild_equals_replaying_list_by_list(spark, vectors):
    lists = defaultdict(dict)
    for r in sorted(run(Query("SELECT uid, CAST(t AS DATE) AS day, id, aid, op, kind FROM act WHERE aid IS NOT NULL"), spark, DIR).collect(), key=lambda r: r.id):
        lists[r.uid, r.day].setdefault(r.aid, []).append(r)
    profiles, want = defaultdict(lambda: defaultdict(float)), {}
    for uid, day in sorted(lists):
        verdicts = {}
        for aid, acts in lists[uid, day].items():
            judged = [a.op for a in acts if a.op < 0 or a.op >= 100]
            if judged:
                verdicts[aid] = "DEMOTED" if judged[-1] < 0 else "PROMOTED"
            elif any(a.kind in ("view", "click") for a in acts):
                verdicts[aid] = "VIEWED"
        rho, _ = feedback_coefficients(list(lists[uid, day])[: f.SHOWN], verdicts, coin(f"{uid}/{day}") == 1)
        moved = set()
        for aid, x in rho.items():
            for t, v in vectors[0].get(aid, {}).items() if x else ():
                profiles[uid][t] += x * v
                moved.add(t)
        want |= {(uid, day, t): profiles[uid][t] for t in moved}
    got = {(r.uid, r.list, r.term): r.w for r in registry.queries()["rebuilt_profiles"](spark, DIR).collect()}
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    half = f.list_coefficients(spark, DIR, 300, 600).count()
    assert 0 < half < f.list_coefficients(spark, DIR).count()


def test_seeded_profiles_equal_a_plain_loop(spark, vectors):
    rows = f.simulated_lists(spark, DIR).collect()
    rounds = defaultdict(dict)
    for r in rows:
        rounds[r.uid, r.round][r.place] = r.aid
    assert all(max(own) == f.SIMULATED and len(set(own.values())) == len(own) for own in rounds.values())
    vec, idf = vectors
    profiles = defaultdict(lambda: defaultdict(float))
    for uid, k in sorted(rounds):
        w = profiles[uid]
        shown = [a for _, a in sorted(rounds[uid, k].items())]
        own = shown[-1]
        score = {a: round(sum(x * w.get(t, 0) * idf[t] for t, x in vec.get(a, {}).items()), 12) for a in shown}
        shown = sorted(shown, key=lambda a: (-score[a], shown.index(a)))
        for j, a in enumerate(shown):
            step = (1 if a == own else 1 / (1 + math.log(2 + j))) - 1 / (1 + math.log(1 + j))
            for t, x in vec.get(a, {}).items():
                w[t] += step * x
            if a == own:
                break
    want = {(u, t): v for u, w in profiles.items() for t, v in w.items() if abs(v) >= f.LEAST_WEIGHT}
    got = {(r.uid, r.term): r.w for r in registry.queries()["seeded_profiles"](spark, DIR).collect()}
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_vectors_travel_in_three_bytes_a_term():
    rng = np.random.default_rng(6)
    numbers = np.sort(rng.choice(100_000, 150, replace=False))
    tfs = rng.integers(1, 9, 150)
    assert len(f.packed_vector(numbers, tfs)) == 1 + 3 * 150
    for n, tf in ((numbers, tfs), (numbers * 1000, tfs), (numbers, tfs * 1000), (numbers[:0], tfs[:0])):
        back, often = f.unpacked_vector(f.packed_vector(n, tf))
        assert back.tolist() == n.tolist() and often.tolist() == tf.tolist()
