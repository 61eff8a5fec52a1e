import random

import pytest
from pyspark.sql import functions as F

from tributary.plans.lists import BEHIND, Ranked


def frame(spark, lists):
    rows = [(k, a, i) for k, own in lists.items() for i, a in enumerate(own)]
    return Ranked.of(spark.createDataFrame(rows, "k long, aid long, place long"), "k", F.col("place"))


def got(ranked):
    out = {}
    for r in sorted(ranked.rows.collect(), key=lambda r: (r.key, r.rn)):
        out.setdefault(r.key, []).append(r.aid)
        assert len(out[r.key]) == r.rn
    return out


def merged(*lists):
    places = {}
    for own in lists:
        for i, a in enumerate(own, 1):
            places.setdefault(a, []).append(i)
    return sorted(places, key=lambda a: (sorted(places[a]) + [BEHIND] * (len(lists) - len(places[a])), a))


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_match_plain_lists(spark, seed):
    rng = random.Random(seed)
    a, b, c = ({k: rng.sample(range(30), rng.randint(1, 12)) for k in range(8) if rng.random() < 0.7} for _ in range(3))
    x, y, z = (frame(spark, v) for v in (a, b, c))
    keys = a.keys() | b.keys() | c.keys()
    assert got(x) == a
    assert got(x.merge(y, z)) == {k: merged(*(v.get(k, []) for v in (a, b, c))) for k in keys}
    assert got(x.then(y)) == {k: a.get(k, []) + [i for i in b.get(k, []) if i not in a.get(k, [])] for k in a.keys() | b.keys()}
    assert got(x.otherwise(y).otherwise(z)) == {k: a.get(k) or b.get(k) or c[k] for k in keys}
    gone = spark.createDataFrame([(k, i) for k in range(8) for i in range(0, 30, 3)], "key long, aid long")
    assert got(x.without(gone)) == {k: own for k, v in a.items() if (own := [i for i in v if i % 3])}
    tree = x.head(3).then(y.merge(z)).without(gone).head(5)
    want = {}
    for k in keys:
        first = a.get(k, [])[:3]
        rest = merged(b.get(k, []), c.get(k, []))
        want[k] = [i for i in first + [i for i in rest if i not in first] if i % 3][:5]
    assert got(tree) == {k: v for k, v in want.items() if v}


def test_nulls_repeats_and_empty_lists(spark):
    rows = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, None, 0), (None, 4, 0), (1, 6, 1)], "k long, aid long, place long")
    ranked = Ranked.of(rows, "k", F.col("place"))
    assert got(ranked) == {1: [5, 6]}
    none = Ranked.of(rows.limit(0), "k", F.col("place"))
    assert got(none.otherwise(ranked)) == got(ranked.then(none)) == got(ranked.merge(none)) == {1: [5, 6]} and got(none.merge(none)) == {}
