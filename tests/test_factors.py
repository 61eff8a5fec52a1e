import numpy as np

from tributary.functions.query_syntax import Clause, parse
from tributary.operators import factors, scoring


def test_parse():
    assert parse('The cat* category:hep-th title:Quantum days:30 foo:bar cat*') == [
        Clause("prefix", "cat"), Clause("category", "hep-th"), Clause("term", "quantum", "title"), Clause("days", "30"), Clause("term", "foo:bar"),
    ]
    assert parse('"Dark matter, now"') == [Clause("phrase", "dark matter now")]
    assert parse("  ") == [] and parse('""') == [] and parse("*") == []


def test_singular_values(spark):
    rng = np.random.default_rng(5)
    a = (rng.random((30, 20)) < np.outer(np.linspace(0.1, 0.9, 30), np.ones(20))).astype(float)
    a[:10, :8] = 1
    cells = spark.createDataFrame([(i, j) for i in range(30) for j in range(20) if a[i, j]], "row long, col long")
    values, _ = factors.singular(cells, k=2, rounds=14)
    assert np.allclose(values, np.linalg.svd(a)[1][:2], rtol=2e-2)
    assert np.allclose(factors.singular(cells.limit(0), k=2, rounds=2)[0], 0)


def test_block_scores(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 6)
    rng = np.random.default_rng(2)
    u, v = (np.where(rng.random((n, 15)) < 0.5, rng.random((n, 15)).round(3), 0) for n in (13, 25))
    rows = lambda x: [(i, j, float(x[i, j])) for i in range(len(x)) for j in range(15) if x[i, j]]
    profiles, items = spark.createDataFrame(rows(u), "uid long, term long, x double"), spark.createDataFrame(rows(v), "aid long, term long, x double")
    hidden = spark.createDataFrame([(0, 3), (0, 4), (5, 1)], "uid long, aid long")
    s = (u @ v.T).round(5)
    got = {(r.uid, r.aid): r.s for r in scoring.scores(profiles, items, least=1.5).collect()}
    assert got.keys() == {(i, j) for i in range(13) for j in range(25) if s[i, j] >= 1.5}
    for i, j in ((0, 3), (0, 4), (5, 1)):
        s[i, j] = -1
    best = {(r.uid, r.rn): r.aid for r in scoring.scores(profiles, items, hidden, top=4).collect()}
    assert best == {(i, k): j for i in range(13) for k, j in enumerate(sorted(range(25), key=lambda j: (-s[i, j], j))[:4], 1)}


def test_profiles_move_no_terms_of_users(spark, monkeypatch):
    """Only pages move; the rows of users and terms stay where the vectors of the articles met them, and postings are stored once."""
    from tributary.plans import registry, vectors

    monkeypatch.setattr(vectors, "PAGES", 50)
    for name in ("profile_from_history", "upload_profiles", "reordered_profile", "dot_products"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(part" in plan, name
        assert plan.count("Exchange hashpartitioning") == 1 and "split(" not in plan, name


def test_products_of_articles_give_the_scores_of_profiles(spark, monkeypatch):
    few = {(r.uid, r.rn): (r.aid, r.s) for r in scoring.flagship(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(scoring, "ACTED", 0)
    many = {(r.uid, r.rn): (r.aid, r.s) for r in scoring.flagship(spark, "/root/testdata/sf0.001").collect()}
    assert few == many and len(few) == 150


def test_blocks_of_short_rows_are_large():
    # 90,000 users and 500,000 articles of 100 numbers each: an article went to 225 tasks and a user to 1,250
    assert scoring._blocks(90_000, 9_000_000, 10) <= 5 and scoring._blocks(500_000, 50_000_000, 10, 32) <= 32
    assert scoring._blocks(1_000, 9_000_000, 10) == 5


def test_products_of_blocks(monkeypatch):
    import pandas as pd

    from tributary.operators import similarity

    rng = np.random.default_rng(4)
    x, y = (np.where(rng.random((n, 90)) < np.linspace(0.02, 0.7, 90), rng.random((n, 90)), 0) for n in (40, 33))
    x[0] = y[0] = 0
    x[0, 3] = y[0, 5] = 1
    rows = lambda m: pd.DataFrame({"aid": range(len(m)), "terms": [np.flatnonzero(r) * 7 for r in m], "xs": [r[r != 0] for r in m]})
    for rare, at_once in ((1, 50), (10, 1), (10, 10**6), (10**9, 5)):
        monkeypatch.setattr(similarity, "RARE", rare)
        monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", at_once)
        assert np.allclose(similarity.products(rows(x), rows(y)), x @ y.T)
