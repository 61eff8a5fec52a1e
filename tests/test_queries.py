import math
import os

import duckdb
import pytest

import __spark_entry__
from tributary.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0


def rows(columns, got):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["uid", "aid", "s", "rn"]


def test_profiles_add_all_pages_of_positive_score(spark):
    from collections import defaultdict

    from tributary.plans.dialect import Query, run

    pages = run(Query("SELECT uid, aid, score, last_id FROM page_score WHERE score > 0"), spark, DIR).collect()
    vectors, lists, want = defaultdict(list), defaultdict(list), defaultdict(float)
    for r in run(Query("SELECT aid, term, x FROM vec"), spark, DIR).collect():
        vectors[r.aid].append((r.term, r.x))
    for r in pages:
        lists[r.uid].append((-r.score, -r.last_id, r.aid is not None, r.aid))
    assert max(map(len, lists.values())) > 10
    for uid, rows in lists.items():
        for i, row in enumerate(sorted(rows, key=lambda x: x[:3])):
            for term, x in vectors[row[3]]:
                want[uid, term] += x / (1 + math.log(i + 1))
    got = {(r.uid, r.term): r.w1 for r in registry.queries()["profile_from_history"](spark, DIR).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_coaccess_union_and_provenance_take_every_key(spark):
    from collections import Counter, defaultdict

    from tributary.plans.dialect import Query, run

    rows = lambda name: registry.queries()[name](spark, DIR).collect()
    acts = run(Query("SELECT id, uid, sid, aid, w FROM act"), spark, DIR).collect()
    best, newest = defaultdict(dict), {}
    for r in acts:
        newest[r.uid, r.aid] = max(r.id, newest.get((r.uid, r.aid), r.id))
        if r.w > 0:
            best[r.sid][r.aid] = max(r.w, best[r.sid].get(r.aid, 0))
    local, total = Counter(), Counter()
    for s in best.values():
        for a, w in s.items():
            total[a] += w
            for b, x in s.items():
                if a is not None and b is not None and a != b:
                    local[a, b] += w * x
    assert {(r.a0, r.aid): r.score for r in rows("coaccess_local")} == local
    # of every article the twenty best among all others
    want = {}
    for a in total.keys() - {None}:
        every = sorted((-(n + local[a, b]), b) for b, n in total.items() if b is not None and b != a)[:20]
        want |= {(a, b): (-n, i) for i, (n, b) in enumerate(every, 1)}
    assert {(r.a0, r.aid): (r.score, r.rn) for r in rows("coaccess_combined")} == want
    users = {u for u, _ in newest}
    want = dict(newest)
    for (u, a), i in newest.items():
        if u - 1 in users:
            want[u - 1, a] = max(i, want.get((u - 1, a), i))
    assert {(r.uid, r.aid): r.id for r in rows("union_newer")} == want
    ranks = {(r.uid, r.aid): r.rn for r in run(Query("SELECT uid, aid, rn FROM ranked_page WHERE aid IS NOT NULL"), spark, DIR).collect()}
    listed = {u for u, _ in ranks}
    keys = ranks.keys() | {(u - 1, a) for u, a in ranks if u - 1 in listed}
    got = {(r.uid, r.aid): (r.arank, r.brank) for r in rows("provenance_ranks") if r.aid is not None}
    assert got == {(u, a): (ranks.get((u, a), 0), ranks.get((u + 1, a), 0)) for u, a in keys}
    assert min(r.score for r in rows("coaccess_sum_of_max")) < 5
    assert all(0 < min(r.s for r in rows(name)) < 1 for name in ("profile_linear_score", "profile_log_score"))


def test_terms_keep_accented_letters(spark):
    from tributary.plans.dialect import Query, run

    got = run(Query("SELECT @TERMS(concat('Über-élan 3x', CAST(aid AS STRING)) ) AS term FROM article WHERE aid = 1"), spark, DIR)
    assert [r.term for r in got.collect()] == ["über", "élan", "3x1"]


def test_a_removed_article_scores_no_folder(spark):
    from collections import defaultdict

    from tributary.plans.dialect import Query, run

    state, judged, viewed = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in sorted(run(Query("SELECT id, uid, aid, kind, op FROM act"), spark, DIR).collect()):
        key = r.uid, r.aid
        if r.kind in ("purchase", "error"):
            state[key] = 1000 if r.kind == "purchase" else 0
        if r.kind in ("signup", "error"):
            judged[key] = r.op
        if r.kind in ("view", "click"):
            viewed[key] = max(viewed[key], r.op)
    want = {k: s for k in state | judged | viewed if (s := state[k] + judged[k] + viewed[k])}
    assert {(r.uid, r.aid): r.score for r in registry.queries()["page_score"](spark, DIR).collect()} == want


def test_rank_vectors_are_compared_place_by_place(spark):
    from collections import defaultdict

    from tributary.plans.dialect import Query, run

    ranks = defaultdict(list)
    for r in run(Query("SELECT aid, rn FROM ranked_page"), spark, DIR).collect():
        ranks[r.aid].append(r.rn)
    longest = max(map(len, ranks.values()))
    order = sorted(ranks, key=lambda a: (sorted(ranks[a]) + [10**9] * (longest - len(ranks[a])), a is not None, a))
    assert [r.aid for r in registry.queries()["rank_vector_merge"](spark, DIR).collect()] == order[:20]
