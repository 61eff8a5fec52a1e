"""Packed articles, and products of their blocks: the same numbers as rows of terms, with nothing copied in a shuffle."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.operators import kernels, scoring, similarity
from tributary.plans import packed, registry
from tributary.plans.dialect import Query, run

DIR = "/root/testdata/sf0.001"


def test_wide_steps_and_large_frequencies_come_back():
    rows = [[0, 1, 70_000, 70_001, 400_000], [65_535, 65_536, 131_071], [200_000]]
    tfs = [[1, 300, 70_000, 2, 5], [1, 2, 3], [9]]
    steps, tf, lengths = packed.steps_of(np.concatenate(rows), np.concatenate(tfs), np.array([5, 3, 1]))
    table = pa.table({"aid": pa.array([7, 8, 9]), "steps": packed.binaries(steps, lengths), "tfs": packed.binaries(tf, lengths)})
    cells = packed.frequencies(table)
    assert [cells.cols[a:b].tolist() for a, b in zip(cells.starts, cells.starts[1:])] == rows
    assert [cells.x[a:b].tolist() for a, b in zip(cells.starts, cells.starts[1:])] == tfs


def test_articles_are_the_vectors_of_the_dialect(spark):
    made = packed.articles(spark, DIR)
    cells = packed.unit(packed.frequencies(made.rows.toArrow()), made.idf)
    got = {(a, t): x for a, t, x in zip(np.repeat(cells.aids, cells.lengths).tolist(), made.terms[cells.cols].tolist(), cells.x.tolist())}
    want = {(r.aid, r.h): r.x for r in run(Query("SELECT aid, xxhash64(term) AS h, x FROM vec"), spark, DIR).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(x, abs=1e-12) for k, x in want.items())


def test_rows_of_one_id_are_one_article(spark, tmp_path):
    docs = [(i, "en", "s", "same word other", 15) for i in range(12)] + [(3, "en", "s", "word word", 9), (None, "en", "s", "same word", 9), (40, "fr", "s", None, 0)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    made = packed.articles(spark, str(tmp_path))
    cells = packed.frequencies(made.rows.toArrow())
    assert made.n == 15 and sorted(made.df.tolist()) == [12, 13, 13] and sorted(cells.aids.tolist()) == list(range(12))
    assert sorted(cells.x[slice(*cells.starts[cells.aids.tolist().index(3) :][:2])].tolist()) == [1, 1, 3]


@pytest.mark.parametrize("name", ["flagship", "profile_linear_score", "profile_log_score", "similarity_thresholds", "article_neighbours", "similar_articles", "long_text_candidates", "profile_term_search"])
def test_blocks_meet_without_a_shuffle(spark, name):
    """Vectors stood in a shuffle once for each block that they met; now pairs of stored blocks are read where they are multiplied."""
    plan = registry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    at = min(plan.index(x) for x in ("CartesianProduct", "BroadcastNestedLoopJoin") if x in plan)
    assert "hashpartitioning" not in plan[at:] and "CoGroup" not in plan


def test_the_best_over_many_blocks(spark, monkeypatch):
    """Small boxes, so that every list is put together from many pairs: the same scores as in one."""
    whole = {n: sorted(registry.queries()[n](spark, DIR).collect()) for n in ("flagship", "article_neighbours", "long_text_candidates")}
    monkeypatch.setattr(scoring, "ITEMS", 7)
    monkeypatch.setattr(scoring, "USERS", 5)
    monkeypatch.setattr(scoring, "AT_ONCE", 2)
    monkeypatch.setattr(scoring, "GROUPS", 1)
    monkeypatch.setattr(similarity, "BLOCK", 9)
    monkeypatch.setattr(packed, "CACHE_BYTES", 1)
    for n, rows in whole.items():
        assert sorted(registry.queries()[n](spark, DIR).collect()) == rows, n


def test_greedy_lists_move_no_terms(spark):
    """A user's list met its candidates as rows of users, articles and terms; the lists of equal articles go by the lower id."""
    plan = registry.queries()["greedy_lists"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "term" not in plan


@pytest.mark.parametrize("seed", range(6))
def test_greedy_order_of_cells_is_that_of_matrices(seed):
    rng = np.random.default_rng(seed)
    items = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6)) for _ in range(40)]
    b = np.zeros((40, 30))
    for i, (at, x) in enumerate(items):
        b[i, at] = x
    assert kernels.lazy_greedy_cells(items, 30, 25)[0] == kernels.greedy_utility(b.sum(axis=1), b, np.ones(30), 25)


def test_blocks_of_rows_of_terms(spark, monkeypatch):
    """Vectors that are given as rows meet in blocks too; a group of several blocks has all its pairs."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    rng = np.random.default_rng(0)
    x = rng.random((30, 5))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    rows = [(i % 2, i, t, float(x[i, t])) for i in range(30) for t in range(5)]
    got = similarity.cosines(spark.createDataFrame(rows, "grp long, aid long, term long, x double"), 0.6).select("a", "b", F.round("s", 9).alias("s")).collect()
    s = x @ x.T
    assert {(r.a, r.b) for r in got} == {(i, j) for i in range(30) for j in range(30) if i != j and i % 2 == j % 2 and s[i, j] >= 0.6} and len(got) == len({(r.a, r.b) for r in got})


def test_seeded_profiles_make_no_lists_of_cells(spark):
    """A worker held the cells of a batch of articles as objects; packed articles become packed vectors in bytes."""
    plan = registry.queries()["seeded_profiles"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "tf" not in plan.replace("tfs", "")
