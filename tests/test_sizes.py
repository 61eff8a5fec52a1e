"""Queries on tables larger than the given ones, or of a shape that only these have."""

import re

import pytest

from tributary.plans.dialect import run
from tributary.plans.registry import QUERIES, queries


def test_shares_of_terms_are_exact_whatever_the_order(spark):
    """One term eight million times and 200,000 terms once: sums of doubles, term by term, are off by more than a millionth of the large count."""
    given = {
        "article": "SELECT 1 AS aid, 'c' AS cat",
        "posting": "SELECT 1 AS aid, concat('t', id) AS term, CASE WHEN id = 0 THEN 8000000 ELSE 1 END AS tf FROM range(200000)",
        "token": "SELECT 1 AS aid, concat('t00', greatest(0, id - 7999999)) AS term FROM range(8199999)",
    }
    r = run(QUERIES["theta_check"], spark, "/root/testdata/sf0.001", given).first()
    assert (r.n, r.wrong, r.total) == (200000, 0, 1.0)


@pytest.mark.parametrize("name", ["flat_vectors", "fielded_vectors", "lda_export", "svm_export"])
def test_rows_of_documents_and_terms_do_not_move(spark, name):
    """Texts move to their document's partition; what is made of them there is not shuffled again, and the vocabulary is broadcast, be it for a plan without known sizes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
    assert moved.count("doc_id") == 1 and "field" not in moved
    # svm_export brings a class to each line
    assert set(moved) <= {"doc_id"} | ({"aid"} if name == "svm_export" else set())


def test_missing_similarities_splits_only_texts_acted_on(spark):
    """Vectors of all articles are not made: the final plan reads no text."""
    plan = queries()["missing_similarities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "posting" not in plan


def test_suggestions_of_many_users_are_few_files(spark, tmp_path):
    """Files do not grow with the users; an article or user that is null comes back as null."""
    from pyspark.sql import functions as F

    from tributary.sources import formats

    rows = spark.range(600).select(F.when(F.col("id") < 599, F.col("id") % 300).alias("uid"), F.when(F.col("id") > 0, F.col("id")).alias("aid"), (F.col("id") / 2).alias("score"), F.lit(1).alias("rn"), F.lit('a "b"\tiUnperturbed=7').alias("comment"))
    formats.write_suggestions(rows.repartition(3), str(tmp_path / "s"))
    assert len(list(tmp_path.glob("s/**/*.txt"))) <= formats.BUCKETS
    got = {(r.uid, r.aid, r.score, r.comment, r.unperturbed) for r in formats.read_suggestions(spark, str(tmp_path / "s")).collect()}
    assert got == {(i % 300 if i < 599 else None, i or None, i / 2, "a 'b'\tiUnperturbed=7", 7) for i in range(600)}


def test_searches_by_many_terms_make_no_candidates(spark, monkeypatch):
    """Pairs of a query and an article that share a term are not rows anywhere."""
    from tributary.operators import topk

    def never(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(topk, "candidates", never)
    assert queries()["long_text_candidates"](spark, "/root/testdata/sf0.001").limit(1).count() == 1
