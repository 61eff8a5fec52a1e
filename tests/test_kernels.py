import numpy as np
import pytest

from tributary.operators import kernels as k


def test_team_draft_ends_with_either_list():
    assert [x[0] for x in k.team_draft([1, 2, 3], [2, 4], lambda i: 1)] == [1, 2, 3]
    assert [x[0] for x in k.team_draft([1, 2, 3], [2, 4], lambda i: 0)] == [2, 1, 4]
    assert k.team_draft([], [1], lambda i: 1) == []


def test_stable_orders_are_permutations_of_known_items():
    assert k.stable_slots(["x", "b", "y", "a"], ["a", "b", "c"]) == ["x", "a", "y", "b"]
    assert k.stable_slots(["x"], ["a", "b", "c"]) == ["x", "a"]
    assert k.stable_merge(["x", "b", "y", "a"], ["a", "b", "c"], 4) == ["a", "b", "x", "c"]


@pytest.mark.parametrize("orphan", [True, False])
def test_feedback_is_a_permutation_and_promotes(orphan):
    items = list(range(30))
    rho, final = k.feedback_coefficients(items, {7: "PROMOTED", 2: "DEMOTED", 4: "VIEWED", 25: "DEMOTED"}, orphan)
    assert sorted(final) == items
    assert final[0] == 7 and rho[7] > 0
    assert final.index(2) > 2 and rho[2] < 0


def test_upheld_pair_rewards_both():
    rho, final = k.feedback_coefficients([1, 2], {1: "VIEWED"}, False)
    assert final == [1, 2]
    assert rho[1] == rho[2] == pytest.approx(k.gamma(0) - k.gamma(1))


def test_kalman_step():
    mu, sigma = k.kalman(np.zeros(2), np.eye(2), np.array([1.0, 0.0]), 1.0, 0.1)
    assert mu == pytest.approx([1 / 1.01, 0])
    assert sigma == pytest.approx(np.array([[1 - 1 / 1.01, 0], [0, 1]]))


def test_digamma_known_values():
    assert k.digamma(1) == pytest.approx(-0.5772156649, abs=1e-8)
    assert k.digamma(0.5) == pytest.approx(-1.9635100260, abs=1e-8)


def test_longest_match_first():
    assert k.longest_match(["a", "b", "b"], {("a",): 0, ("a", "b"): 1, ("b",): 2}, 3) == [0, 1, 1]
    assert k.longest_match([], {("a",): 0}, 1) == [0]


def test_index_exceeds_mean_and_grows_with_patience():
    assert k.index_of(1, 1, 0.9, 100) > k.index_of(1, 1, 0.5, 100) > 0.5
    assert k.stopping_mean(5, 5, 0.9, 0.5, 100) <= 0.5 + 1e-6


def test_greedy_utility_prefers_new_terms():
    terms = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 0.9]])
    assert k.greedy_utility(np.zeros(3), terms, np.ones(2)) == [0, 2, 1]


def test_arms_keep_large_counts(spark, tmp_path):
    rows = [(1, "purchase", 60), (1, "error", 70), (2, "purchase", 450), (2, "error", 200)]
    rows = [(aid, kind) for aid, kind, n in rows for _ in range(n)]
    events = spark.createDataFrame([(i, 1, f'{{"k": {aid}}}', kind) for i, (aid, kind) in enumerate(rows)], "event_id long, user_id long, props string, event_type string")
    events.selectExpr("*", "TIMESTAMP '2024-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.alpha, r.beta): r for r in k.arm_indices(spark, str(tmp_path)).collect()}
    assert got.keys() == {(61, 71), (451, 201)}
    for (a, b), r in got.items():
        assert r["mean"] == pytest.approx(a / (a + b))
        assert r.nu == pytest.approx(k.index_of(a, b, 0.9, 1000), abs=2e-5)
        assert r.mu_star == pytest.approx(k.stopping_mean(a, b, 0.9, 0.5, 1000), abs=2e-5)
