from __future__ import annotations

import tracemalloc
from dataclasses import replace

import numpy as np
import pytest

from indexloom.operators import optimise as op


def problem(n=12, seed=1):
    r = np.random.default_rng(seed)
    b = r.normal(size=(n, 3))
    c = (b @ b.T * 0.3 + np.diag(r.uniform(0.5, 2, n))) * 1e-4
    w = r.uniform(0.5, 2, n)
    return op.Problem([f"n{i}" for i in range(n)], w / w.sum(), c, expected=r.normal(0, 1e-3, n), attributes={"group": np.array(["a", "b", "c"] * n)[:n], "score": r.normal(size=n), "carbon": r.uniform(1, 9, n), "adv": r.uniform(1, 5, n)})


def test_minimum_variance_has_its_closed_form():
    p = problem()
    s = op.solve(p, op.minimise_variance(), [op.full_investment()])
    want = np.linalg.solve(p.covariance, np.ones(len(p)))
    assert s.feasible and np.allclose(s.weights, want / want.sum(), atol=1e-5)


def test_tracking_error_is_nil_at_the_benchmark():
    p = problem()
    assert np.allclose(op.solve(p, op.minimise_tracking_error(), [op.full_investment(), op.long_only()]).weights, p.benchmark, atol=1e-5)


def test_long_only_variance_meets_the_optimality_conditions():
    p = problem(20, 3)
    s = op.solve(p, op.minimise_variance(), [op.full_investment(), op.long_only(), op.weight_bounds(0.15)])
    w, g = s.weights, p.covariance @ s.weights
    inside = (w > 1e-4) & (w < 0.15 - 1e-4)
    level = g[inside].mean()
    assert s.feasible and np.allclose(g[inside], level, rtol=1e-2)
    assert (g[w <= 1e-4] >= level * 0.99).all() and (g[w >= 0.15 - 1e-4] <= level * 1.01).all()


def test_very_different_variances():
    v = np.geomspace(1e-5, 30, 40)
    p = op.Problem([str(i) for i in range(40)], np.full(40, 1 / 40), np.diag(v))
    s = op.solve(p, op.minimise_variance(), [op.full_investment(), op.long_only()], rounds=5000, tolerance=1e-8)
    assert s.feasible and np.allclose(s.weights, (1 / v) / (1 / v).sum(), atol=1e-4)


def test_a_wide_book_of_uncorrelated_names_is_solved_without_a_square_matrix():
    n = 4000
    v = np.exp(np.random.default_rng(1).uniform(np.log(1e-4), np.log(3600), n))
    tracemalloc.start()
    s = op.solve(op.Problem(range(n), np.full(n, 1 / n), v), op.minimise_variance(), [op.full_investment(), op.long_only()], rounds=5000, tolerance=1e-8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < n * n * 8 / 10  # a tenth of one square matrix
    assert s.feasible and np.allclose(s.weights, (1 / v) / (1 / v).sum(), atol=1e-8)


@pytest.mark.parametrize("objective", [op.minimise_variance(), op.minimise_tracking_error(), op.maximise_exposure("score"), op.with_costs(op.mean_variance(5.0), linear_bps=1, impact=1e-3)], ids=lambda o: o.name)
def test_variances_alone_are_a_diagonal_covariance(objective):
    p = problem(30, 5)
    alone = replace(p, covariance=np.diag(p.covariance).copy())
    full = replace(p, covariance=np.diag(alone.covariance))
    cs = [op.full_investment(), op.long_only(), op.weight_bounds(0.2), op.tracking_error(0.05), op.turnover(0.4), op.group_deviation("group", 0.02), op.exposure("score", lowest=0.05), op.intensity_reduction("carbon", 0.1), op.liquidity_cap("adv", 4)]
    for some in (cs, cs[:1]) if objective.name != "exposure:score" else (cs,):
        a, b = (op.solve(x, objective, some) for x in (alone, full))
        assert a.feasible and b.feasible and np.allclose(a.weights, b.weights, atol=1e-5) and a.value == pytest.approx(b.value, abs=1e-8)
    priced = [op.price_constraints(x, objective, cs[:4], 0.01) for x in (alone, full)]
    assert np.allclose(priced[0].iloc[:, 1:], priced[1].iloc[:, 1:], atol=1e-6)


def test_every_constraint_is_met_and_costs_something():
    p = problem(30, 5)
    cs = [op.full_investment(), op.long_only(), op.weight_bounds(0.2), op.tracking_error(0.02), op.turnover(0.2), op.group_deviation("group", 0.02), op.exposure("score", lowest=0.05), op.intensity_reduction("carbon", 0.1), op.liquidity_cap("adv", 4)]
    s = op.solve(p, op.maximise_exposure("score"), cs)
    w, b = s.weights, p.benchmark
    assert s.feasible and abs(w.sum() - 1) < 1e-6 and w.min() > -1e-6 and w.max() < 0.2 + 1e-6
    assert np.sqrt((w - b) @ p.covariance @ (w - b) * 252) < 0.02 + 1e-4 and np.abs(w - b).sum() / 2 < 0.2 + 1e-6
    assert all(abs((w - b)[p.attributes["group"] == g].sum()) < 0.02 + 1e-6 for g in "abc") and (w - b) @ p.attributes["score"] > 0.05 - 1e-6
    assert p.attributes["carbon"] @ w <= 0.9 * p.attributes["carbon"] @ b + 1e-6
    free = op.solve(p, op.maximise_exposure("score"), cs[:3])
    assert free.value < s.value
    priced = op.price_constraints(p, op.maximise_exposure("score"), cs, 0.01)
    assert set(priced["constraint"]) == {k.name for k in cs[2:]} and (priced["objective_saved"] > -1e-6).all() and priced["objective_saved"].max() > 1e-4


def test_costs_keep_weights_where_they_are():
    p = problem(10, 7)
    plain = op.solve(p, op.mean_variance(5.0), [op.full_investment(), op.long_only()])
    dear = op.solve(p, op.with_costs(op.mean_variance(5.0), linear_bps=100), [op.full_investment(), op.long_only()])
    some = op.solve(p, op.with_costs(op.mean_variance(5.0), linear_bps=1, impact=1e-3), [op.full_investment(), op.long_only()])
    moved = lambda s: np.abs(s.weights - p.benchmark).sum()
    assert moved(dear) < 1e-5 < moved(some) < moved(plain)


def test_contradictions_are_found_and_measured():
    p = problem(10, 9)
    cs = [op.full_investment(), op.long_only(), op.weight_bounds(0.05)]
    assert not op.solve(p, op.minimise_variance(), cs).feasible
    d = op.diagnose(p, op.minimise_variance(), cs)
    assert d["constraint"].tolist() == ["weight_bounds"] and d["slack"][0] == pytest.approx(0.05, abs=1e-3)


def test_top_names():
    p = problem(30, 11)
    s = op.select_top(p, op.minimise_tracking_error(), [op.full_investment(), op.long_only()], 10)
    assert s.feasible and (s.weights > 1e-6).sum() <= 10 and abs(s.weights.sum() - 1) < 1e-5


def test_l1_ball_and_empty():
    assert np.allclose(op.l1_ball(np.array([3.0, -1.0]), 2), [2, 0]) and np.allclose(op.l1_ball(np.array([0.5, 0.5]), 2), [0.5, 0.5])
    assert op.solve(op.Problem([], np.zeros(0), np.zeros((0, 0))), op.minimise_variance(), []).feasible


def test_groups_in_parallel(spark):
    rows = [(g, f"n{i}", 0.1, 1.0 + (i if g == "x" else 0)) for g in "xy" for i in range(10)]
    df = spark.createDataFrame(rows, "day string, name string, b double, v double")
    got = op.solve_groups(df, "day", "name", "b", [], op.minimise_variance(), [op.full_investment(), op.long_only()], "v").collect()
    w = {(r["day"], r["name"]): r["weight"] for r in got}
    inv = np.array([1 / (1.0 + i) for i in range(10)])
    assert all(r["feasible"] for r in got) and all(abs(w["x", f"n{i}"] - inv[i] / inv.sum()) < 1e-4 and abs(w["y", f"n{i}"] - 0.1) < 1e-4 for i in range(10))
