from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexloom.functions import dates
from indexloom.operators import compare, research, risk, series, text
from indexloom.operators import crosssection as cs
from indexloom.operators import regression as rg

D = dt.date
CUTS = {"L": 0.7, "M": 0.85, "S": 0.98}


def test_buffer_holds_neighbours_within_the_width_only(spark):
    r = random.Random(4)
    rows = [(1, f"n{i:03}", float(round(1e6 / (i + 1) ** 1.3)), r.choice(["L", "M", "S", "X", None])) for i in range(200)] + [(1, "none", None, "L"), (1, "zero", 0.0, None)]
    got = {x["n"]: x for x in cs.buffered_bands(spark.createDataFrame(rows, "g int, n string, size double, before string"), ["g"], "size", "n", CUTS, "X", "before", 0.02).collect()}
    total, run = sum(s for *_, s, _ in rows if s), 0.0
    names, cuts = "LMSX", [0.7, 0.85, 0.98]
    for _, n, s, before in sorted((x for x in rows if x[2]), key=lambda x: (-x[2], x[1])):
        run += s
        cum = round(run / total, 12)
        hard = next((b for b, c in zip("LMS", cuts, strict=True) if cum <= c), "X")
        near = before is not None and abs(names.index(before) - names.index(hard)) == 1 and round(abs(cum - cuts[min(names.index(before), names.index(hard))]), 12) <= 0.02
        band = before if near else hard
        assert (got[n]["hard"], got[n]["band"], got[n]["held"], got[n]["moved"]) == (hard, band, near, before is not None and band != before)
    assert got["none"]["band"] == "X" and got["none"]["moved"] and any(x["held"] for x in got.values())
    summary = cs.band_summary(spark.createDataFrame(list(got.values())), ["g"], "size").collect()
    assert sum(x["n"] for x in summary) == 202 and math.isclose(sum(x["weight"] or 0 for x in summary), 1)


def test_liquidity_counts_sessions_and_ranks_from_nought(spark):
    rows = [(k, D(2024, 1, 1) + dt.timedelta(3 * i), 10.0 + i % 3, v, i == 9) for k, v in (("a", 5.0), ("b", 1.0), ("c", None)) for i in range(10)]
    got = {r["k"]: r for r in cs.liquidity(spark.createDataFrame(rows, "k string, d date, c double, v double, p boolean"), "k", "d", "c", "v", "p", 4).collect()}
    assert got["a"]["n"] == 4 and got["a"]["paused"] and got["a"]["percentile"] == 1 and got["b"]["percentile"] == 0.5 and got["c"]["percentile"] == 0 and got["c"]["traded"] is None
    assert cs.liquidity(spark.createDataFrame([], "k string, d date, c double, v double, p boolean"), "k", "d", "c", "v", "p", 4).count() == 0


def test_newey_west_by_group_is_the_single_one(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(r.normal(size=60))] + [("b", i, float(x)) for i, x in enumerate(r.normal(size=40))], "g string, t int, v double")
    by = {x["g"]: x for x in research.newey_west_by(df, "g", "t", "v", 4).collect()}
    for g in "ab":
        one = research.newey_west(df.where(F.col("g") == g), "t", "v", 4).first()
        assert math.isclose(one["mean"], by[g]["mean"]) and math.isclose(one["se"], by[g]["se"]) and one["n"] == by[g]["n"]


def test_joint_alpha_is_the_quadratic_form(spark):
    r = np.random.default_rng(2)
    f = r.normal(0.01, 0.05, (120, 2))
    y = 0.001 + f @ r.normal(size=(2, 5)) + r.normal(0, 0.02, (120, 5))
    x = np.column_stack([np.ones(120), f])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    s = (y - x @ b).T @ (y - x @ b) / 120
    m, v = f.mean(0), np.cov(f.T, bias=True)
    want = (120 - 5 - 2) / 5 * (b[0] @ np.linalg.solve(s, b[0])) / (1 + m @ np.linalg.solve(v, m))
    assert math.isclose(rg.joint_alpha_test(y, f)["statistic"], want, rel_tol=1e-8)
    df = spark.createDataFrame(np.c_[f, y].tolist() + [[None] * 7], "f0 double, f1 double, y0 double, y1 double, y2 double, y3 double, y4 double")
    got, p = rg.joint_alpha(rg.gram_matrix(df, df.columns), 2)
    assert math.isclose(got, want, rel_tol=1e-6) and 0 < p < 1


def test_marginal_contributions_add_up_to_the_volatility(spark):
    r = np.random.default_rng(3)
    x, w, s = r.normal(size=(6, 2)), r.dirichlet(np.ones(6)), r.uniform(1, 2, 6)
    a = r.normal(size=(2, 2))
    f = a @ a.T
    c = x @ f @ x.T + np.diag(s)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = risk.marginal_contributions(
        frame([(i, float(w[i])) for i in range(6)], "n int, w double"), frame([(i, f"f{k}", float(x[i, k])) for i in range(6) for k in range(2)], "n int, factor string, exposure double"),
        frame([(f"f{i}", f"f{j}", float(f[i, j])) for i in range(2) for j in range(2)], "a string, b string, cov double"), frame([(i, float(s[i])) for i in range(6)], "n int, specific double"), "n", 12.0,
    ).collect()
    sd = math.sqrt(w @ c @ w)
    assert all(math.isclose(g["marginal"], (c @ w)[g["n"]] / sd * math.sqrt(12), rel_tol=1e-9) for g in got)
    assert math.isclose(sum(g["contribution"] for g in got), sd * math.sqrt(12), rel_tol=1e-9)


def test_walk_forward_windows(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, r.normal(0, [1, 2, 3]).tolist()) for i in range(100)], "t int, v array<double>")
    got = {x["estimator"]: x for x in risk.walk_forward(df, "t", "v", 40, 10).collect()}
    assert set(got) == {"sample", "components", "diagonal"} and all(x["n_windows"] == 6 and 0.5 < x["realised"] < 1.5 for x in got.values())
    assert risk.walk_forward(df.limit(20), "t", "v", 40, 10).count() == 0


def test_random_signals_show_nothing(spark):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, m, float(r.normal())) for i in range(60) for m in range(40)], "id long, m int, fwd double")
    x = research.random_benchmark(df, "m", "fwd", lambda k: F.hash("id", "m", k), 10, 20, 0.5).collect()
    assert len(x) == 10 and all(g["n_months"] == 40 and abs(g["mean_ic"]) < 0.1 and abs(g["t"]) < 5 and math.isclose(g["implied_breadth"], (0.5 / g["mean_ic"]) ** 2) for g in x)


def test_deflated_sharpe_with_standardised_trials():
    from statistics import NormalDist

    n, g = NormalDist(), 0.5772156649
    best = (1 - g) * n.inv_cdf(1 - 1 / 10) + g * n.inv_cdf(1 - 1 / (10 * math.e))
    assert math.isclose(research.deflated_sharpe(2.0, 10, 100, -0.5, 4.0), n.cdf((2.0 - best) * math.sqrt(99) / math.sqrt(1 + 0.5 * 2.0 + 0.75 * 4.0)))
    assert research.deflated_sharpe(0.3, 10, 100, trial_spread=0.1) > research.deflated_sharpe(0.3, 10, 100)
    with pytest.raises(ValueError):
        research.deflated_sharpe(1.0, 0, 100)


def test_findings_of_one_pass(spark):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(9)] + [(None, -1.0), ("z", None)], "k string, v double")
    got = {r["rule"]: r for r in compare.findings(df, [("low", "WARN", F.col("v") < 7), ("none", "BLOCK", F.col("v") > 99), ("null", "WARN", F.col("v").isNull())], F.col("k")).collect()}
    assert (got["low"]["n_bad"], got["low"]["n_rows"], got["low"]["sample"], got["low"]["passed"]) == (8, 11, "k0,k1,k2,k3,k4", False)
    assert got["none"]["passed"] and got["none"]["sample"] == "" and got["null"]["sample"] == "z"
    assert all(r["passed"] and r["n_rows"] == 0 for r in compare.findings(df.limit(0), [("low", "WARN", F.col("v") < 7)], F.col("k")).collect())


def test_a_check_that_fails_blocks(spark):
    def broken():
        raise KeyError("v")

    r = compare.guarded("prices", broken, spark).first()
    assert (r["rule"], r["severity"], r["passed"], r["sample"]) == ("prices", "BLOCK", False, "KeyError")


def test_chunks_hold_every_word_in_place(spark):
    words = {k: [f"w{i}" for i in range(n)] for k, n in enumerate((1, 219, 221, 239, 400, 1000, 0))}
    got = text.chunks(spark.createDataFrame([(k, "  ".join(w)) for k, w in words.items()] + [(9, None)], "k int, t string"), "k", "t").collect()
    assert {r["k"] for r in got} == {k for k, w in words.items() if w}
    for r in got:
        assert r["body"].split(" ") == words[r["k"]][r["first_word"] : r["first_word"] + r["n_words"]]
    for k, w in words.items():
        assert len({i for r in got if r["k"] == k for i in range(r["first_word"], r["first_word"] + r["n_words"])}) == len(w)


def test_evaluation_by_category(spark):
    rows = [("a", True, False, False, 1.0, ["3"]), ("a", False, False, True, 0.5, []), ("b", True, True, True, None, [])]
    df = spark.createDataFrame(rows, "c string, passed boolean, ab boolean, should boolean, citation_precision double, u array<string>")
    got = {r["c"]: r for r in text.report(df, "c", abstained="ab", should_abstain="should", unsupported="u").collect()}
    assert (got["a"]["accuracy"], got["a"]["citation_precision"], got["a"]["abstention_accuracy"], got["a"]["hallucination_rate"]) == (0.5, 0.75, 0.5, 0.5)
    assert got["b"]["citation_precision"] is None and got["b"]["abstained"] == 1


def test_hedge_leg_carry_and_quarter(spark):
    r = spark.createDataFrame([(100.0, 1.1, 1.0, D(2024, 5, 3))], "n double, f double, s double, d date").select(series.leg_mark(F.col("n"), F.col("f"), F.col("s")).alias("m"), series.carry(F.lit(0.05), F.lit(0.03), F.lit(0.5)).alias("c"), dates.quarter_of(F.col("d")).alias("q")).first()
    assert math.isclose(r["m"], 10) and math.isclose(r["c"], 0.01) and r["q"] == 2


def test_hysteresis_per_key(spark):
    v = [1.0, 1.4, 1.6, 1.2, 3.0, None, 2.9, 0.0]
    df = spark.createDataFrame([(k, D(2024, 1, 1) + dt.timedelta(i), x) for k in ("a", "b") for i, x in enumerate(v)] + [(None, D(2024, 1, 1), 1.0)], "k string, d date, v double")
    got = {(r["k"], r["d"].day): r["adopted"] for r in research.hysteresis(df, "k", "d", "v", 0.5).collect()}
    assert [got["a", i] for i in (1, 2, 3, 4, 5, 7, 8)] == [1.0, 1.0, 1.6, 1.6, 3.0, 3.0, 0.0] and len(got) == 14


def test_gram_of_a_panel_wider_than_a_task_holds(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, r.normal(size=7).tolist()) for i in range(50)] + [(99, None)], "t int, v array<double>").repartition(3)
    rows = lambda **kw: {(x["i"], x["j"]): x for x in risk.gram(df, "v", F.col("t") + 1.0, **kw).collect()}
    whole, blocks = rows(), rows(widest=3)
    assert set(whole) == set(blocks) and len(whole) == 28
    assert all(math.isclose(whole[k][c], blocks[k][c], rel_tol=1e-9, abs_tol=1e-9) for k in whole for c in ("n", "w", "w2", "wi", "wj", "wij"))
