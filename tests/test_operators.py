from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexloom.operators import compare, crosssection, events, pit, research, risk, series, text

D = dt.date


def brute_cap(w, cap):
    w = np.array(w) / sum(w)
    frozen = np.zeros(len(w), bool)
    for _ in range(1000):
        over = (w > cap + 1e-13) & ~frozen
        if not over.any():
            return w
        frozen |= over
        free = w[~frozen].sum()
        w = np.where(frozen, cap, w * (1 - cap * frozen.sum()) / free)
    raise AssertionError


def test_capping_equals_the_iteration(spark):
    r = random.Random(1)
    rows, want = [], {}
    for g in range(12):
        w = [r.paretovariate(1) for _ in range(r.randrange(12, 40))]
        rows += [(g, i, x) for i, x in enumerate(w)]
        want |= {(g, i): x for i, x in enumerate(brute_cap(w, 0.1))}
    got = crosssection.cap_weights(spark.createDataFrame(rows, "g int, i int, w double"), ["g"], "w", 0.1, "i").collect()
    assert all(abs(x["capped"] - want[x["g"], x["i"]]) < 1e-9 and x["feasible"] for x in got)
    tight = crosssection.cap_weights(spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0)], "g int, i int, w double"), ["g"], "w", 0.3, "i").collect()
    assert [(x["capped"], x["feasible"]) for x in tight] == [(0.5, False)] * 2


def test_ceilings_equal_the_iteration(spark):
    r = random.Random(2)
    rows, want = [], {}
    for g in range(10):
        w = np.array([r.random() + 0.01 for _ in range(20)])
        c = np.array([r.random() * 0.12 + 0.02 for _ in range(20)])
        c *= max(1, 1.1 / c.sum())
        x, frozen = w / w.sum(), np.zeros(20, bool)
        while ((x > c + 1e-13) & ~frozen).any():
            frozen |= x > c + 1e-13
            x = np.where(frozen, c, w * (1 - c[frozen].sum()) / w[~frozen].sum())
        rows += [(g, i, float(a), float(b)) for i, (a, b) in enumerate(zip(w, c, strict=True))]
        want |= {(g, i): v for i, v in enumerate(x)}
    got = crosssection.ceiling_weights(spark.createDataFrame(rows, "g int, i int, w double, c double"), ["g"], "w", "c", "i").collect()
    assert all(abs(x["limited"] - want[x["g"], x["i"]]) < 1e-9 for x in got)


def test_group_cap_and_bands(spark):
    df = spark.createDataFrame([(0, "a", 0.5), (0, "a", 0.2), (0, "b", 0.2), (0, "c", 0.1)], "d int, k string, w double")
    got = {(r["k"], round(r["group_capped"], 6)) for r in crosssection.cap_groups(df, ["d"], "k", "w", 0.4).collect()}
    assert got == {("a", 0.285714), ("a", 0.114286), ("b", 0.4), ("c", 0.2)}
    sizes = [(1, i, float(10 ** (i % 7)) + i) for i in range(300)] + [(1, 999, None)]
    x = crosssection.cumulative_bands(spark.createDataFrame(sizes, "g int, i int, s double"), ["g"], "s", "i", {"L": 0.7, "M": 0.9}, "S").collect()
    order, total, run = sorted([s for s in sizes if s[2]], key=lambda s: (-s[2], s[1])), sum(s[2] for s in sizes if s[2]), 0.0
    want = {999: "S"}
    for _, i, s in order:
        run += s
        want[i] = "L" if run / total <= 0.7 else "M" if run / total <= 0.9 else "S"
    assert {r["i"]: r["band"] for r in x} == want


def test_rank_normal_and_quantile_bins(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([3.0, 1.0, 2.0, 2.0, None])], "d int, i int, v double")
    got = {r["i"]: r["normal"] for r in crosssection.rank_normalise(df, ["d"], "v").collect()}
    assert got[4] is None and got[2] == got[3] and abs(got[0] + got[1]) < 1e-12 and got[0] > 0
    import pandas as pd

    n = 23
    b = spark.range(n).select(F.lit(0).alias("d"), "id", F.col("id").cast("double").alias("v")).withColumn("b", crosssection.quantile_bin("v", ["d"], 5, "id")).orderBy("id")
    assert [r["b"] for r in b.collect()] == list(pd.qcut(pd.Series(range(n)), 5, labels=False) + 1)


def test_latest_row_is_whole_and_carry_forward(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), 1.0, 5.0), ("a", D(2020, 1, 2), None, 6.0)], "k string, d date, x double, y double")
    assert tuple(pit.latest_by(df, ["k"], ["d"]).select("k", "x", "y").first()) == ("a", None, 6.0)
    cal = spark.createDataFrame([("a", D(2019, 12, 31)), ("a", D(2020, 1, 5))], "k string, d date")
    assert [(r["x"], r["age_days"]) for r in pit.carry_forward(cal, df, "k", "d", "x").orderBy("d").collect()] == [(None, None), (1.0, 4)]


def test_point_in_time_differs_from_the_naive_query(spark):
    f = spark.read.parquet("/root/testdata/sf0.01/fundamentals.parquet")
    a, b = (q(f, "2023-06-30", ["BOOK_EQUITY"]).select("security_id", "period_end", "filed_date") for q in (pit.pit_latest, pit.naive_latest))
    assert not b.exceptAll(a).isEmpty() and a.where("filed_date > DATE'2023-06-30'").isEmpty()


def test_events_and_effects(spark):
    rows = [("1", "S", "SPLIT", D(2020, 1, 1), '{"ratio": 2.0}'), ("2", "S", "SPLIT", D(2020, 1, 1), '{"ratio": 0}'), ("3", "S", "CASH_DIVIDEND", None, '{"amount": 1, "currency": "USD"}'), ("4", "S", "CASH_DIVIDEND", D(2020, 1, 1), '{"amount": 1}'), ("5", "S", "SUSPENSION", D(2020, 1, 1), "{}"),
            ("6", "S", "SPLIT", D(2020, 1, 1), "{oops"), ("7", "S", "RIGHTS_ISSUE", D(2020, 1, 1), '{"subscription_price": 70, "new_shares": 1, "per_held": 4}'), ("8", "S", "SPLIT", D(2020, 1, 1), None)]
    e = events.parse(spark.createDataFrame(rows, "event_id string, security_id string, event_type string, ex_date date, payload string"))
    assert {r["event_id"]: r["reason"] for r in e.collect()} == {"1": None, "2": "not_positive:ratio", "3": "no_ex_date", "4": "missing:currency", "5": "unknown_type", "6": "bad_json", "7": None, "8": "bad_json"}
    after = {r["event_id"]: r["p2"] for r in e.where("reason IS NULL").withColumn("close", F.lit(100.0)).withColumn("p2", events.price_effect()).collect()}
    assert after == {"1": 50.0, "7": 94.0}


def test_second_moments_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=(200, 6))
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "t int, v array<double>").repartition(5)
    c = risk.covariances(df, "v")
    assert np.allclose(risk.matrix_of(c), np.cov(x.T)) and np.allclose(risk.matrix_of(c, "corr"), np.corrcoef(x.T))
    live = df.where("v IS NOT NULL")
    w = 0.5 ** ((199 - np.arange(200)) / 30)
    m = (w[:, None] * x).sum(0) / w.sum()
    want = ((w[:, None] * (x - m)).T @ (x - m)) / w.sum() / (1 - (w**2).sum() / w.sum() ** 2)
    assert np.allclose(risk.matrix_of(risk.decayed_covariances(live, "v", "t", 30.0)), want)
    s = risk.shrink_to_constant_correlation(df, "v")
    assert 0 <= s.intensity <= 1 and np.allclose(np.diag(s.covariance), np.var(x, axis=0))
    low, values = risk.principal_covariance(np.cov(x.T), 6)
    assert np.allclose(low, np.cov(x.T)) and (np.diff(values) <= 0).all()
    mv = risk.minimum_variance(np.cov(x.T), 1.0)
    assert abs(mv.sum() - 1) < 1e-12 and (np.linalg.eigvalsh(risk.positive_definite(np.array([[1, 2.0], [2, 1]]))) > 0).all()
    weights = spark.createDataFrame([(i, float(v)) for i, v in enumerate(mv)], "i int, weight double")
    assert abs(risk.portfolio_variance(weights, c).first()["variance"] - mv @ np.cov(x.T) @ mv) < 1e-12


def test_hysteresis_and_multiple_testing(spark):
    v = [1.0, 1.1, 1.3, 1.2, 0.9, None]
    df = spark.createDataFrame([("a", D(2020, 1, i + 1), x) for i, x in enumerate(v)], "k string, d date, v double")
    assert [r["adopted"] for r in research.hysteresis(df, "k", "d", "v", 0.2).orderBy("d").collect()] == [1.0, 1.0, 1.3, 1.3, 0.9]
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate([5.0, 2.6, 2.4, 1.0, 0.1])], "n string, t double")
    got = {r["n"]: (r["bonferroni"], r["benjamini_hochberg"]) for r in research.multiple_testing(t, "n", "t", 0.05).collect()}
    assert got == {"0": (True, True), "1": (True, True), "2": (False, True), "3": (False, False), "4": (False, False)}
    assert research.deflated_sharpe(0.1, 1, 500) > research.deflated_sharpe(0.1, 100, 500)


def test_series(spark):
    df = spark.createDataFrame([("a", D(2020, 1, i + 1), x) for i, x in enumerate([100.0, 110.0, 99.0, 0.0, 50.0])], "k string, d date, v double")
    r = [x["ret"] for x in series.with_returns(df, "k", "d", "v").orderBy("d").collect()]
    assert r[0] is None and abs(r[1] - 0.1) < 1e-12 and r[3] == -1 and r[4] is None
    s = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.5), ("a", 3, 3.0)], "k string, o int, r double")
    assert [round(x["factor"], 9) for x in series.cumulative_factor(s, "k", "o", "r").orderBy("o").collect()] == [3.0, 1.5, 3.0]


def test_hash_does_not_depend_on_order_and_sees_changes(spark):
    a = spark.range(1000).selectExpr("id", "id % 7 as x")
    h = lambda df: compare.content_hash(df).first()["content_hash"]
    assert h(a) == h(a.orderBy(F.desc("id")).repartition(7)) != h(a.withColumn("x", F.when(F.col("id") == 5, 9).otherwise(F.col("x"))))
    assert compare.content_hash(a.limit(0)).first()["n_rows"] == 0


def test_text_pages_numbers_and_grades(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.page_text(F.lit("<html><style>p{}</style><script>x<1</script><p>A &amp; B&nbsp;&lt;c&gt;</p></html>"))) == "A & B <c>"
    assert one(text.tokens(F.lit("The Index's level, 12!"))) == ["index's", "level", "12"] and one(text.tokens(F.lit(None).cast("string"))) == []
    assert one(text.unsupported_numbers(F.lit("It rose 1,234.5 or 12.30% of 7"), F.array(F.lit("1234.5"), F.lit("7")))) == ["12.30"]
    assert "12.30" in one(text.renderings(F.lit(0.123)))
    rows = [("Divisor is 300.", ["divisor"], ["error"], ["a", "b"], ["a"], False, False), ("no", ["divisor"], [], [], [], True, True), ("no", ["divisor"], [], [], [], False, True)]
    g = text.grade(spark.createDataFrame(rows, "ans string, m array<string>, n array<string>, c array<string>, e array<string>, ab boolean, sh boolean"), answer="ans", must="m", must_not="n", cited="c", expected="e", abstained="ab", should_abstain="sh").collect()
    assert [(r["passed"], r["citation_precision"]) for r in g] == [(True, 0.5), (True, None), (False, None)]


def test_chunks_cover_all_words(spark):
    docs = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate([0, 1, 219, 220, 221, 240, 260, 400, 1000])] + [(99, None)]
    got = {}
    for r in text.chunks(spark.createDataFrame(docs, "i int, t string"), "i", "t").collect():
        got.setdefault(r["i"], set()).update(r["body"].split())
    assert {k: len(v) for k, v in got.items()} == {i: len(t.split()) for i, t in docs if t}


@pytest.mark.parametrize("window", [1, 5])
def test_nearest_against_brute_force(spark, window):
    r = random.Random(6)
    day = lambda: D(2020, 1, 1) + dt.timedelta(r.randrange(60))
    a = [(f"e{i}", r.choice("xy"), day()) for i in range(60)]
    b = [(i, r.choice("xyz"), day()) for i in range(60)]
    got = {x["e"]: (x["gap"], x["b"]) for x in pit.nearest(spark.createDataFrame(a, "e string, k string, d date"), spark.createDataFrame(b, "b int, k string, f date"), "k", "d", "f", "e", "b", window).collect()}
    want = {e: min((abs((d - f).days), i) for i, kk, f in b if kk == k and abs((d - f).days) <= window) for e, k, d in a if any(kk == k and abs((d - f).days) <= window for _, kk, f in b)}
    assert got == want
