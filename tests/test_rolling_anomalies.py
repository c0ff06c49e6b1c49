from __future__ import annotations

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from indexloom.operators.anomalies import ForestParams, average_path, forest_scores, implausible_readings, score_readings
from indexloom.operators.rolling import daily_totals, entity_calendar, trailing

D = dt.date
P = "l string, d date, c double, v double, x boolean, score double, day int"


def totals(spark, rows):
    return daily_totals(spark.createDataFrame(rows, P), entity="l", day="d", amount=F.when((F.col("c") > 0) & (F.col("c") < float("inf")), F.col("c") * F.col("v")), prefer=F.col("v"))


def test_trailing_against_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), D(2022, 1, 1) + dt.timedelta(r.randrange(150)), r.choice([1.0, 2.5, None, float("nan"), float("inf"), -1.0]), r.choice([1.0, 4.0, None, 0.0]), None, 0.0, 0) for _ in range(150)]
    rows += [(None, D(2022, 1, 1), 1.0, 1.0, None, 0.0, 0), ("a", None, 1.0, 1.0, None, 0.0, 0)]
    day = {}
    for l, d, c, v, *_ in rows:
        if l and d:
            amount = c * v if c is not None and v is not None and 0 < c < float("inf") else None
            key = (-1.0 if v is None else v, float("-inf") if amount is None else amount)
            day[l, d] = max(day.get((l, d), ((-2.0, 0.0), None)), (key, amount), key=lambda z: z[0])
    t = totals(spark, rows)
    got = trailing(entity_calendar(t), t, [7, 30]).collect()
    spans = {}
    for l, d in day:
        a, b = spans.get(l, (d, d))
        spans[l] = min(a, d), max(b, d)
    assert len(got) == sum((b - a).days + 1 for a, b in spans.values())
    for g in got:
        for w in (7, 30):
            inside = [day[g["entity"], g["day"] - dt.timedelta(i)][1] for i in range(w) if (g["entity"], g["day"] - dt.timedelta(i)) in day]
            want = sum(x or 0.0 for x in inside)
            assert abs(g[f"total_{w}"] - want) < 1e-9 and abs(g[f"average_{w}"] - want / w) < 1e-9 and g[f"active_{w}"] == len(inside)


def test_calendar_goes_on_while_a_window_holds_the_last_total(spark):
    t = totals(spark, [("a", D(2022, 1, 1), 2.0, 3.0, None, 0.0, 0), ("a", D(2022, 3, 1), 1.0, 1.0, None, 0.0, 0)])
    got = {r["day"]: (r["total_7"], r["total_30"]) for r in trailing(entity_calendar(t, tail_days=29), t, [7, 30]).collect()}
    assert len(got) == 60 + 29 and max(got) == D(2022, 3, 30)
    assert got[D(2022, 3, 30)] == (0.0, 1.0) and got[D(2022, 3, 7)] == (1.0, 1.0) and got[D(2022, 3, 8)] == (0.0, 1.0) and got[D(2022, 1, 31)] == (0.0, 0.0)


def test_spans_over_bucket_borders_repeated_rows_and_busy_entities(spark):
    r = random.Random(2)
    days = sorted({D(2020, 1, 1) + dt.timedelta(r.randrange(700)) for _ in range(300)})
    t = totals(spark, [("a", d, 1.0, float(i + 1), None, 0.0, 0) for i, d in enumerate(days)])
    cal = spark.createDataFrame([("a", D(2020, 1, 1), D(2022, 3, 1)), ("a", D(2020, 1, 1), D(2022, 3, 1)), ("b", D(2020, 5, 1), D(2020, 5, 3)), ("a", None, None)], "entity string, first date, last date")
    got = {(x["entity"], x["day"]): (x["total_7"], x["total_30"]) for x in trailing(cal, t, [7, 30]).collect()}
    assert len(got) == (D(2022, 3, 1) - D(2020, 1, 1)).days + 1 + 3
    for (e, day), sums in got.items():
        assert sums == tuple(sum(i + 1.0 for i, d in enumerate(days) if e == "a" and 0 <= (day - d).days < w) for w in (7, 30))


def test_asked_days_without_any_total_give_zero(spark):
    t = totals(spark, [("a", D(2022, 1, 1), 2.0, 3.0, None, 0.0, 0)])
    cal = spark.createDataFrame([("a", D(2022, 1, 7)), ("a", D(2022, 1, 8)), ("z", D(2022, 1, 1)), ("a", None)], "entity string, day date")
    got = {(r["entity"], r["day"]): (r["total_7"], r["total_30"], r["active_7"]) for r in trailing(cal, t, [7, 30]).collect()}
    assert got == {("a", D(2022, 1, 7)): (6.0, 6.0, 1), ("a", D(2022, 1, 8)): (0.0, 6.0, 0), ("z", D(2022, 1, 1)): (0.0, 0.0, 0)}
    e = totals(spark, [])
    assert trailing(entity_calendar(e), e, [7]).count() == 0


def series(seed, n=120, sd=0.01):
    r = np.random.default_rng(seed)
    return np.round(50 * np.exp(np.cumsum(r.normal(0, sd, n))), 3).tolist()


def rows_of(name, closes, volume=100.0):
    return [(name, D(2022, 1, 3) + dt.timedelta(i), c, volume, False, 0.0, 0) for i, c in enumerate(closes)]


def flags(spark, rows):
    x = score_readings(spark.createDataFrame(rows, P), source="l", day="d", value="c", activity="v", paused="x")
    return {(r["source"], r["day"]): r for r in x.collect()}


def test_spikes_runs_limits_and_a_level_shift(spark):
    rows = []
    one, three, shift, stuck, bad = (series(i) for i in range(5))
    one[50] *= 1.8
    three[60:63] = [c * 0.5 for c in three[60:63]]
    shift[70:] = [c * 2 for c in shift[70:]]
    stuck[20:29] = [stuck[20]] * 9
    bad[10], bad[11], bad[12], bad[13] = 0.0, float("nan"), float("inf"), None
    for name, c in zip("abcde", (one, three, shift, stuck, bad), strict=True):
        rows += rows_of(name, c)
    quiet = rows_of("f", [7.0] * 60, 0.0)
    got = flags(spark, rows + quiet + rows[:30])
    at = lambda k, i: got[k, D(2022, 1, 3) + dt.timedelta(i)]
    assert {k for k, r in got.items() if r["spike"]} == {("a", D(2022, 1, 3) + dt.timedelta(50)), *[("b", D(2022, 1, 3) + dt.timedelta(i)) for i in (60, 61, 62)]}
    assert {k for k, r in got.items() if r["stuck"]} == {("d", D(2022, 1, 3) + dt.timedelta(i)) for i in range(21, 29)}
    assert [at("e", i)["impossible"] for i in range(10, 14)] == [True, True, True, False]
    assert sum(r["impossible"] for r in got.values()) == 3
    assert at("e", 13)["score"] is None and at("a", 50)["score"] > 0.6
    assert len(got) == 5 * 120 + 60


def cases(c):
    """The exact rule by brute force: positions of excursions and of stuck readings."""
    move = np.abs(np.diff(np.log(c)))
    usual, l = np.sort(move[move > 0])[(np.count_nonzero(move) - 1) // 2], np.log(c)
    spikes, stuck, start = set(), set(), 0
    for k in (1, 2, 3):
        for i in range(len(c) - k - 1):
            far = min(min(abs(x - l[i]), abs(x - l[i + k + 1])) for x in l[i + 1 : i + k + 1])
            if far > 10 * usual and abs(l[i + k + 1] - l[i]) < 0.5 * far:
                spikes |= set(range(i + 1, i + k + 1))
    for i in range(1, len(c) + 1):
        if i == len(c) or c[i] != c[start]:
            stuck |= set(range(start + 1, i)) if i - start >= 6 else set()
            start = i
    return spikes, stuck


def test_every_case_of_often_stuck_and_coarse_sources_is_found(spark):
    rows, want = [], {}
    for seed in range(20):
        often, coarse = np.array(series(seed, 300)), np.round(np.array(series(seed, 300, 0.004)) * 2) / 2
        for at in range(10, 270, 75):
            often[at : at + 30] = often[at]  # 40 % of the readings
        often[52] *= 1.4
        coarse[150] = round(coarse[150] * 3.2) / 2
        for name, c in ((f"often{seed}", often), (f"coarse{seed}", coarse)):
            rows += rows_of(name, c.tolist())
            want[name] = cases(c)
    got = flags(spark, rows)
    for i, kind in enumerate(("spike", "stuck")):
        found = {k for k, r in got.items() if r[kind]}
        assert found == {(name, D(2022, 1, 3) + dt.timedelta(j)) for name, w in want.items() for j in w[i]} and found


def test_no_gate_loses_a_case(spark):
    c = series(3, 200)
    c[20:29], c[90] = [c[20]] * 9, c[90] * 1.5
    x = score_readings(spark.createDataFrame(rows_of("a", c), P), source="l", day="d", value="c", activity="v", paused="x", params=ForestParams(gate=2.0))
    got = x.where("spike OR stuck").count()
    assert got == 9


def test_the_forest_says_what_it_suspects_and_flags_come_from_the_rules_alone(spark):
    c = series(3, 200)
    c[20:29], c[90] = [c[20]] * 9, c[90] * 1.5
    rows = spark.createDataFrame(rows_of("a", c) + [(None, D(2022, 1, 1), -1.0, 1.0, False, 0.0, 0)], P)
    by = {"source": "l", "day": "d", "value": "c", "activity": "v", "paused": "x"}
    names = ["source", "day", "impossible", "spike", "stuck"]
    plain = implausible_readings(rows, **by)
    flagged = sorted(map(tuple, plain.collect()), key=str)
    assert plain.columns == names and sum(any(r[2:]) for r in flagged) == 10
    for gate in (0.0, 0.42, 0.6, 2.0):
        got = score_readings(rows, **by, params=ForestParams(gate=gate)).collect()
        assert all(r["suspected"] == (r["score"] is not None and r["score"] >= gate) for r in got)
        assert sorted((tuple(r[k] for k in names) for r in got), key=str) == flagged


def test_paused_or_idle_readings_end_a_run(spark):
    rows = rows_of("d", series(9)[:40] + [5.0] * 11)
    rows[45] = (*rows[45][:4], True, 0.0, 0)
    assert not any(r["stuck"] for r in flags(spark, rows).values())
    rows[45] = (*rows[45][:4], None, 0.0, 0)
    assert sum(r["stuck"] for r in flags(spark, rows).values()) == 10


def test_unplaced_rows_single_readings_and_empty_tables(spark):
    rows = [(None, D(2022, 1, 1), 1.0, 1.0, False, 0.0, 0), ("a", None, -1.0, 1.0, False, 0.0, 0), ("b", D(2022, 1, 1), 1.0, None, None, 0.0, 0)]
    x = score_readings(spark.createDataFrame(rows, P), source="l", day="d", value="c", activity="v", paused="x").collect()
    assert len(x) == 3 and sum(r["impossible"] for r in x) == 1 and not any(r["spike"] or r["stuck"] for r in x)
    assert score_readings(spark.createDataFrame([], P), source="l", day="d", value="c", activity="v", paused="x").count() == 0


def test_forest_isolates_the_odd_one_and_is_deterministic():
    r = np.random.default_rng(0)
    x = np.abs(r.normal(0, 1, (200, 4))).astype(np.float32)
    x[7] = 9
    g, ok = np.repeat([0, 1], 100), np.ones(200, bool)
    seeds = np.array([5, 6], np.uint64)
    s = forest_scores(x, g, seeds, ok, ForestParams())
    assert s.argmax() == 7 and s[7] > 0.7 and np.median(s) < 0.45
    alone = forest_scores(x[100:], np.zeros(100, int), seeds[1:], ok[100:], ForestParams())
    assert np.allclose(s[100:], alone)
    assert list(average_path(np.array([0, 1, 2]))) == [0, 0, 1]
