from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from indexloom.operators.asof import as_known

D = dt.date
V = "s string, item string, p date, f date, value double, note string"
E = "s string, k date, note string"


def run(spark, events, versions, **kw):
    ev, ve = spark.createDataFrame(events, E), spark.createDataFrame(versions, V)
    x = as_known(ev, ve, entity=["s"], event_time="k", order=["p", "f"], variants={"item": ["A", "B"]}, clocks={"known": F.greatest("f", "p"), "hindsight": F.col("p")}, **kw)
    return {(r["s"], r["k"], r["item"]): (tuple(r["known"]) if r["known"] else None, tuple(r["hindsight"]) if r["hindsight"] else None) for r in x.collect()}


def brute(events, versions):
    out = {}
    for s, k, _ in events:
        if s is None or k is None:
            continue
        for item in "AB":
            ok = [(p, f) for vs, vi, p, f, _, _ in versions if vs == s and vi == item and p and f and p <= k]
            known = [x for x in ok if x[1] <= k]
            out[s, k, item] = max(known, default=None), max(ok, default=None)
    return out


def random_case(seed, n=60):
    r = random.Random(seed)
    day = lambda: D(2020, 1, 1) + dt.timedelta(r.randrange(900))
    versions = [(r.choice(["x", "y", None]), r.choice("ABC"), r.choice([day(), day(), day(), None]), r.choice([day(), day(), None]), 1.0, "n") for _ in range(n)]
    events = [(r.choice(["x", "y", "z", None]), r.choice([day(), day(), None]), "e") for _ in range(n // 2)]
    return events + events[:5], versions + versions[:5]


def test_against_brute_force_uncut_and_in_shards(spark):
    for seed in range(3):
        events, versions = random_case(seed)
        want = brute(events, versions)
        assert run(spark, events, versions, shard_days=36_600) == want
        assert run(spark, events, versions) == want
        assert run(spark, events, versions, shard_days=20) == want


def test_restatement_of_an_old_period_does_not_win_and_same_day_counts(spark):
    versions = [("x", "A", D(2021, 3, 31), D(2021, 4, 10), 1.0, ""), ("x", "A", D(2021, 6, 30), D(2021, 7, 10), 1.0, ""), ("x", "A", D(2021, 3, 31), D(2021, 8, 1), 2.0, "")]
    got = run(spark, [("x", D(2021, 7, 10), ""), ("x", D(2021, 9, 1), ""), ("x", D(2021, 4, 9), "")], versions)
    assert got["x", D(2021, 7, 10), "A"][0] == (D(2021, 6, 30), D(2021, 7, 10))
    assert got["x", D(2021, 9, 1), "A"][0] == (D(2021, 6, 30), D(2021, 7, 10))
    assert got["x", D(2021, 4, 9), "A"] == (None, (D(2021, 3, 31), D(2021, 8, 1)))
    assert got["x", D(2021, 9, 1), "B"] == (None, None)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [("x", D(2021, 1, 1), "")], []) == {("x", D(2021, 1, 1), "A"): (None, None), ("x", D(2021, 1, 1), "B"): (None, None)}


def test_clashing_extra_columns(spark):
    ev = spark.createDataFrame([("x", D(2021, 5, 1), 1, 2, 3)], "s string, k date, t int, asked int, v0 int")
    ve = spark.createDataFrame([("x", "A", D(2021, 3, 31), D(2021, 4, 1), 1, 2)], "s string, item string, p date, f date, shard int, hot int")
    r = as_known(ev, ve, entity=["s"], event_time="k", order=["p", "f"], variants={"item": ["A"]}, clocks={"known": F.col("f")}).collect()
    assert len(r) == 1 and tuple(r[0]["known"]) == (D(2021, 3, 31), D(2021, 4, 1))


def test_event_times_within_a_day_and_other_orders(spark):
    ev = spark.createDataFrame([("x", dt.datetime(2021, 5, 1, h), 0) for h in (1, 5, 9, 13)], "s string, k timestamp, n int")
    ve = spark.createDataFrame([("x", dt.datetime(2021, 5, 1, h), v, c) for h, v, c in ((2, 1, "a"), (5, 3, "b"), (6, 2, "c"), (12, 3, "c"))], "s string, t timestamp, v int, c string")
    for days in (1 / 24, 0.25, 366):
        x = as_known(ev, ve, entity=["s"], event_time="k", order=["v", "c"], clocks={"known": F.col("t")}, shard_days=days)
        assert sorted((r["k"].hour, tuple(r["known"]) if r["known"] else None) for r in x.collect()) == [(1, None), (5, (3, "b")), (9, (3, "b")), (13, (3, "c"))]


def test_every_key_gets_carry_in_with_the_default_shards(spark):
    versions = [("x", "A", D(2015, 3, 31), D(2015, 4, 10), 1.0, "")]
    got = run(spark, [("x", D(y, 6, 1), "") for y in range(2014, 2024)], versions)
    assert [got["x", D(y, 6, 1), "A"][0] is not None for y in range(2014, 2024)] == [False] + [True] * 9


def test_a_hot_entity_is_cut_and_no_side_is_broadcast_by_hint(spark):
    n = 3000
    ev = spark.range(n).select(F.lit("x").alias("s"), F.expr("date_add(date'2010-01-01', cast(id as int))").alias("k"))
    ve = spark.range(n).select(F.lit("x").alias("s"), F.lit("A").alias("item"), F.expr("date_add(date'2010-01-01', cast(id as int))").alias("p"), F.expr("date_add(date'2010-01-01', cast(id + id % 90 as int))").alias("f"))
    kw = dict(entity=["s"], event_time="k", order=["p", "f"], variants={"item": ["A"]}, clocks={"known": F.col("f")})
    cut, uncut = as_known(ev, ve, **kw, shard_days=30), as_known(ev, ve, **kw, shard_days=36_600)
    assert cut.count() == n and cut.exceptAll(uncut).isEmpty() and uncut.exceptAll(cut).isEmpty()
