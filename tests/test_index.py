from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from indexloom.operators import events, index

D = dt.date
DAY = D(2024, 1, 1)


def at(i):
    return DAY + dt.timedelta(i)


def frames(spark, prices, actions=(), reviews=(), ends=()):
    p = spark.createDataFrame([(k, at(i), c) for k, i, c in prices], "id string, day date, close double")
    a = spark.createDataFrame([(k, at(i), r, s, c) for k, i, r, s, c in actions], "id string, day date, ratio double, special double, cash double")
    r = spark.createDataFrame([(k, at(i), h) for k, i, h in reviews], "id string, day date, holding double")
    e = spark.createDataFrame([(k, at(i)) for k, i in ends], "id string, day date")
    return index.event_rows(p, a, r, e)


def levels(spark, rows, rates=(("USD", 0, 1.0),), currency=None, base=None):
    ids = {r["id"] for r in rows.select("id").distinct().collect()}
    c = spark.createDataFrame([(k, (currency or {}).get(k, "USD")) for k in ids], "id string, currency string")
    q = spark.createDataFrame([(k, at(i), x) for k, i, x in rates], "currency string, day date, rate double")
    x = index.index_levels(index.daily_values(index.timelines(rows), c, q, ["USD", "EUR"]), base)
    return {r["day"]: r for r in x.collect()}


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9)


def test_levels_start_at_the_base_and_follow_values(spark):
    got = levels(spark, frames(spark, [("a", 0, 10.0), ("a", 1, 10.0), ("a", 2, 11.0), ("b", 0, 5.0), ("b", 2, 4.0), ("b", 3, float("nan")), ("b", 4, None)], reviews=[("a", 1, 100.0), ("b", 1, 40.0)]))
    assert sorted(got) == [at(i) for i in (1, 2, 3, 4)]
    assert close(got[at(1)]["price_level"], 1000) and close(got[at(2)]["price_level"], 1000 * (1100 + 160) / 1200) and close(got[at(4)]["price_level"], 1050)
    assert close(got[at(2)]["divisor"], 1.2) and close(got[at(2)]["divisor"] * got[at(2)]["price_level"], 1260)


def test_a_split_moves_neither_level_nor_divisor_even_without_a_price_on_its_day(spark):
    prices = [("a", 0, 10.0), ("a", 1, 12.0), ("a", 3, 6.5), ("b", 0, 1.0), ("b", 2, 1.0), ("b", 3, 1.0)]
    got = levels(spark, frames(spark, prices, [("a", 2, 2.0, None, None)], [("a", 1, 10.0), ("b", 1, 10.0)]))
    assert close(got[at(2)]["price_level"], got[at(1)]["price_level"]) and close(got[at(2)]["divisor"], got[at(1)]["divisor"]) and got[at(2)]["changes"] == 0
    assert close(got[at(3)]["price_level"] / got[at(2)]["price_level"], (20 * 6.5 + 10) / (10 * 12 + 10))


def test_returned_capital_rebases_the_divisor_and_income_lifts_the_total_level_only(spark):
    prices = [("a", i, c) for i, c in enumerate([10.0, 10.0, 8.0, 7.5])]
    got = levels(spark, frames(spark, prices, [("a", 2, None, 2.0, None), ("a", 3, None, None, 0.5)], [("a", 1, 100.0)]))
    assert close(got[at(2)]["price_level"], 1000) and close(got[at(2)]["divisor"], 0.8) and close(got[at(2)]["divisor_before"], 1.0)
    assert close(got[at(3)]["price_level"], 1000 * 7.5 / 8) and close(got[at(3)]["total_level"], 1000)
    change = {r["day"]: r for r in index.divisor_changes(spark.createDataFrame(list(got.values()))).collect()}
    assert set(change) == {at(2)} and close(change[at(2)]["divisor_after"] / change[at(2)]["divisor_before"], change[at(2)]["value_after"] / change[at(2)]["value_before"])


def test_a_distribution_comes_off_before_the_split_of_its_day(spark):
    prices = [("a", 0, 10.0), ("a", 1, 10.0), ("a", 2, 4.0)]
    got = levels(spark, frames(spark, prices, [("a", 2, 2.0, 2.0, None)], [("a", 1, 100.0)]))
    assert close(got[at(2)]["price_level"], 1000)


def test_reviews_ends_and_members_without_price_keep_the_level(spark):
    prices = [("a", i, 10.0 + i) for i in range(8)] + [("b", i, 5.0) for i in range(8)] + [("c", 6, 1.0)]
    got = levels(spark, frames(spark, prices, (), [("a", 1, 10.0), ("b", 1, None), ("c", 1, 50.0), ("a", 3, 5.0), ("b", 3, 30.0), ("c", 3, 50.0)], [("b", 6)]))
    for i in range(2, 8):
        a, b = 10.0 + i, 10.0 + i - 1
        want = (a / b) if i < 3 else (5 * a + 150) / (5 * b + 150) if i < 6 else a / b
        assert close(got[at(i)]["price_level"] / got[at(i - 1)]["price_level"], want)
    assert got[at(3)]["changes"] == 2 and got[at(6)]["changes"] == 1


def test_rates_are_carried_and_unknown_currencies_have_no_value(spark):
    prices = [("a", i, 10.0) for i in range(5)] + [("b", i, 10.0) for i in range(5)] + [("x", i, 10.0) for i in range(5)]
    got = levels(spark, frames(spark, prices, (), [(k, 1, 1.0) for k in "abx"]), [("USD", 0, 1.0), ("EUR", 0, 2.0), ("EUR", 3, 1.0)], {"b": "EUR", "x": None})
    assert close(got[at(1)]["value"], 30) and close(got[at(2)]["value"], 30) and close(got[at(3)]["value"], 20) and close(got[at(3)]["price_level"], 1000 * 2 / 3)


def dense(prices, actions, reviews, ends, ids, last):
    """The index by definition: every member on every day."""
    p, u, out, level, seeded = dict.fromkeys(ids), dict.fromkeys(ids, 0.0), {}, 1000.0, False
    for i in range(last):
        act = {k: (r, s) for k, j, r, s, _ in actions if j == i}
        before = {k: p[k] for k in ids}
        for k in ids:
            ratio, special = act.get(k, (None, None))
            if p[k] is not None:
                p[k] = max(p[k] - (special or 0), 0) / (ratio or 1)
            u[k] *= ratio or 1
            for kk, j, h in reviews:
                if kk == k and j == i:
                    u[k] = h if h and before[k] is not None else 0.0
            if (k, i) in ends:
                u[k] = 0.0
        opening = sum((p[k] or 0) * u[k] for k in ids)
        for k, j, c in prices:
            if j == i:
                p[k] = c
        value = sum((p[k] or 0) * u[k] for k in ids)
        if value > 0:
            level *= value / opening if seeded and opening > 0 else 1
            seeded = True
            out[at(i)] = level
    return out


def random_case(seed):
    r = random.Random(seed)
    ids = list("abcdef")
    prices = [(k, i, round(r.uniform(5, 15), 2)) for k in ids for i in range(40) if r.random() < 0.7]
    actions = [(r.choice(ids), i, r.choice([None, 2.0, 0.5]), r.choice([None, 0.5]), None) for i in range(5, 40, 4)]
    reviews = [(k, i, r.choice([None, 0.0, 10.0, 30.0])) for i in (2, 12, 25) for k in ids]
    return ids, prices, actions, reviews, [(r.choice(ids), 30)]


@pytest.mark.parametrize("seed", range(3))
def test_against_the_definition_and_rolled_on_from_a_state(spark, seed):
    ids, prices, actions, reviews, ends = random_case(seed)
    rows = frames(spark, prices, actions, reviews, ends)
    got, want = levels(spark, rows), dense(prices, actions, reviews, ends, ids, 40)
    assert got and all(close(r["price_level"], want[d]) for d, r in got.items())
    day = at(20)
    past = rows.where(F.col("day") <= F.lit(day))
    state = index.index_state(index.timelines(past), day.isoformat())
    last = max(levels(spark, past).items())[1]
    rolled = levels(spark, rows.where(F.col("day") > F.lit(day)).unionByName(index.event_rows(state=state)), base=index.Base(last["price_level"], last["total_level"]))
    assert all(close(r["price_level"], got[d]["price_level"]) and close(r["total_level"], got[d]["total_level"]) for d, r in rolled.items() if d > day)
    assert {d for d in rolled if d > day} == {d for d in got if d > day}


def test_empty(spark):
    assert levels(spark, frames(spark, [])) == {}


PAYLOADS = [
    ("CASH_DIVIDEND", '{"amount": 1, "currency": "USD"}', 10, 9.0, 100.0), ("SPLIT", '{"ratio": 2}', 20, 5.0, 200.0), ("RIGHTS_ISSUE", '{"subscription_price": 5, "new_shares": 1, "per_held": 4, "cum_price": 10}', 30, 9.0, 125.0),
    ("SPINOFF", '{"spinco_security_id": "s", "shares_per_parent_share": 0.5, "value_per_parent_share": 3, "parent_cum_price": 10}', 40, 7.0, 100.0), ("SHARES_CHANGE", '{"new_shares": 130, "old_shares": 100}', 50, 10.0, 130.0),
    ("FLOAT_CHANGE", '{"new_float": 0.5, "old_float": 0.7}', 51, 10.0, 100.0), ("MERGER_STOCK", '{"acquirer_security_id": "x", "exchange_ratio": 0.4, "implied_value_per_share": 12}', 60, 12.0, 0.0),
    ("MERGER_CASH", '{"cash_per_share": 13}', 61, 13.0, 0.0), ("DELISTING", "{}", 62, 0.0, 0.0),
]


def test_effects_of_every_type(spark):
    rows = [(f"e{i}", t, "s", D(2024, 1, 5), p) for i, (t, p, *_) in enumerate(PAYLOADS)]
    rows += [("x", "MERGER", "s", D(2024, 1, 5), "{}"), ("y", "SPLIT", "s", D(2024, 1, 5), '{"ratio": -1}'), ("z", "SPLIT", "s", D(2024, 1, 5), "{"), ("w", "SPINOFF", "s", D(2024, 1, 5), "{}"), ("v", "SPLIT", "s", None, '{"ratio": 2}')]
    e = events.parse(spark.createDataFrame(rows, "event_id string, event_type string, security_id string, ex_date date, payload string"))
    reasons = {r["event_id"]: r["reason"] for r in e.collect()}
    assert [reasons[k] for k in "xyzwv"] == ["unknown_type", "not_positive:ratio", "bad_json", "missing:value_per_parent_share", "no_ex_date"]
    p = spark.createDataFrame([("s", D(2024, 1, 3), 11.0), ("s", D(2024, 1, 4), 10.0), ("s", D(2024, 1, 5), 1.0)], "security_id string, date date, close double")
    x = events.effects(events.cum_prices(e.where("reason IS NULL"), p), F.lit(100.0), F.lit(0.7))
    got = {r["event_type"]: r for r in x.collect()}
    for t, _, order, price, shares in PAYLOADS:
        r = got[t]
        assert (r["apply_order"], r["price_after"], r["shares_after"], r["float_after"]) == (order, price, shares, 0.5 if t == "FLOAT_CHANGE" else 0.7), t
    assert got["SPLIT"]["value_factor"] == 1 and got["RIGHTS_ISSUE"]["value_factor"] == 1.125
