from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from indexloom.operators.history import bitmap_versions, history_from_intervals, history_from_snapshots
from indexloom.operators.intervals import coverage, merge_lists, spans

D = dt.date
S = "s string, t string, v string, f date, e date, periods int, multiple int, kind string"
OPEN = D(9999, 12, 31)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], S)


def sample(seed, n=80, days=200):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        f = r.choice([D(2020, 1, 1) + dt.timedelta(r.randrange(days))] * 9 + [None])
        e = r.choice([None, OPEN, *[(f or D(2020, 1, 1)) + dt.timedelta(r.randrange(-2, 40)) for _ in range(14)]])
        rows.append((r.choice(["a", "b", "c", None]), "isin", r.choice(["P", "q ", "Q", None]), f, e))
    return rows + rows[:8]


def brute_spans(rows):
    out = set()
    keys = {(s, t) for s, t, *_ in rows if s and t}
    for k in keys:
        pairs = {(f, e or OPEN) for s, t, _, f, e in rows if (s, t) == k and f and (e is None or e > f)}
        merged = []
        for f, e in sorted(pairs):
            if merged and f <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] += 1
            else:
                merged.append([f, e, 1])
        out |= {(*k, "period", f, None if e == OPEN else e, n > 1) for f, e, n in merged}
        out |= {(*k, "gap", a[1], b[0], False) for a, b in zip(merged, merged[1:], strict=False)}
    return out


def brute_versions(rows):
    out = set()
    for k in {(s, t) for s, t, *_ in rows if s and t}:
        own = [(f, e or OPEN, v.strip().upper()) for s, t, v, f, e in rows if (s, t) == k and f and v and (e is None or e > f)]
        cuts = sorted({x for f, e, _ in own for x in (f, e)})
        found = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            on = max((x for x in own if x[0] <= a and x[1] >= b), default=None)
            if on and found and found[-1][0] == on[2] and found[-1][2] == a:
                found[-1][2] = b
            elif on:
                found.append([on[2], a, b])
        out |= {(*k, v, a, None if b == OPEN else b) for v, a, b in found}
    return out


def test_spans_against_brute_force(spark):
    for seed in range(3):
        rows = sample(seed)
        for days in (1461, 10):
            c = coverage(frame(spark, rows), entity=["s", "t"], start="f", end="e", branch_days=days)
            got = {tuple(r) for r in spans(c, ["s", "t"]).collect()}
            assert got == brute_spans(rows)


def test_merge_is_the_same_in_any_grouping():
    r = random.Random(4)
    items = [{"f": (a := r.randrange(100)), "e": a + r.randrange(1, 9), "m": False} for _ in range(60)]
    kind = pa.list_(pa.struct([("f", pa.int32()), ("e", pa.int32()), ("m", pa.bool_())]))
    whole = merge_lists(pa.array([items], kind)).to_pylist()[0]
    for cut in (1, 13, 30):
        parts = merge_lists(pa.array([items[:cut], items[cut:], []], kind)).to_pylist()
        assert merge_lists(pa.array([parts[1] + parts[0] + parts[2]], kind)).to_pylist()[0] == whole
    assert merge_lists(pa.array([[], []], kind)).to_pylist() == [[], []]


def test_single_touching_repeated_and_empty(spark):
    rows = [("a", "isin", "P", D(2020, 1, 1), D(2020, 2, 1))] * 3 + [("b", "isin", "P", D(2020, 1, 1), D(2020, 2, 1)), ("b", "isin", "P", D(2020, 2, 1), None), ("c", "isin", "P", D(2020, 2, 1), D(2020, 2, 1))]
    got = {tuple(r) for r in spans(coverage(frame(spark, rows), entity=["s", "t"], start="f", end="e"), ["s", "t"]).collect()}
    assert got == {("a", "isin", "period", D(2020, 1, 1), D(2020, 2, 1), False), ("b", "isin", "period", D(2020, 1, 1), None, True)}
    assert spans(coverage(frame(spark, []), entity=["s", "t"], start="f", end="e"), ["s", "t"]).count() == 0


def test_versions_against_brute_force(spark):
    for seed in range(3):
        rows = sample(seed)
        # one value per entity and start day, so that no tie is left to the rule of the docstring
        rows = list({(r[0], r[3]): r for r in rows}.values())
        h = history_from_intervals(frame(spark, rows), entity=["s", "t"], value=F.upper(F.trim("v")), start="f", end="e")
        assert {tuple(r)[:5] for r in h.collect()} == brute_versions(rows)


def versions_of(rows):
    """bitmap_versions of (entity, value, from, to) rows, as tuples in order."""
    e, v, f, t = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return sorted(zip(*(x.tolist() for x in bitmap_versions(e, f, t, v)), strict=True))


def test_value_that_comes_back_has_two_versions():
    assert versions_of([(0, 7, 0, 30), (0, 8, 10, 20)]) == [(0, 7, 0, 10), (0, 7, 20, 30), (0, 8, 10, 20)]


def test_versions_of_many_snapshots_over_word_borders():
    r = random.Random(8)
    rows = []
    for entity in range(6):
        starts = r.sample(range(-500, 3000), (1, 40, 64, 65, 200, 300)[entity])
        rows += [(entity, r.randrange(4), a, a + r.choice([1, 5, 90, 2_900_000])) for a in starts]
    want = []
    for entity in range(6):
        own = [x for x in rows if x[0] == entity]
        days = sorted({d for x in own for d in x[2:]})
        held = None
        for a, b in zip(days, days[1:], strict=False):
            on = max((x for x in own if x[2] <= a and x[3] >= b), key=lambda x: x[2], default=None)
            if on and held and held[1] == on[1] and held[3] == a:
                held[3] = b
            else:
                want += [tuple(held)] if held else []
                held = [entity, on[1], a, b] if on else None
        want += [tuple(held)] if held else []
    r.shuffle(rows)
    assert versions_of(rows) == sorted(want)


def test_tie_on_start_takes_the_later_end(spark):
    rows = [("a", "isin", "P", D(2020, 1, 1), D(2020, 2, 1)), ("a", "isin", "Q", D(2020, 1, 1), D(2020, 3, 1))]
    h = history_from_intervals(frame(spark, rows), entity=["s", "t"], value=F.col("v"), start="f", end="e").collect()
    assert [(r["value"], r["n_versions"]) for r in h] == [("Q", 1)]
    assert history_from_intervals(frame(spark, []), entity=["s", "t"], value=F.col("v"), start="f", end="e").count() == 0


def test_snapshot_runs_over_word_borders(spark):
    r = random.Random(3)
    days = [D(2020, 1, 1) + dt.timedelta(7 * i) for i in range(150)]
    rows = [(k, r.choice(["u", "v"]), d) for k in "ab" for d in days if r.random() < 0.9] + [("c", "w", d) for d in days] + [(None, "u", days[0]), ("a", None, days[0])]
    got = sorted(tuple(x) for x in history_from_snapshots(spark.createDataFrame(rows + rows[:9], "k string, x string, d date"), entity=["k"], value=F.col("x"), day="d").collect())
    want, on = [], set(rows)
    for key, value in [(k, v) for k in "abc" for v in "uvw"]:
        start = None
        for i in range(len(days) + 1):
            here = i < len(days) and (key, value, days[i]) in on
            if here and start is None:
                start = i
            elif not here and start is not None:
                want.append((key, value, days[start], days[i - 1], i - start))
                start = None
    assert got == sorted(want)
    assert ("c", "w", days[0], days[-1], 150) in got
    assert history_from_snapshots(spark.createDataFrame([], "k string, x string, d date"), entity=["k"], value=F.col("x"), day="d").count() == 0
