from __future__ import annotations

import datetime as dt
import random

from indexloom.operators.late import lambda_views
from indexloom.streaming.lambda_store import LambdaStore

D = dt.date
S = "s string, e date, k date, v double, late int"


def views(spark, rows):
    x = lambda_views(spark.createDataFrame(rows, S), entity=["s"], event_time="e", known_time="k", value="v")
    return {(r["s"], r["period"]): r for r in x.collect()}


def brute(rows, s, period, limit):
    end = (period.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)
    ok = [(e, k, v) for rs, e, k, v, _ in rows if rs == s and e and k and v is not None and e.replace(day=1) == period and k <= end + dt.timedelta(limit)]
    return max(ok)[2] if ok else None


def sample(seed, n=120):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        e = D(2021, 1, 1) + dt.timedelta(r.randrange(150))
        rows.append((r.choice(["a", "b", None]), r.choice([e, e, e, None]), r.choice([e + dt.timedelta(r.randrange(-20, 120)), None]), r.choice([1.0, 2.0, 3.0, None]), 0))
    return rows + rows[:10]


def test_all_layers_against_brute_force(spark):
    rows = sample(1)
    got = views(spark, rows)
    assert got
    for (s, p), r in got.items():
        assert r["provisional"] == brute(rows, s, p, 0)
        assert list(r["batches"]) == [brute(rows, s, p, x) for x in (15, 30, 45)]
        assert r["final"] == brute(rows, s, p, 45)


def test_cut_off_day_counts_and_the_day_after_does_not(spark):
    rows = [("a", D(2021, 1, 5), D(2021, 1, 31), 1.0, 0), ("a", D(2021, 1, 6), D(2021, 3, 17), 2.0, 0), ("a", D(2021, 1, 7), D(2021, 3, 18), 3.0, 0)]
    r = views(spark, rows)["a", D(2021, 1, 1)]
    assert (r["provisional"], r["final"], r["n_in_time"], r["n_late"], r["n_cut_off"]) == (1.0, 2.0, 1, 1, 1)


def test_empty_and_unusable(spark):
    assert views(spark, []) == {}
    assert views(spark, [(None, D(2021, 1, 1), D(2021, 1, 1), 1.0, 0), ("a", D(2021, 1, 1), None, 1.0, 0)]) == {}


def test_store_fed_in_arrival_order_ends_as_the_views_do(spark, tmp_path):
    rows = [r for r in sample(2) if r[1] and r[2]]
    store = LambdaStore(spark, f"file://{tmp_path}/store", entity=["s"], event_time="e", known_time="k", value="v", schema=S)
    day, last = min(r[2] for r in rows), max(r[2] for r in rows) + dt.timedelta(60)
    step = dt.timedelta(40)
    while day <= last:
        store.ingest(spark.createDataFrame([r for r in rows if day - step < r[2] <= day], S))
        store.run_batch(day)
        day += step
    got = {(r["s"], r["period"]): r["value"] for r in store.serve().collect()}
    want = {k: r["final"] for k, r in views(spark, rows).items() if r["final"] is not None}
    assert got == want
    assert all(r["frozen"] for r in store.serve().collect())


def test_fast_layer_serves_before_any_batch(spark, tmp_path):
    store = LambdaStore(spark, f"file://{tmp_path}/fast", entity=["s"], event_time="e", known_time="k", value="v", schema=S)
    store.ingest(spark.createDataFrame([("a", D(2021, 1, 5), D(2021, 1, 6), 1.0, 0)], S))
    store.ingest(spark.createDataFrame([("a", D(2021, 1, 4), D(2021, 1, 9), 9.0, 0), ("b", D(2021, 1, 4), D(2021, 1, 9), 5.0, 0)], S))
    assert {(r["s"], r["value"], r["frozen"]) for r in store.serve().collect()} == {("a", 1.0, False), ("b", 5.0, False)}


def test_fast_layer_between_batches_against_brute_force(spark):
    rows = sample(5)
    for (s, p), r in views(spark, rows).items():
        assert list(r["before_batch"]) == [brute(rows, s, p, x) for x in (15, 30, 45)]


def store(spark, tmp_path):
    return LambdaStore(spark, f"file://{tmp_path}/store", entity=["s"], event_time="e", known_time="k", value="v", schema=S)


def served(x):
    return {(r["s"], r["period"]): (r["value"], r["frozen"]) for r in x.serve().collect()}


def test_a_record_known_after_the_batch_day_is_still_served(spark, tmp_path):
    x = store(spark, tmp_path)
    x.ingest(spark.createDataFrame([("a", D(2021, 1, 5), D(2021, 1, 6), 1.0, 0), ("a", D(2021, 1, 9), D(2021, 2, 20), 2.0, 0)], S))
    x.run_batch(D(2021, 2, 1))
    assert served(x) == {("a", D(2021, 1, 1)): (2.0, False)}
    x.run_batch(D(2021, 3, 1))
    assert served(x) == {("a", D(2021, 1, 1)): (2.0, False)}
    x.run_batch(D(2021, 3, 18))
    assert served(x) == {("a", D(2021, 1, 1)): (2.0, True)}
    x.ingest(spark.createDataFrame([("a", D(2021, 1, 30), D(2021, 3, 1), 3.0, 0)], S))
    assert served(x) == {("a", D(2021, 1, 1)): (2.0, True)}


def test_a_replayed_increment_replaces_itself_and_an_unpublished_one_is_not_read(spark, tmp_path):
    x = store(spark, tmp_path)
    part = spark.createDataFrame([("a", D(2021, 1, 5), D(2021, 1, 6), 1.0, 0)], S)
    x.ingest(part, number=7)
    x.ingest(part, number=7)
    x.run_batch(D(2021, 1, 31))
    assert x._log(x._published("speed")).count() == 1 and served(x) == {("a", D(2021, 1, 1)): (1.0, False)}
    spark.createDataFrame([("a", D(2021, 1, 8), D(2021, 1, 9), 9.0, 0)], S).write.parquet(f"{x.path}/log/8")
    x.run_batch(D(2021, 2, 1))
    assert served(x) == {("a", D(2021, 1, 1)): (1.0, False)}


def test_a_stream_feeds_the_fast_layer(spark, tmp_path):
    x = store(spark, tmp_path)
    spark.createDataFrame([("a", D(2021, 1, 5), D(2021, 1, 6), 1.0, 0)], S).write.parquet(f"file://{tmp_path}/in")
    x.attach(spark.readStream.schema(S).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    assert served(x) == {("a", D(2021, 1, 1)): (1.0, False)} and x._published("speed") == [1]
