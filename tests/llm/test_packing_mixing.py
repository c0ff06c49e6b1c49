from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from indexloom.llm import packing
from indexloom.llm.mixing import mix
from indexloom.llm.packing import best_plan, pack, plan_best_fit, ranks_within
from indexloom.llm.tokens import VOCABULARY, encoding, n_tokens, quality_of, tokens_and_quality

SIZES = {"short": 8, "medium": 20, "long": 50}


def brute_best_fit(lengths, capacities):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= x]
        if not fit:
            bins.append(b := [max(capacities), 0])
        else:
            b = min(fit, key=lambda z: z[0])
        b[0] -= x
        b[1] += x
    return sum(next(c for c in sorted(capacities) if c >= b[1]) - b[1] for b in bins), len(bins)


def unfolded(plan, counts):
    """Every item of the plan: (container, offset, length)."""
    out = []
    for length, rank, n, first, per, offset in plan.slots:
        out += [(first + i // per, offset + i % per * length, length, rank + i) for i in range(n)]
    for length, n in counts.items():
        assert sorted(r for *_, le, r in out if le == length) == list(range(n))
    return out


def test_plan_equals_best_fit_over_items():
    for seed in range(30):
        r = random.Random(seed)
        lengths = [r.choice([r.randrange(1, 51), r.randrange(1, 9)]) for _ in range(r.randrange(1, 300))]
        counts = Counter(lengths)
        plan = plan_best_fit(counts, SIZES.values())
        items = unfolded(plan, counts)
        used = defaultdict(list)
        for c, o, le, _ in items:
            used[c].append((o, le))
        for first, n, capacity, total in plan.containers:
            for c in range(first, first + n):
                spans = sorted(used[c])
                assert sum(le for _, le in spans) == total <= capacity
                assert all(a + le <= b for (a, le), (b, _) in zip(spans, spans[1:], strict=False))
        assert (plan.unused(), sum(n for _, n, *_ in plan.containers)) == brute_best_fit(lengths, SIZES.values())
        assert best_plan(counts, SIZES.values()).unused() <= plan.unused()


def test_plan_of_a_billion_items_is_small():
    counts = {i: 1_000_000_000 // i for i in range(1, 2000)}
    plan = best_plan(counts, [512, 2048, 8192])
    assert len(plan.slots) < 20_000 and sum(s[2] for s in plan.slots) == sum(counts.values())


def test_pack_places_every_item_once(spark):
    r = random.Random(5)
    sizes = [r.choice([0, 3, 7, 11, 19, 50, 51, 120, None]) for _ in range(400)] + [3] * 300
    df = spark.createDataFrame([(i, n, 1, 2) for i, n in enumerate(sizes)], "doc_id long, n_tokens int, length int, piece int")
    rows = pack(df, SIZES, shards=7).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x["doc_id"]].append(x)
        by_bin[x["container_id"]].append(x)
    for i, n in enumerate(sizes):
        pieces = sorted(by_doc[i], key=lambda x: x["piece"])
        assert sum(x["n_tokens"] for x in pieces) == (n or 0)
        assert len(pieces) == max(1, -(-(n or 0) // 50)) and [x["first_token"] for x in pieces] == [50 * k for k in range(len(pieces))]
    for xs in by_bin.values():
        assert len({(x["pack_name"], x["capacity"]) for x in xs}) == 1 and SIZES[xs[0]["pack_name"]] == xs[0]["capacity"]
        spans = sorted((x["offset"], x["offset"] + x["n_tokens"]) for x in xs)
        assert spans[-1][1] <= xs[0]["capacity"] and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_slots_over_many_blocks_and_capacities(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 8)
    r = random.Random(9)
    counts = {n: r.randrange(1, 90) for n in range(0, 51)}
    plan = best_plan(counts, SIZES.values())
    capacity = {c: cap for first, n, cap, _ in plan.containers for c in range(first, first + n)}
    want = {(le, rank): (c, capacity[c], o) for c, o, le, rank in unfolded(plan, counts)}
    got = {}
    for x in packing.slot_blocks(spark, plan).collect():
        for rank in range(max(x["from"], x["block"] * 8), min(x["to"], x["block"] * 8 + 8)):
            assert (x["length"], rank) not in got
            i = rank - x["from"]
            got[x["length"], rank] = (x["container"] + i // x["per"], x["capacity"], x["offset"] + i % x["per"] * x["length"])
    assert got == want


def test_quality_prefers_prose_to_noise_and_repetition():
    e = encoding(VOCABULARY)
    q = lambda t: quality_of(len(t), e.encode_ordinary(t))
    prose = "The committee met on Tuesday to discuss how the new rules affect small exporters, and it asked for comments by the end of the month."
    assert q(prose) > 0.8 and q(prose) > q("the same " * 60) and q(prose) > q("7f 3a 9c 01 d4 " * 12) and q(prose) > q("Yes.") > q("") == 0.05
    assert all(0.05 <= q(x) <= 1 for x in ("", "a", "é" * 5000, "0" * 9000, prose * 50))


def test_tokens_and_quality_agree_with_the_count(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "i int, t string").select("i", n_tokens("t").alias("n"), tokens_and_quality(F.col("t")).alias("m"))
    assert {r["i"]: (r["n"], r["m"]["n"]) for r in df.collect()} == {1: (2, 2), 2: (0, 0), 3: (0, 0)}


def test_pack_empty_and_no_sizes(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens int")
    assert pack(df, SIZES).count() == 0
    with pytest.raises(ValueError):
        pack(df, {})


def test_ranks_are_whole_and_do_not_depend_on_shards(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g")
    rows = ranks_within(df, "g", ["id"], 13).collect()
    for g in range(3):
        own = sorted(r["rank"] for r in rows if r["g"] == g)
        assert own == list(range(len(own)))


def test_tokens_of_null_empty_special_and_long(spark):
    texts = [None, "", "two words", "<|endoftext|>", "a" * 60_000, "naïve 日本語 ½"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", n_tokens("t").alias("n")).orderBy("i").select("n").collect()]
    e = encoding(VOCABULARY)
    assert got == [len(e.encode_ordinary(t)) if t else 0 for t in texts] and got[:3] == [0, 0, 2] and got[3] > 1
    assert e.decode(e.encode_ordinary(texts[5])) == texts[5]


def test_tokens_agree_with_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    e = encoding(VOCABULARY)
    for text in ["The index gained 1.25% on 3 May 2024.", "Der Streubesitz sinkt\n\n von 0,46 %", "x  y\t z "]:
        assert e.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id long, source string, n_tokens int, q double, budget int, h string"


def draw(spark, docs, targets, **kw):
    drawn, report = mix(spark.createDataFrame([(*d, 1, "h") for d in docs], DOCS), spark.createDataFrame(targets, TARGETS), weight="q", ranges=16, **kw)
    return {r["doc_id"]: r["uses"] for r in drawn.collect()}, {r["source"]: r for r in report.collect()}


def corpus(seed=1, n=3000):
    r = random.Random(seed)
    kinds = ["a"] * 6 + ["b"] * 3 + ["C-d"]
    return [(i, r.choice(kinds), r.randrange(1, 60), r.random() + 0.1) for i in range(n)]


def test_shares_are_met_and_repeats_capped(spark):
    docs = corpus()
    uses, report = draw(spark, docs, [("a", 0.3, 1), ("b", 0.4, 2), ("c_d", 0.3, 4), ("none", 0.0, 2)])
    for s, share in (("a", 0.3), ("b", 0.4), ("c_d", 0.3)):
        assert abs(report[s]["reached_share"] - share) < 0.005 and report[s]["most_uses"] <= report[s]["max_repeats"] and not report[s]["short"]
        want = sum(n * uses.get(i, 0) for i, k, n, _ in docs if k.lower().replace("-", "_") == s)
        assert report[s]["tokens"] == want
    cd = {uses.get(i) for i, k, *_ in docs if k == "C-d"}
    assert min(cd) >= max(cd) - 1 >= 1


def test_prefix_of_the_key_order_as_one_sort_would_take_it(spark):
    from pyspark.sql import functions as F

    from indexloom.llm.mixing import unit

    docs = corpus(2, 500)
    uses, report = draw(spark, docs, [("a", 1.0, 1)], total_tokens=2000)
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], DOCS).where("source = 'a'").withColumn("key", -F.log(unit(F.col("doc_id"), 17)) / F.col("q"))
    ahead, want = 0, set()
    for r in df.orderBy("key", "doc_id").collect():
        if ahead + r["n_tokens"] / 2 <= 2000:
            want.add(r["doc_id"])
        ahead += r["n_tokens"]
    assert set(uses) == want and abs(report["a"]["tokens"] - 2000) <= 30


def test_short_missing_null_and_empty(spark):
    docs = [(1, "a", 10, 1.0), (2, None, 10, 1.0), (3, "a", 0, 1.0), (4, "a", None, 1.0), (5, "b", 10, float("nan")), (6, "b", 10, None), (7, "zz", 5, 1.0)]
    uses, report = draw(spark, docs, [("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.2, 1)], total_tokens=1000)
    assert uses == {1: 3, 5: 1, 6: 1} and all(report[s]["short"] for s in "abc") and report["c"]["reached_share"] == 0
    uses, report = draw(spark, [], [("a", 0.5, 3)])
    assert uses == {} and report["a"]["tokens"] == 0
    assert draw(spark, docs, []) == ({}, {})


def test_heavier_documents_come_first_more_often(spark):
    docs = [(i, "a", 10, 5.0 if i % 2 else 0.5) for i in range(2000)]
    uses, _ = draw(spark, docs, [("a", 1.0, 1)], total_tokens=5000)
    heavy = sum(i % 2 for i in uses)
    assert heavy > 3 * (len(uses) - heavy)
