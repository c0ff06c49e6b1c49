from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from indexloom.functions import dates
from indexloom.functions import identifiers as ids
from indexloom.sources import files
from indexloom.sources.catalog import Catalog, Router, write_cookbook
from indexloom.sources.snapshot import Snapshot, read_filed_years, write_filed_years
from indexloom.sources.synthetic import Config, Universe

SF = "/root/testdata/sf0.001"


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_known_identifiers(spark):
    assert value(spark, ids.is_isin(F.lit("US0378331005"))) and not value(spark, ids.is_isin(F.lit("US0378331006")))
    assert value(spark, ids.is_sedol(F.lit("0263494"))) and not value(spark, ids.is_sedol(F.lit("A263494")))
    assert value(spark, ids.is_cusip(F.lit("037833100"))) and not value(spark, ids.is_cusip(F.lit("037833101")))
    assert value(spark, ids.cusip_to_isin(F.lit("037833100"))) == "US0378331005"
    assert value(spark, ids.normal_isin(F.lit(" us03783 31005 "))) == "US0378331005" and value(spark, ids.normal_isin(F.lit("x"))) is None
    assert value(spark, ids.normal_ticker(F.lit(" brk/b "))) == "BRK.B" and value(spark, ids.normal_ticker(F.lit("brk-b"), False)) == "BRK"
    assert not value(spark, ids.is_isin(F.lit(None).cast("string")))


def test_made_identifiers_are_valid_and_a_changed_digit_is_found(spark):
    x = spark.range(500).select(ids.make_isin(F.lit("GB"), F.col("id")).alias("i"), ids.make_sedol(F.col("id")).alias("s"), ids.make_cusip(F.col("id")).alias("c"))
    assert x.where(~(ids.is_isin(F.col("i")) & ids.is_sedol(F.col("s")) & ids.is_cusip(F.col("c")))).isEmpty()
    wrong = F.concat(F.substring("i", 1, 11), ((F.substring("i", 12, 1).cast("int") + 1) % 10).cast("string"))
    assert x.where(ids.is_isin(wrong)).isEmpty()


def test_dates(spark):
    assert value(spark, dates.third_friday(F.lit("2026-06-30").cast("date"))) == dt.date(2026, 6, 19)
    days = value(spark, dates.business_days("2024-12-23", "2025-01-02", ["12-25", "12-26", "01-01"]))
    assert days == [dt.date(2024, 12, d) for d in (23, 24, 27, 30, 31)] + [dt.date(2025, 1, 2)]
    assert value(spark, dates.is_month_end(F.lit("2024-02-29").cast("date")))


def test_snapshot_reads_copies_and_fingerprints(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Snapshot(spark, str(tmp_path))
    s = Snapshot(spark, SF)
    s.materialise(str(tmp_path / "copy"), ["securities", "listings"], note="x")
    t = Snapshot(spark, str(tmp_path / "copy"), ["securities", "listings"])
    assert t.fingerprint(["securities", "listings"]) == s.fingerprint(["securities", "listings"]) != s.fingerprint(["shares"])
    assert s.prices(start="2023-01-01", end="2022-01-01").isEmpty()
    plan = s.prices(["a"], "2023-01-01", "2023-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(date" in plan.replace(" ", "")


def test_filing_years_prune_partitions(spark, tmp_path):
    f = Snapshot(spark, SF).table("fundamentals")
    write_filed_years(f, str(tmp_path / "pit"))
    x = read_filed_years(spark, str(tmp_path / "pit"), "2022-06-30")
    assert x.count() == f.where("filed_date <= DATE'2022-06-30'").count() > 0
    assert "PartitionFilters: [isnotnull(filed_year" in x._jdf.queryExecution().executedPlan().toString()


def test_delimited_preamble_and_json_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("adsh\ttag\tvalue\n1\tREV\t5\n2\tREV\tx\n")
    x = files.read_delimited(spark, str(tmp_path / "a.tsv"), "adsh string, tag string, value double", "\t")
    assert [tuple(r) for r in x.orderBy("adsh").collect()] == [("1", "REV", 5.0), ("2", "REV", None)]
    (tmp_path / "h.csv").write_text('Fund Holdings\nAs of,2024-01-31\n\nTicker,Name,Market Value\nAAA,"A, Inc","1,234.5"\nBBB,B,7\n')
    h = files.read_after_preamble(spark, str(tmp_path / "h.csv"), "Ticker").withColumn("market_value", files.number("market_value"))
    assert [tuple(r) for r in h.orderBy("ticker").collect()] == [("AAA", "A, Inc", 1234.5), ("BBB", "B", 7.0)]
    files.write_jsonl(h, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "ticker string, market_value double").count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "run.json").write_text('{\n "run": "r1",\n "n": 3\n}')
    assert files.read_manifests(spark, str(tmp_path / "m"), "run string, n int").first()["n"] == 3
    assert files.renamed(h, {"ticker": "id", "missing": "y"}).columns == ["id"]


def test_catalog_and_router(spark, tmp_path):
    c = Catalog(spark, "t_").load(Snapshot(spark, SF), ["shares", "listings"])
    assert c.tables() == ["listings", "shares"] and c.row_counts().count() == 2
    assert c.sql("SELECT count(*) AS n FROM t_shares WHERE effective_date <= :day", day="2022-01-01").first()["n"] > 0
    write_cookbook({"b": "SELECT 2", "a": "SELECT 1"}, str(tmp_path / "c.md"))
    assert (tmp_path / "c.md").read_text().index("## a") < (tmp_path / "c.md").read_text().index("## b")
    s = Snapshot(spark, SF)
    r = Router({"x": s, "y": object()}, {"issuers": "x"})
    assert r.issuers().columns and r.route("issuers") == "x"
    with pytest.raises(KeyError):
        r.prices()
    assert {tuple(z) for z in r.capabilities(spark, ["issuers", "shares"]).collect()} == {("x", "routed", "yes"), ("y", "absent", "absent")}


def test_synthetic_universe_is_deterministic(spark):
    u = Universe(spark, Config(securities=6, start="2016-01-04", end="2016-03-31"))
    p = u.prices()
    assert p.count() == 6 * u.calendar().count() and p.where("close <= 0 OR volume <= 0").isEmpty()
    assert p.exceptAll(Universe(spark, Config(securities=6, start="2016-01-04", end="2016-03-31")).prices().repartition(7)).isEmpty()
    assert u.identifiers().where(~(ids.is_isin(F.col("isin")) & ids.is_sedol(F.col("sedol")))).isEmpty()
    assert Config().fingerprint() != Config(seed=8).fingerprint()
