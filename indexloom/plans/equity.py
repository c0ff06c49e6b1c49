"""Market values, value factors, liquidity, buffered bands, the composed factor pipeline and evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import crosssection as cs
from ..operators import optimise, pit, research, series, text
from ..sources.tables import table
from .common import CLEAN, FX, SIGNALS, clean_prices, fx, signals, text_day
from .indexes import BASE, QUOTES, _QUOTES, _members, _rates

QUERIES, SQL = {}, {}
DAY, BEFORE = "2023-06-30", "2022-12-30"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- market values


def caps(spark: SparkSession, d: str, day: str) -> DataFrame:
    """Per listing on a day: last close, shares and float in force and known, rate, full and float market value in the base currency."""
    at = F.lit(day).cast("date")
    p = clean_prices(spark, d).where(F.col("date") <= at).groupBy("listing_id").agg(F.max_by("close", "date").alias("close"))
    s = table(spark, d, "shares").where((F.col("effective_date") <= at) & (F.col("knowledge_date") <= at) & (F.col("shares_outstanding") > 0) & F.col("free_float_factor").between(0, 1))
    s = pit.latest_by(s, ["security_id"], ["effective_date", "knowledge_date", "shares_outstanding", "free_float_factor"], ["shares_outstanding", "free_float_factor"])
    r = _rates(spark, d).where(F.col("day") <= at).groupBy("currency").agg(F.max(F.struct("day", "rate"))["rate"].alias("rate"))
    x = _members(spark, d).withColumnRenamed("id", "listing_id").join(p, "listing_id").join(s, "security_id").join(r, "currency")
    full = F.col("close") * F.col("shares_outstanding") * F.col("rate")
    return x.select("listing_id", "security_id", "close", "rate", full.alias("full_cap"), (full * F.col("free_float_factor")).alias("float_cap"))


_RATES = f"""q(currency, quote) AS (VALUES {_QUOTES}), rates AS (SELECT q.currency, (fx.date + INTERVAL 27 YEAR)::DATE AS day, rate FROM fx JOIN q USING (quote) UNION ALL SELECT DISTINCT '{BASE}', (date + INTERVAL 27 YEAR)::DATE, 1.0 FROM fx)"""


def _caps_sql(name: str, day: str) -> str:
    return f"""{name} AS (SELECT l.listing_id, l.security_id, p.close, r.rate, close * s.s * rate AS full_cap, close * s.s * s.f * rate AS float_cap FROM listings l JOIN (SELECT listing_id, arg_max(close, date) AS close FROM cp WHERE date <= DATE '{day}' GROUP BY 1) p USING (listing_id)
 JOIN (SELECT security_id, shares_outstanding AS s, free_float_factor AS f FROM shares WHERE effective_date <= DATE '{day}' AND knowledge_date <= DATE '{day}' AND shares_outstanding > 0 AND free_float_factor BETWEEN 0 AND 1
  QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC, knowledge_date DESC, shares_outstanding DESC, free_float_factor DESC) = 1) s USING (security_id)
 JOIN (SELECT currency, arg_max(rate, (day, rate)) AS rate FROM rates WHERE day <= DATE '{day}' GROUP BY 1) r ON r.currency = l.currency WHERE l.listing_id IS NOT NULL)"""


_CAPS = f"WITH {CLEAN}, {FX}, {_RATES}, {_caps_sql('c', DAY)}"


@query(_CAPS + """SELECT listing_id, round(full_cap, 2) AS full_cap, round(float_cap, 2) AS float_cap, round(full_cap / sum(full_cap) OVER (), 10) AS full_weight, round(float_cap / sum(float_cap) OVER (), 10) AS float_weight FROM c""")
def market_cap_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights from price x shares x float x rate."""
    x = caps(spark, d, DAY)
    total = x.agg(F.sum("full_cap").alias("a"), F.sum("float_cap").alias("b"))
    a, b = total.select("a").scalar(), total.select("b").scalar()
    return x.select("listing_id", F.round("full_cap", 2).alias("full_cap"), F.round("float_cap", 2).alias("float_cap"), F.round(F.col("full_cap") / a, 10).alias("full_weight"), F.round(F.col("float_cap") / b, 10).alias("float_weight"))


_SESSIONS = f"d AS (SELECT DISTINCT date FROM cp0 WHERE date <= DATE '{DAY}' ORDER BY date DESC LIMIT 60), w AS (SELECT * FROM cp0 WHERE date <= DATE '{DAY}' AND date >= (SELECT min(date) FROM d))"
_PRICED = """cp0 AS (SELECT listing_id, date, close, volume, is_suspended FROM prices WHERE close > 0 AND isfinite(close) AND listing_id IS NOT NULL AND date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id, date ORDER BY volume DESC NULLS LAST, close DESC, is_suspended DESC NULLS LAST) = 1)"""
_LIQ = f"""WITH {_PRICED}, {_SESSIONS}, m AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY listing_id ORDER BY date)) AS move FROM w),
g AS (SELECT listing_id, median(close * volume) AS traded, count(*) AS n, arg_max(close, date) AS last_close, coalesce(arg_max(is_suspended, date), FALSE) AS paused, stddev_samp(move) * sqrt(252) AS vol FROM m GROUP BY 1)"""


def _priced(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prices").where("close > 0 AND close < double('Infinity') AND listing_id IS NOT NULL").where(F.col("date") <= F.lit(DAY).cast("date"))
    return p.groupBy("listing_id", "date").agg(F.max(F.struct("volume", "close", "is_suspended")).alias("s")).select("listing_id", "date", "s.*")


@query(_LIQ + """SELECT listing_id, round(traded, 2) AS traded, n, last_close, paused, round(vol, 8) AS vol, round((row_number() OVER (ORDER BY traded NULLS FIRST, listing_id) - 1) / nullif(count(*) OVER () - 1, 0), 8) AS percentile FROM g""")
def liquidity_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Trading measures over the last 60 sessions and the percentile of traded value."""
    x = cs.liquidity(_priced(spark, d), "listing_id", "date", "close", "volume", "is_suspended", 60)
    return x.select("listing_id", F.round("traded", 2).alias("traded"), "n", "last_close", "paused", F.round("vol", 8).alias("vol"), F.round("percentile", 8).alias("percentile"))


@query(_LIQ + """, i AS (SELECT listing_id, CASE WHEN vol > 0 THEN 1 / vol ELSE 0 END AS i FROM g) SELECT listing_id, round(i / sum(i) OVER (), 10) AS weight FROM i""")
def inverse_volatility_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by one over volatility, 0 without any."""
    x = cs.liquidity(_priced(spark, d), "listing_id", "date", "close", "volume", "is_suspended", 60).select("listing_id", F.when(F.col("vol") > 0, 1 / F.col("vol")).otherwise(0.0).alias("i"))
    return x.select("listing_id", F.round(F.col("i") / x.agg(F.sum("i")).scalar(), 10).alias("weight"))


@query(_LIQ + """, v AS (SELECT coalesce(l.mic, '') || ':' || coalesce(l.currency, '') AS book, g.listing_id, vol * vol AS v FROM g JOIN (SELECT DISTINCT listing_id, mic, currency FROM listings) l USING (listing_id) WHERE vol > 0.01)
SELECT book, listing_id, round((1 / v) / sum(1 / v) OVER (PARTITION BY book), 3) AS weight, TRUE AS feasible FROM v""")
def optimised_weights(spark: SparkSession, d: str) -> DataFrame:
    """The long-only book of least variance per market and currency, with uncorrelated names: the solver must find weights by one over variance."""
    x = cs.liquidity(_priced(spark, d), "listing_id", "date", "close", "volume", "is_suspended", 60).where("vol > 0.01")
    l = table(spark, d, "listings").select("listing_id", F.concat(F.coalesce("mic", F.lit("")), F.lit(":"), F.coalesce("currency", F.lit(""))).alias("book")).distinct()
    x = x.join(l, "listing_id").select("book", "listing_id", (F.col("vol") * F.col("vol")).alias("v"))
    x = x.withColumn("b", 1 / F.count(F.lit(1)).over(Window.partitionBy("book")))
    y = optimise.solve_groups(x, "book", "listing_id", "b", [], optimise.minimise_variance(), [optimise.full_investment(), optimise.long_only()], "v")
    return y.select("book", "listing_id", F.round("weight", 3).alias("weight"), "feasible")


_ITEMS = {"BOOK_EQUITY": "book", "NET_INCOME": "income", "REVENUE": "revenue", "OPERATING_CASHFLOW": "cash", "CAPEX": "capex", "DIVIDENDS_PAID": "dividends"}


@query(_CAPS + f""", s AS (SELECT security_id, max(full_cap) AS cap FROM c GROUP BY 1), f AS (SELECT security_id, item, value FROM fundamentals WHERE filed_date <= DATE '{DAY}' AND value IS NOT NULL AND period_end >= DATE '{DAY}' - 550 AND item IN ({', '.join(f"'{k}'" for k in _ITEMS)})
 QUALIFY row_number() OVER (PARTITION BY security_id, item ORDER BY period_end DESC, filed_date DESC, value DESC) = 1),
w AS (SELECT security_id, {', '.join(f"max(value) FILTER (WHERE item = '{k}') AS {v}" for k, v in _ITEMS.items())} FROM f GROUP BY 1)
SELECT security_id, round(book / cap, 10) AS book_to_price, round(income / cap, 10) AS earnings_to_price, round((cash + capex) / cap, 10) AS cashflow_to_price, round(revenue / cap, 10) AS sales_to_price, CASE WHEN dividends IS NOT NULL THEN round(greatest(-dividends, 0) / cap, 10) END AS dividend_yield, round(ln(greatest(cap, 1)), 8) AS log_market_cap FROM s LEFT JOIN w USING (security_id) WHERE cap > 0""")
def value_factors(spark: SparkSession, d: str) -> DataFrame:
    """Value ratios of the figures filed by the day to the market value of the day; null without a figure."""
    s = caps(spark, d, DAY).groupBy("security_id").agg(F.max("full_cap").alias("cap")).where("cap > 0")
    w = pit.pit_latest(table(spark, d, "fundamentals"), DAY, list(_ITEMS)).groupBy("security_id").pivot("item", list(_ITEMS)).agg(F.max("value")).withColumnsRenamed(_ITEMS)
    over = lambda c: F.round(c / F.col("cap"), 10)
    paid = F.when(F.col("dividends").isNotNull(), F.greatest(-F.col("dividends"), F.lit(0.0)))
    return s.join(w, "security_id", "left").select(
        "security_id", over(F.col("book")).alias("book_to_price"), over(F.col("income")).alias("earnings_to_price"), over(F.col("cash") + F.col("capex")).alias("cashflow_to_price"), over(F.col("revenue")).alias("sales_to_price"), over(paid).alias("dividend_yield"),
        F.round(F.log(F.greatest("cap", F.lit(1.0))), 8).alias("log_market_cap"),
    )


# -- bands


CUTS, REST, WIDTH = {"LARGE": 0.7, "MID": 0.85, "SMALL": 0.98}, "MICRO", 0.02


def _bands(spark: SparkSession, d: str) -> DataFrame:
    size = lambda day: caps(spark, d, day).groupBy("security_id").agg(F.max("float_cap").alias("size")).withColumn("all", F.lit(1))
    before = cs.cumulative_bands(size(BEFORE), ["all"], "size", "security_id", CUTS, REST).select("security_id", F.col("band").alias("previous"))
    return cs.buffered_bands(size(DAY).join(before, "security_id", "left"), ["all"], "size", "security_id", CUTS, REST, "previous", WIDTH)


def _band_sql(name: str, source: str) -> str:
    return f"""{name}0 AS (SELECT security_id, max(float_cap) AS size FROM {source} GROUP BY 1), {name}1 AS (SELECT security_id, size, round(CAST(sum(CAST(size AS DECIMAL(28, 4))) OVER (ORDER BY size DESC, security_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(CAST(size AS DECIMAL(28, 4))) OVER () AS DOUBLE), 12) AS cum FROM {name}0 WHERE size > 0),
{name} AS (SELECT o.security_id, o.size, cum, CASE WHEN cum <= 0.7 THEN 'LARGE' WHEN cum <= 0.85 THEN 'MID' WHEN cum <= 0.98 THEN 'SMALL' ELSE 'MICRO' END AS band FROM {name}0 o LEFT JOIN {name}1 USING (security_id))"""


_BANDS = f"""WITH {CLEAN}, {FX}, {_RATES}, {_caps_sql('c', DAY)}, {_caps_sql('b', BEFORE)}, {_band_sql('x', 'c')}, {_band_sql('y', 'b')}, n(band, i, cut) AS (VALUES ('LARGE', 1, 0.7), ('MID', 2, 0.85), ('SMALL', 3, 0.98), ('MICRO', 4, 1.0)),
z AS (SELECT x.security_id, x.size, x.cum, x.band AS hard, y.band AS previous, coalesce(abs(h.i - p.i) = 1 AND round(abs(x.cum - least(h.cut, p.cut)), 12) <= 0.02, FALSE) AS held FROM x LEFT JOIN y USING (security_id) LEFT JOIN n h ON h.band = x.band LEFT JOIN n p ON p.band = y.band),
r AS (SELECT *, CASE WHEN held THEN previous ELSE hard END AS band FROM z)"""


@query(_BANDS + "SELECT security_id, round(cum, 8) AS cumulative, previous, hard, band, held, coalesce(band <> previous, FALSE) AS moved FROM r")
def size_bands_buffered(spark: SparkSession, d: str) -> DataFrame:
    """Bands of the day with a buffer for those of half a year before."""
    return _bands(spark, d).select("security_id", F.round("cumulative", 8).alias("cumulative"), "previous", "hard", "band", "held", "moved")


@query(_BANDS + "SELECT band, count(*) AS n, count(*) FILTER (WHERE coalesce(band <> previous, FALSE)) AS moved, count(*) FILTER (WHERE held) AS held, round(sum(size) / sum(sum(size)) OVER (), 8) AS weight FROM r GROUP BY band")
def size_band_summary(spark: SparkSession, d: str) -> DataFrame:
    return cs.band_summary(_bands(spark, d), ["all"], "size").select("band", "n", "moved", "held", F.round("weight", 8).alias("weight"))


# -- factors and research


@query(f"""WITH {SIGNALS}, q AS (SELECT as_of, quantile_cont(signal, 0.01) AS lo, quantile_cont(signal, 0.99) AS hi FROM sg GROUP BY as_of), a AS (SELECT sg.as_of, security_id, industry, cap, least(greatest(signal, lo), hi) AS v FROM sg JOIN q USING (as_of)),
b AS (SELECT *, stddev_samp(v) OVER w AS sd, sum(v * cap) OVER w / sum(cap) OVER w AS m FROM a WINDOW w AS (PARTITION BY as_of)), c AS (SELECT *, CASE WHEN sd IS NULL OR sd <= 1e-12 THEN 0 ELSE (v - m) / sd END AS z FROM b),
e AS (SELECT *, z - sum(z * cap) OVER w / sum(cap) OVER w AS n FROM c WINDOW w AS (PARTITION BY as_of, industry)), f AS (SELECT *, stddev_samp(n) OVER w AS sn, avg(n) OVER w AS mn FROM e WINDOW w AS (PARTITION BY as_of))
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, round(CASE WHEN sn IS NULL OR sn <= 1e-12 THEN 0 ELSE (n - mn) / sn END, 7) AS score FROM f""")
def factor_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A raw signal made a score, month by month: winsorise, standardise, neutralise, standardise, fill."""
    return cs.pipeline(signals(spark, d), ["as_of"], "industry", "signal", "cap").select(text_day("as_of").alias("as_of"), "security_id", F.round("score", 7).alias("score"))


@query(f"""WITH {SIGNALS}, f AS (SELECT *, ln(lead(signal) OVER (PARTITION BY security_id ORDER BY as_of) / signal) AS fwd FROM sg), k AS (SELECT unnest(range(1, 21))::INT AS k), s AS (SELECT k, as_of, fwd, ((security_id * 48271 + (year(as_of) * 12 + month(as_of)) * 16807 + k * 69621) * 40692) % 2147483399 AS r, security_id FROM f, k WHERE fwd IS NOT NULL),
a AS (SELECT k, as_of, rank() OVER (PARTITION BY k, as_of ORDER BY r) + (count(*) OVER (PARTITION BY k, as_of, r) - 1) / 2.0 AS x, rank() OVER (PARTITION BY k, as_of ORDER BY fwd) + (count(*) OVER (PARTITION BY k, as_of, fwd) - 1) / 2.0 AS y FROM s),
c AS (SELECT k, as_of, corr(x, y) AS ic FROM a GROUP BY ALL HAVING count(*) >= 20)
SELECT k AS trial, count(*) AS n_months, round(avg(ic), 8) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)), 6) AS t, round(pow(0.5 / nullif(avg(ic), 0), 2), 4) AS implied_breadth FROM c GROUP BY k""")
def random_signal_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """What twenty signals of chance reach: mean rank correlation, its t, and the breadth that an information ratio of 0.5 would need."""
    w = Window.partitionBy("security_id").orderBy("as_of")
    f = signals(spark, d).withColumn("fwd", F.log(F.lead("signal").over(w) / F.col("signal")))
    month = F.year("as_of") * 12 + F.month("as_of")
    chance = lambda k: ((F.col("security_id").cast("bigint") * 48271 + month * 16807 + k * 69621) * 40692) % 2147483399
    x = research.random_benchmark(f, "as_of", "fwd", chance, trials=20, least=20, target_ratio=0.5)
    return x.select("trial", "n_months", F.round("mean_ic", 8).alias("mean_ic"), F.round("t", 6).alias("t"), F.round("implied_breadth", 4).alias("implied_breadth"))


# -- hedging


_DEP = """dep AS (SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS date, r.r_name AS quote, AVG(o.o_totalprice) / 1e7 AS rate FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2)"""


def deposit_rates(spark: SparkSession, d: str) -> DataFrame:
    """A monthly deposit rate per quote, derived from orders as the exchange rates are."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    return x.groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("date"), F.col("r_name").alias("quote")).agg((F.avg("o_totalprice") / 1e7).alias("rate"))


@query(f"""WITH {FX}, {_DEP}, x AS (SELECT quote, date, rate, first_value(rate) OVER w AS struck, first_value(date) OVER w AS reset FROM fx WINDOW w AS (PARTITION BY quote, date_trunc('month', date) ORDER BY date)),
y AS (SELECT x.*, dep.rate AS own FROM x ASOF LEFT JOIN dep ON dep.quote = x.quote AND dep.date <= x.reset), e(quote, notional) AS (VALUES ('AFRICA', 1e6), ('AMERICA', 2e6), ('ASIA', 3e6), ('EUROPE', 4e6), ('MIDDLE EAST', 5e6)),
m AS (SELECT y.*, notional, struck * (1 + 0.03 / 12) / (1 + own / 12) AS forward FROM y JOIN e USING (quote))
SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS legs, round(sum(notional * (forward - rate)), 4) AS mark, round(sum((0.03 - own) / 12 * notional), 6) AS carry FROM m GROUP BY date""")
def hedge_legs(spark: SparkSession, d: str) -> DataFrame:
    """Legs struck at each month's first rate over the deposit rates then in force, marked on every day and summed."""
    x = series.resets(fx(spark, d), "quote", "date", "rate")
    month = Window.partitionBy("quote", F.trunc("date", "month"))
    x = x.withColumn("reset", F.min("date").over(month))
    own = pit.carry_forward(x.select("quote", F.col("reset").alias("date")).distinct(), deposit_rates(spark, d), "quote", "date", "rate").select("quote", F.col("date").alias("reset"), F.col("rate").alias("own"))
    exposure = F.create_map(*[F.lit(v) for i, q in enumerate(sorted({*QUOTES.values()})) for v in (q, (i + 1) * 1e6)])
    m = x.join(own, ["quote", "reset"], "left").withColumn("notional", exposure[F.col("quote")])
    forward = series.forward_rate(F.col("struck"), F.lit(0.03), F.col("own"), F.lit(1 / 12))
    return m.groupBy(text_day("date").alias("day")).agg(F.count(F.lit(1)).alias("legs"), F.round(F.sum(series.leg_mark(F.col("notional"), forward, F.col("rate"))), 4).alias("mark"), F.round(F.sum(series.carry(F.lit(0.03), F.col("own"), F.lit(1 / 12)) * F.col("notional")), 6).alias("carry"))


# -- evaluation


@query("""WITH c AS (SELECT lower(trim(source)) AS category, coalesce(text, '') AS answer, trim(coalesce(text, '')) = '' AS abstained, coalesce(n_chars, 0) = 0 AS should_abstain, security_id FROM documents WHERE source IS NOT NULL),
g AS (SELECT *, abstained = should_abstain AND (should_abstain OR (contains(lower(answer), 'the') AND NOT contains(lower(answer), 'lorem'))) AS passed, CASE WHEN security_id IS NOT NULL THEN CASE WHEN category IN ('exchange_notice', 'press_wire') THEN 1.0 ELSE 0.0 END END AS cp FROM c)
SELECT category, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE abstained) AS abstained, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(avg(cp) FILTER (WHERE NOT abstained), 8) AS citation_precision, round(avg(CASE WHEN abstained = should_abstain THEN 1.0 ELSE 0.0 END), 8) AS abstention_accuracy FROM g GROUP BY category""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents graded as if they were answers, summed up by source."""
    x = table(spark, d, "documents").where("source IS NOT NULL").select(
        F.lower(F.trim("source")).alias("category"), F.coalesce("text", F.lit("")).alias("answer"), F.array(F.lit("the")).alias("must"), F.array(F.lit("lorem")).alias("must_not"),
        F.when(F.col("security_id").isNotNull(), F.array(F.lower(F.trim("source")))).otherwise(F.array().cast("array<string>")).alias("cited"), F.array(F.lit("exchange_notice"), F.lit("press_wire")).alias("expected"),
        (F.trim(F.coalesce("text", F.lit(""))) == "").alias("abstained"), (F.coalesce("n_chars", F.lit(0)) == 0).alias("should_abstain"),
    )
    g = text.grade(x, answer="answer", must="must", must_not="must_not", cited="cited", expected="expected", abstained="abstained", should_abstain="should_abstain")
    g = g.withColumn("unsupported", F.array().cast("array<string>"))
    r = text.report(g, "category", abstained="abstained", should_abstain="should_abstain", unsupported="unsupported").drop("hallucination_rate")
    return r.withColumns({c: F.round(c, 8) for c in ("accuracy", "citation_precision", "abstention_accuracy")})
