"""Weights with ceilings, conversions, ratios, bridges and drills as queries, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import compare, pit
from ..operators import crosssection as cs
from ..sources.tables import table
from .common import CLEAN, FX, SIGNALS, clean_prices, fx, signals, text_day

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH m AS (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2024-12-01', INTERVAL 1 MONTH))::DATE AS m), t AS (SELECT m, (m + CAST((12 - dayofweek(m)) % 7 AS INT) + 14)::DATE AS f FROM m WHERE month(m) IN (3, 6, 9, 12))
SELECT strftime(f, '%Y-%m-%d') AS effective, strftime(f - 14, '%Y-%m-%d') AS announced, strftime(f - 35, '%Y-%m-%d') AS cut_off FROM t""")
def review_calendar(spark: SparkSession, d: str) -> DataFrame:
    m = spark.range(1).select(F.explode(dates.month_starts("2020-01-01", "2024-12-01")).alias("m")).where(F.month("m").isin(3, 6, 9, 12))
    f = dates.third_friday(F.col("m"))
    return m.select(text_day(f).alias("effective"), text_day(F.date_sub(f, 14)).alias("announced"), text_day(F.date_sub(f, 35)).alias("cut_off"))


@query(f"""WITH {SIGNALS}, r AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY signal DESC, security_id) AS i, greatest(1, round_even(count(*) OVER (PARTITION BY as_of) * 0.2, 0)) AS k FROM sg)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, round(cap / sum(cap) OVER (PARTITION BY as_of), 10) AS weight FROM r WHERE i <= k""")
def selection_weights(spark: SparkSession, d: str) -> DataFrame:
    t = cs.top_fraction(signals(spark, d), ["as_of"], "signal", "security_id", 0.2)
    return t.select(text_day("as_of").alias("as_of"), "security_id", F.round(cs.normalised_weight(F.col("cap"), ["as_of"]), 10).alias("weight"))


@query(f"""WITH RECURSIVE {SIGNALS}, w AS (SELECT as_of, security_id, signal / sum(signal) OVER p AS w, 3 * sqrt(cap) / sum(sqrt(cap)) OVER p AS c FROM sg WINDOW p AS (PARTITION BY as_of)), f AS (SELECT *, sum(c) OVER (PARTITION BY as_of) >= 1 - 1e-12 AS feasible FROM w),
r AS (SELECT 0 AS i, as_of, security_id, w, c, feasible, w AS x, FALSE AS done FROM f
 UNION ALL SELECT i + 1, as_of, security_id, w, c, feasible, CASE WHEN done OR x > c THEN c ELSE w * (1 - sum(CASE WHEN done OR x > c THEN c ELSE 0 END) OVER p) / sum(CASE WHEN done OR x > c THEN 0 ELSE w END) OVER p END, done OR x > c FROM r WHERE i < 60 AND feasible WINDOW p AS (PARTITION BY as_of))
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, round(x, 10) AS limited, feasible FROM r WHERE i = 60""")
def ceiling_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by signal under ceilings proportional to the square root of capacity."""
    s = signals(spark, d).withColumn("ceiling", 3 * F.sqrt("cap") / F.sum(F.sqrt("cap")).over(Window.partitionBy("as_of")))
    return cs.ceiling_weights(s, ["as_of"], "signal", "ceiling", "security_id").select(text_day("as_of").alias("as_of"), "security_id", F.round("limited", 10).alias("limited"), "feasible")


@query(f"""WITH RECURSIVE {SIGNALS}, w AS (SELECT as_of, industry, security_id, signal / sum(signal) OVER (PARTITION BY as_of) AS w FROM sg), g AS (SELECT as_of, industry, sum(w) AS g FROM w GROUP BY ALL),
r AS (SELECT 0 AS i, as_of, industry, g, g AS x, FALSE AS done FROM g
 UNION ALL SELECT i + 1, as_of, industry, g, CASE WHEN done OR x > 0.25 THEN 0.25 ELSE g * (1 - 0.25 * count(*) FILTER (WHERE done OR x > 0.25) OVER p) / sum(CASE WHEN done OR x > 0.25 THEN 0 ELSE g END) OVER p END, done OR x > 0.25 FROM r WHERE i < 20 WINDOW p AS (PARTITION BY as_of)),
z AS (SELECT as_of, industry, g, x, count(*) OVER (PARTITION BY as_of) AS n FROM r WHERE i = 20)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, industry, security_id, round(w * CASE WHEN n * 0.25 >= 1 - 1e-12 THEN x ELSE 1.0 / n END / g, 10) AS weight, n * 0.25 >= 1 - 1e-12 AS feasible FROM w JOIN z USING (as_of, industry)""")
def group_capped_weights(spark: SparkSession, d: str) -> DataFrame:
    """No industry above 25 % of a month."""
    s = signals(spark, d).withColumn("w", cs.normalised_weight(F.col("signal"), ["as_of"]))
    return cs.cap_groups(s, ["as_of"], "industry", "w", 0.25).select(text_day("as_of").alias("as_of"), "industry", "security_id", F.round("group_capped", 10).alias("weight"), "feasible")


@query("""WITH c AS (SELECT listing_id, as_of, window_days, max(weight) AS weight, max(adv) AS adv FROM capacity GROUP BY ALL), t AS (SELECT *, 1e9 * weight / nullif(adv * 0.2, 0) AS days FROM c)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, window_days, count(*) AS n, count(days) AS n_tradable, round(sum(weight * days) / sum(weight) FILTER (WHERE days IS NOT NULL), 6) AS mean_days FROM t GROUP BY as_of, window_days""")
def days_to_trade(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean days to trade a fund of 1e9 at a fifth of the daily value."""
    c = table(spark, d, "capacity").groupBy("listing_id", "as_of", "window_days").agg(F.max("weight").alias("weight"), F.max("adv").alias("adv"))
    t = c.withColumn("days", F.try_divide(1e9 * F.col("weight"), F.nullif(F.col("adv") * 0.2, F.lit(0.0))))
    return t.groupBy(text_day("as_of").alias("as_of"), "window_days").agg(
        F.count(F.lit(1)).alias("n"), F.count("days").alias("n_tradable"), F.round(F.sum(F.col("weight") * F.col("days")) / F.sum(F.when(F.col("days").isNotNull(), F.col("weight"))), 6).alias("mean_days")
    )


@query(f"""WITH {FX}, v AS (SELECT CAST(o_orderdate AS DATE) AS date, r_name AS quote, o_orderpriority AS book, sum(o_totalprice) AS local FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)
SELECT v.book, v.quote, count(*) AS n, round(sum(v.local * fx.rate), 2) AS base, round(sum(v.local), 2) AS local FROM v ASOF JOIN fx ON v.quote = fx.quote AND v.date >= fx.date WHERE v.date - fx.date <= 7 GROUP BY v.book, v.quote""")
def currency_exposures(spark: SparkSession, d: str) -> DataFrame:
    """Local values converted at the as-of rate of at most seven days, by currency."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    v = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    v = v.groupBy(F.to_date("o_orderdate").alias("date"), F.col("r_name").alias("quote"), F.col("o_orderpriority").alias("book")).agg(F.sum("o_totalprice").alias("local"))
    rate = pit.carry_forward(v.select("quote", "date").distinct(), fx(spark, d), "quote", "date", "rate").where("age_days <= 7")
    return v.join(rate, ["quote", "date"]).groupBy("book", "quote").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("local") * F.col("rate")), 2).alias("base"), F.round(F.sum("local"), 2).alias("local"))


_PIT = """WITH p AS (SELECT security_id, item, value FROM fundamentals WHERE filed_date <= DATE '2023-06-30' AND period_end >= DATE '2023-06-30' - 550 AND value IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY security_id, item ORDER BY period_end DESC, filed_date DESC, value DESC) = 1),
w AS (SELECT security_id, max(value) FILTER (WHERE item = 'BOOK_EQUITY') AS book, max(value) FILTER (WHERE item = 'NET_INCOME') AS ni, max(value) FILTER (WHERE item = 'TOTAL_ASSETS') AS assets, max(value) FILTER (WHERE item = 'TOTAL_DEBT') AS debt,
 max(value) FILTER (WHERE item = 'GROSS_PROFIT') AS gp, max(value) FILTER (WHERE item = 'OPERATING_CASHFLOW') AS ocf FROM p GROUP BY security_id)"""


@query(_PIT + """ SELECT security_id, round(CASE WHEN book > 0 THEN ni / book END, 8) AS roe, round(CASE WHEN assets > 0 THEN debt / assets END, 8) AS leverage, round(CASE WHEN assets > 0 THEN gp / assets END, 8) AS profitability, round(CASE WHEN assets > 0 THEN (ni - ocf) / assets END, 8) AS accruals FROM w""")
def fundamental_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of the figures known on a day; a denominator that is not positive gives null."""
    items = {"BOOK_EQUITY": "book", "NET_INCOME": "ni", "TOTAL_ASSETS": "assets", "TOTAL_DEBT": "debt", "GROSS_PROFIT": "gp", "OPERATING_CASHFLOW": "ocf"}
    f = table(spark, d, "fundamentals")
    p = pit.pit_latest(f, "2023-06-30", ["BOOK_EQUITY", "NET_INCOME", "REVENUE", "TOTAL_ASSETS", "TOTAL_DEBT", "GROSS_PROFIT", "OPERATING_CASHFLOW", "CAPEX", "DIVIDENDS_PAID"])
    w = p.groupBy("security_id").pivot("item", list(items)).agg(F.max("value")).withColumnsRenamed(items)
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, a / F.col(b)), 8)
    return w.select("security_id", ratio(F.col("ni"), "book").alias("roe"), ratio(F.col("debt"), "assets").alias("leverage"), ratio(F.col("gp"), "assets").alias("profitability"), ratio(F.col("ni") - F.col("ocf"), "assets").alias("accruals"))


@query("""WITH q AS (SELECT DISTINCT security_id, item, period_end, value FROM (SELECT *, row_number() OVER (PARTITION BY security_id, item, period_end ORDER BY filed_date DESC, value DESC) AS r FROM fundamentals WHERE value IS NOT NULL AND filed_date IS NOT NULL AND item IS NOT NULL) WHERE r = 1)
SELECT a.security_id, a.item, strftime(a.period_end, '%Y-%m-%d') AS period_end, round(a.value / b.value - 1, 8) AS growth FROM q a JOIN q b ON a.security_id = b.security_id AND a.item = b.item AND b.period_end = (a.period_end - INTERVAL 1 YEAR)::DATE WHERE b.value > 0""")
def yearly_growth(spark: SparkSession, d: str) -> DataFrame:
    """Growth of the last filed value over the same period a year before."""
    f = table(spark, d, "fundamentals").where("value IS NOT NULL AND filed_date IS NOT NULL AND item IS NOT NULL")
    q = pit.latest_by(f, ["security_id", "item", "period_end"], ["filed_date", "value"], ["value"])
    b = q.select("security_id", "item", F.col("period_end").alias("before"), F.col("value").alias("base")).where("base > 0")
    x = q.withColumn("before", F.add_months("period_end", -12)).join(b, ["security_id", "item", "before"])
    return x.select("security_id", "item", text_day("period_end").alias("period_end"), F.round(F.col("value") / F.col("base") - 1, 8).alias("growth"))


@query(f"""WITH {SIGNALS}, m AS (SELECT as_of, avg(signal) AS v FROM sg GROUP BY as_of) SELECT strftime(as_of, '%Y-%m-%d') AS step, round(v - lag(v) OVER (ORDER BY as_of), 6) AS change, round(v - first_value(v) OVER (ORDER BY as_of), 6) AS cumulative FROM m""")
def step_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """Changes from step to step and since the first; one row per month, so the one window is short."""
    m = signals(spark, d).groupBy("as_of").agg(F.avg("signal").alias("v"))
    w = Window.partitionBy(F.lit(0)).orderBy("as_of")
    return m.select(text_day("as_of").alias("step"), F.round(F.col("v") - F.lag("v").over(w), 6).alias("change"), F.round(F.col("v") - F.first("v").over(w), 6).alias("cumulative"))


@query(f"""WITH {CLEAN}, r AS (SELECT listing_id, date, close / lag(close) OVER w - 1 AS ret FROM cp WINDOW w AS (PARTITION BY listing_id ORDER BY date)), p AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY listing_id ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS vol, count(ret) OVER (PARTITION BY listing_id ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS n FROM r)
SELECT listing_id, count(*) AS n, round(stddev_samp(ret / vol), 6) AS bias, round(1 - 2 * sqrt(2.0 / count(*)), 6) AS low, round(1 + 2 * sqrt(2.0 / count(*)), 6) AS high FROM p WHERE n >= 40 AND vol > 1e-12 AND ret IS NOT NULL GROUP BY listing_id HAVING count(*) > 1""")
def bias_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Spread of returns over their trailing volatility: 1 if the forecast is unbiased."""
    w = Window.partitionBy("listing_id").orderBy("date")
    r = clean_prices(spark, d).select("listing_id", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"))
    t = w.rowsBetween(-60, -1)
    p = r.withColumn("vol", F.stddev_samp("ret").over(t)).withColumn("n", F.count("ret").over(t)).where("n >= 40 AND vol > 1e-12 AND ret IS NOT NULL")
    g = p.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp(F.col("ret") / F.col("vol")), 6).alias("bias")).where("n > 1")
    half = 2 * F.sqrt(2.0 / F.col("n"))
    return g.select("listing_id", "n", "bias", F.round(1 - half, 6).alias("low"), F.round(1 + half, 6).alias("high"))


@query(f"""WITH {CLEAN}, r AS (SELECT listing_id, date, close / lag(close) OVER (PARTITION BY listing_id ORDER BY date) - 1 AS ret FROM cp), m AS (SELECT date, avg(ret) AS m FROM r WHERE ret IS NOT NULL GROUP BY date), x AS (SELECT listing_id, ret, ret - m AS active FROM r JOIN m USING (date) WHERE ret IS NOT NULL)
SELECT listing_id, count(*) AS n, round(avg(active) * 252, 6) AS active_return, round(stddev_samp(active) * sqrt(252), 6) AS tracking_error, round(avg(active) * 252 / nullif(stddev_samp(active) * sqrt(252), 0), 6) AS information_ratio FROM x GROUP BY listing_id HAVING count(*) > 20""")
def variants_compared(spark: SparkSession, d: str) -> DataFrame:
    """Active return, tracking error and information ratio of each series against the mean of all."""
    w = Window.partitionBy("listing_id").orderBy("date")
    r = clean_prices(spark, d).select("listing_id", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).where("ret IS NOT NULL")
    x = r.join(r.groupBy("date").agg(F.avg("ret").alias("m")), "date").withColumn("active", F.col("ret") - F.col("m"))
    g = x.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"), (F.avg("active") * 252).alias("a"), (F.stddev_samp("active") * F.sqrt(F.lit(252.0))).alias("t")).where("n > 20")
    return g.select("listing_id", "n", F.round("a", 6).alias("active_return"), F.round("t", 6).alias("tracking_error"), F.round(F.try_divide("a", F.nullif("t", F.lit(0.0))), 6).alias("information_ratio"))


@query(f"""WITH {FX}, x AS (SELECT quote, date, rate, lag(rate) OVER (PARTITION BY quote ORDER BY date) AS p FROM fx) SELECT quote, count(*) AS n_jumps, count(*) FILTER (WHERE abs(rate * p - 1) < 0.25) AS n_like_inverted, round(max(abs(rate / p - 1)), 8) AS largest FROM x WHERE abs(rate / p - 1) > 0.1 GROUP BY quote""")
def fx_jumps(spark: SparkSession, d: str) -> DataFrame:
    """Moves of more than a tenth, and those that look like an inverted quote."""
    x = fx(spark, d).withColumn("p", F.lag("rate").over(Window.partitionBy("quote").orderBy("date"))).withColumn("move", F.abs(F.col("rate") / F.col("p") - 1)).where("move > 0.1")
    return x.groupBy("quote").agg(F.count(F.lit(1)).alias("n_jumps"), F.count_if(F.abs(F.col("rate") * F.col("p") - 1) < 0.25).alias("n_like_inverted"), F.round(F.max("move"), 8).alias("largest"))


@query(f"""WITH {CLEAN}, a AS (SELECT listing_id FROM listings WHERE listing_start <= DATE '2023-06-30' AND (listing_end IS NULL OR listing_end > DATE '2023-06-30'))
SELECT a.listing_id, strftime(max(cp.date), '%Y-%m-%d') AS last_price FROM a LEFT JOIN cp ON cp.listing_id = a.listing_id AND cp.date <= DATE '2023-06-30' GROUP BY a.listing_id HAVING max(cp.date) IS NULL OR max(cp.date) < DATE '2023-06-30' - 5""")
def unpriced_listings(spark: SparkSession, d: str) -> DataFrame:
    a = pit.in_force(table(spark, d, "listings"), "2023-06-30", "listing_start", "listing_end").select("listing_id")
    p = clean_prices(spark, d).where("date <= DATE'2023-06-30'").groupBy("listing_id").agg(F.max("date").alias("last"))
    return a.join(p, "listing_id", "left").where("last IS NULL OR last < date_sub(DATE'2023-06-30', 5)").select("listing_id", text_day("last").alias("last_price"))


@query("""WITH d AS (SELECT doc_id, security_id, CAST(published AS DATE) AS p FROM documents WHERE security_id IS NOT NULL AND published IS NOT NULL AND length(trim(text, ' ')) > 0), e AS (SELECT event_id, security_id, announcement_date AS a FROM corp_actions WHERE announcement_date IS NOT NULL)
SELECT event_id, doc_id, abs(p - a)::INT AS gap FROM e JOIN d USING (security_id) WHERE abs(p - a) <= 5 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(p - a), doc_id) = 1""")
def events_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Each announced event with the nearest document of its security within five days."""
    e = table(spark, d, "corp_actions").where("announcement_date IS NOT NULL").select("event_id", "security_id", "announcement_date")
    t = table(spark, d, "documents").where("security_id IS NOT NULL AND published IS NOT NULL AND length(trim(text)) > 0").select("doc_id", "security_id", F.to_date("published").alias("published"))
    return pit.nearest(e, t, "security_id", "announcement_date", "published", "event_id", "doc_id", 5)


FAULTS = ("none", "factor_ten", "factor_hundredth", "negative", "missing", "duplicated", "null", "stale", "split_missed", "delisted_held", "infinite")


@query(f"""WITH {CLEAN}, k AS (SELECT cp.listing_id, date, close, lag(close) OVER (PARTITION BY cp.listing_id ORDER BY date) AS prior, md5(cp.listing_id)[1:1] = '0' AS unlucky, l.e FROM cp LEFT JOIN (SELECT listing_id, min(listing_end) AS e FROM listings GROUP BY 1) l ON l.listing_id = cp.listing_id),
f(fault) AS (VALUES {', '.join(f"('{x}')" for x in FAULTS)}), c(copy) AS (VALUES (0), (1)),
x AS (SELECT fault, listing_id, date, prior, CASE WHEN fault = 'delisted_held' AND unlucky THEN date - 1 ELSE e END AS e, CASE WHEN NOT unlucky THEN close WHEN fault = 'factor_ten' THEN close * 10 WHEN fault = 'factor_hundredth' THEN close / 100 WHEN fault = 'negative' THEN -close WHEN fault = 'null' THEN NULL WHEN fault = 'stale' THEN prior
 WHEN fault = 'split_missed' THEN close / 8 WHEN fault = 'infinite' THEN 'Infinity'::DOUBLE ELSE close END AS close, NOT (fault = 'missing' AND unlucky) AS there FROM k, f, c WHERE copy = 0 OR (fault = 'duplicated' AND unlucky)),
g AS (SELECT fault, listing_id, date, count(*) FILTER (WHERE there) AS copies, any_value(close) AS close, any_value(prior) AS prior, any_value(e) AS e FROM x GROUP BY ALL),
s AS (SELECT fault, count(*) FILTER (WHERE copies = 0) AS n_missing, count(*) FILTER (WHERE copies > 1) AS n_duplicate, count(*) FILTER (WHERE copies > 0 AND close IS NULL) AS n_null, count(*) FILTER (WHERE copies > 0 AND close IS NOT NULL AND NOT (close > 0 AND isfinite(close))) AS n_no_price,
 count(*) FILTER (WHERE copies > 0 AND (close / prior > 6 OR prior / close > 6)) AS n_jumps, count(*) FILTER (WHERE copies > 0 AND close = prior) AS n_stale, count(*) FILTER (WHERE copies > 0 AND date > e) AS n_ended FROM g GROUP BY fault)
SELECT s.*, s.n_missing > b.n_missing OR s.n_duplicate > b.n_duplicate OR s.n_null > b.n_null OR s.n_no_price > b.n_no_price OR s.n_jumps > b.n_jumps OR s.n_stale > b.n_stale OR s.n_ended > b.n_ended AS detected FROM s, (SELECT * FROM s WHERE fault = 'none') b""")
def chaos_drill(spark: SparkSession, d: str) -> DataFrame:
    """Which faults injected into a sixteenth of the listings the rules detect, against the same rules on the clean prices.

    Prices are windowed once; every row is written out once per fault, altered, and all faults are
    checked in one aggregation per key and one per fault.
    """
    w = Window.partitionBy("listing_id").orderBy("date")
    e = table(spark, d, "listings").groupBy("listing_id").agg(F.min("listing_end").alias("e"))
    k = clean_prices(spark, d).withColumn("prior", F.lag("close").over(w)).join(e, "listing_id", "left").withColumn("unlucky", F.substring(F.md5("listing_id"), 1, 1) == "0")
    c, bad = F.col("close"), lambda f: (F.col("fault") == f) & F.col("unlucky")
    x = k.withColumn("fault", F.explode(F.array(*[F.lit(f) for f in FAULTS]))).withColumn("copies", F.when(bad("missing"), 0).when(bad("duplicated"), 2).otherwise(1))
    new = F.when(bad("factor_ten"), c * 10).when(bad("factor_hundredth"), c / 100).when(bad("negative"), -c).when(bad("null"), None).when(bad("stale"), F.col("prior")).when(bad("split_missed"), c / 8).when(bad("infinite"), float("inf")).otherwise(c)
    x = x.select("fault", "listing_id", "date", "prior", F.when(bad("delisted_held"), F.date_sub("date", 1)).otherwise(F.col("e")).alias("e"), new.alias("close"), F.explode(F.array_repeat(F.lit(1), F.greatest("copies", F.lit(1)))).alias("one"), F.least("copies", F.lit(1)).alias("there"))
    g = x.groupBy("fault", "listing_id", "date").agg(F.sum("there").alias("copies"), *[F.max(n).alias(n) for n in ("close", "prior", "e")])
    here = F.col("copies") > 0
    s = g.groupBy("fault").agg(
        F.count_if(~here).alias("n_missing"), F.count_if(F.col("copies") > 1).alias("n_duplicate"), F.count_if(here & c.isNull()).alias("n_null"), F.count_if(here & c.isNotNull() & ~((c > 0) & (c < float("inf")))).alias("n_no_price"),
        F.count_if(here & ((c / F.col("prior") > 6) | F.coalesce(F.try_divide("prior", "close") > 6, F.lit(False)))).alias("n_jumps"), F.count_if(here & (c == F.col("prior"))).alias("n_stale"), F.count_if(here & (F.col("date") > F.col("e"))).alias("n_ended"),
    )
    clean = Window.partitionBy(F.lit(0))  # one row per fault
    base = lambda n: F.max(F.when(F.col("fault") == "none", F.col(n))).over(clean)
    return s.withColumn("detected", reduce(lambda a, b: a | b, [F.col(n) > base(n) for n in ("n_missing", "n_duplicate", "n_null", "n_no_price", "n_jumps", "n_stale", "n_ended")]))
