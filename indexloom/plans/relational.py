"""Sources and point-in-time relational patterns as queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pit
from ..sources.files import to_long
from ..sources.snapshot import Snapshot
from ..sources.tables import table
from .common import CLEAN, FX, MEMBERSHIP, SIGNALS, clean_prices, fx, membership, rounded, signals, text_day

AS_OF = "2023-06-30"
QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- sources


@query("""SELECT 'prices' AS what, count(*) AS n FROM prices UNION ALL SELECT 'shares', count(*) FROM shares UNION ALL SELECT 'fundamentals', count(*) FROM fundamentals
UNION ALL SELECT 'corp_actions', count(*) FROM corp_actions UNION ALL SELECT 'securities', count(*) FROM securities UNION ALL SELECT 'listings', count(*) FROM listings
UNION ALL SELECT 'identifiers', count(*) FROM identifiers UNION ALL SELECT 'event:' || event_type, count(*) FROM corp_actions WHERE event_type IS NOT NULL GROUP BY event_type""")
def snapshot_summary(spark: SparkSession, d: str) -> DataFrame:
    return Snapshot(spark, d).summary().where("what IS NOT NULL")


@query("SELECT DISTINCT strftime(date, '%Y-%m-%d') AS day FROM prices WHERE date IS NOT NULL")
def trading_calendar(spark: SparkSession, d: str) -> DataFrame:
    return Snapshot(spark, d).calendar().select(text_day("date").alias("day"))


@query("""SELECT listing_id, strftime(date, '%Y-%m-%d') AS day, volume FROM prices WHERE listing_id IN (SELECT listing_id FROM listings WHERE country = 'DE')
AND date BETWEEN DATE '2023-01-01' AND DATE '2023-03-31' AND volume IS NOT NULL""")
def prices_range(spark: SparkSession, d: str) -> DataFrame:
    s = Snapshot(spark, d)
    german = s.table("listings").where("country = 'DE'").select("listing_id")
    return s.prices(start="2023-01-01", end="2023-03-31").where("volume IS NOT NULL").join(german, "listing_id", "left_semi").select("listing_id", text_day("date").alias("day"), "volume")


@query("""SELECT security_id, strftime(effective_date, '%Y-%m-%d') AS effective_date, strftime(knowledge_date, '%Y-%m-%d') AS knowledge_date, shares_outstanding, free_float_factor FROM shares
WHERE knowledge_date <= DATE '2023-06-30'
QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC NULLS LAST, knowledge_date DESC, shares_outstanding DESC NULLS LAST, free_float_factor DESC NULLS LAST) = 1""")
def shares_as_of(spark: SparkSession, d: str) -> DataFrame:
    return Snapshot(spark, d).shares(AS_OF).select("security_id", text_day("effective_date").alias("effective_date"), text_day("knowledge_date").alias("knowledge_date"), "shares_outstanding", "free_float_factor")


@query("""SELECT security_id, strftime(effective_date, '%Y-%m-%d') AS effective_date, reason, count(*) AS n FROM shares WHERE effective_date BETWEEN DATE '2022-01-01' AND DATE '2022-12-31' GROUP BY ALL""")
def shares_history(spark: SparkSession, d: str) -> DataFrame:
    s = Snapshot(spark, d).shares_history(start="2022-01-01", end="2022-12-31")
    return s.groupBy("security_id", text_day("effective_date").alias("effective_date"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT security_id, icb_industry, icb_industry || '10' AS icb_supersector FROM securities")
def classifications(spark: SparkSession, d: str) -> DataFrame:
    return Snapshot(spark, d).classifications()


@query("""SELECT issuer_id, security_id, country, currency FROM securities WHERE issuer_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY issuer_id ORDER BY security_id, country, currency) = 1""")
def issuers(spark: SparkSession, d: str) -> DataFrame:
    return Snapshot(spark, d).issuers().where("issuer_id IS NOT NULL")


@query("""WITH w AS (SELECT security_id, listing_id, max(upper(trim(identifier_value, ' '))) FILTER (WHERE identifier_type = 'isin') AS isin, max(upper(trim(identifier_value, ' '))) FILTER (WHERE identifier_type = 'sedol') AS sedol,
 max(upper(trim(identifier_value, ' '))) FILTER (WHERE identifier_type = 'ticker') AS ticker FROM identifiers WHERE listing_id IS NOT NULL GROUP BY ALL)
SELECT security_id, listing_id, identifier_type, identifier_value FROM w UNPIVOT (identifier_value FOR identifier_type IN (isin, sedol, ticker))""")
def identifiers_wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "identifiers").where("listing_id IS NOT NULL")
    wide = i.groupBy("security_id", "listing_id").pivot("identifier_type", ["isin", "sedol", "ticker"]).agg(F.max(F.upper(F.trim("identifier_value"))))
    return to_long(wide, ["security_id", "listing_id"], ["isin", "sedol", "ticker"], "identifier_type", "identifier_value")


@query("""SELECT security_id, item, strftime(period_end, '%Y-%m-%d') AS period_end, strftime(filed_date, '%Y-%m-%d') AS filed_date, n > 1 AS restated FROM (
 SELECT *, row_number() OVER (PARTITION BY security_id, item, period_end ORDER BY filed_date) AS n FROM (SELECT DISTINCT security_id, item, period_end, filed_date FROM fundamentals WHERE filed_date IS NOT NULL))""")
def restatement_flags(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fundamentals").select("security_id", "item", "period_end", "filed_date").where("filed_date IS NOT NULL").distinct()
    w = Window.partitionBy("security_id", "item", "period_end").orderBy("filed_date")
    return f.select("security_id", "item", text_day("period_end").alias("period_end"), text_day("filed_date").alias("filed_date"), (F.row_number().over(w) > 1).alias("restated"))


@query("""SELECT filed_year, n FROM (SELECT year(filed_date)::INT AS filed_year, count(*) AS n FROM fundamentals WHERE filed_date <= DATE '2023-06-30' GROUP BY 1)""")
def filed_years(spark: SparkSession, d: str) -> DataFrame:
    return pit.known_at(table(spark, d, "fundamentals"), AS_OF, "filed_date").groupBy(F.year("filed_date").alias("filed_year")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FX}, cal AS (SELECT q.quote, c.d::DATE AS date FROM (SELECT DISTINCT quote FROM fx) q, (SELECT unnest(generate_series((SELECT min(date) FROM fx), (SELECT max(date) FROM fx), INTERVAL 1 DAY)) AS d) c)
SELECT cal.quote, strftime(cal.date, '%Y-%m-%d') AS day, round(fx.rate, 12) AS rate, (cal.date - fx.date)::INT AS age_days FROM cal ASOF LEFT JOIN fx ON cal.quote = fx.quote AND cal.date >= fx.date""")
def fx_carried_forward(spark: SparkSession, d: str) -> DataFrame:
    """Rates on every calendar day with the last observation carried forward."""
    r = fx(spark, d)
    span = r.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    cal = r.select("quote").distinct().select("quote", F.explode(F.sequence(span.select("a").scalar(), span.select("b").scalar())).alias("date"))
    x = pit.carry_forward(cal, r, "quote", "date", "rate")
    return x.select("quote", text_day("date").alias("day"), rounded("rate", 12).alias("rate"), "age_days")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, measure, value FROM lineitem UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax)))
SELECT measure, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY measure""")
def measures_long(spark: SparkSession, d: str) -> DataFrame:
    x = to_long(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")
    return x.groupBy("measure").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# -- point in time and SQL patterns

ITEMS = ["BOOK_EQUITY", "NET_INCOME", "REVENUE"]


@query("""SELECT security_id, item, strftime(period_end, '%Y-%m-%d') AS period_end, strftime(filed_date, '%Y-%m-%d') AS filed_date, value FROM fundamentals
WHERE filed_date <= DATE '2023-06-30' AND period_end >= DATE '2023-06-30' - 550 AND item IN ('BOOK_EQUITY', 'NET_INCOME', 'REVENUE') AND value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY security_id, item ORDER BY period_end DESC, filed_date DESC, value DESC) = 1""")
def pit_fundamental(spark: SparkSession, d: str) -> DataFrame:
    return Snapshot(spark, d).fundamentals(AS_OF, ITEMS).select("security_id", "item", text_day("period_end").alias("period_end"), text_day("filed_date").alias("filed_date"), "value")


@query("""SELECT security_id, item, strftime(period_end, '%Y-%m-%d') AS period_end, strftime(filed_date, '%Y-%m-%d') AS filed_date, value FROM fundamentals
WHERE period_end <= DATE '2023-06-30' AND item IN ('BOOK_EQUITY', 'NET_INCOME', 'REVENUE') AND value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY security_id, item ORDER BY period_end DESC, filed_date DESC NULLS LAST, value DESC) = 1""")
def naive_fundamental(spark: SparkSession, d: str) -> DataFrame:
    x = pit.naive_latest(table(spark, d, "fundamentals"), AS_OF, ITEMS)
    return x.select("security_id", "item", text_day("period_end").alias("period_end"), text_day("filed_date").alias("filed_date"), "value")


@query("""WITH r AS (SELECT security_id, period_end, filed_date, value FROM fundamentals WHERE item = 'NET_INCOME' AND filed_date <= DATE '2023-06-30' AND value IS NOT NULL AND period_end IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY security_id, period_end ORDER BY filed_date DESC, value DESC) = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY period_end DESC) AS k FROM r)
SELECT security_id, round(sum(value), 4) AS ttm, strftime(max(period_end), '%Y-%m-%d') AS last_period, strftime(max(filed_date), '%Y-%m-%d') AS last_filed FROM l WHERE k <= 4 GROUP BY security_id HAVING count(*) = 4""")
def ttm_fundamental(spark: SparkSession, d: str) -> DataFrame:
    x = Snapshot(spark, d).fundamentals_ttm(AS_OF, "NET_INCOME")
    return x.select("security_id", F.round("ttm", 4).alias("ttm"), text_day("last_period").alias("last_period"), text_day("last_filed").alias("last_filed"))


@query(f"""WITH {CLEAN}, m AS (SELECT listing_id, date_trunc('month', date)::DATE AS month, close FROM cp QUALIFY row_number() OVER (PARTITION BY listing_id, date_trunc('month', date) ORDER BY date DESC) = 1),
g AS (SELECT listing_id, month, lag(close, 1) OVER w / nullif(lag(close, 12) OVER w, 0) - 1 AS momentum FROM m WINDOW w AS (PARTITION BY listing_id ORDER BY month))
SELECT listing_id, strftime(month, '%Y-%m-%d') AS month, round(momentum, 8) AS momentum FROM g WHERE momentum IS NOT NULL""")
def momentum_12_1(spark: SparkSession, d: str) -> DataFrame:
    m = pit.month_last(clean_prices(spark, d), "listing_id", "date", "close")
    x = m.select("listing_id", text_day("month").alias("month"), F.round(pit.lag_ratio(m, "listing_id", "month", "close", 1, 12), 8).alias("momentum"))
    return x.where("momentum IS NOT NULL")


@query(f"""WITH {SIGNALS} SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, CAST(ntile(10) OVER (PARTITION BY as_of ORDER BY signal, security_id) AS INT) AS decile,
CAST(ntile(10) OVER (PARTITION BY as_of, industry ORDER BY signal, security_id) AS INT) AS industry_decile, round(percent_rank() OVER (PARTITION BY as_of ORDER BY signal), 8) AS pct FROM sg""")
def cross_sectional_decile(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    day, ind = Window.partitionBy("as_of"), Window.partitionBy("as_of", "industry")
    return s.select(
        text_day("as_of").alias("as_of"), "security_id", F.ntile(10).over(day.orderBy("signal", "security_id")).alias("decile"), F.ntile(10).over(ind.orderBy("signal", "security_id")).alias("industry_decile"),
        F.round(F.percent_rank().over(day.orderBy("signal")), 8).alias("pct"),
    )


@query(f"""WITH {MEMBERSHIP} SELECT index_id, security_id, strftime(from_date, '%Y-%m-%d') AS from_date, weight FROM mb WHERE from_date <= DATE '1998-06-30' AND (to_date IS NULL OR to_date > DATE '1998-06-30')""")
def membership_as_of(spark: SparkSession, d: str) -> DataFrame:
    return pit.in_force(membership(spark, d), "1998-06-30", "from_date", "to_date").select("index_id", "security_id", text_day("from_date").alias("from_date"), "weight")


@query("""WITH m AS (SELECT DISTINCT event_type AS index_id, user_id AS security_id, CAST(ts AS DATE) AS day FROM events),
r AS (SELECT *, dense_rank() OVER (PARTITION BY index_id ORDER BY day) - row_number() OVER (PARTITION BY index_id, security_id ORDER BY day) AS g FROM m)
SELECT index_id, security_id, strftime(min(day), '%Y-%m-%d') AS from_date, strftime(max(day), '%Y-%m-%d') AS to_date, count(*) AS n_days FROM r GROUP BY index_id, security_id, g""")
def membership_spells(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("index_id"), F.col("user_id").alias("security_id"), F.to_date("ts").alias("day"))
    return pit.spells(e, "index_id", "security_id", "day").withColumns({c: text_day(c) for c in ("from_date", "to_date")})


_TWO = f"""WITH {MEMBERSHIP},
a AS (SELECT index_id, security_id, sum(weight) AS w FROM mb WHERE from_date <= DATE '1997-12-31' AND (to_date IS NULL OR to_date > DATE '1997-12-31') GROUP BY 1, 2),
b AS (SELECT index_id, security_id, sum(weight) AS w FROM mb WHERE from_date <= DATE '1998-12-31' AND (to_date IS NULL OR to_date > DATE '1998-12-31') GROUP BY 1, 2),
p AS (SELECT index_id, security_id, w / sum(w) OVER (PARTITION BY index_id) AS w FROM a), q AS (SELECT index_id, security_id, w / sum(w) OVER (PARTITION BY index_id) AS w FROM b),
x AS (SELECT p.w AS w0, q.w AS w1, coalesce(p.index_id, q.index_id) AS index_id, coalesce(p.security_id, q.security_id) AS security_id FROM p FULL JOIN q ON p.security_id = q.security_id AND p.index_id = q.index_id)
"""


def _two(spark: SparkSession, d: str) -> DataFrame:
    """Weights of every index on two days, each a share of its index."""
    m = membership(spark, d)

    def at(day: str) -> DataFrame:
        g = pit.in_force(m, day, "from_date", "to_date").groupBy("index_id", "security_id").agg(F.sum("weight").alias("w"))
        return g.join(g.groupBy("index_id").agg(F.sum("w").alias("of")), "index_id").select("index_id", "security_id", (F.col("w") / F.col("of")).alias("w"))

    return pit.snapshot_diff(at("1997-12-31"), at("1998-12-31"), ["index_id", "security_id"], "w")


@query(_TWO + """SELECT index_id, round(sum(abs(coalesce(w1, 0) - coalesce(w0, 0))) / 2, 8) AS one_way, round(sum(w1) FILTER (WHERE w0 IS NULL), 8) AS added_weight, round(sum(w0) FILTER (WHERE w1 IS NULL), 8) AS deleted_weight,
round(sum(abs(w1 - w0)), 8) AS drift, count(*) FILTER (WHERE w0 IS NULL) AS n_added, count(*) FILTER (WHERE w1 IS NULL) AS n_deleted FROM x GROUP BY index_id""")
def turnover_between_reviews(spark: SparkSession, d: str) -> DataFrame:
    return pit.turnover(_two(spark, d), ["index_id"]).withColumns({c: F.round(c, 8) for c in ("one_way", "added_weight", "deleted_weight", "drift")})


@query(_TWO + "SELECT index_id, security_id, round(w0, 10) AS w0, round(w1, 10) AS w1, round(coalesce(w1, 0) - coalesce(w0, 0), 10) AS change FROM x")
def reconstitution_diff(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d).withColumns({c: F.round(c, 10) for c in ("w0", "w1", "change")})


@query("""SELECT security_id, listing_id, upper(trim(identifier_value, ' ')) AS identifier_value, count(*) AS n FROM identifiers WHERE identifier_type = 'ticker' AND valid_from <= DATE '2023-06-30' AND (valid_to IS NULL OR valid_to > DATE '2023-06-30') GROUP BY ALL""")
def identifier_as_of(spark: SparkSession, d: str) -> DataFrame:
    i = pit.in_force(table(spark, d, "identifiers").where("identifier_type = 'ticker'"), AS_OF, "valid_from", "valid_to")
    return i.groupBy("security_id", "listing_id", F.upper(F.trim("identifier_value")).alias("identifier_value")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLEAN}, c AS (SELECT listing_id, date, CASE WHEN close = lag(close) OVER w THEN 0 ELSE 1 END AS c FROM cp WINDOW w AS (PARTITION BY listing_id ORDER BY date)),
r AS (SELECT *, sum(c) OVER (PARTITION BY listing_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT listing_id, strftime(min(date), '%Y-%m-%d') AS from_date, strftime(max(date), '%Y-%m-%d') AS to_date, count(*) AS n FROM r GROUP BY listing_id, run HAVING count(*) >= 3""")
def stale_prices(spark: SparkSession, d: str) -> DataFrame:
    return pit.runs(clean_prices(spark, d), "listing_id", "date", F.col("close"), 3).withColumns({c: text_day(c) for c in ("from_date", "to_date")})


@query(f"""WITH {CLEAN} SELECT strftime(date, '%Y-%m-%d') AS day, max(close) FILTER (WHERE currency = 'EUR') AS "EUR", max(close) FILTER (WHERE currency = 'GBP') AS "GBP", max(close) FILTER (WHERE currency = 'USD') AS "USD"
FROM cp JOIN listings USING (listing_id) GROUP BY date""")
def prices_wide(spark: SparkSession, d: str) -> DataFrame:
    """Pivot with declared columns, so no pass over the data is needed to find them."""
    x = clean_prices(spark, d).join(table(spark, d, "listings").select("listing_id", "currency"), "listing_id")
    return x.groupBy("date").pivot("currency", ["EUR", "GBP", "USD"]).agg(F.max("close")).select(text_day("date").alias("day"), "EUR", "GBP", "USD")


@query("""WITH e AS (SELECT event_id, security_id, ex_date FROM corp_actions WHERE ex_date IS NOT NULL),
s AS (SELECT DISTINCT security_id, effective_date FROM shares)
SELECT event_id, strftime(effective_date, '%Y-%m-%d') AS nearest_shares, abs(ex_date - effective_date)::INT AS gap FROM e JOIN s USING (security_id) WHERE abs(ex_date - effective_date) <= 5
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(ex_date - effective_date), effective_date) = 1""")
def nearest_in_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "corp_actions").where("ex_date IS NOT NULL").select("event_id", "security_id", "ex_date")
    s = table(spark, d, "shares").select("security_id", "effective_date").distinct()
    return pit.nearest(e, s, "security_id", "ex_date", "effective_date", "event_id", "effective_date", 5).select("event_id", text_day("effective_date").alias("nearest_shares"), "gap")


@query(f"""WITH {FX}, o AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, r_name AS quote FROM lineitem, region)
SELECT o.quote, strftime(o.date, '%Y-%m-%d') AS day, CASE WHEN o.date - fx.date <= 7 THEN round(fx.rate, 12) END AS rate, (o.date - fx.date)::INT AS age_days, o.date - fx.date > 7 OR fx.date IS NULL AS stale
FROM o ASOF LEFT JOIN fx ON o.quote = fx.quote AND o.date >= fx.date""")
def fx_as_of(spark: SparkSession, d: str) -> DataFrame:
    """As-of rate at most seven days old; older ones are flagged instead of used."""
    days = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    names = table(spark, d, "region").agg(F.collect_set("r_name")).scalar()  # one per region
    days = days.select(F.explode(names).alias("quote"), "date")
    x = pit.carry_forward(days, fx(spark, d), "quote", "date", "rate")
    fresh = F.coalesce(F.col("age_days") <= 7, F.lit(False))
    return x.select("quote", text_day("date").alias("day"), F.when(fresh, F.round("rate", 12)).alias("rate"), "age_days", (~fresh).alias("stale"))


@query("""SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(c_mktsegment) + grouping(o_orderstatus) AS INT) AS level
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)""")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    """Subtotals over a dimension hierarchy (an extension)."""
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = x.select(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"), "o_totalprice").rollup("segment", "status")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), (F.grouping("segment") + F.grouping("status")).cast("int").alias("level"))
