"""Identity, events, quality and text as queries, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import compare, events, pit, text
from ..sources.tables import table
from .common import CLEAN, clean_prices, text_day

QUERIES, SQL = {}, {}
DAY = "2023-06-30"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- identity

_VAL = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"


@query("""WITH v AS (SELECT DISTINCT upper(trim(identifier_value, ' ')) AS v FROM identifiers WHERE identifier_type = 'isin' AND identifier_value IS NOT NULL),
d AS (SELECT v, array_to_string(list_transform(string_split(v[1:11], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), '') AS digits FROM v WHERE regexp_full_match(v, '[A-Z]{2}[A-Z0-9]{9}[0-9]')),
s AS (SELECT v, (10 - list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN (CAST(c AS INT) * 2) // 10 + (CAST(c AS INT) * 2) % 10 ELSE CAST(c AS INT) END)) % 10) % 10 AS digit FROM d)
SELECT v.v AS isin, coalesce(s.digit = CAST(v.v[12] AS INT), FALSE) AS is_valid FROM v LEFT JOIN s USING (v)""")
def isin_validity(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "identifiers").where("identifier_type = 'isin' AND identifier_value IS NOT NULL").select(F.upper(F.trim("identifier_value")).alias("isin")).distinct()
    return v.select("isin", ids.is_isin(F.col("isin")).alias("is_valid"))


@query("""WITH v AS (SELECT DISTINCT upper(trim(identifier_value, ' ')) AS v FROM identifiers WHERE identifier_type = 'sedol' AND identifier_value IS NOT NULL),
s AS (SELECT v, (10 - list_sum(list_transform(string_split(v[1:6], ''), lambda c, i: (CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END) * [1, 3, 1, 7, 3, 9][i])) % 10) % 10 AS digit FROM v WHERE regexp_full_match(v, '[B-DF-HJ-NP-TV-Z0-9]{6}[0-9]'))
SELECT v.v AS sedol, coalesce(s.digit = CAST(v.v[7] AS INT), FALSE) AS is_valid FROM v LEFT JOIN s USING (v)""")
def sedol_validity(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "identifiers").where("identifier_type = 'sedol' AND identifier_value IS NOT NULL").select(F.upper(F.trim("identifier_value")).alias("sedol")).distinct()
    return v.select("sedol", ids.is_sedol(F.col("sedol")).alias("is_valid"))


@query("""WITH r AS (SELECT identifier_value, security_id, valid_from, valid_to, lead(valid_from) OVER (PARTITION BY upper(trim(identifier_value, ' ')) ORDER BY valid_from, security_id, valid_to NULLS LAST) AS n FROM
 (SELECT DISTINCT upper(trim(identifier_value, ' ')) AS identifier_value, security_id, valid_from, CASE WHEN valid_to < DATE '9999-01-01' THEN valid_to END AS valid_to FROM identifiers WHERE identifier_type = 'ticker' AND valid_from IS NOT NULL))
SELECT identifier_value, security_id, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(coalesce(valid_to, n), '%Y-%m-%d') AS valid_to, coalesce(n < coalesce(valid_to, DATE '9999-12-31'), FALSE) AS overlaps FROM r""")
def ticker_mappings_closed(spark: SparkSession, d: str) -> DataFrame:
    """Open mappings closed by the next one of the same ticker; overlapping ones flagged."""
    i = table(spark, d, "identifiers").where("identifier_type = 'ticker' AND valid_from IS NOT NULL")
    r = i.select(F.upper(F.trim("identifier_value")).alias("identifier_value"), "security_id", "valid_from", F.when(F.col("valid_to") < "9999-01-01", F.col("valid_to")).alias("valid_to")).distinct()
    n = F.lead("valid_from").over(Window.partitionBy("identifier_value").orderBy("valid_from", "security_id", F.col("valid_to").asc_nulls_last()))
    r = r.withColumn("n", n)
    return r.select(
        "identifier_value", "security_id", text_day("valid_from").alias("valid_from"), text_day(F.coalesce("valid_to", "n")).alias("valid_to"),
        F.coalesce(F.col("n") < F.coalesce("valid_to", F.lit("9999-12-31").cast("date")), F.lit(False)).alias("overlaps"),
    )


@query("""WITH a AS (SELECT DISTINCT identifier_type, upper(trim(identifier_value, ' ')) AS v, security_id FROM identifiers WHERE valid_from <= DATE '2023-06-30' AND (valid_to IS NULL OR valid_to > DATE '2023-06-30'))
SELECT identifier_type, v AS identifier_value, count(*) AS n_securities, CASE WHEN count(*) = 1 THEN min(security_id) END AS security_id FROM a GROUP BY ALL""")
def identifiers_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Every identifier in force with its security, null where several claim it."""
    a = pit.in_force(table(spark, d, "identifiers"), DAY, "valid_from", "valid_to").select("identifier_type", F.upper(F.trim("identifier_value")).alias("identifier_value"), "security_id").distinct()
    return a.groupBy("identifier_type", "identifier_value").agg(F.count(F.lit(1)).alias("n_securities"), F.min("security_id").alias("s")).select("identifier_type", "identifier_value", "n_securities", F.when(F.col("n_securities") == 1, F.col("s")).alias("security_id"))


@query("""WITH a AS (SELECT security_id, identifier_type, max(upper(trim(identifier_value, ' '))) AS v FROM identifiers WHERE valid_from <= DATE '2023-06-30' AND (valid_to IS NULL OR valid_to > DATE '2023-06-30') GROUP BY ALL)
SELECT security_id, coalesce(max(v) FILTER (WHERE identifier_type = 'sedol'), max(v) FILTER (WHERE identifier_type = 'isin'), max(v) FILTER (WHERE identifier_type = 'ticker')) AS primary_id FROM a GROUP BY security_id""")
def primary_identifier(spark: SparkSession, d: str) -> DataFrame:
    a = pit.in_force(table(spark, d, "identifiers"), DAY, "valid_from", "valid_to").withColumn("v", F.upper(F.trim("identifier_value")))
    best = [F.max(F.when(F.col("identifier_type") == t, F.col("v"))) for t in ("sedol", "isin", "ticker")]
    return a.groupBy("security_id").agg(F.coalesce(*best).alias("primary_id"))


@query("""WITH l AS (SELECT security_id, listing_id, country FROM listings WHERE listing_start <= DATE '2023-06-30' AND (listing_end IS NULL OR listing_end > DATE '2023-06-30'))
SELECT s.security_id, count(l.listing_id) AS n_active, CASE WHEN count(l.listing_id) = 1 THEN min(l.listing_id) WHEN count(l.listing_id) FILTER (WHERE l.country = s.country) = 1 THEN min(l.listing_id) FILTER (WHERE l.country = s.country) END AS picked
FROM securities s LEFT JOIN l USING (security_id) GROUP BY s.security_id""")
def picked_listing(spark: SparkSession, d: str) -> DataFrame:
    """The sole active listing, else the sole one at home, else none: ambiguous."""
    act = pit.in_force(table(spark, d, "listings"), DAY, "listing_start", "listing_end").select("security_id", "listing_id", F.col("country").alias("lc"))
    x = table(spark, d, "securities").select("security_id", "country").join(act, "security_id", "left")
    home = F.col("lc") == F.col("country")
    g = x.groupBy("security_id").agg(F.count("listing_id").alias("n_active"), F.min("listing_id").alias("a"), F.count_if(home).alias("nh"), F.min(F.when(home, F.col("listing_id"))).alias("h"))
    return g.select("security_id", "n_active", F.when(F.col("n_active") == 1, F.col("a")).when(F.col("nh") == 1, F.col("h")).alias("picked"))


@query("""SELECT security_id, issuer_id, count(*) OVER p - 1 AS n_siblings, min(security_id) OVER p AS lead_line FROM (SELECT DISTINCT security_id, issuer_id FROM securities WHERE issuer_id IS NOT NULL AND security_id IS NOT NULL) WINDOW p AS (PARTITION BY issuer_id) QUALIFY count(*) OVER p > 1""")
def sibling_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of an issuer that has several, with the issuer as its class, the number of its siblings and the class's first line; pairs are not written out."""
    s = table(spark, d, "securities").where("issuer_id IS NOT NULL AND security_id IS NOT NULL").select("security_id", "issuer_id").distinct()
    many = s.groupBy("issuer_id").agg(F.count(F.lit(1)).alias("n"), F.min("security_id").alias("lead_line")).where("n > 1")
    return s.join(many, "issuer_id").select("security_id", "issuer_id", (F.col("n") - 1).alias("n_siblings"), "lead_line")


@query("""SELECT issuer_id, count(*) AS n, min(security_id) AS first_line, max(security_id) AS last_line FROM securities WHERE issuer_id IS NOT NULL GROUP BY issuer_id HAVING count(*) > 1""")
def multiline_issuers(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "securities").where("issuer_id IS NOT NULL").groupBy("issuer_id").agg(F.count(F.lit(1)).alias("n"), F.min("security_id").alias("first_line"), F.max("security_id").alias("last_line"))
    return g.where("n > 1")


@query("""SELECT l.listing_id, s.security_id, s.issuer_id, l.mic, s.icb_industry FROM listings l JOIN securities s USING (security_id)
WHERE l.listing_start <= DATE '2023-06-30' AND (l.listing_end IS NULL OR l.listing_end > DATE '2023-06-30') AND s.listing_start <= DATE '2023-06-30' AND (s.listing_end IS NULL OR s.listing_end > DATE '2023-06-30')""")
def master_snapshot(spark: SparkSession, d: str) -> DataFrame:
    at = lambda t: pit.in_force(table(spark, d, t), DAY, "listing_start", "listing_end")
    return at("listings").select("listing_id", "security_id", "mic").join(at("securities").select("security_id", "issuer_id", "icb_industry"), "security_id").select("listing_id", "security_id", "issuer_id", "mic", "icb_industry")


@query("""SELECT 'listing_without_security' AS finding, listing_id AS key FROM listings l WHERE NOT EXISTS (SELECT 1 FROM securities s WHERE s.security_id = l.security_id)
UNION ALL SELECT 'security_without_listing', security_id FROM securities s WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.security_id = s.security_id)
UNION ALL SELECT 'no_industry', security_id FROM securities WHERE icb_industry IS NULL
UNION ALL SELECT 'limit_out_of_range', security_id FROM securities WHERE foreign_ownership_limit < 0 OR foreign_ownership_limit > 1
UNION ALL SELECT 'ends_before_start', listing_id FROM listings WHERE listing_end <= listing_start
UNION ALL SELECT DISTINCT 'identifier_of_unknown_security', security_id FROM identifiers i WHERE NOT EXISTS (SELECT 1 FROM securities s WHERE s.security_id = i.security_id)""")
def master_findings(spark: SparkSession, d: str) -> DataFrame:
    s, l, i = (table(spark, d, t) for t in ("securities", "listings", "identifiers"))
    one = lambda df, name, key: df.select(F.lit(name).alias("finding"), F.col(key).alias("key"))
    parts = [
        one(l.join(s, "security_id", "left_anti"), "listing_without_security", "listing_id"), one(s.join(l, "security_id", "left_anti"), "security_without_listing", "security_id"),
        one(s.where("icb_industry IS NULL"), "no_industry", "security_id"), one(s.where("foreign_ownership_limit < 0 OR foreign_ownership_limit > 1"), "limit_out_of_range", "security_id"),
        one(l.where("listing_end <= listing_start"), "ends_before_start", "listing_id"), one(i.join(s, "security_id", "left_anti").select("security_id").distinct(), "identifier_of_unknown_security", "security_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


# -- events


@query("""SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(payload, '$.amount') AS DOUBLE)), 6) AS mean_amount, round(avg(CAST(json_extract_string(payload, '$.ratio') AS DOUBLE)), 6) AS mean_ratio,
CAST(CASE event_type WHEN 'CASH_DIVIDEND' THEN 10 WHEN 'SPECIAL_DIVIDEND' THEN 11 WHEN 'RETURN_OF_CAPITAL' THEN 12 WHEN 'SPLIT' THEN 20 WHEN 'REVERSE_SPLIT' THEN 20 WHEN 'BONUS_ISSUE' THEN 21 WHEN 'RIGHTS_ISSUE' THEN 30 WHEN 'SPINOFF' THEN 40 WHEN 'FLOAT_CHANGE' THEN 51 WHEN 'MERGER_STOCK' THEN 60 WHEN 'MERGER_CASH' THEN 61 WHEN 'DELISTING' THEN 62 ELSE 50 END AS INT) AS apply_order FROM corp_actions WHERE ex_date IS NOT NULL AND event_type IN ('SPLIT', 'REVERSE_SPLIT', 'CASH_DIVIDEND', 'SPECIAL_DIVIDEND', 'FLOAT_CHANGE') GROUP BY event_type""")
def events_parsed(spark: SparkSession, d: str) -> DataFrame:
    e = events.parse(table(spark, d, "corp_actions")).where("reason IS NULL")
    return e.groupBy("event_type", "apply_order").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p.amount"), 6).alias("mean_amount"), F.round(F.avg("p.ratio"), 6).alias("mean_ratio"))


@query("""WITH j AS (SELECT event_type, ex_date, json_valid(payload) AS valid, TRY_CAST(payload AS JSON) AS p FROM corp_actions),
f AS (SELECT *, TRY_CAST(p->>'amount' AS DOUBLE) AS amount, p->>'currency' AS currency, TRY_CAST(p->>'ratio' AS DOUBLE) AS ratio, TRY_CAST(p->>'new_float' AS DOUBLE) AS new_float, TRY_CAST(p->>'old_float' AS DOUBLE) AS old_float FROM j)
SELECT CASE WHEN event_type IS NULL OR event_type NOT IN ('CASH_DIVIDEND', 'SPECIAL_DIVIDEND', 'RETURN_OF_CAPITAL', 'SPLIT', 'REVERSE_SPLIT', 'BONUS_ISSUE', 'RIGHTS_ISSUE', 'SPINOFF', 'SHARES_CHANGE', 'FLOAT_CHANGE', 'MERGER_STOCK', 'MERGER_CASH', 'DELISTING') THEN 'unknown_type'
WHEN valid IS NOT TRUE THEN 'bad_json' WHEN ex_date IS NULL THEN 'no_ex_date'
WHEN event_type IN ('CASH_DIVIDEND', 'SPECIAL_DIVIDEND', 'RETURN_OF_CAPITAL') AND amount IS NULL THEN 'missing:amount' WHEN event_type IN ('CASH_DIVIDEND', 'SPECIAL_DIVIDEND', 'RETURN_OF_CAPITAL') AND currency IS NULL THEN 'missing:currency'
WHEN event_type IN ('SPLIT', 'REVERSE_SPLIT', 'BONUS_ISSUE') AND ratio IS NULL THEN 'missing:ratio' WHEN event_type = 'FLOAT_CHANGE' AND new_float IS NULL THEN 'missing:new_float' WHEN event_type = 'FLOAT_CHANGE' AND old_float IS NULL THEN 'missing:old_float'
WHEN event_type IN ('CASH_DIVIDEND', 'SPECIAL_DIVIDEND', 'RETURN_OF_CAPITAL') AND amount <= 0 THEN 'not_positive:amount' WHEN event_type IN ('SPLIT', 'REVERSE_SPLIT', 'BONUS_ISSUE') AND ratio <= 0 THEN 'not_positive:ratio'
ELSE 'ok' END AS reason, event_type, count(*) AS n FROM f GROUP BY ALL""")
def events_quarantined(spark: SparkSession, d: str) -> DataFrame:
    return events.parse(table(spark, d, "corp_actions")).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLEAN}, s AS (SELECT security_id, date, max(close) AS close FROM cp GROUP BY ALL), e AS (SELECT event_id, security_id, ex_date, CAST(json_extract_string(payload, '$.amount') AS DOUBLE) AS amount FROM corp_actions WHERE event_type = 'SPECIAL_DIVIDEND' AND ex_date IS NOT NULL)
SELECT e.event_id, amount, s.close AS cum_price, CASE WHEN amount > 0.05 * s.close THEN 'RETURN_OF_CAPITAL' ELSE 'SPECIAL_DIVIDEND' END AS kind FROM e ASOF LEFT JOIN s ON e.security_id = s.security_id AND e.ex_date > s.date""")
def special_dividends(spark: SparkSession, d: str) -> DataFrame:
    e = events.parse(table(spark, d, "corp_actions")).where("reason IS NULL AND event_type = 'SPECIAL_DIVIDEND'")
    p = clean_prices(spark, d).groupBy("security_id", "date").agg(F.max("close").alias("close"))
    return events.special_as_capital(e, p).select("event_id", "amount", "cum_price", "kind")


@query(f"""WITH {CLEAN}, s AS (SELECT security_id, date, max(close) AS close FROM cp GROUP BY ALL), e AS (SELECT event_id, event_type, security_id, ex_date, CAST(payload->>'amount' AS DOUBLE) AS amount, CAST(payload->>'ratio' AS DOUBLE) AS ratio, CAST(payload->>'new_float' AS DOUBLE) AS nf FROM corp_actions WHERE ex_date IS NOT NULL AND security_id IS NOT NULL AND event_type IN ('CASH_DIVIDEND', 'SPECIAL_DIVIDEND', 'RETURN_OF_CAPITAL', 'SPLIT', 'REVERSE_SPLIT', 'BONUS_ISSUE', 'FLOAT_CHANGE')),
x AS (SELECT e.*, s.close FROM e ASOF LEFT JOIN s ON e.security_id = s.security_id AND e.ex_date > s.date),
y AS (SELECT *, CASE WHEN ratio IS NOT NULL THEN close / ratio WHEN amount IS NOT NULL THEN greatest(close - amount, 0) ELSE close END AS price_after, coalesce(ratio, 1) AS shares_after, coalesce(nf, 1) AS float_after FROM x)
SELECT event_id, event_type, strftime(ex_date, '%Y-%m-%d') AS ex_date, close, round(CASE WHEN close IS NOT NULL THEN price_after END, 6) AS price_after, shares_after, float_after, round(CASE WHEN close IS NOT NULL THEN price_after * shares_after / nullif(close, 0) END, 8) AS value_factor FROM y""")
def event_effects(spark: SparkSession, d: str) -> DataFrame:
    """What every event that can be built does to price, shares and float of one share held."""
    e = events.parse(table(spark, d, "corp_actions")).where("reason IS NULL AND security_id IS NOT NULL")
    p = clean_prices(spark, d).where("security_id IS NOT NULL").groupBy("security_id", "date").agg(F.max("close").alias("close"))
    x = events.effects(events.cum_prices(e, p))
    return x.select("event_id", "event_type", text_day("ex_date").alias("ex_date"), "close", F.round("price_after", 6).alias("price_after"), "shares_after", "float_after", F.round("value_factor", 8).alias("value_factor"))


# -- quality


@query("""SELECT listing_id, strftime(date, '%Y-%m-%d') AS day, count(*) AS copies FROM prices GROUP BY ALL HAVING count(*) > 1""")
def duplicate_prices(spark: SparkSession, d: str) -> DataFrame:
    return compare.duplicates(table(spark, d, "prices").select("listing_id", text_day("date").alias("day")), ["listing_id", "day"])


_FINDINGS = """WITH f(rule, severity, n_bad, n_rows) AS (
SELECT 'no_null_close', 'BLOCK', count(*) FILTER (WHERE close IS NULL), count(*) FROM prices
UNION ALL SELECT 'positive_close', 'BLOCK', count(*) FILTER (WHERE NOT (close > 0 AND isfinite(close)) AND close IS NOT NULL), count(*) FROM prices
UNION ALL SELECT 'ohlc_consistent', 'WARN', count(*) FILTER (WHERE high < low OR close > high * 1.0001 OR close < low * 0.9999), count(*) FROM prices
UNION ALL SELECT 'float_in_range', 'BLOCK', count(*) FILTER (WHERE free_float_factor < 0 OR free_float_factor > 1), count(*) FROM shares
UNION ALL SELECT 'shares_plausible', 'BLOCK', count(*) FILTER (WHERE shares_outstanding <= 0 OR NOT isfinite(shares_outstanding)), count(*) FROM shares
UNION ALL SELECT 'volume_not_negative', 'ESCALATE', count(*) FILTER (WHERE volume < 0), count(*) FROM prices
UNION ALL SELECT 'currency_given', 'WARN', count(*) FILTER (WHERE currency IS NULL), count(*) FROM prices
UNION ALL SELECT 'listing_given', 'BLOCK', count(*) FILTER (WHERE listing_id IS NULL OR security_id IS NULL), count(*) FROM prices
UNION ALL SELECT 'paused_days_do_not_trade', 'WARN', count(*) FILTER (WHERE is_suspended AND volume > 0), count(*) FROM prices
UNION ALL SELECT 'known_day_given', 'WARN', count(*) FILTER (WHERE knowledge_date IS NULL), count(*) FROM shares
UNION ALL SELECT 'limit_in_range', 'WARN', count(*) FILTER (WHERE foreign_ownership_limit < 0 OR foreign_ownership_limit > 1), count(*) FROM shares
UNION ALL SELECT 'filed_after_period', 'WARN', count(*) FILTER (WHERE filed_date < period_end), count(*) FROM fundamentals
UNION ALL SELECT 'value_given', 'WARN', count(*) FILTER (WHERE value IS NULL), count(*) FROM fundamentals
UNION ALL SELECT 'weight_not_negative', 'BLOCK', count(*) FILTER (WHERE weight < -1e-12), count(*) FROM capacity
UNION ALL SELECT 'weight_under_limit', 'WARN', count(*) FILTER (WHERE weight > 0.15), count(*) FROM capacity
UNION ALL SELECT 'adv_not_negative', 'BLOCK', count(*) FILTER (WHERE adv < 0), count(*) FROM capacity
UNION ALL SELECT 'interval_in_order', 'WARN', count(*) FILTER (WHERE valid_to <= valid_from), count(*) FROM identifiers)
"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    good = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf"))
    either = lambda *cs: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs])
    of_prices = [
        ("no_null_close", "BLOCK", F.col("close").isNull()), ("positive_close", "BLOCK", F.col("close").isNotNull() & ~good("close")),
        ("ohlc_consistent", "WARN", either(F.col("high") < F.col("low"), F.col("close") > F.col("high") * 1.0001, F.col("close") < F.col("low") * 0.9999)), ("volume_not_negative", "ESCALATE", F.col("volume") < 0),
        ("currency_given", "WARN", F.col("currency").isNull()), ("listing_given", "BLOCK", F.col("listing_id").isNull() | F.col("security_id").isNull()), ("paused_days_do_not_trade", "WARN", F.col("is_suspended") & (F.col("volume") > 0)),
    ]
    of_shares = [
        ("float_in_range", "BLOCK", (F.col("free_float_factor") < 0) | (F.col("free_float_factor") > 1)), ("shares_plausible", "BLOCK", F.col("shares_outstanding").isNotNull() & ~good("shares_outstanding")),
        ("known_day_given", "WARN", F.col("knowledge_date").isNull()), ("limit_in_range", "WARN", (F.col("foreign_ownership_limit") < 0) | (F.col("foreign_ownership_limit") > 1)),
    ]
    of_filings = [("filed_after_period", "WARN", F.col("filed_date") < F.col("period_end")), ("value_given", "WARN", F.col("value").isNull())]
    of_weights = [("weight_not_negative", "BLOCK", F.col("weight") < -1e-12), ("weight_under_limit", "WARN", F.col("weight") > 0.15), ("adv_not_negative", "BLOCK", F.col("adv") < 0)]
    of_identifiers = [("interval_in_order", "WARN", F.col("valid_to") <= F.col("valid_from"))]
    tables = [
        ("prices", of_prices, F.concat_ws("@", "listing_id", F.col("date").cast("string"))), ("shares", of_shares, F.col("security_id")), ("fundamentals", of_filings, F.col("security_id")),
        ("capacity", of_weights, F.concat_ws("@", "listing_id", F.col("as_of").cast("string"))), ("identifiers", of_identifiers, F.col("security_id")),
    ]
    return reduce(DataFrame.unionByName, [compare.guarded(t, lambda t=t, r=r, k=k: compare.findings(table(spark, d, t), r, k), spark) for t, r, k in tables])


@query(_FINDINGS + "SELECT rule, severity, n_bad = 0 AS passed, n_bad, n_rows FROM f")
def quality_findings(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).drop("sample")


@query(_FINDINGS + """SELECT CASE max(CASE WHEN n_bad > 0 THEN CASE severity WHEN 'WARN' THEN 20 WHEN 'BLOCK' THEN 30 ELSE 40 END END) WHEN 20 THEN 'WARN' WHEN 30 THEN 'BLOCK' WHEN 40 THEN 'ESCALATE' ELSE 'OK' END AS decision,
count(*) AS n_rules, count(*) FILTER (WHERE n_bad > 0) AS n_failed FROM f""")
def publication_gate(spark: SparkSession, d: str) -> DataFrame:
    return compare.gate(_findings(spark, d), {"WARN": 20, "BLOCK": 30, "ESCALATE": 40})


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, median(abs(l_extendedprice - m)) AS s FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey, round(abs(l_extendedprice - m) / nullif(1.4826 * s, 0), 6) AS robust_z FROM lineitem JOIN m USING (l_suppkey) JOIN s USING (l_suppkey) WHERE abs(l_extendedprice - m) / nullif(1.4826 * s, 0) > 1.4""")
def robust_outliers(spark: SparkSession, d: str) -> DataFrame:
    x = compare.robust_outliers(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", 1.4)
    return x.select("l_orderkey", "l_linenumber", "l_suppkey", F.round("robust_z", 6).alias("robust_z"))


@query("""WITH o AS (SELECT security_id, shares_outstanding AS w FROM shares WHERE effective_date <= DATE '2022-12-31' AND shares_outstanding > 0 QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC, knowledge_date DESC NULLS LAST, shares_outstanding DESC) = 1),
t AS (SELECT security_id, shares_outstanding AS w FROM shares WHERE effective_date <= DATE '2023-12-31' AND shares_outstanding > 0 QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC, knowledge_date DESC NULLS LAST, shares_outstanding DESC) = 1),
x AS (SELECT coalesce(o.security_id, t.security_id) AS security_id, o.w / (SELECT sum(w) FROM o) AS ours, t.w / (SELECT sum(w) FROM t) AS theirs FROM o FULL JOIN t ON o.security_id = t.security_id)
SELECT security_id, round(ours, 10) AS ours, round(theirs, 10) AS theirs, round(coalesce(ours, 0) - coalesce(theirs, 0), 10) AS difference, CASE WHEN ours IS NULL THEN 'only_theirs' WHEN theirs IS NULL THEN 'only_ours' WHEN abs(coalesce(ours, 0) - coalesce(theirs, 0)) > 0.0001 THEN 'weight_differs' ELSE 'match' END AS category FROM x""")
def constituents_reconciled(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "shares").where("shares_outstanding > 0")
    at = lambda day: pit.latest_by(s.where(F.col("effective_date") <= day), ["security_id"], ["effective_date", "knowledge_date", "shares_outstanding"], ["shares_outstanding"])
    x = compare.reconcile(at("2022-12-31"), at("2023-12-31"), "security_id", "shares_outstanding", 1e-4)
    return x.withColumns({c: F.round(c, 10) for c in ("ours", "theirs", "difference")})


@query(f"""WITH {CLEAN}, g AS (SELECT date, sum(close) AS level FROM cp GROUP BY date), c AS (SELECT date, level * CASE WHEN date >= DATE '2024-01-01' THEN 1.00005 ELSE 1 END AS level FROM g WHERE date <> (SELECT max(date) FROM g))
SELECT strftime(coalesce(g.date, c.date), '%Y-%m-%d') AS day, CASE WHEN g.date IS NULL THEN 'extra' WHEN c.date IS NULL THEN 'missing' ELSE 'both' END AS status, round(abs(c.level / g.level - 1) * 10000, 6) AS worst_bps FROM g FULL JOIN c ON g.date = c.date""")
def runs_compared(spark: SparkSession, d: str) -> DataFrame:
    """A golden run against one with a seeded drift and a lost day."""
    g = clean_prices(spark, d).groupBy("date").agg(F.sum("close").alias("level"))
    c = g.where(F.col("date") != g.agg(F.max("date")).scalar()).withColumn("level", F.col("level") * F.when(F.col("date") >= "2024-01-01", 1.00005).otherwise(1.0))
    return compare.compare_runs(g, c, "date", ["level"]).select(text_day("date").alias("day"), "status", F.round("worst_bps", 6).alias("worst_bps"))


@query(None)
def table_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Order-insensitive content hashes of the canonical tables."""
    names = ["prices", "shares", "fundamentals", "corp_actions", "securities", "listings", "identifiers"]
    return reduce(DataFrame.unionByName, [compare.content_hash(table(spark, d, t)).withColumn("name", F.lit(t)) for t in names])


@query(f"""WITH {CLEAN}, r AS (SELECT listing_id, date, close, close / lag(close) OVER (PARTITION BY listing_id ORDER BY date) - 1 AS ret FROM cp)
SELECT listing_id, strftime(arg_max(date, (ret, date)), '%Y-%m-%d') AS best_day, strftime(arg_min(date, (ret, date)), '%Y-%m-%d') AS worst_day, count(*) AS n FROM r WHERE ret IS NOT NULL GROUP BY listing_id""")
def notable_days(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("listing_id").orderBy("date")
    r = clean_prices(spark, d).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where("ret IS NOT NULL")
    s = F.struct("ret", "date")
    return r.groupBy("listing_id").agg(text_day(F.max_by("date", s)).alias("best_day"), text_day(F.min_by("date", s)).alias("worst_day"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT ex_date AS day, count(*) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM corp_actions WHERE ex_date IS NOT NULL GROUP BY 1),
l AS (SELECT DISTINCT date AS day FROM prices WHERE date IS NOT NULL)
SELECT strftime(l.day, '%Y-%m-%d') AS day, coalesce(n_events, 0) AS n_events, first_event, last_event, types FROM l LEFT JOIN a USING (day)""")
def days_frame(spark: SparkSession, d: str) -> DataFrame:
    """Every session with its events' aggregates."""
    a = table(spark, d, "corp_actions").groupBy(F.col("ex_date").alias("day")).agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))
    l = table(spark, d, "prices").select(F.col("date").alias("day")).where("day IS NOT NULL").distinct()
    return l.join(a, "day", "left").select(text_day("day").alias("day"), F.coalesce("n_events", F.lit(0).cast("bigint")).alias("n_events"), "first_event", "last_event", "types")


# -- text

_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"
_TOK = f"tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9'']+)', 1), lambda w: w NOT IN {_STOP}) AS t FROM documents)"


@query(f"""WITH {_TOK} SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_terms FROM tk""")
def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


@query(f"""WITH {_TOK}, x AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM tk) SELECT term, count(*) AS df FROM x GROUP BY term""")
def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return text.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::INT AS n FROM documents), c AS (SELECT doc_id, n, greatest(1, ceil((n - 40) / 180.0))::INT AS k FROM w WHERE n > 0),
f AS (SELECT doc_id, n, CASE WHEN k > 1 AND n - (k - 1) * 180 - 40 < 20 THEN k - 1 ELSE k END AS k FROM c), x AS (SELECT doc_id, n, k, unnest(range(k))::INT AS chunk FROM f)
SELECT x.doc_id, chunk, (chunk * 180)::INT AS first_word, (CASE WHEN chunk = k - 1 THEN n - chunk * 180 ELSE 220 END)::INT AS n_words,
md5(array_to_string(list_slice(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), chunk * 180 + 1, chunk * 180 + CASE WHEN chunk = k - 1 THEN n - chunk * 180 ELSE 220 END), ' ')) AS body_hash FROM x JOIN documents USING (doc_id)""")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = text.chunks(table(spark, d, "documents"), "doc_id", "text")
    return x.withColumn("body_hash", F.md5("body")).drop("body")


_QUERIES = "(VALUES (1, 'How is the divisor adjusted after a special dividend?'), (2, 'free float change after a block sale'), (3, 'stale price check stopped the run'), (4, 'momentum twelve months before the last one')) q(query, question)"


@query(f"""WITH {_TOK}, qs AS (SELECT query, unnest(list_distinct(list_filter(regexp_extract_all(lower(question), '([a-z0-9'']+)', 1), lambda w: w NOT IN {_STOP}))) AS term FROM {_QUERIES}),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY ALL), l AS (SELECT doc_id, len(t) AS length FROM tk), s AS (SELECT count(*) AS n, avg(length) AS mean FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT qs.query, p.doc_id, sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.length / s.mean))) AS score FROM qs JOIN p USING (term) JOIN f USING (term) JOIN l ON l.doc_id = p.doc_id, s GROUP BY ALL)
SELECT CAST(query AS INT) AS query, doc_id AS doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM r QUALIFY rank <= 10""")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    q = spark.sql(f"SELECT CAST(query AS INT) AS query, question FROM {_QUERIES}")
    x = text.bm25(table(spark, d, "documents"), q, key="doc_id", text="text", query_key="query", query_text="question", top=10)
    return x.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(None)
def pages_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of every document's text without markup."""
    x = table(spark, d, "documents").select("doc_id", text.page_text(F.col("text")).alias("plain"))
    return x.select("doc_id", F.length("plain").alias("n_chars"), F.sha2("plain", 256).alias("digest"))


@query(None)
def document_numbers(spark: SparkSession, d: str) -> DataFrame:
    """How many different numbers a text states, and how many a fact pack of the first ten integers does not cover."""
    n = text.numbers(F.col("text"))
    allowed = F.array(*[F.lit(str(i)) for i in range(11)])
    return table(spark, d, "documents").select("doc_id", F.size(n).alias("n_numbers"), F.size(text.unsupported_numbers(F.col("text"), allowed)).alias("n_unsupported"))
