"""A divisor index over the test tables as queries, with their SQL twins.

The queries fold changes of value (see ``operators.index``); the twins follow the definition: every
member on every day with its carried price, its units and the rate of its currency.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators import index
from ..operators.asof import as_known
from ..sources.tables import table
from .common import CLEAN, FX, clean_prices, fx, text_day

#: Which rate of the order-based rate table stands for a currency; the base currency has rate 1.
QUOTES = {"GBP": "EUROPE", "EUR": "EUROPE", "SEK": "EUROPE", "CHF": "MIDDLE EAST", "JPY": "ASIA", "KRW": "ASIA", "HKD": "ASIA", "AUD": "AFRICA", "BRL": "AMERICA", "CAD": "AMERICA"}
BASE = "USD"
#: Days on which holdings are set: third Fridays of the last months of quarters.
REVIEWS = [next(d for d in (dt.date(y, m, 15) + dt.timedelta(i) for i in range(7)) if d.weekday() == 4) for y in (2022, 2023, 2024) for m in (3, 6, 9, 12)]
#: The day whose state the daily roll starts from.
ROLL = "2023-12-29"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per currency and day: the order-based table 27 years on."""
    x = fx(spark, d).select(F.add_months("date", 324).alias("day"), "quote", "rate")
    of = F.array(*[F.struct(F.lit(c).alias("currency"), F.lit(q).alias("q")) for c, q in QUOTES.items()])
    x = x.withColumn("c", F.explode(F.filter(of, lambda c: c["q"] == F.col("quote")))).select(F.col("c.currency").alias("currency"), "day", "rate")
    return x.unionByName(x.select("day").distinct().select(F.lit(BASE).alias("currency"), "day", F.lit(1.0).alias("rate")))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings").where("listing_id IS NOT NULL AND security_id IS NOT NULL").select(F.col("listing_id").alias("id"), "security_id", "currency", "listing_end")


def _holdings(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    """Shares x free float of every member on every review day: the latest record then in force and known."""
    s = table(spark, d, "shares").where("shares_outstanding > 0 AND free_float_factor > 0 AND free_float_factor <= 1")
    asked = members.select("security_id").distinct().withColumn("review", F.explode(F.array(*[F.lit(x) for x in REVIEWS])))
    known = as_known(asked, s, entity=["security_id"], event_time="review", order=["effective_date", "knowledge_date"], clocks={"r": F.greatest("effective_date", "knowledge_date")})
    one = s.groupBy("security_id", "effective_date", "knowledge_date").agg(F.max(F.col("shares_outstanding") * F.col("free_float_factor")).alias("holding"))
    h = known.select("security_id", "review", F.col("r.effective_date").alias("effective_date"), F.col("r.knowledge_date").alias("knowledge_date")).join(one, ["security_id", "effective_date", "knowledge_date"], "left")
    listed = F.col("listing_end").isNull() | (F.col("listing_end") >= F.col("review"))
    return members.join(h, "security_id").select("id", F.col("review").alias("day"), F.when(listed, F.col("holding")).alias("holding"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    amount = F.col("p.amount")
    kind = F.col("event_type")
    a = table(spark, d, "corp_actions").where("ex_date IS NOT NULL").withColumn("p", F.from_json("payload", "amount double, ratio double"))
    a = a.where(kind.isin("SPLIT", "REVERSE_SPLIT", "CASH_DIVIDEND", "SPECIAL_DIVIDEND")).select(
        "security_id", F.col("ex_date").alias("day"), F.when(kind.isin("SPLIT", "REVERSE_SPLIT"), F.col("p.ratio")).alias("ratio"), F.when(kind == "SPECIAL_DIVIDEND", amount).alias("special"), F.when(kind == "CASH_DIVIDEND", amount).alias("cash")
    )
    return index.event_rows(
        prices=clean_prices(spark, d).select(F.col("listing_id").alias("id"), F.col("date").alias("day"), "close"),
        actions=a.join(m.select("id", "security_id"), "security_id"),
        reviews=_holdings(spark, d, m),
        ends=m.where("listing_end IS NOT NULL").select("id", F.date_add("listing_end", 1).alias("day")),
    )


def _levels(spark: SparkSession, d: str, rows: DataFrame, base: index.Base | None = None) -> DataFrame:
    values = index.daily_values(index.timelines(rows), _members(spark, d).select("id", "currency"), _rates(spark, d), [BASE, *QUOTES])
    return index.index_levels(values, base)


def index_levels(spark: SparkSession, d: str) -> DataFrame:
    """Price and total return levels and the divisor of the index of all listings on every day on which something happened."""
    x = _levels(spark, d, _rows(spark, d))
    return x.select(text_day("day").alias("day"), F.round("price_level", 4).alias("price_level"), F.round("total_level", 4).alias("total_level"), F.round(F.col("divisor") / 1e3, 2).alias("divisor_thousands"))


def divisor_events(spark: SparkSession, d: str) -> DataFrame:
    """Every day on which the divisor was rebased."""
    x = index.divisor_changes(_levels(spark, d, _rows(spark, d)))
    return x.select(text_day("day").alias("day"), F.round(F.col("divisor_after") / F.col("divisor_before"), 8).alias("divisor_ratio"), F.round(F.col("value_after") / F.col("value_before"), 8).alias("value_ratio"), F.round("avoided_move", 6).alias("avoided_move"))


def daily_roll(spark: SparkSession, d: str) -> DataFrame:
    """Levels after a day rolled on from the stored state of that day: one row per member and the two levels, without the history before."""
    rows, day = _rows(spark, d), F.lit(ROLL).cast("date")
    past = rows.where(F.col("day") <= day)
    state = cut(index.index_state(index.timelines(past), ROLL))
    last = _levels(spark, d, past).orderBy(F.desc("day")).limit(1).first()  # one row of levels
    if last is None:
        return index_levels(spark, d).select("day", "price_level", "total_level").limit(0)
    members = index.event_rows(state=state)
    x = _levels(spark, d, rows.where(F.col("day") > day).unionByName(members), index.Base(last["price_level"], last["total_level"]))
    return x.where(F.col("day") > day).select(text_day("day").alias("day"), F.round("price_level", 4).alias("price_level"), F.round("total_level", 4).alias("total_level"))


_REVIEWS = ", ".join(f"(DATE '{x}')" for x in REVIEWS)
_QUOTES = ", ".join(f"('{c}', '{q}')" for c, q in QUOTES.items())
_LEVELS = f"""WITH {CLEAN}, {FX}, q(currency, quote) AS (VALUES {_QUOTES}), rv(day) AS (VALUES {_REVIEWS}),
rates AS (SELECT q.currency, (fx.date + INTERVAL 27 YEAR)::DATE AS day, max(rate) AS rate FROM fx JOIN q USING (quote) GROUP BY ALL UNION ALL SELECT DISTINCT '{BASE}', (date + INTERVAL 27 YEAR)::DATE, 1.0 FROM fx),
l AS (SELECT listing_id, security_id, currency, listing_end FROM listings WHERE listing_id IS NOT NULL AND security_id IS NOT NULL AND (currency = '{BASE}' OR currency IN (SELECT currency FROM q))),
ca AS (SELECT l.listing_id, c.ex_date AS day, coalesce(sum(ln(CASE WHEN event_type IN ('SPLIT', 'REVERSE_SPLIT') THEN (payload->>'ratio')::DOUBLE END)), 0) AS lr,
  coalesce(sum(CASE WHEN event_type = 'SPECIAL_DIVIDEND' THEN (payload->>'amount')::DOUBLE END), 0) AS special, coalesce(sum(CASE WHEN event_type = 'CASH_DIVIDEND' THEN (payload->>'amount')::DOUBLE END), 0) AS cash
  FROM corp_actions c JOIN l USING (security_id) WHERE c.ex_date IS NOT NULL AND event_type IN ('SPLIT', 'REVERSE_SPLIT', 'CASH_DIVIDEND', 'SPECIAL_DIVIDEND') GROUP BY ALL),
sh AS (SELECT security_id, effective_date, knowledge_date, max(shares_outstanding * free_float_factor) AS h FROM shares WHERE shares_outstanding > 0 AND free_float_factor > 0 AND free_float_factor <= 1 AND effective_date IS NOT NULL AND knowledge_date IS NOT NULL GROUP BY ALL),
hold AS (SELECT l.listing_id, rv.day, CASE WHEN l.listing_end IS NULL OR l.listing_end >= rv.day THEN arg_max(sh.h, (sh.effective_date, sh.knowledge_date)) END AS h
  FROM l CROSS JOIN rv LEFT JOIN sh ON sh.security_id = l.security_id AND sh.effective_date <= rv.day AND sh.knowledge_date <= rv.day GROUP BY l.listing_id, rv.day, l.listing_end),
pr AS (SELECT cp.* FROM cp JOIN l USING (listing_id)),
days AS (SELECT DISTINCT day FROM (SELECT date AS day FROM pr UNION ALL SELECT day FROM ca UNION ALL SELECT day FROM rv UNION ALL SELECT listing_end + 1 FROM l WHERE listing_end IS NOT NULL)),
dense AS (SELECT l.listing_id, l.currency, d.day, pr.close, coalesce(ca.lr, 0) AS lr, coalesce(ca.special, 0) AS special, coalesce(ca.cash, 0) AS cash, hold.h, hold.day IS NOT NULL AS review, coalesce(l.listing_end + 1 = d.day, FALSE) AS leaves
  FROM l CROSS JOIN days d LEFT JOIN pr ON pr.listing_id = l.listing_id AND pr.date = d.day LEFT JOIN ca ON ca.listing_id = l.listing_id AND ca.day = d.day LEFT JOIN hold ON hold.listing_id = l.listing_id AND hold.day = d.day),
a AS (SELECT *, sum(lr) OVER w AS lf FROM dense WINDOW w AS (PARTITION BY listing_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
a2 AS (SELECT *, sum(special * exp(lf - lr)) OVER w AS paid FROM a WINDOW w AS (PARTITION BY listing_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN last_value(close IGNORE NULLS) OVER w IS NOT NULL THEN greatest(last_value(close * exp(lf) + paid IGNORE NULLS) OVER w - paid, 0) END AS p FROM a2 WINDOW w AS (PARTITION BY listing_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, lag(p) OVER w AS pb FROM b WINDOW w AS (PARTITION BY listing_id ORDER BY day)),
e AS (SELECT *, coalesce(last_value(CASE WHEN leaves THEN 0 WHEN review AND h > 0 AND pb IS NOT NULL THEN h / exp(lf) WHEN review THEN 0 END IGNORE NULLS) OVER w, 0) AS u FROM c WINDOW w AS (PARTITION BY listing_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, lag(u) OVER w AS ub FROM e WINDOW w AS (PARTITION BY listing_id ORDER BY day)),
r AS (SELECT d.currency, d.day, rates.rate FROM (SELECT DISTINCT currency, day FROM f) d ASOF LEFT JOIN rates ON rates.currency = d.currency AND rates.day <= d.day),
rr AS (SELECT *, coalesce(lag(rate) OVER (PARTITION BY currency ORDER BY day), rate) AS rb FROM r),
v AS (SELECT f.day, coalesce(sum(p * u * rate), 0) AS mv, coalesce(sum(pb * ub * rb), 0) AS held, coalesce(sum(greatest(pb - special * exp(lf - lr), 0) * u * rb) FILTER (WHERE pb IS NOT NULL), 0) AS opened, coalesce(sum(cash * exp(lf - lr) * u * rate), 0) AS income,
  count(*) FILTER (WHERE abs(coalesce(greatest(pb - special * exp(lf - lr), 0) * u, 0) - coalesce(pb * ub, 0)) > 1e-9 AND pb IS NOT NULL) AS changes FROM f JOIN rr ON rr.currency = f.currency AND rr.day = f.day GROUP BY f.day),
m AS (SELECT *, row_number() OVER (ORDER BY day) = 1 AS first FROM v WHERE mv > 0),
x AS (SELECT *, CASE WHEN first OR opened <= 0 THEN 1 ELSE mv / opened END AS pr, CASE WHEN first OR opened <= 0 THEN 1 ELSE (mv + income) / opened END AS tr FROM m),
levels AS (SELECT *, 1000 * exp(sum(ln(pr)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS pl, 1000 * exp(sum(ln(tr)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS tl FROM x)
"""

SQL = {
    "index_levels": _LEVELS + "SELECT strftime(day, '%Y-%m-%d') AS day, round(pl, 4) AS price_level, round(tl, 4) AS total_level, round(mv / pl / 1e3, 2) AS divisor_thousands FROM levels",
    "divisor_events": _LEVELS
    + """, z AS (SELECT *, lag(mv / pl) OVER (ORDER BY day) AS db, lag(pl) OVER (ORDER BY day) AS lb FROM levels)
SELECT strftime(day, '%Y-%m-%d') AS day, round(mv / pl / db, 8) AS divisor_ratio, round(opened / held, 8) AS value_ratio, round(opened / db / lb - 1, 6) AS avoided_move FROM z WHERE changes > 0 AND db IS NOT NULL AND opened > 0 AND held > 0""",
    "daily_roll": _LEVELS + f"SELECT strftime(day, '%Y-%m-%d') AS day, round(pl, 4) AS price_level, round(tl, 4) AS total_level FROM levels WHERE day > DATE '{ROLL}'",
}
QUERIES = {f.__name__: f for f in (index_levels, divisor_events, daily_roll)}
