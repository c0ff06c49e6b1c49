"""Queries p1 to p6 on the data-processing problems of TESTDATA.md, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.anomalies import implausible_readings, score_readings
from ..operators.asof import as_known
from ..operators.history import history_from_intervals, history_from_snapshots
from ..operators.intervals import coverage, spans
from ..operators.late import lambda_views
from ..operators.rolling import daily_totals, entity_calendar, trailing
from ..sources.tables import table

ITEMS = ["BOOK_EQUITY", "NET_INCOME"]


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd")


# -- 1. attributes as known at event time


def _p1(spark: SparkSession, d: str) -> DataFrame:
    filings = table(spark, d, "fundamentals").where(F.col("value").isNotNull() & (F.col("filed_date") >= F.col("period_end")))
    return as_known(
        table(spark, d, "shares"),
        filings,
        entity=["security_id"],
        event_time="knowledge_date",
        order=["period_end", "filed_date"],
        variants={"item": ITEMS},
        clocks={"known": F.greatest("filed_date", "period_end"), "hindsight": F.col("period_end")},
    )


def p1_as_known(spark: SparkSession, d: str) -> DataFrame:
    """Every share record's day and item with the figure in force, null where none was known."""
    x = _p1(spark, d)
    return x.select("security_id", _text("knowledge_date").alias("knowledge_date"), "item", _text("known.period_end").alias("period_end"), _text("known.filed_date").alias("filed_date"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    x = _p1(spark, d).where(F.col("known").isNotNull() & ~F.col("known").eqNullSafe(F.col("hindsight")))
    return x.select("security_id", _text("knowledge_date").alias("knowledge_date"), "item", _text("known.period_end").alias("period_end"), _text("known.filed_date").alias("filed_date"))


_P1_SQL = """
WITH asked AS (SELECT DISTINCT s.security_id, s.knowledge_date AS k, i.item FROM shares s, (VALUES ('BOOK_EQUITY'), ('NET_INCOME')) i(item)
               WHERE s.knowledge_date IS NOT NULL AND s.security_id IS NOT NULL),
filed AS (SELECT DISTINCT security_id, item, period_end, filed_date FROM fundamentals WHERE value IS NOT NULL AND filed_date >= period_end),
known AS (SELECT a.security_id, a.k, a.item, f.period_end, f.filed_date,
                 ROW_NUMBER() OVER (PARTITION BY a.security_id, a.k, a.item ORDER BY f.period_end DESC NULLS LAST, f.filed_date DESC NULLS LAST) AS r
          FROM asked a LEFT JOIN filed f ON f.security_id = a.security_id AND f.item = a.item AND f.filed_date <= a.k AND f.period_end <= a.k),
later AS (SELECT a.security_id, a.k, a.item, f.period_end, f.filed_date,
                 ROW_NUMBER() OVER (PARTITION BY a.security_id, a.k, a.item ORDER BY f.period_end DESC NULLS LAST, f.filed_date DESC NULLS LAST) AS r
          FROM asked a LEFT JOIN filed f ON f.security_id = a.security_id AND f.item = a.item AND f.period_end <= a.k)
"""

SQL = {
    "p1_as_known": _P1_SQL
    + """SELECT security_id, strftime(k, '%Y-%m-%d') AS knowledge_date, item, strftime(period_end, '%Y-%m-%d') AS period_end,
       strftime(filed_date, '%Y-%m-%d') AS filed_date FROM known WHERE r = 1""",
    "p1_found": _P1_SQL
    + """SELECT n.security_id, strftime(n.k, '%Y-%m-%d') AS knowledge_date, n.item, strftime(n.period_end, '%Y-%m-%d') AS period_end,
       strftime(n.filed_date, '%Y-%m-%d') AS filed_date
FROM known n JOIN later l ON l.security_id = n.security_id AND l.k = n.k AND l.item = n.item AND l.r = 1
WHERE n.r = 1 AND n.period_end IS NOT NULL AND (n.period_end, n.filed_date) <> (l.period_end, l.filed_date)""",
}

# -- 2. late and out-of-order events


def _p2(spark: SparkSession, d: str) -> DataFrame:
    return lambda_views(table(spark, d, "shares"), entity=["security_id"], event_time="effective_date", known_time="knowledge_date", value="shares_outstanding")


def p2_closing(spark: SparkSession, d: str) -> DataFrame:
    """Closing shares per security and month: first published, after every batch, and frozen."""
    x = _p2(spark, d)
    return x.select(
        "security_id", F.date_format("period", "yyyy-MM").alias("month_key"), F.col("provisional").alias("first_published"), F.col("batches")[0].alias("after_15_days"),
        F.col("batches")[1].alias("after_30_days"), F.col("final").alias("corrected"), "n_in_time", "n_late", "n_cut_off",
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = _p2(spark, d).where(F.col("final").isNotNull() & ~F.col("final").eqNullSafe(F.col("provisional")))
    return x.select("security_id", F.date_format("period", "yyyy-MM").alias("month_key"))


_P2_SQL = """
WITH r AS (SELECT security_id, date_trunc('month', effective_date)::DATE AS m, effective_date AS t, knowledge_date AS k, shares_outstanding AS v,
                  knowledge_date - last_day(effective_date) AS late
           FROM shares WHERE security_id IS NOT NULL AND effective_date IS NOT NULL AND knowledge_date IS NOT NULL AND shares_outstanding IS NOT NULL),
c AS (SELECT security_id, strftime(m, '%Y-%m') AS month_key,
             arg_max(v, (t, k, v)) FILTER (WHERE late <= 0) AS first_published,
             arg_max(v, (t, k, v)) FILTER (WHERE late <= 15) AS after_15_days,
             arg_max(v, (t, k, v)) FILTER (WHERE late <= 30) AS after_30_days,
             arg_max(v, (t, k, v)) FILTER (WHERE late <= 45) AS corrected,
             count(*) FILTER (WHERE late <= 0) AS n_in_time, count(*) FILTER (WHERE late > 0 AND late <= 45) AS n_late, count(*) FILTER (WHERE late > 45) AS n_cut_off
      FROM r GROUP BY ALL)
"""
SQL["p2_closing"] = _P2_SQL + "SELECT * FROM c"
SQL["p2_found"] = _P2_SQL + "SELECT security_id, month_key FROM c WHERE corrected IS NOT NULL AND corrected IS DISTINCT FROM first_published"

# -- 3. overlapping and gapped time intervals

KEY = ["security_id", "identifier_type"]


def _p3(spark: SparkSession, d: str) -> DataFrame:
    return spans(coverage(table(spark, d, "identifiers"), entity=KEY, start="valid_from", end="valid_to"), KEY)


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    """All continuous periods and gaps."""
    return _p3(spark, d).select(*KEY, "span_kind", _text("span_from").alias("span_from"), F.coalesce(_text("span_to"), F.lit("open")).alias("span_to"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    x = _p3(spark, d).where((F.col("span_kind") == "gap") | F.col("multiple"))
    return x.select(*KEY, "span_kind", _text("span_from").alias("span_from"), F.coalesce(_text("span_to"), F.lit("open")).alias("span_to"))


_P3_SQL = """
WITH r AS (SELECT DISTINCT security_id, identifier_type, valid_from AS f, coalesce(valid_to, DATE '9999-12-31') AS e FROM identifiers
           WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from) AND security_id IS NOT NULL AND identifier_type IS NOT NULL),
m AS (SELECT *, CASE WHEN f <= max(e) OVER (PARTITION BY security_id, identifier_type ORDER BY f, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS s FROM r),
g AS (SELECT *, sum(s) OVER (PARTITION BY security_id, identifier_type ORDER BY f, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT security_id, identifier_type, min(f) AS f, max(e) AS e, count(*) AS n FROM g GROUP BY security_id, identifier_type, island),
x AS (SELECT security_id, identifier_type, 'period' AS span_kind, f AS a, e AS b, n FROM p
      UNION ALL SELECT security_id, identifier_type, 'gap', e, lead(f) OVER (PARTITION BY security_id, identifier_type ORDER BY f), 2 FROM p
      QUALIFY lead(f) OVER (PARTITION BY security_id, identifier_type ORDER BY f) IS NOT NULL)
SELECT security_id, identifier_type, span_kind, strftime(a, '%Y-%m-%d') AS span_from,
       CASE WHEN b = DATE '9999-12-31' THEN 'open' ELSE strftime(b, '%Y-%m-%d') END AS span_to FROM x
"""
SQL["p3_spans"] = _P3_SQL
SQL["p3_found"] = _P3_SQL + "WHERE n > 1"

# -- 4. implausible spikes in measurements


_P4 = {"source": "listing_id", "day": "date", "value": "close", "activity": "volume", "paused": "is_suspended"}


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with its isolation score and flags."""
    return score_readings(table(spark, d, "prices"), **_P4).select(F.col("source").alias("listing_id"), _text("day").alias("trade_date"), F.round("score", 6).alias("score"), "suspected", "impossible", "spike", "stuck")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    x = implausible_readings(table(spark, d, "prices"), **_P4).where(F.col("impossible") | F.col("spike") | F.col("stuck"))
    return x.select(F.col("source").alias("listing_id"), _text("day").alias("trade_date"))


SQL["p4_found"] = """
WITH p AS (SELECT listing_id, date, close, volume, is_suspended, (close > 0 AND isfinite(close)) AS ok FROM prices WHERE listing_id IS NOT NULL AND date IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY listing_id, date ORDER BY volume DESC NULLS LAST, close DESC NULLS LAST, is_suspended DESC NULLS LAST) = 1),
v AS (SELECT listing_id, date, ln(close) AS l, row_number() OVER w AS i, abs(ln(close) - lag(ln(close)) OVER w) AS move FROM p WHERE ok WINDOW w AS (PARTITION BY listing_id ORDER BY date)),
u AS (SELECT listing_id, quantile_disc(move, 0.5) AS usual FROM v WHERE move > 0 GROUP BY listing_id),
n AS (SELECT v.*, usual, lag(l) OVER w AS b1, lag(l, 2) OVER w AS b2, lag(l, 3) OVER w AS b3, lead(l) OVER w AS a1, lead(l, 2) OVER w AS a2, lead(l, 3) OVER w AS a3
      FROM v JOIN u USING (listing_id) WINDOW w AS (PARTITION BY listing_id ORDER BY date)),
e AS (SELECT listing_id, i, 1 AS k FROM n WHERE least(abs(l - b1), abs(l - a1)) > 10 * usual AND abs(a1 - b1) < 0.5 * least(abs(l - b1), abs(l - a1)) AND b1 IS NOT NULL AND a1 IS NOT NULL
      UNION ALL SELECT listing_id, i, 2 FROM n WHERE b1 IS NOT NULL AND a2 IS NOT NULL AND least(abs(l - b1), abs(l - a2), abs(a1 - b1), abs(a1 - a2)) > 10 * usual
        AND abs(a2 - b1) < 0.5 * least(abs(l - b1), abs(l - a2), abs(a1 - b1), abs(a1 - a2))
      UNION ALL SELECT listing_id, i, 3 FROM n WHERE b1 IS NOT NULL AND a3 IS NOT NULL AND least(abs(l - b1), abs(l - a3), abs(a1 - b1), abs(a1 - a3), abs(a2 - b1), abs(a2 - a3)) > 10 * usual
        AND abs(a3 - b1) < 0.5 * least(abs(l - b1), abs(l - a3), abs(a1 - b1), abs(a1 - a3), abs(a2 - b1), abs(a2 - a3))),
spike AS (SELECT v.listing_id, v.date FROM e JOIN v ON v.listing_id = e.listing_id AND v.i >= e.i AND v.i < e.i + e.k),
t AS (SELECT *, coalesce(ok AND volume > 0 AND is_suspended IS DISTINCT FROM TRUE, FALSE) AS live FROM p),
c AS (SELECT *, CASE WHEN live AND lag(live) OVER w AND close = lag(close) OVER w THEN 0 ELSE 1 END AS start FROM t WINDOW w AS (PARTITION BY listing_id ORDER BY date)),
r AS (SELECT *, sum(start) OVER (PARTITION BY listing_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM c),
stuck AS (SELECT listing_id, date FROM (SELECT *, count(*) OVER (PARTITION BY listing_id, run) AS size FROM r) WHERE size >= 6 AND start = 0)
SELECT DISTINCT listing_id, strftime(date, '%Y-%m-%d') AS trade_date FROM
  (SELECT listing_id, date FROM p WHERE close IS NOT NULL AND NOT ok UNION ALL SELECT * FROM spike UNION ALL SELECT * FROM stuck)
"""

# -- 5. history of changing entity attributes


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return history_from_intervals(table(spark, d, "identifiers"), entity=KEY, value=F.upper(F.trim("identifier_value")), start="valid_from", end="valid_to")


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    """All versions of every security's identifiers."""
    return _p5(spark, d).select(*KEY, F.col("value").alias("identifier_value"), _text("valid_from").alias("valid_from"), F.coalesce(_text("valid_to"), F.lit("open")).alias("valid_to"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    x = _p5(spark, d).where(F.col("n_versions") > 1)
    return x.select(*KEY, F.col("value").alias("identifier_value"), _text("valid_from").alias("valid_from"), F.coalesce(_text("valid_to"), F.lit("open")).alias("valid_to"))


def p5_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Which sector a listing showed over the periodic snapshots of capacity."""
    x = history_from_snapshots(table(spark, d, "capacity"), entity=["listing_id"], value=F.col("sector"), day="as_of")
    return x.select("listing_id", F.col("value").alias("sector"), _text("first_seen").alias("first_seen"), _text("last_seen").alias("last_seen"), F.col("n_snapshots").cast("bigint").alias("n_snapshots"))


_P5_SQL = """
WITH r AS (SELECT security_id, identifier_type, upper(trim(identifier_value, ' ')) AS v, valid_from AS f, max(coalesce(valid_to, DATE '9999-12-31')) AS e FROM identifiers
           WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from) AND security_id IS NOT NULL AND identifier_type IS NOT NULL AND identifier_value IS NOT NULL GROUP BY ALL),
b AS (SELECT security_id, identifier_type, f AS x FROM r UNION SELECT security_id, identifier_type, e FROM r),
s AS (SELECT *, lead(x) OVER (PARTITION BY security_id, identifier_type ORDER BY x) AS y FROM b),
i AS (SELECT s.security_id, s.identifier_type, s.x, s.y, arg_max(r.v, (r.f, r.e, r.v)) AS v FROM s JOIN r ON r.security_id = s.security_id AND r.identifier_type = s.identifier_type
      AND r.f <= s.x AND r.e >= s.y WHERE s.y IS NOT NULL GROUP BY ALL),
c AS (SELECT *, CASE WHEN lag(y) OVER w = x AND lag(v) OVER w = v THEN 0 ELSE 1 END AS n FROM i WINDOW w AS (PARTITION BY security_id, identifier_type ORDER BY x)),
g AS (SELECT *, sum(n) OVER (PARTITION BY security_id, identifier_type ORDER BY x ROWS UNBOUNDED PRECEDING) AS version FROM c),
h AS (SELECT security_id, identifier_type, any_value(v) AS v, min(x) AS f, max(y) AS e, count(*) OVER (PARTITION BY security_id, identifier_type) AS versions FROM g GROUP BY security_id, identifier_type, version)
SELECT security_id, identifier_type, v AS identifier_value, strftime(f, '%Y-%m-%d') AS valid_from, CASE WHEN e = DATE '9999-12-31' THEN 'open' ELSE strftime(e, '%Y-%m-%d') END AS valid_to FROM h
"""
SQL["p5_history"] = _P5_SQL
SQL["p5_found"] = _P5_SQL + "WHERE versions > 1"
SQL["p5_snapshots"] = """
WITH d AS (SELECT DISTINCT listing_id, sector, as_of FROM capacity WHERE listing_id IS NOT NULL AND sector IS NOT NULL AND as_of IS NOT NULL),
a AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS i FROM (SELECT DISTINCT as_of FROM d)),
g AS (SELECT d.*, i - row_number() OVER (PARTITION BY listing_id, sector ORDER BY d.as_of) AS island FROM d JOIN a ON a.as_of = d.as_of)
SELECT listing_id, sector, strftime(min(as_of), '%Y-%m-%d') AS first_seen, strftime(max(as_of), '%Y-%m-%d') AS last_seen, count(*) AS n_snapshots FROM g GROUP BY listing_id, sector, island
"""

# -- 6. rolling totals over trailing periods

WINDOWS = [7, 30]


def _traded(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    amount = F.when((c > 0) & (c < float("inf")), c * F.col("volume"))
    return daily_totals(table(spark, d, "prices"), entity="listing_id", day="date", amount=amount, prefer=F.col("volume"))


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Traded value of every listing and calendar day over the trailing 7 and 30 days, from its first day to the last on which a window still holds its last trade."""
    t = _traded(spark, d)
    x = trailing(entity_calendar(t, tail_days=max(WINDOWS) - 1), t, WINDOWS)
    return x.select(
        F.col("entity").alias("listing_id"), _text("day").alias("day"), *[F.round(f"{n}_{w}", r).alias(f"{n}_{w}") for w in WINDOWS for n, r in (("total", 6), ("average", 6))], "active_7", "active_30"
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "capacity").where("adv IS NOT NULL").select("listing_id", "as_of", "window_days", "adv")
    x = trailing(asked.select(F.col("listing_id").alias("entity"), F.col("as_of").alias("day")), _traded(spark, d), WINDOWS)
    true = x.select(F.col("entity").alias("listing_id"), F.col("day").alias("as_of"), F.explode(F.create_map(*[y for w in WINDOWS for y in (F.lit(w), F.col(f"average_{w}"))])).alias("window_days", "average"))
    bad = F.when(F.col("average") == 0, F.col("adv") != 0).otherwise(F.abs(F.col("adv") - F.col("average")) > 0.01 * F.col("average"))
    return asked.join(true, ["listing_id", "as_of", "window_days"]).where(bad).select("listing_id", _text("as_of").alias("as_of"), "window_days").distinct()


_P6_SQL = """
WITH t AS (SELECT listing_id, date, CASE WHEN close > 0 AND isfinite(close) THEN close * volume END AS a FROM prices WHERE listing_id IS NOT NULL AND date IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY listing_id, date ORDER BY volume DESC NULLS LAST, a DESC NULLS LAST) = 1)
"""
SQL["p6_rolling"] = (
    _P6_SQL
    + """, s AS (SELECT listing_id, min(date) AS f, max(date) AS e FROM t GROUP BY 1),
c AS (SELECT listing_id, unnest(generate_series(f, e + 29, INTERVAL 1 DAY))::DATE AS day FROM s),
x AS (SELECT c.listing_id, c.day, t.a, t.date IS NOT NULL AS traded FROM c LEFT JOIN t ON t.listing_id = c.listing_id AND t.date = c.day)
SELECT listing_id, strftime(day, '%Y-%m-%d') AS day,
       round(coalesce(sum(a) OVER w7, 0), 6) AS total_7, round(coalesce(sum(a) OVER w7, 0) / 7, 6) AS average_7,
       round(coalesce(sum(a) OVER w30, 0), 6) AS total_30, round(coalesce(sum(a) OVER w30, 0) / 30, 6) AS average_30,
       count(*) FILTER (WHERE traded) OVER w7 AS active_7, count(*) FILTER (WHERE traded) OVER w30 AS active_30
FROM x WINDOW w7 AS (PARTITION BY listing_id ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY listing_id ORDER BY day ROWS 29 PRECEDING)"""
)
SQL["p6_found"] = (
    _P6_SQL
    + """, x AS (SELECT c.listing_id, c.as_of, c.window_days, c.adv, coalesce(sum(t.a), 0) / c.window_days AS average
      FROM (SELECT DISTINCT listing_id, as_of, window_days, adv FROM capacity WHERE adv IS NOT NULL) c
      LEFT JOIN t ON t.listing_id = c.listing_id AND t.date <= c.as_of AND t.date > c.as_of - c.window_days GROUP BY c.listing_id, c.as_of, c.window_days, c.adv)
SELECT DISTINCT listing_id, strftime(as_of, '%Y-%m-%d') AS as_of, window_days FROM x WHERE CASE WHEN average = 0 THEN adv <> 0 ELSE abs(adv - average) > 0.01 * average END"""
)

QUERIES = {
    f.__name__: f
    for f in (p1_as_known, p1_found, p2_closing, p2_found, p3_spans, p3_found, p4_scores, p4_found, p5_history, p5_found, p5_snapshots, p6_rolling, p6_found)
}
