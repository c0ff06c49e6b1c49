"""Time series, cross-sections, weights and research statistics as queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import crosssection as cs
from ..operators import research, series
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


def _round(df: DataFrame, n: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


_RET = f"WITH {CLEAN}, r AS (SELECT listing_id, date, close, close / lag(close) OVER (PARTITION BY listing_id ORDER BY date) - 1 AS ret FROM cp)"


@query(_RET + ", x AS (SELECT listing_id, date, ret FROM r) SELECT listing_id, strftime(date, '%Y-%m-%d') AS day, round(ret, 8) AS ret FROM x WHERE ret IS NOT NULL AND abs(ret) > 0.1")
def large_returns(spark: SparkSession, d: str) -> DataFrame:
    x = series.with_returns(clean_prices(spark, d), "listing_id", "date", "close")
    return x.where("abs(ret) > 0.1").select("listing_id", text_day("date").alias("day"), F.round("ret", 8).alias("ret"))


@query(_RET + """, x AS (SELECT *, close / max(close) OVER (PARTITION BY listing_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM r)
SELECT listing_id, count(ret) AS n, round(pow(arg_max(close, date) / arg_min(close, date), 1.0 / nullif((max(date) - min(date)) / 365.25, 0)) - 1, 6) AS annual_return, round(stddev_samp(ret) * sqrt(252), 6) AS annual_vol,
round(avg(ret) * 252 / nullif(stddev_samp(ret) FILTER (WHERE ret < 0) * sqrt(252), 0), 6) AS sortino, round(min(dd), 6) AS max_drawdown, round(max(ret), 6) AS best, round(min(ret), 6) AS worst, round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END), 6) AS positive_share
FROM x GROUP BY listing_id""")
def performance_summary(spark: SparkSession, d: str) -> DataFrame:
    x = series.summary(clean_prices(spark, d), "listing_id", "date", "close")
    return _round(x, 6, "annual_return", "annual_vol", "sortino", "max_drawdown", "best", "worst", "positive_share")


@query(f"""WITH {CLEAN}, x AS (SELECT listing_id, date, close / lag(close, 21) OVER w - 1 AS a, close / lag(close, 63) OVER w - 1 AS b, close / lag(close, 126) OVER w - 1 AS c FROM cp WINDOW w AS (PARTITION BY listing_id ORDER BY date))
SELECT listing_id, round(a, 8) AS return_21, round(b, 8) AS return_63, round(c, 8) AS return_126 FROM x QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY date DESC) = 1""")
def trailing_performance(spark: SparkSession, d: str) -> DataFrame:
    x = series.trailing_performance(clean_prices(spark, d), "listing_id", "date", "close", [21, 63, 126])
    return _round(x, 8, "return_21", "return_63", "return_126")


@query(f"""WITH {CLEAN}, y AS (SELECT listing_id, year(date)::INT AS year, arg_max(close, date) AS last FROM cp GROUP BY 1, 2)
SELECT listing_id, year, last, round(last / lag(last) OVER (PARTITION BY listing_id ORDER BY year) - 1, 8) AS year_return FROM y""")
def calendar_year_returns(spark: SparkSession, d: str) -> DataFrame:
    return _round(series.calendar_years(clean_prices(spark, d), "listing_id", "date", "close"), 8, "year_return")


@query(f"""WITH {CLEAN}, x AS (SELECT listing_id, date, lead(date) OVER w AS n, lag(date) OVER w AS p FROM cp WINDOW w AS (PARTITION BY listing_id ORDER BY date))
SELECT listing_id, strftime(date, '%Y-%m-%d') AS day, n IS NULL OR date_trunc('month', n) <> date_trunc('month', date) AS is_month_end, n IS NULL OR p IS NULL AS is_edge FROM x
WHERE n IS NULL OR p IS NULL OR date_trunc('month', n) <> date_trunc('month', date)""")
def snapshot_days(spark: SparkSession, d: str) -> DataFrame:
    x = series.period_ends(clean_prices(spark, d), "listing_id", "date").where("is_month_end OR is_edge")
    return x.select("listing_id", text_day("date").alias("day"), "is_month_end", "is_edge")


@query(_RET + """, f AS (SELECT listing_id, date, CASE WHEN count(ret) OVER w = 5 THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS forward FROM r WHERE ret IS NOT NULL AND ret > -1 WINDOW w AS (PARTITION BY listing_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT date_trunc('month', date)::DATE::VARCHAR AS month, count(forward) AS n, round(avg(forward), 6) AS mean FROM f GROUP BY 1""")
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    r = series.with_returns(clean_prices(spark, d), "listing_id", "date", "close").where("ret IS NOT NULL AND ret > -1")
    x = series.forward_compound(r, "listing_id", "date", "ret", 5)
    return x.groupBy(text_day(F.trunc("date", "month")).alias("month")).agg(F.count("forward").alias("n"), F.round(F.avg("forward"), 6).alias("mean"))


@query(_RET + """, x AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY date DESC) AS n FROM r WHERE ret IS NOT NULL)
SELECT listing_id, count(*) AS n, round(CASE WHEN count(*) FILTER (WHERE n > 21 AND n <= 126) = 105 THEN exp(sum(ln(1 + ret)) FILTER (WHERE n > 21 AND n <= 126)) - 1 END, 8) AS momentum, round(1 - exp(sum(ln(1 + ret)) FILTER (WHERE n <= 21)), 8) AS reversal,
round(CASE WHEN count(*) >= 60 THEN stddev_samp(ret) FILTER (WHERE n <= 126) * sqrt(252) END, 8) AS volatility, round(CASE WHEN count(*) >= 60 THEN stddev_samp(ret) FILTER (WHERE n <= 126 AND ret < 0) * sqrt(252) END, 8) AS downside FROM x GROUP BY listing_id""")
def return_factors(spark: SparkSession, d: str) -> DataFrame:
    r = series.with_returns(clean_prices(spark, d), "listing_id", "date", "close")
    return _round(series.window_factors(r, "listing_id", "date", "ret", 126, 21, 21, 60), 8, "momentum", "reversal", "volatility", "downside")


@query(_RET + """, m AS (SELECT date, avg(ret) AS m FROM r WHERE ret IS NOT NULL GROUP BY date)
SELECT listing_id, count(*) AS n, round(covar_samp(ret, m) / nullif(var_samp(m), 0), 8) AS beta FROM r JOIN m USING (date) WHERE ret IS NOT NULL GROUP BY listing_id HAVING count(*) >= 60""")
def market_beta(spark: SparkSession, d: str) -> DataFrame:
    r = series.with_returns(clean_prices(spark, d), "listing_id", "date", "close")
    return _round(series.market_beta(r, "listing_id", "date", "ret", 60), 8, "beta")


_SPLITS = """WITH s AS (SELECT security_id, event_id, ex_date, CAST(json_extract_string(payload, '$.ratio') AS DOUBLE) AS ratio FROM corp_actions WHERE event_type IN ('SPLIT', 'REVERSE_SPLIT', 'BONUS_ISSUE') AND ex_date IS NOT NULL)"""


@query(_SPLITS + """, v AS (SELECT * FROM s WHERE ratio > 0)
SELECT security_id, event_id, ratio, round(exp(sum(ln(ratio)) OVER (PARTITION BY security_id ORDER BY ex_date, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS factor FROM v""")
def split_factors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corp_actions").where("event_type IN ('SPLIT', 'REVERSE_SPLIT', 'BONUS_ISSUE') AND ex_date IS NOT NULL")
    s = c.select("security_id", "event_id", F.struct("ex_date", "event_id").alias("at"), F.from_json("payload", "ratio double")["ratio"].alias("ratio")).where("ratio > 0")
    return series.cumulative_factor(s, "security_id", "at", "ratio").select("security_id", "event_id", "ratio", F.round("factor", 8).alias("factor"))


@query(f"""WITH {FX}, x AS (SELECT quote, date, rate, lag(date) OVER w AS p, first_value(rate) OVER (PARTITION BY quote, date_trunc('month', date) ORDER BY date) AS struck FROM fx WINDOW w AS (PARTITION BY quote ORDER BY date))
SELECT quote, strftime(date, '%Y-%m-%d') AS day, p IS NULL OR date_trunc('month', p) <> date_trunc('month', date) AS is_reset, round(struck * (1 + 0.03 / 12) / (1 + 0.01 / 12), 10) AS forward, round(struck * (1 + 0.03 / 12) / (1 + 0.01 / 12) - rate, 10) AS mark FROM x""")
def hedge_marks(spark: SparkSession, d: str) -> DataFrame:
    """Forwards struck at each month's first rate, marked on every day."""
    x = series.resets(fx(spark, d), "quote", "date", "rate")
    f = series.forward_rate(F.col("struck"), F.lit(0.03), F.lit(0.01), F.lit(1 / 12))
    return x.select("quote", text_day("date").alias("day"), "is_reset", F.round(f, 10).alias("forward"), F.round(f - F.col("rate"), 10).alias("mark"))


@query(f"""WITH {CLEAN}, t AS (SELECT listing_id, date, close * volume AS v FROM cp WHERE volume > 0), m AS (SELECT l.currency AS ccy, t.date, sum(v) AS mv FROM t JOIN listings l USING (listing_id) WHERE l.currency IS NOT NULL GROUP BY 1, 2),
r AS (SELECT ccy, date, mv / lag(mv) OVER (PARTITION BY ccy ORDER BY date) AS ratio FROM m)
SELECT ccy, strftime(date, '%Y-%m-%d') AS day, round(1000 * exp(sum(ln(coalesce(ratio, 1))) OVER (PARTITION BY ccy ORDER BY date ROWS UNBOUNDED PRECEDING)), 4) AS level FROM r""")
def chained_level(spark: SparkSession, d: str) -> DataFrame:
    """Levels chained from daily value ratios, the closed form of a divisor index."""
    p = clean_prices(spark, d).where("volume > 0").join(table(spark, d, "listings").select("listing_id", F.col("currency").alias("ccy")), "listing_id").where("ccy IS NOT NULL")
    m = p.groupBy("ccy", "date").agg(F.sum(F.col("close") * F.col("volume")).alias("mv"))
    r = m.withColumn("ratio", F.col("mv") / F.lag("mv").over(Window.partitionBy("ccy").orderBy("date")))
    return series.chain(r, "ccy", "date", "ratio", 1000.0).select("ccy", text_day("date").alias("day"), F.round("level", 4).alias("level"))


# -- cross-sections


@query(f"""WITH {SIGNALS}, q AS (SELECT as_of, quantile_cont(signal, 0.01) AS lo, quantile_cont(signal, 0.99) AS hi FROM sg GROUP BY as_of)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, round(least(greatest(signal, lo), hi), 4) AS winsorised FROM sg JOIN q USING (as_of)""")
def winsorised(spark: SparkSession, d: str) -> DataFrame:
    return cs.winsorise(signals(spark, d), ["as_of"], "signal").select(text_day("as_of").alias("as_of"), "security_id", F.round("winsorised", 4).alias("winsorised"))


@query(f"""WITH {SIGNALS}, m AS (SELECT as_of, median(signal) AS m FROM sg GROUP BY as_of), s AS (SELECT as_of, 1.4826 * 3 * median(abs(signal - m)) AS s FROM sg JOIN m USING (as_of) GROUP BY as_of)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, round(least(greatest(signal, m - s), m + s), 4) AS winsorised FROM sg JOIN m USING (as_of) JOIN s USING (as_of)""")
def winsorised_mad(spark: SparkSession, d: str) -> DataFrame:
    return cs.winsorise_mad(signals(spark, d), ["as_of"], "signal").select(text_day("as_of").alias("as_of"), "security_id", F.round("winsorised", 4).alias("winsorised"))


@query(f"""WITH {SIGNALS}, w AS (SELECT *, stddev_samp(signal) OVER p AS sd, sum(signal * cap) OVER p / sum(cap) OVER p AS mean, avg(signal) OVER p AS plain FROM sg WINDOW p AS (PARTITION BY as_of))
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, CASE WHEN sd IS NULL OR sd <= 1e-12 THEN 0 ELSE round((signal - plain) / sd, 8) END AS z, CASE WHEN sd IS NULL OR sd <= 1e-12 THEN 0 ELSE round((signal - mean) / sd, 8) END AS weighted_z FROM w""")
def zscores(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select(text_day("as_of").alias("as_of"), "security_id", F.round(cs.zscore("signal", ["as_of"]), 8).alias("z"), F.round(cs.zscore("signal", ["as_of"], "cap"), 8).alias("weighted_z"))


@query(None)
def rank_normalised(spark: SparkSession, d: str) -> DataFrame:
    return cs.rank_normalise(signals(spark, d), ["as_of"], "signal").select(text_day("as_of").alias("as_of"), "security_id", F.round("normal", 8).alias("normal"))


@query(f"""WITH {SIGNALS} SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, round(signal - sum(signal * cap) OVER (PARTITION BY as_of, industry) / sum(cap) OVER (PARTITION BY as_of, industry), 4) AS neutral FROM sg""")
def neutralised(spark: SparkSession, d: str) -> DataFrame:
    return cs.neutralise(signals(spark, d), ["as_of"], "industry", "signal", "cap").select(text_day("as_of").alias("as_of"), "security_id", F.round("neutral", 4).alias("neutral"))


@query(f"""WITH {SIGNALS}, x AS (SELECT *, CASE WHEN signal > 100000 THEN signal END AS v FROM sg), m AS (SELECT as_of, industry, median(v) AS f FROM x GROUP BY ALL), p AS (SELECT as_of, quantile_cont(v, 0.05) AS q FROM x GROUP BY ALL)
SELECT strftime(x.as_of, '%Y-%m-%d') AS as_of, security_id, coalesce(v, f) AS by_category, round(coalesce(v, q), 6) AS penalised FROM x JOIN m USING (as_of, industry) JOIN p USING (as_of)""")
def filled_missing(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).withColumn("v", F.expr("CASE WHEN signal > 100000 THEN signal END"))
    a = cs.fill(x, ["as_of"], "v", "category", "industry").withColumnRenamed("filled", "by_category")
    return cs.fill(a, ["as_of"], "v", "penalise").select(text_day("as_of").alias("as_of"), "security_id", "by_category", F.round("filled", 6).alias("penalised"))


@query(f"""WITH {SIGNALS}, r AS (SELECT *, rank() OVER (PARTITION BY as_of ORDER BY signal) + (count(*) OVER (PARTITION BY as_of, signal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY as_of ORDER BY cap) + (count(*) OVER (PARTITION BY as_of, cap) - 1) / 2.0 AS b, count(*) OVER (PARTITION BY as_of) AS n FROM sg)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, round(a / n * 0.7 + b / n * 0.3, 8) AS mixed, round(signal * 0.7 + cap * 0.3, 4) AS integrated FROM r""")
def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    w = {"signal": 0.7, "cap": 0.3}
    return signals(spark, d).select(text_day("as_of").alias("as_of"), "security_id", F.round(cs.combine(w, "mixed", ["as_of"]), 8).alias("mixed"), F.round(cs.combine(w, "integrated", ["as_of"]), 4).alias("integrated"))


@query(f"""WITH {SIGNALS}, r AS (SELECT as_of, rank() OVER (PARTITION BY as_of ORDER BY signal) + (count(*) OVER (PARTITION BY as_of, signal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY as_of ORDER BY cap) + (count(*) OVER (PARTITION BY as_of, cap) - 1) / 2.0 AS b FROM sg)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, count(*) AS n, round(corr(a, b), 8) AS spearman FROM r GROUP BY as_of HAVING count(*) >= 20""")
def factor_correlation(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).select("as_of", cs.average_rank("signal", ["as_of"]).alias("a"), cs.average_rank("cap", ["as_of"]).alias("b"))
    return s.groupBy(text_day("as_of").alias("as_of")).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("a", "b"), 8).alias("spearman")).where("n >= 20")


@query(f"""WITH {SIGNALS} SELECT strftime(as_of, '%Y-%m-%d') AS as_of, count(*) AS n, round(avg(signal), 6) AS mean, round(stddev_samp(signal), 6) AS sd, min(signal) AS low, round(quantile_cont(signal, 0.1), 6) AS p10, round(median(signal), 6) AS mid, round(quantile_cont(signal, 0.9), 6) AS p90, max(signal) AS high FROM sg GROUP BY as_of""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).groupBy(text_day("as_of").alias("as_of")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("signal"), 6).alias("mean"), F.round(F.stddev_samp("signal"), 6).alias("sd"), F.min("signal").alias("low"), F.round(F.percentile("signal", F.lit(0.1)), 6).alias("p10"),
        F.round(F.median("signal"), 6).alias("mid"), F.round(F.percentile("signal", F.lit(0.9)), 6).alias("p90"), F.max("signal").alias("high"),
    )


# -- weights


@query(f"""WITH {SIGNALS}, w AS (SELECT *, signal / sum(signal) OVER p AS by_size, 1.0 / count(*) OVER p AS equal, 1 / cap / sum(1 / cap) OVER p AS inverse, cap * (exp(0.5 * signal / 1e6) + 0.1) / sum(cap * (exp(0.5 * signal / 1e6) + 0.1)) OVER p AS tilt FROM sg WINDOW p AS (PARTITION BY as_of))
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, security_id, round(by_size, 10) AS by_size, round(equal, 10) AS equal, round(inverse, 10) AS inverse, round(tilt, 10) AS tilt FROM w""")
def weighting_schemes(spark: SparkSession, d: str) -> DataFrame:
    g = ["as_of"]
    w = {"by_size": F.col("signal"), "equal": F.lit(1.0), "inverse": 1 / F.col("cap"), "tilt": F.col("cap") * (F.exp(0.5 * F.col("signal") / 1e6) + 0.1)}
    return signals(spark, d).select(text_day("as_of").alias("as_of"), "security_id", *[F.round(cs.normalised_weight(x, g), 10).alias(n) for n, x in w.items()])


@query(f"""WITH RECURSIVE {SIGNALS}, b AS (SELECT industry, security_id, sum(signal) AS s FROM sg GROUP BY ALL), w AS (SELECT industry, security_id, s / sum(s) OVER (PARTITION BY industry) AS w FROM b),
r AS (SELECT 0 AS i, industry, security_id, w, w AS x, FALSE AS done FROM w
 UNION ALL SELECT i + 1, industry, security_id, w, CASE WHEN done OR x > 0.02 THEN 0.02 ELSE w * (1 - 0.02 * count(*) FILTER (WHERE done OR x > 0.02) OVER p) / sum(CASE WHEN done OR x > 0.02 THEN 0 ELSE w END) OVER p END, done OR x > 0.02 FROM r WHERE i < 60 WINDOW p AS (PARTITION BY industry))
SELECT industry, security_id, round(CASE WHEN count(*) OVER q * 0.02 >= 1 - 1e-12 THEN x ELSE 1.0 / count(*) OVER q END, 10) AS capped, count(*) OVER q * 0.02 >= 1 - 1e-12 AS feasible FROM r WHERE i = 60 WINDOW q AS (PARTITION BY industry)""")
def capped_weights(spark: SparkSession, d: str) -> DataFrame:
    b = signals(spark, d).groupBy("industry", "security_id").agg(F.sum("signal").alias("s"))
    return cs.cap_weights(b, ["industry"], "s", 0.02, "security_id").select("industry", "security_id", F.round("capped", 10).alias("capped"), "feasible")


@query(f"""WITH {SIGNALS}, b AS (SELECT security_id, CAST(sum(signal) AS DECIMAL(28, 4)) AS s, sum(signal) AS f FROM sg GROUP BY 1), c AS (SELECT security_id, round(CAST(sum(s) OVER (ORDER BY f DESC, security_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 12) AS cumulative FROM b)
SELECT security_id, round(cumulative, 8) AS cumulative, CASE WHEN cumulative <= 0.7 THEN 'LARGE' WHEN cumulative <= 0.85 THEN 'MID' WHEN cumulative <= 0.98 THEN 'SMALL' ELSE 'MICRO' END AS band FROM c""")
def size_bands(spark: SparkSession, d: str) -> DataFrame:
    b = signals(spark, d).groupBy("security_id").agg(F.sum("signal").alias("s")).withColumn("all", F.lit(1))
    x = cs.cumulative_bands(b, ["all"], "s", "security_id", {"LARGE": 0.7, "MID": 0.85, "SMALL": 0.98}, "MICRO")
    return x.select("security_id", F.round("cumulative", 8).alias("cumulative"), "band")


# -- research

_FWD = f"WITH {SIGNALS}, f AS (SELECT *, ln(lead(signal) OVER (PARTITION BY security_id ORDER BY as_of) / signal) AS fwd FROM sg)"


def _with_forward(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy("as_of")
    return signals(spark, d).withColumn("fwd", F.log(F.lead("signal").over(w) / F.col("signal")))


@query(_FWD + """, r AS (SELECT as_of, rank() OVER (PARTITION BY as_of ORDER BY signal) + (count(*) OVER (PARTITION BY as_of, signal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY as_of ORDER BY fwd) + (count(*) OVER (PARTITION BY as_of, fwd) - 1) / 2.0 AS b, signal, fwd FROM f WHERE fwd IS NOT NULL)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, count(*) AS n, round(corr(a, b), 8) AS spearman, round(corr(signal, fwd), 8) AS pearson FROM r GROUP BY as_of HAVING count(*) >= 20""")
def information_coefficient(spark: SparkSession, d: str) -> DataFrame:
    x = research.information_coefficient(_with_forward(spark, d), "as_of", "signal", "fwd", 20)
    return x.select(text_day("as_of").alias("as_of"), "n", F.round("spearman", 8).alias("spearman"), F.round("pearson", 8).alias("pearson"))


@query(_FWD + """, b AS (SELECT as_of, fwd, greatest(1, ceil((row_number() OVER (PARTITION BY as_of ORDER BY signal, security_id) - 1) * 5 / (count(*) OVER (PARTITION BY as_of) - 1)))::INT AS bin, count(*) OVER (PARTITION BY as_of) AS c FROM f WHERE fwd IS NOT NULL)
SELECT bin, count(*) AS n, round(avg(fwd), 8) AS mean FROM b WHERE c > 20 GROUP BY bin""")
def quantile_returns(spark: SparkSession, d: str) -> DataFrame:
    x = _with_forward(spark, d).where("fwd IS NOT NULL").withColumn("bin", cs.quantile_bin("signal", ["as_of"], 5, "security_id")).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("as_of")))
    return x.where("c > 20").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fwd"), 8).alias("mean"))


@query(_FWD + """, s AS (SELECT as_of, regr_slope(fwd, signal / 1e6) AS slope, regr_intercept(fwd, signal / 1e6) AS alpha, regr_r2(fwd, signal / 1e6) AS r2, count(*) AS n FROM f WHERE fwd IS NOT NULL GROUP BY as_of HAVING count(*) >= 20)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, n, round(slope, 6) AS slope, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM s""")
def cross_sectional_regression(spark: SparkSession, d: str) -> DataFrame:
    x = research.period_regressions(_with_forward(spark, d).withColumn("x", F.col("signal") / 1e6), "as_of", "fwd", "x", 20)
    return x.select(text_day("as_of").alias("as_of"), "n", *[F.round(c, 6).alias(c) for c in ("slope", "alpha", "r2")])


_NW = """, t AS (SELECT *, row_number() OVER (ORDER BY as_of) AS i, count(*) OVER () AS c, slope - avg(slope) OVER () AS e FROM s),
l AS (SELECT any_value(c) AS c, avg(slope) AS mean, sum(e * e) / any_value(c) AS g0 FROM t), k AS (SELECT unnest(range(1, 5)) AS k),
g AS (SELECT k.k, sum(a.e * b.e) / any_value(a.c) AS g FROM k JOIN t a ON TRUE JOIN t b ON b.i = a.i - k.k GROUP BY k.k)
SELECT l.c AS n, round(l.mean, 8) AS mean, round(sqrt(greatest(l.g0 + 2 * (SELECT sum((1 - k / 5.0) * g) FROM g), 0) / l.c), 8) AS se FROM l"""


@query(_FWD + ", s AS (SELECT as_of, regr_slope(fwd, signal / 1e6) AS slope FROM f WHERE fwd IS NOT NULL GROUP BY as_of HAVING count(*) >= 20)" + _NW)
def fama_macbeth(spark: SparkSession, d: str) -> DataFrame:
    """Per-date slopes, then their mean with a Newey-West standard error of four lags."""
    x = research.period_regressions(_with_forward(spark, d).withColumn("x", F.col("signal") / 1e6), "as_of", "fwd", "x", 20)
    return research.newey_west(x, "as_of", "slope", 4).select("n", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"))


@query(None)
def multiple_testing(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg and Bonferroni over the per-date slopes' t-statistics."""
    x = research.period_regressions(_with_forward(spark, d).withColumn("x", F.col("signal") / 1e6), "as_of", "fwd", "x", 20)
    return research.multiple_testing(x.select(text_day("as_of").alias("test"), "t"), "test", "t", 0.05).withColumn("p", F.round("p", 8))


@query(_FWD + """, h AS (SELECT s.as_of, s.security_id, s.signal, k.k, ln(lead(signal, 1) OVER w / signal) AS f1, ln(lead(signal, 2) OVER w / signal) AS f2, ln(lead(signal, 3) OVER w / signal) AS f3 FROM sg s, (VALUES (1), (2), (3)) k(k) WINDOW w AS (PARTITION BY s.security_id, k.k ORDER BY s.as_of)),
x AS (SELECT as_of, k AS horizon, signal, CASE k WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END AS fwd FROM h), c AS (SELECT as_of, horizon, corr(signal, fwd) AS ic, count(*) AS n FROM x WHERE fwd IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)
SELECT horizon, count(*) AS n_dates, round(avg(ic), 8) AS mean_ic FROM c GROUP BY horizon""")
def ic_decay(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy("as_of")
    s = signals(spark, d).select("as_of", "signal", *[F.log(F.lead("signal", k).over(w) / F.col("signal")).alias(f"f{k}") for k in (1, 2, 3)])
    x = s.unpivot(["as_of", "signal"], ["f1", "f2", "f3"], "h", "fwd").where("fwd IS NOT NULL").withColumn("horizon", F.substring("h", 2, 1).cast("int"))
    c = x.groupBy("as_of", "horizon").agg(F.corr("signal", "fwd").alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    return c.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_dates"), F.round(F.avg("ic"), 8).alias("mean_ic"))
