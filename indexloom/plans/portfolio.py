"""Risk, attribution and streaming windows as queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import attribution, research, risk
from ..sources.tables import table
from ..streaming import windows
from .common import SIGNALS, signals, text_day

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_LONG = "x AS (SELECT vec_id AS t, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS r FROM embeddings)"


@query(f"""WITH {_LONG} SELECT a.i, b.i AS j, count(*) AS n, round(covar_samp(a.r, b.r), 9) AS cov, round(corr(a.r, b.r), 9) AS corr FROM x a JOIN x b ON a.t = b.t AND a.i <= b.i GROUP BY ALL""")
def sample_covariance(spark: SparkSession, d: str) -> DataFrame:
    x = risk.covariances(table(spark, d, "embeddings"), "embedding")
    return x.select("i", "j", "n", F.round("cov", 9).alias("cov"), F.round("corr", 9).alias("corr"))


@query(f"""WITH {_LONG}, w AS (SELECT DISTINCT t, pow(0.5, ((SELECT max(t) FROM x) - t) / 90.0) AS w FROM x), k AS (SELECT sum(w) AS s, sum(w * w) AS s2 FROM w)
SELECT a.i, b.i AS j, round((sum(w * a.r * b.r) / any_value(s) - sum(w * a.r) * sum(w * b.r) / (any_value(s) * any_value(s))) / (1 - any_value(s2) / (any_value(s) * any_value(s))), 9) AS cov FROM x a JOIN x b ON a.t = b.t AND a.i <= b.i JOIN w ON w.t = a.t, k GROUP BY ALL""")
def decayed_covariance(spark: SparkSession, d: str) -> DataFrame:
    return risk.decayed_covariances(table(spark, d, "embeddings"), "embedding", "vec_id", 90.0).withColumn("cov", F.round("cov", 9))


@query(None)
def shrunk_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Diagonal of the shrunk covariance and the intensity."""
    s = risk.shrink_to_constant_correlation(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(i, float(v), s.intensity) for i, v in enumerate(s.covariance.diagonal())], "i int, variance double, intensity double")


@query(None)
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    """The five largest eigenvalues of the sample covariance and their share of all variance."""
    m = risk.matrix_of(risk.covariances(table(spark, d, "embeddings"), "embedding"))
    _, values = risk.principal_covariance(m, 5)
    return spark.createDataFrame([(k + 1, float(v), float(v / m.trace())) for k, v in enumerate(values)], "component int, eigenvalue double, share double")


@query(f"""WITH {_LONG}, c AS (SELECT a.i, b.i AS j, covar_samp(a.r, b.r) AS cov FROM x a JOIN x b ON a.t = b.t GROUP BY ALL) SELECT round(sum(cov) / pow((SELECT count(DISTINCT i) FROM x), 2), 10) AS variance FROM c""")
def equal_weight_variance(spark: SparkSession, d: str) -> DataFrame:
    c = risk.covariances(table(spark, d, "embeddings"), "embedding")
    n = c.where("i = j").select("i")
    w = n.withColumn("weight", F.lit(1.0) / n.agg(F.count(F.lit(1))).scalar())
    return risk.portfolio_variance(w, c).select(F.round("variance", 10).alias("variance"))


_BOOK = f"""WITH {SIGNALS}, f AS (SELECT *, ln(lead(signal) OVER (PARTITION BY security_id ORDER BY as_of) / signal) AS ret FROM sg), b AS (SELECT *, signal / sum(signal) OVER (PARTITION BY as_of) AS p, cap / sum(cap) OVER (PARTITION BY as_of) AS b FROM f WHERE ret IS NOT NULL)"""


def _book(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy("as_of")
    f = signals(spark, d).withColumn("ret", F.log(F.lead("signal").over(w) / F.col("signal"))).where("ret IS NOT NULL")
    m = Window.partitionBy("as_of")
    return f.withColumn("p", F.col("signal") / F.sum("signal").over(m)).withColumn("b", F.col("cap") / F.sum("cap").over(m))


@query(_BOOK + """, g AS (SELECT as_of, industry, sum(p) AS wp, sum(b) AS wb, sum(p * ret) / sum(p) AS rp, sum(b * ret) / sum(b) AS rb FROM b GROUP BY ALL), t AS (SELECT as_of, sum(wb * rb) AS tb, sum(wp * rp) AS tp FROM g GROUP BY as_of)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, industry, round((wp - wb) * (rb - tb), 9) AS allocation, round(wb * (rp - rb), 9) AS selection, round((wp - wb) * (rp - rb), 9) AS interaction, round(tp - tb, 9) AS active FROM g JOIN t USING (as_of)""")
def brinson_attribution(spark: SparkSession, d: str) -> DataFrame:
    x = attribution.brinson(_book(spark, d), ["as_of"], "industry", "p", "b", "ret")
    return x.select(text_day("as_of").alias("as_of"), "industry", *[F.round(c, 9).alias(c) for c in ("allocation", "selection", "interaction", "active")])


@query(_BOOK + "SELECT strftime(as_of, '%Y-%m-%d') AS as_of, round(sum(abs(p - b)) / 2, 9) AS active_share, count(*) AS n_held FROM b GROUP BY as_of")
def active_share(spark: SparkSession, d: str) -> DataFrame:
    x = attribution.active_share(_book(spark, d), ["as_of"], "p", "b")
    return x.select(text_day("as_of").alias("as_of"), F.round("active_share", 9).alias("active_share"), "n_held")


@query(f"""WITH RECURSIVE {SIGNALS}, o AS (SELECT security_id, as_of, signal, row_number() OVER (PARTITION BY security_id ORDER BY as_of) AS i FROM sg),
r AS (SELECT security_id, as_of, i, signal AS held FROM o WHERE i = 1 UNION ALL SELECT o.security_id, o.as_of, o.i, CASE WHEN abs(o.signal - r.held) > 150000 THEN o.signal ELSE r.held END FROM r JOIN o ON o.security_id = r.security_id AND o.i = r.i + 1)
SELECT security_id, strftime(as_of, '%Y-%m-%d') AS as_of, round(held, 4) AS adopted FROM r""")
def buffered_signal(spark: SparkSession, d: str) -> DataFrame:
    """The signal held until it moves by more than 150,000."""
    x = research.hysteresis(signals(spark, d), "security_id", "as_of", "signal", 150_000.0)
    return x.select("security_id", text_day("as_of").alias("as_of"), F.round("adopted", 4).alias("adopted"))


# -- streaming (an extension)


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_daily_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling day windows computed by a stream over the event files."""
    x = windows.run_available(windows.windowed(windows.event_stream(spark, d), "1 day"))
    return x.select(text_day("start").alias("day"), "event_type", "n", "total")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) - s.k * INTERVAL 6 HOURS AS start, event_type, value FROM events, (VALUES (0), (1)) s(k))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    x = windows.windowed(table(spark, d, "events"), "12 hours", "6 hours")
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, session""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = windows.sessions(table(spark, d, "events"), "user_id", "2 hours")
    return x.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "last")], "n", "total")
