"""Multivariate regressions and the factor risk model as queries; numpy in grouped functions, so without SQL twins but one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import regression as rg
from ..operators import research, risk
from ..sources.tables import table
from .common import clean_prices, signals, text_day

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """Monthly cross-sections: forward log growth on scaled signal, log cap and industry dummies."""
    w = Window.partitionBy("security_id").orderBy("as_of")
    s = signals(spark, d).withColumn("fwd", F.log(F.lead("signal").over(w) / F.col("signal")))
    dummy = {f"ind_{x.lower()}": (F.col("industry") == x).cast("double") for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")}
    return s.select("as_of", "security_id", "industry", "cap", "fwd", (F.col("signal") / 1e6).alias("size"), F.log("cap").alias("log_cap"), *[v.alias(k) for k, v in dummy.items()])


XS = ["size", "log_cap", "ind_automobile", "ind_building", "ind_furniture", "ind_household"]


@query
def period_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Per month the weighted regression of forward growth with errors clustered by industry."""
    x = rg.per_group(_panel(spark, d), "as_of", "fwd", XS, weight="cap", cluster="industry", errors="cluster", least=30)
    return x.select(text_day("as_of").alias("as_of"), "term", *[F.round(c, 8).alias(c) for c in ("coef", "se", "r2")], "n")


@query
def series_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Per listing the regression of its returns on the market's and its lag, with autocorrelation-robust errors."""
    w = Window.partitionBy("listing_id").orderBy("date")
    r = clean_prices(spark, d).select("listing_id", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).where("ret IS NOT NULL AND abs(ret) < 0.5")
    m = r.groupBy("date").agg(F.avg("ret").alias("market"))
    m = m.withColumn("before", F.lag("market").over(Window.partitionBy(F.lit(0)).orderBy("date")))  # one row per day
    x = rg.per_group(r.join(m, "date"), "listing_id", "ret", ["market", "before"], order="date", errors="newey_west", lags=4, least=60)
    return x.select("listing_id", "term", *[F.round(c, 8).alias(c) for c in ("coef", "se", "r2")], "n")


def _model(spark: SparkSession, d: str):
    p = _panel(spark, d).withColumn("root_cap", F.sqrt("cap"))
    f, r = rg.factor_returns(p, "as_of", "security_id", "fwd", XS, "root_cap", 30)
    return p, f, r


@query
def factor_model_returns(spark: SparkSession, d: str) -> DataFrame:
    """Factor returns per month of the square-root-cap weighted model."""
    return _model(spark, d)[1].select(text_day("as_of").alias("as_of"), "factor", F.round("ret", 8).alias("ret"), F.round("r2", 8).alias("r2"))


def _book_model(p: DataFrame, f: DataFrame, r: DataFrame):
    """Weights, exposures, factor covariance and specific variances of the cap-weighted book at the last month."""
    a, b = f.select("as_of", F.col("factor").alias("a"), F.col("ret").alias("x")), f.select("as_of", F.col("factor").alias("b"), F.col("ret").alias("y"))
    cov = a.join(b, "as_of").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))  # factors squared per month
    last = p.where("fwd IS NOT NULL").agg(F.max("as_of")).scalar()
    book = p.where(F.col("as_of") == last).withColumn("const", F.lit(1.0))
    w = book.select("security_id", "cap").withColumn("w", F.col("cap") / book.agg(F.sum("cap")).scalar()).drop("cap")
    return w, book.unpivot(["security_id"], ["const", *XS], "factor", "exposure"), cov, rg.specific_variance(r, "as_of", "security_id", 365.0)


@query
def factor_risk(spark: SparkSession, d: str) -> DataFrame:
    """Variance of the cap-weighted book at the last month, split by factor and the specific part."""
    w, e, cov, s = _book_model(*_model(spark, d))
    return rg.risk_decomposition(w, e, cov, s, "security_id").select("factor", F.round("variance", 12).alias("variance"))


@query
def joint_alpha(spark: SparkSession, d: str) -> DataFrame:
    """F test that four industries' mean growth has no intercept on the market's and the fifth industry's."""
    p = _panel(spark, d).where("fwd IS NOT NULL")
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    m = p.groupBy("as_of").agg(F.avg("fwd").alias("market"), *[F.avg(F.when(F.col("industry") == n, F.col("fwd"))).alias(n.lower()) for n in names])
    g = rg.gram_matrix(m, ["market", "machinery", *[n.lower() for n in names[:-1]]])
    f, pv = rg.joint_alpha(g, 2)
    return spark.createDataFrame([(int(g[0, 0]), 4, 2, float(f), float(pv))], "n_periods int, n_portfolios int, n_factors int, statistic double, p double")


@query
def fama_macbeth_many(spark: SparkSession, d: str) -> DataFrame:
    """Weighted regressions on all characteristics per month, and the mean of every coefficient with its autocorrelation-robust t."""
    c = rg.per_group(_panel(spark, d), "as_of", "fwd", XS, weight="cap", least=30).select("as_of", "term", "coef")
    x = research.newey_west_by(c, "term", "as_of", "coef", 3)
    return x.select("term", "n", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"), F.round(F.try_divide("mean", F.nullif("se", F.lit(0.0))), 6).alias("t"))


@query
def marginal_risk(spark: SparkSession, d: str) -> DataFrame:
    """Every name's marginal contribution to the risk of the cap-weighted book at the last month."""
    p, f, r = _model(spark, d)
    w, e, cov, s = _book_model(p, f, r)
    x = risk.marginal_contributions(w, e, cov, s, "security_id", 12.0)
    return x.select("security_id", F.round("marginal", 8).alias("marginal"), F.round("contribution", 10).alias("contribution"))


@query
def estimator_bakeoff(spark: SparkSession, d: str) -> DataFrame:
    """Minimum variance portfolios of the embedding axes by three estimators, walked forward: what risk they had afterwards."""
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("t"), "embedding")
    return risk.walk_forward(x, "t", "embedding", estimation=120, holding=20).select("estimator", "n_windows", F.round("realised", 8).alias("realised"), F.round("forecast", 8).alias("forecast"))
