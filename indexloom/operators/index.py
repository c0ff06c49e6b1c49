"""A divisor index: holdings in split-adjusted units, a divisor that absorbs what is no market move, and levels.

    level = sum over members of (price x units x fx) / divisor

On a day with structural changes (a review, a distribution that is not income, a listing that
ends) the divisor is rebased at the previous close so that the level does not move:
``divisor_after / divisor_before = value_after / value_before``. Between two days the level moves
by ``value at the close / value at the open`` of the same holdings, so levels are a running
product and the divisor is the value over the level.

Nothing is folded day by day over the members. A member's value changes only on its own days (a
price, a split, a review), so its time line is one window that gives changes of value; changes are
summed per currency and day, and values are running sums of them. Only tables of one row per
currency and day, bounded by the calendar, are ever ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Base:
    """Where levels start: the price and the total return level of the first day with members."""

    price: float = 1000.0
    total: float = 1000.0


#: Columns of a member's event rows, all but the first two nullable.
EVENTS = "id string, day date, close double, log_ratio double, special double, cash double, holding double, review boolean, leaves boolean, units double"


def event_rows(
    prices: DataFrame | None = None, actions: DataFrame | None = None, reviews: DataFrame | None = None, ends: DataFrame | None = None, state: DataFrame | None = None
) -> DataFrame:
    """One table of all that happens to members.

    ``prices`` (id, day, close); ``actions`` (id, day, ratio, special, cash): the split ratio, the
    distribution that is returned capital and the income per share, where there are any;
    ``reviews`` (id, day, holding): shares x float x capping of every candidate on a review day,
    null or 0 for one that is no member; ``ends`` (id, day): the first day on which a member is
    gone; ``state`` as of :func:`index_state`.
    """
    nothing = {"close": "double", "log_ratio": "double", "special": "double", "cash": "double", "holding": "double", "review": "boolean", "leaves": "boolean", "units": "double"}
    parts = [
        (prices, {"close": F.col("close")}),
        (actions, {"log_ratio": F.log(F.when(F.col("ratio") > 0, F.col("ratio"))), "special": F.col("special"), "cash": F.col("cash")}),
        (reviews, {"holding": F.col("holding"), "review": F.lit(True)}),
        (ends, {"leaves": F.lit(True)}),
        (state, {"close": F.col("close"), "log_ratio": F.col("log_factor"), "units": F.col("units")}),
    ]
    frames = [x.select("id", "day", *[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in nothing.items()]) for x, own in parts if x is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where(F.col("id").isNotNull() & F.col("day").isNotNull())


def timelines(rows: DataFrame) -> DataFrame:
    """Per member and day of its own: adjusted price ``p``, ``units``, ``log_factor`` of splits, and the changes ``delta`` (value at the close), ``structural`` (at the previous close) and ``income``.

    A split multiplies the shares and divides the price, so neither adjusted price nor units know
    of it. A distribution is per share before a split of its day. On a review day units become the
    holding over the split factor, or 0 without a holding or an earlier price; a member that leaves
    goes at its last price. A price that is null, not positive or not finite is none.
    """
    c = F.col("close")
    g = rows.groupBy("id", "day").agg(
        F.max(F.when((c > 0) & (c < float("inf")), c)).alias("close"),
        *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in ("log_ratio", "special", "cash")],
        F.max("holding").alias("holding"),
        *[F.coalesce(F.max(n), F.lit(False)).alias(n) for n in ("review", "leaves")],
        F.max("units").alias("seed"),
    )
    line = Window.partitionBy("id").orderBy("day")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = g.withColumn("log_factor", F.sum("log_ratio").over(upto))
    per_share = lambda n: F.col(n) * F.exp(F.col("log_factor") - F.col("log_ratio"))
    # a price that is carried over a distribution is carried without it
    x = x.withColumn("paid", F.sum(per_share("special")).over(upto))
    x = x.withColumn("p", F.greatest(F.last(F.col("close") * F.exp("log_factor") + F.col("paid"), True).over(upto) - F.col("paid"), F.lit(0.0)))
    x = x.withColumn("p", F.when(F.last("close", True).over(upto).isNotNull(), F.col("p")))
    x = x.withColumn("p_before", F.lag("p").over(line))
    held = F.when((F.col("holding") > 0) & F.col("p_before").isNotNull(), F.col("holding") / F.exp("log_factor")).otherwise(0.0)
    x = x.withColumn("units", F.coalesce(F.last(F.when(F.col("leaves"), 0.0).when(F.col("review"), held).otherwise(F.col("seed")), True).over(upto), F.lit(0.0)))
    x = x.withColumn("v", F.coalesce(F.col("p") * F.col("units"), F.lit(0.0))).withColumn("v_before", F.coalesce(F.lag("v").over(line), F.lit(0.0)))
    opening = F.coalesce(F.greatest(F.col("p_before") - per_share("special"), F.lit(0.0)) * F.col("units"), F.lit(0.0))
    return x.select(
        "id", "day", "p", "units", "log_factor", (F.col("v") - F.col("v_before")).alias("delta"), (opening - F.col("v_before")).alias("structural"), (per_share("cash") * F.col("units")).alias("income")
    )


def daily_values(lines: DataFrame, currency: DataFrame, rates: DataFrame, currencies: Sequence[str]) -> DataFrame:
    """Per day the members' value at the close, ``before`` (previous close), ``opening`` (previous close, today's holdings), ``income`` and ``changes``.

    ``currency`` (id, currency) of the members; ``rates`` (currency, day, rate), carried forward.
    Members without one of the ``currencies``, or whose currency has no rate yet, have no value.
    """
    sums = ("delta", "structural", "income")
    local = lines.join(currency, "id").where(F.col("currency").isin(*currencies)).groupBy("currency", "day").agg(*[F.sum(n).alias(n) for n in sums], F.count_if(F.abs("structural") > 1e-9).alias("changes"))
    days = local.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("currency", F.struct(*sums, "changes")))).alias("m"))  # one entry per currency
    grid = days.select(F.explode(F.array(*[F.lit(c) for c in currencies])).alias("currency"), "day", "m").select("currency", "day", F.col("m")[F.col("currency")].alias("s"))
    grid = grid.select("currency", "day", F.lit(True).alias("open"), *[F.coalesce(f"s.{n}", F.lit(0.0)).alias(n) for n in sums], F.coalesce("s.changes", F.lit(0)).alias("changes"))
    quoted = rates.where((F.col("rate") > 0) & F.col("currency").isin(*currencies)).groupBy("currency", "day").agg(F.max("rate").alias("rate")).withColumn("open", F.lit(False))
    by = Window.partitionBy("currency").orderBy("day", "open")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = grid.unionByName(quoted, allowMissingColumns=True).withColumn("fx", F.last("rate", True).over(upto)).where("open")
    x = x.withColumn("value", F.sum("delta").over(upto)).withColumn("held", F.coalesce(F.lag("value").over(by), F.lit(0.0))).withColumn("fx_before", F.coalesce(F.lag("fx").over(by), F.col("fx")))
    return x.groupBy("day").agg(
        F.coalesce(F.sum(F.col("value") * F.col("fx")), F.lit(0.0)).alias("close"), F.coalesce(F.sum(F.col("held") * F.col("fx_before")), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum((F.col("held") + F.col("structural")) * F.col("fx_before")), F.lit(0.0)).alias("opening"), F.coalesce(F.sum(F.col("income") * F.col("fx")), F.lit(0.0)).alias("income"), F.sum("changes").alias("changes"),
    )


def _product(x: Column, by) -> Column:
    return F.exp(F.sum(F.log(x)).over(by))


def index_levels(values: DataFrame, base: Base | None = None) -> DataFrame:
    """Levels from :func:`daily_values`: ``day``, ``price_level``, ``total_level``, ``divisor``, ``divisor_before``, ``value``, ``opening``, ``before``, ``changes``.

    The first day with members has the base levels. A day whose members are worth nothing at the
    open moves nothing. One row per day of the calendar is ordered in one task.
    """
    b = base or Base()
    w = Window.orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = values.where("close > 0").withColumn("first", F.row_number().over(w) == 1)
    moved = lambda extra: F.when(F.col("first") | (F.col("opening") <= 0), 1.0).otherwise((F.col("close") + extra) / F.col("opening"))
    x = x.withColumn("price_level", b.price * _product(moved(F.lit(0.0)), upto)).withColumn("total_level", b.total * _product(moved(F.col("income")), upto))
    x = x.withColumn("divisor", F.col("close") / F.col("price_level")).withColumn("divisor_before", F.lag("divisor").over(w)).withColumn("level_before", F.lag("price_level").over(w))
    return x.select("day", "price_level", "total_level", "divisor", "divisor_before", "level_before", F.col("close").alias("value"), "opening", "before", "changes")


def index_state(lines: DataFrame, day: str) -> DataFrame:
    """What a later run needs of every member on a day: id, day, last ``close``, ``log_factor``, ``units``."""
    w = Window.partitionBy("id").orderBy(F.desc("day"))
    x = lines.where(F.col("day") <= F.lit(day).cast("date")).withColumn("r", F.row_number().over(w)).where("r = 1 AND p IS NOT NULL")
    return x.select("id", F.lit(day).cast("date").alias("day"), (F.col("p") / F.exp("log_factor")).alias("close"), "log_factor", "units")


def divisor_changes(levels: DataFrame) -> DataFrame:
    """The days on which the divisor moved: before, after, the values it was rebased between and what the level would have moved by without it."""
    x = levels.where("changes > 0 AND divisor_before IS NOT NULL AND opening > 0 AND before > 0")
    return x.select("day", "changes", "divisor_before", F.col("divisor").alias("divisor_after"), F.col("before").alias("value_before"), F.col("opening").alias("value_after"), "level_before", (F.col("opening") / F.col("divisor_before") / F.col("level_before") - 1).alias("avoided_move"))
