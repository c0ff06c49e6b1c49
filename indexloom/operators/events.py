"""Corporate-action events: typed payloads, quarantine, order of application, per-share effects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = (
    "amount double, currency string, ratio double, new_float double, old_float double, new_shares double, old_shares double, subscription_price double, per_held double, cum_price double, spinco_security_id string,"
    " shares_per_parent_share double, value_per_parent_share double, parent_cum_price double, cash_per_share double, acquirer_security_id string, exchange_ratio double, implied_value_per_share double, final_price double"
)

#: Fields an event of a type must have, and those of them that must be positive.
REQUIRED: Mapping[str, tuple[str, ...]] = {
    "CASH_DIVIDEND": ("amount", "currency"), "SPECIAL_DIVIDEND": ("amount", "currency"), "RETURN_OF_CAPITAL": ("amount", "currency"), "SPLIT": ("ratio",), "REVERSE_SPLIT": ("ratio",), "BONUS_ISSUE": ("ratio",),
    "RIGHTS_ISSUE": ("subscription_price", "new_shares", "per_held"), "SPINOFF": ("spinco_security_id", "shares_per_parent_share", "value_per_parent_share"), "SHARES_CHANGE": ("new_shares", "old_shares"),
    "FLOAT_CHANGE": ("new_float", "old_float"), "MERGER_STOCK": ("acquirer_security_id", "exchange_ratio", "implied_value_per_share"), "MERGER_CASH": ("cash_per_share",), "DELISTING": (),
}
POSITIVE = {"amount", "ratio", "subscription_price", "new_shares", "per_held", "shares_per_parent_share", "exchange_ratio", "cash_per_share"}

#: The order of application on one day. Distributions come off the price first, then splits rescale it, and what changes or ends a member comes last.
ORDER: Mapping[str, int] = {
    "CASH_DIVIDEND": 10, "SPECIAL_DIVIDEND": 11, "RETURN_OF_CAPITAL": 12, "SPLIT": 20, "REVERSE_SPLIT": 20, "BONUS_ISSUE": 21, "RIGHTS_ISSUE": 30, "SPINOFF": 40, "SHARES_CHANGE": 50, "FLOAT_CHANGE": 51,
    "MERGER_STOCK": 60, "MERGER_CASH": 61, "DELISTING": 62,
}
#: The order of an event of any other type.
OTHER = 50


def parse(actions: DataFrame) -> DataFrame:
    """Every event with its typed payload ``p``, ``apply_order`` and the ``reason`` it cannot be built, null if it can.

    Reasons: ``unknown_type``, ``bad_json``, ``missing:<field>``, ``not_positive:<field>``, ``no_ex_date``.
    """
    x = actions.withColumn("p", F.from_json("payload", PAYLOAD))
    order = F.lit(OTHER)
    for t, n in ORDER.items():
        order = F.when(F.col("event_type") == t, n).otherwise(order)
    missing, low = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, fields in REQUIRED.items():
        for f in fields:
            missing = F.when((F.col("event_type") == t) & F.col(f"p.{f}").isNull(), f"missing:{f}").otherwise(missing)
            if f in POSITIVE:
                low = F.when((F.col("event_type") == t) & (F.col(f"p.{f}") <= 0), f"not_positive:{f}").otherwise(low)
    known = F.coalesce(F.col("event_type").isin(*REQUIRED), F.lit(False))
    bad = F.get_json_object("payload", "$").isNull()
    reason = F.when(~known, "unknown_type").when(bad, "bad_json").when(F.col("ex_date").isNull(), "no_ex_date").otherwise(F.coalesce(missing, low))
    return x.withColumn("apply_order", order).withColumn("reason", reason)


def special_as_capital(events: DataFrame, prices: DataFrame, share: float = 0.05) -> DataFrame:
    """Events with ``kind``: a special dividend above ``share`` of the last close before its ex-date returns capital.

    ``prices`` (security_id, date, close). The close comes from an as-of merge of both tables.
    """
    e = events.select("event_id", "security_id", F.col("ex_date").alias("d"), "event_type", F.col("p.amount").alias("amount"))
    u = e.select("security_id", "d", "event_id", "event_type", "amount", F.lit(None).cast("double").alias("c"), F.lit(0).alias("o"))
    u = u.unionByName(prices.select("security_id", F.col("date").alias("d"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("amount"), F.col("close").alias("c"), F.lit(1).alias("o")))
    from pyspark.sql import Window

    w = Window.partitionBy("security_id").orderBy("d", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = u.withColumn("cum_price", F.last("c", True).over(w)).where("o = 0")
    kind = F.when((F.col("event_type") == "SPECIAL_DIVIDEND") & (F.col("amount") > share * F.col("cum_price")), "RETURN_OF_CAPITAL").otherwise(F.col("event_type"))
    return x.select("event_id", "event_type", "amount", "cum_price", kind.alias("kind"))


def theoretical_ex_rights(cum: Column, subscription: Column, new: Column, held: Column) -> Column:
    return (held * cum + new * subscription) / (held + new)


def price_effect() -> Column:
    """Price after an event from the price ``close`` before it: what ``p`` does to one share, never below 0.

    A member that is merged or delisted is first marked to its terms; that is a return.
    """
    c = F.col("close")
    t = F.col("event_type")
    after = (
        F.when(t.isin("SPLIT", "REVERSE_SPLIT", "BONUS_ISSUE"), c / F.nullif(F.col("p.ratio"), F.lit(0.0)))
        .when(t.isin("CASH_DIVIDEND", "SPECIAL_DIVIDEND", "RETURN_OF_CAPITAL"), c - F.col("p.amount"))
        .when(t == "RIGHTS_ISSUE", theoretical_ex_rights(c, F.col("p.subscription_price"), F.col("p.new_shares"), F.col("p.per_held")))
        .when(t == "SPINOFF", c - F.col("p.value_per_parent_share"))
        .when(t == "MERGER_CASH", F.col("p.cash_per_share"))
        .when(t == "MERGER_STOCK", F.col("p.implied_value_per_share"))
        .when(t == "DELISTING", F.coalesce(F.col("p.final_price"), F.lit(0.0)))
        .otherwise(c)
    )
    return F.when(after.isNotNull(), F.greatest(after, F.lit(0.0)))


def share_effect(shares: Column) -> Column:
    """Shares after an event from those before it. An acquirer's new shares come from :func:`acquired_shares`."""
    t = F.col("event_type")
    return (
        F.when(t.isin("SPLIT", "REVERSE_SPLIT", "BONUS_ISSUE"), shares * F.col("p.ratio"))
        .when(t == "RIGHTS_ISSUE", shares * (1 + F.col("p.new_shares") / F.nullif(F.col("p.per_held"), F.lit(0.0))))
        .when(t == "SHARES_CHANGE", F.col("p.new_shares"))
        .when(t.isin("MERGER_CASH", "MERGER_STOCK", "DELISTING"), F.lit(0.0))
        .otherwise(shares)
    )


def float_effect(factor: Column) -> Column:
    """Free-float factor after an event."""
    return F.when(F.col("event_type") == "FLOAT_CHANGE", F.col("p.new_float")).otherwise(factor)


def acquired_shares(target_shares: Column) -> Column:
    """New shares of the acquirer in a share merger."""
    return F.when(F.col("event_type") == "MERGER_STOCK", target_shares * F.col("p.exchange_ratio"))


def cum_prices(events: DataFrame, prices: DataFrame) -> DataFrame:
    """``events`` (security_id, ex_date) with ``close``: the last close before the ex-date, null without one. One merge of both time lines, no range join."""
    from pyspark.sql import Window

    mine = F.struct(*[F.col(c) for c in events.columns])
    u = events.select(F.col("security_id").alias("__s"), F.col("ex_date").alias("__d"), mine.alias("__e"), F.lit(None).cast("double").alias("__c"), F.lit(0).alias("__o"))
    q = prices.select(F.col("security_id").alias("__s"), F.col("date").alias("__d"), F.lit(None).cast(u.schema["__e"].dataType).alias("__e"), F.col("close").alias("__c"), F.lit(1).alias("__o"))
    w = Window.partitionBy("__s").orderBy("__d", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return u.unionByName(q).withColumn("close", F.last("__c", True).over(w)).where("__o = 0").select("__e.*", "close")


def effects(events: DataFrame, shares: Column | None = None, factor: Column | None = None) -> DataFrame:
    """``events`` with ``close`` and parsed ``p``, with price, shares and float after, and ``value_factor``: value after over value before of one share held.

    A factor other than 1 is what a divisor has to absorb, but for a cash dividend, which is left
    to the market, and a merger or delisting, whose mark is a return.
    """
    s, f = shares if shares is not None else F.lit(1.0), factor if factor is not None else F.lit(1.0)
    x = events.withColumn("price_after", price_effect()).withColumn("shares_after", share_effect(s)).withColumn("float_after", float_effect(f))
    return x.withColumn("value_factor", F.col("price_after") * F.col("shares_after") / F.nullif(F.col("close") * s, F.lit(0.0)))
