"""Late and out-of-order events: per-period closing figures that are corrected until a cut-off.

The two layers of a lambda view share one mergeable state per (entity, period): the greatest
(event time, known time, value) seen. The fast layer folds every arriving increment into a
provisional state. A scheduled batch recomputes the periods that are still open from the full
log, replaces the provisional state, and freezes a period once its lateness cut-off has passed.
Both layers are plain aggregations with map-side combine, so a hot entity costs one partial
state per task.

A period's schedule is the same for all: its end, then a batch every ``batch_days``, the last of
which is the cut-off. Between two of them lies one *turn*; a record belongs to the turn in which
it becomes known. :func:`fast_layer` and :func:`batch_layer` are the layers over those turns and
:func:`lambda_views` serves them; ``streaming.lambda_store`` keeps them in a folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(log: DataFrame, entity: Sequence[str], event_time: str, known_time: str, value: str) -> DataFrame:
    """The log's usable records: entity columns e0.., event time t, known time k, value v, period p."""
    return (
        log.select(*[F.col(c).alias(f"e{i}") for i, c in enumerate(entity)], F.to_date(event_time).alias("t"), F.to_date(known_time).alias("k"), F.col(value).alias("v"))
        .dropna()
        .withColumn("p", F.trunc("t", "month"))
    )


def state(condition: Column | None = None) -> Column:
    """The mergeable closing state of the rows that meet a condition."""
    s = F.struct("t", "k", "v")
    return F.max(s if condition is None else F.when(condition, s))


def late_by() -> Column:
    """Days from the end of the period to the day its record became known; negative before it."""
    return F.datediff(F.col("k"), F.last_day("p"))


def schedule(lateness_days: int, batch_days: int) -> list[int]:
    """Days after a period's end on which its scheduled batches run; the last is the cut-off."""
    return [*range(batch_days, lateness_days, batch_days), lateness_days]


def with_turn(log: DataFrame, runs: Sequence[int]) -> DataFrame:
    """Usable records with their ``turn``: 0 up to the period's end, i up to batch i, one more past the cut-off."""
    late, turn = late_by(), F.lit(len(runs) + 1)
    for i in range(len(runs), -1, -1):
        turn = F.when(late <= (0 if i == 0 else runs[i - 1]), F.lit(i)).otherwise(turn)
    return log.withColumn("turn", turn)


def fast_layer(log: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Per (key, period) the increment of every turn: ``f0``.. ``fn``, the states of the records that arrived in it, and their counts ``n0``.. (one more past the cut-off)."""
    arrived = lambda i: F.col("turn") == i
    return log.groupBy(*keys, "p").agg(*[state(arrived(i)).alias(f"f{i}") for i in range(n + 1)], *[F.count_if(arrived(i)).alias(f"n{i}") for i in range(n + 2)])


def batch_layer(log: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Per (key, period) the figure of every scheduled batch, ``b1``.. ``bn``, each recomputed from the full log as it is then and not from increments."""
    return log.groupBy(*keys, "p").agg(*[state(F.col("turn") <= i).alias(f"b{i}") for i in range(1, n + 1)])


def lambda_views(log: DataFrame, *, entity: Sequence[str], event_time: str, known_time: str, value: str, lateness_days: int = 45, batch_days: int = 15) -> DataFrame:
    """Every (entity, month of event time) as its lambda view published it.

    Columns: the entity, ``period`` (first of month), ``provisional`` (the fast layer at the
    period's last day), ``before_batch`` (what the fast layer had made of each batch's figure just
    before the next batch ran: the last batch merged with the increments since), ``batches`` (the
    closing figure after each scheduled batch, which replaces the provisional one), ``final`` (as
    frozen at the cut-off: the last batch; increments past it change nothing), ``n_in_time``,
    ``n_late``, ``n_cut_off`` record counts.

    The closing figure is the value of the record with the latest event time, then the latest
    known time, then the greatest value. Defined cases: records with a null in entity, event
    time, known time or value do not count; repeated records change nothing but the counts; a
    period first heard of after its cut-off has a null ``final``; an empty log gives no rows.
    """
    runs = schedule(lateness_days, batch_days)
    e = [f"e{i}" for i in range(len(entity))]
    n = len(runs)
    log = with_turn(usable(log, entity, event_time, known_time, value), runs)
    # both layers are partitioned by key and period, so that serving them costs no exchange of its own
    g = fast_layer(log, e, n).join(batch_layer(log, e, n), [*e, "p"])
    # the served view between two batches: the figure of the last one, or of the fast layer before any, with the increments since
    served = [F.greatest(F.col("f0") if i == 1 else F.col(f"b{i - 1}"), F.col(f"f{i}")) for i in range(1, n + 1)]
    return g.select(
        *[F.col(x).alias(c) for x, c in zip(e, entity, strict=True)],
        F.col("p").alias("period"),
        F.col("f0.v").alias("provisional"),
        F.array(*[s["v"] for s in served]).alias("before_batch"),
        F.array(*[F.col(f"b{i}.v") for i in range(1, n + 1)]).alias("batches"),
        F.col(f"b{n}.v").alias("final"),
        F.col("n0").alias("n_in_time"),
        sum((F.col(f"n{i}") for i in range(1, n + 1)), F.lit(0)).alias("n_late"),
        F.col(f"n{n + 1}").alias("n_cut_off"),
    )
