"""Joins, aggregations, windows and set operations that the plans are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows; ``order`` should end in a unique key. Each task sends k rows."""
    return df.orderBy(*order).limit(k)


def rank_within(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group, with their rank.

    A rank limit on a window is pushed below the shuffle by Spark, so each task sends at
    most k rows of a group.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def with_subtotals(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates for the keys, their prefixes and the whole."""
    return df.rollup(*keys).agg(*aggregates)


def keys_without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks, once each."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def with_bucket(df: DataFrame, at: str, every: str) -> DataFrame:
    """``df`` with ``_bucket``, the start of the period (hour, day ...) that ``at`` lies in."""
    return df.withColumn("_bucket", F.date_trunc(every, F.col(at)))


def as_of_latest(left: DataFrame, right: DataFrame, key: str, at: str, since: str, take: str, every: str = "hour") -> DataFrame:
    """Each left row with ``take`` of the last right row of its key at or before its time.

    Both sides meet in one union that is shuffled by key and period, so the rows of a hot key
    are ordered period by period, in many tasks. A period's last right row is carried to the
    later ones of its key over a table of one row a key and period. Of right rows at one time
    the largest ``take`` is the last; null keys, times and values match nothing.
    """
    kind = right.schema[take].dataType
    both = left.withColumns({"_at": F.col(at), "_side": F.lit(1), "_take": F.lit(None).cast(kind)}).unionByName(
        right.where(F.col(take).isNotNull() & F.col(since).isNotNull()).select(key, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.col(take).alias("_take")), allowMissingColumns=True
    )
    both = with_bucket(both, "_at", every)
    upto = Window.partitionBy(key, "_bucket").orderBy("_at", "_side", "_take").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last("_take", ignorenulls=True).over(upto)).where("_side = 1")
    ends = both.groupBy(key, "_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_take"))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_bucket", F.last("_end", ignorenulls=True).over(before)["_take"].alias("_carried"))
    joined = last.join(carried.where("_carried is not null"), [key, "_bucket"], "left")
    known = F.col(key).isNotNull() & F.col("_at").isNotNull()
    return joined.select(*left.columns, F.when(known, F.coalesce("_last", "_carried")).alias(f"last_{take}"))


def visits(events: DataFrame, key: str, at: str, gap: str, *aggregates: Column, every: str = "hour") -> DataFrame:
    """(key, visit, began, ended, ...): events of a key no more than ``gap`` apart are one
    visit; ``aggregates`` are over the columns of ``events``, and must be sums or counts that
    add up, as their sums are taken. Visits of a key are numbered by time.

    Events are ordered within a key and period only, so a hot key's are in many tasks, and
    make the visits of that period. Each period is then one row a key: its first and last
    event and how many visits it opens. Over these rows, few for any key, the first visit of
    a period is joined to the last one before it, or not, and the numbers go on.
    """
    wide = F.expr(f"interval {gap}")
    placed = with_bucket(events, at, every)
    within = Window.partitionBy(key, "_bucket").orderBy(at)
    opens = F.coalesce((F.col(at) - F.lag(at).over(within) > wide).cast("int"), F.lit(0))
    local = placed.withColumn("_opens", opens).withColumn("_nth", F.sum("_opens").over(within.rangeBetween(Window.unboundedPreceding, 0)))
    parts = local.groupBy(key, "_bucket", "_nth").agg(F.min(at).alias("began"), F.max(at).alias("ended"), *aggregates)
    sums = [c for c in parts.columns if c not in (key, "_bucket", "_nth", "began", "ended")]
    periods = parts.groupBy(key, "_bucket").agg(F.min("began").alias("_first"), F.max("ended").alias("_last"), F.max("_nth").alias("_more"))
    in_order = Window.partitionBy(key).orderBy("_bucket")
    new = F.coalesce((F.col("_first") - F.lag("_last").over(in_order) > wide).cast("int"), F.lit(1))
    numbered = periods.withColumn("_new", new).withColumn("_base", F.sum(F.col("_new") + F.col("_more")).over(in_order) - F.col("_more"))
    # null keys are a key of their own
    met = parts.alias("p").join(numbered.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), "_base"), F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    whole = met.groupBy(key, (F.col("_base") + F.col("_nth")).alias("visit"))
    return whole.agg(F.min("began").alias("began"), F.max("ended").alias("ended"), *(F.sum(c).alias(c) for c in sums))
