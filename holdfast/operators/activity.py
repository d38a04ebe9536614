"""Per-user activity: one row per user and active day first, then one row per user.

The day rows come out of a map-side combined aggregate, so a user that holds a third of all rows
reaches the per-user step as at most one row per calendar day. Two events of one UTC day are less
than 24 hours apart, hence every gap inside a day counts 0 whole days and only the gaps between
consecutive active days have to be measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.columns import DAY_US, micros, whole_days
from holdfast.functions.order import facts
from holdfast.session import hold


def span(tx: DataFrame) -> tuple[int, int]:
    """First and last event time in microseconds."""
    row = facts(tx, first=F.min(micros("timestamp")), last=F.max(micros("timestamp")))
    return row["first"], row["last"]


def daily_ledger(
    tx: DataFrame, halves_at: float | None = None, recent_from: int | None = None
) -> DataFrame:
    """(user_id, day) rows: counts, spend moments, first and last instant, split sums."""
    at = micros("timestamp")
    amount = F.col("amount").cast("double")
    aggs = [
        F.count(F.lit(1)).alias("events"),
        F.count("amount").alias("n"),
        F.sum(amount).alias("spend"),
        (F.var_pop(amount) * F.count("amount")).alias("m2"),
        F.max(amount).alias("max_spend"),
        F.min(amount).alias("min_spend"),
        F.min(at).alias("first_us"),
        F.max(at).alias("last_us"),
    ]
    if halves_at is not None:
        old = at < halves_at
        aggs += [
            F.count(F.when(old, F.col("amount"))).alias("old_n"),
            F.sum(F.when(old, amount)).alias("old_spend"),
        ]
    if recent_from is not None:
        aggs.append(F.sum(F.when(at >= recent_from, amount)).alias("recent_spend"))
    if "is_failure" in tx.columns:
        aggs += [F.sum("is_failure").alias("failures"), F.count("is_failure").alias("checked")]
    day = F.floor(at / F.lit(DAY_US)).alias("day")
    return tx.where("timestamp is not null").groupBy("user_id", day).agg(*aggs)


def activity(tx: DataFrame, trend_until: int | None = None) -> DataFrame:
    """One held row per user with everything RFM, gap, trend and lifecycle operators need.

    `trend_until`: end of the observation window for the trend features in microseconds; one day
    after the last event unless given.
    """
    first, last = span(tx)
    if last is None:
        first = last = 0
    until = last + DAY_US if trend_until is None else trend_until
    middle = first + (until - first) / 2
    history = ((last if trend_until is None else trend_until) - first) // DAY_US
    recent = first + max(int(history * 0.7), 1) * DAY_US
    days = daily_ledger(tx, halves_at=middle, recent_from=recent)

    user = W.partitionBy("user_id")
    previous = F.lag("last_us").over(user.orderBy("day"))
    centre = F.sum("spend").over(user) / F.sum("n").over(user)
    days = days.withColumns(
        {
            "gap": whole_days(F.col("first_us"), previous),
            "spread": F.coalesce("m2", F.lit(0.0))
            + F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("spend") / F.col("n") - centre, 2)).otherwise(0.0),
        }
    )
    aggs = [
        F.sum("events").alias("events"),
        F.sum("n").alias("n"),
        F.sum("spend").alias("spend"),
        F.sum("spread").alias("spread"),
        F.max("max_spend").alias("max_spend"),
        F.min("min_spend").alias("min_spend"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.sum(F.col("events") - 1).alias("zero_gaps"),
        F.sum("gap").alias("gap_sum"),
        F.sum(F.col("gap") * F.col("gap")).alias("gap_squares"),
        F.max("gap").alias("gap_max"),
        # at most one entry per active calendar day
        F.sort_array(F.collect_list("gap")).alias("gaps"),
        F.sum("old_n").alias("old_n"),
        F.sum("old_spend").alias("old_spend"),
        F.sum("recent_spend").alias("recent_spend"),
    ]
    if "failures" in days.columns:
        aggs += [F.sum("failures").alias("failures"), F.sum("checked").alias("checked")]
    users = days.groupBy("user_id").agg(*aggs).withColumn("as_of_us", F.lit(last))
    return hold(users)


def gap_median() -> Column:
    """Median whole-day gap of a user; NULL for users with one event."""

    def at(place: str) -> str:
        return f"if({place} < zero_gaps, 0L, get(gaps, cast({place} - zero_gaps as int)))"

    low, high = "floor((events - 2) / 2)", "ceil((events - 2) / 2)"
    return F.expr(f"case when events > 1 then ({at(low)} + {at(high)}) / 2.0D end")


def gap_deviation() -> Column:
    """Sample standard deviation of a user's gaps; NULL below two gaps."""
    squares = "coalesce(gap_squares - gap_sum * gap_sum / (events - 1), 0D)"
    return F.expr(f"case when events > 2 then sqrt(greatest({squares}, 0D) / (events - 2)) end")
