"""Keyed state over live events: idle alerts by event-time timers, and user features kept up to date.

Both operators first thin out what a task has read (instants of a minute, sums of a day), so a user
with a third of the events sends few rows to the task that holds its state. State is bounded by the
calendar and by the delay: what the watermark has passed is folded into sums and a histogram of
gaps, later instants wait in order. Results depend on the events and the watermark only, not on how
the stream was cut into batches.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from holdfast.functions.columns import DAY_US, micros
from holdfast.operators import features

MINUTE_US = 60_000_000
ROCKS_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# processors and thinning run in the Python workers, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def keep_state_in_rocks(spark: SparkSession) -> None:
    """Timers and typed state need this store; its changes are in the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_STATE)


def final_watermark(events: DataFrame, delay_us: int = 0) -> int:
    """Watermark in microseconds after all of a bounded table has been read (whole milliseconds)."""
    last = events.agg(F.max(micros("ts")).alias("t")).first()["t"]
    return ((last or 0) - delay_us) // 1000 * 1000


# ---- idle alerts ---------------------------------------------------------------------------------

def limits(users: DataFrame, factor: float) -> DataFrame:
    """(user_id, limit_us): `factor` times the median interval, which counts as one day at least."""
    if factor * DAY_US <= MINUTE_US:
        raise ValueError("limits are longer than a minute")
    usual = F.greatest("ipi_median", F.lit(1.0)) * F.lit(float(factor)) * F.lit(float(DAY_US))
    return users.select("user_id", F.floor(usual).cast("long").alias("limit_us"))


def _minutes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last instant of every (user, minute) of a batch: no limit is as short as a minute."""
    for batch in batches:
        rows = pa.table({"user_id": batch.column(0), "at": batch.column(1), "limit_us": batch.column(2),
                         "minute": pc.floor(pc.divide(batch.column(1), MINUTE_US))})
        ends = rows.group_by(["user_id", "minute", "limit_us"], use_threads=False).aggregate([("at", "min"), ("at", "max")])
        both = pa.concat_arrays([ends["at_min"].combine_chunks(), ends["at_max"].combine_chunks()])
        twice = {n: pa.concat_arrays([ends[n].combine_chunks()] * 2) for n in ("user_id", "limit_us")}
        yield pa.RecordBatch.from_arrays([twice["user_id"], both, twice["limit_us"]], names=["user_id", "at", "limit_us"])


class IdleAlerts(StatefulProcessor):
    """One row per period in which a user was idle for longer than its limit.

    The row comes when the watermark passes the end of the limit, whether or not the user has come
    back in later events that are read already.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("idle", "last long, limit_us long, told boolean, pending array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, limit, told, pending = self.state.get() or (None, None, False, [])
        times = set(pending)
        for row in rows:
            times.add(row["at"])
            limit = row["limit_us"]
        yield from self._settle(key, last, limit, told, sorted(times), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, limit, told, pending = self.state.get()
        yield from self._settle(key, last, limit, told, list(pending), timerValues)

    def _settle(self, key, last, limit, told, pending: list[int], timers) -> Iterator[Row]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        done = 0
        for at in pending:
            if at > passed:
                break
            if last is not None and at - last > limit and not told:
                yield self._alert(key, last, limit)
            last, told = (at if last is None else max(last, at)), False
            done += 1
        pending = pending[done:]
        if last is not None and not told and last + limit <= passed and (not pending or pending[0] > last + limit):
            yield self._alert(key, last, limit)
            told = True
        self.state.update((last, limit, told, pending))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [pending[0]] if pending else []
        if last is not None and not told:
            due.append(last + limit)
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))

    def _alert(self, key, last: int, limit: int) -> Row:
        return Row(user_id=key[0], last_us=last, due_us=last + limit)

    def close(self) -> None:
        pass


def _instants(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.timestamp_micros("last_us").alias("last_ts"), F.timestamp_micros("due_us").alias("due_ts"))


def idle_alerts(events: DataFrame, users: DataFrame, factor: float = 3.0, delay: str = "1 hour") -> DataFrame:
    """Streaming: (user_id, last_ts, due_ts) of every idle period longer than `factor` usual intervals.

    `users` has user_id and ipi_median; events of unknown users have no limit and raise no alert.
    Events later than the delay are dropped. Run it in update or append mode; `idle_periods` gives
    the same rows of a bounded table.
    """
    keep_state_in_rocks(events.sparkSession)
    known = events.join(limits(users, factor), "user_id").select("user_id", micros("ts").alias("at"), "limit_us")
    thin = known.mapInArrow(_minutes, "user_id string, at long, limit_us long")
    timed = thin.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", delay)
    found = timed.groupBy("user_id").transformWithState(
        IdleAlerts(), "user_id string, last_us long, due_us long", "Update", "EventTime")
    return _instants(found)


def idle_periods(events: DataFrame, users: DataFrame, factor: float, until_us: int) -> DataFrame:
    """The rows of `idle_alerts` when the watermark stands at `until_us`, over a bounded table."""
    minute = F.floor(micros("ts") / F.lit(MINUTE_US)).alias("minute")
    ends = events.groupBy("user_id", minute).agg(F.min(micros("ts")).alias("low"), F.max(micros("ts")).alias("last_us"))
    ahead = F.lead("low").over(W.partitionBy("user_id").orderBy("minute"))
    rows = ends.withColumn("next_us", ahead).join(limits(users, factor), "user_id")
    due = F.col("last_us") + F.col("limit_us")
    open_end = F.col("next_us").isNull() | (F.col("next_us") > F.lit(until_us))
    idle = F.when(open_end, due <= F.lit(until_us)).otherwise(F.col("next_us") > due)
    return _instants(rows.where(idle & (F.col("last_us") <= F.lit(until_us))).withColumn("due_us", due))


# ---- features ------------------------------------------------------------------------------------

_DAY_ROW = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("day", T.LongType()), T.StructField("events", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("spend", T.DoubleType()), T.StructField("spread", T.DoubleType()),
    T.StructField("max_spend", T.DoubleType()), T.StructField("min_spend", T.DoubleType()),
    T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType())])

#: A row of the activity table (`operators.activity`), as far as intervals and spend need it.
ACTIVITY = (
    "user_id string, events long, n long, spend double, spread double, max_spend double, min_spend double, "
    "first_us long, last_us long, zero_gaps long, gap_sum long, gap_squares long, gap_max long, gaps array<bigint>")


def _days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and ends of every (user, day) of a batch."""
    for batch in batches:
        day = pc.floor(pc.divide(pc.cast(batch.column(1), pa.float64()), float(DAY_US))).cast(pa.int64())
        rows = pa.table({"user_id": batch.column(0), "day": day, "at": batch.column(1), "amount": batch.column(2)})
        sums = rows.group_by(["user_id", "day"], use_threads=False).aggregate([
            ([], "count_all"), ("amount", "count"), ("amount", "sum"), ("amount", "variance"), ("amount", "max"), ("amount", "min"),
            ("at", "min"), ("at", "max")])
        columns = [sums["user_id"], sums["day"], sums["count_all"], sums["amount_count"], sums["amount_sum"],
                   pc.multiply(sums["amount_variance"], pc.cast(sums["amount_count"], pa.float64())),
                   sums["amount_max"], sums["amount_min"], sums["at_min"], sums["at_max"]]
        yield from pa.table(columns, names=_DAY_ROW.names).to_batches()


def _merged_spend(a: tuple, b: tuple) -> tuple:
    """(n, sum, squared distance to the mean, max, min) of two disjoint groups of amounts."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    between = (b[1] / b[0] - a[1] / a[0]) ** 2 * a[0] * b[0] / (a[0] + b[0])
    return a[0] + b[0], a[1] + b[1], a[2] + b[2] + between, max(a[3], b[3]), min(a[4], b[4])


class LiveActivity(StatefulProcessor):
    """The activity row of a user, after every batch with events of it.

    Days that the watermark has passed are closed: only their sums, their last instant and the
    histogram of gaps between active days remain. Open days keep their ends, at most one entry a day.
    """

    def __init__(self, forget_days: int | None):
        self.forget_us = None if forget_days is None else forget_days * DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "activity",
            "events long, n long, spend double, spread double, top double, low double, first_us long, last_us long, "
            "zero_gaps long, gaps array<bigint>, times array<bigint>, days array<bigint>, ends array<bigint>")

    def _read(self) -> tuple:
        kept = self.state.get()
        if kept is None:
            return [0, None, None, 0], (0, 0.0, 0.0, None, None), {}, {}
        gaps = dict(zip(kept[9], kept[10]))
        ends = iter(kept[12])
        days = {day: [n, low, high] for day, n, low, high in zip(kept[11], ends, ends, ends)}
        return [kept[0], kept[6], kept[7], kept[8]], tuple(kept[1:6]), gaps, days

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        closed, spend, gaps, days = self._read()
        for r in rows:
            own = days.setdefault(r["day"], [0, r["first_us"], r["last_us"]])
            own[0] += r["events"]
            own[1], own[2] = min(own[1], r["first_us"]), max(own[2], r["last_us"])
            spend = _merged_spend(spend, (r["n"], r["spend"] or 0.0, r["spread"] or 0.0, r["max_spend"], r["min_spend"]))
        self._keep(closed, spend, gaps, days, timerValues)
        seen, all_gaps = list(closed), dict(gaps)
        for day in sorted(days):
            self._close(seen, all_gaps, days[day])
        flat = [g for g in sorted(all_gaps) for _ in range(all_gaps[g])]
        yield Row(
            user_id=key[0], events=seen[0], n=spend[0], spend=spend[1] if spend[0] else None, spread=float(spend[2]),
            max_spend=spend[3], min_spend=spend[4], first_us=seen[1], last_us=seen[2], zero_gaps=seen[3],
            gap_sum=sum(flat) if flat else None, gap_squares=sum(g * g for g in flat) if flat else None,
            gap_max=flat[-1] if flat else None, gaps=flat)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed, spend, gaps, days = self._read()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        newest = max([closed[2] or 0, *(high for _, _, high in days.values())])
        if self.forget_us is not None and newest + self.forget_us <= passed:
            self.state.clear()
        else:
            self._keep(closed, spend, gaps, days, timerValues)
        return iter(())

    def _close(self, closed: list, gaps: dict, day: list) -> None:
        n, low, high = day
        if closed[2] is not None:
            gap = (low - closed[2]) // DAY_US
            gaps[gap] = gaps.get(gap, 0) + 1
        closed[0] += n
        closed[1] = low if closed[1] is None else closed[1]
        closed[2] = high
        closed[3] += n - 1

    def _keep(self, closed: list, spend: tuple, gaps: dict, days: dict, timers) -> None:
        """Close the days that the watermark has passed, write the state, wait for the next end of a day."""
        passed = timers.getCurrentWatermarkInMs() * 1000
        for day in sorted(days):
            if (day + 1) * DAY_US > passed:
                break
            self._close(closed, gaps, days.pop(day))
        order = sorted(days)
        ends = [x for day in order for x in days[day]]
        self.state.update((closed[0], *spend, closed[1], closed[2], closed[3], list(gaps), list(gaps.values()), order, ends))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = max([closed[2] or 0, *(high for _, _, high in days.values())])
        due = [(order[0] + 1) * DAY_US] if order else []
        if self.forget_us is not None:
            due.append(newest + self.forget_us)
        if due:
            self.handle.registerTimer(math.ceil(min(due) / 1000))

    def close(self) -> None:
        pass


def live_activity(events: DataFrame, delay: str = "1 day", forget_days: int | None = None, amount: str = "value") -> DataFrame:
    """Streaming: the activity row of every user that has events in a batch, as of all events so far.

    Events later than the delay are dropped, together with other late ones of their user and day. A
    user without events for `forget_days` loses its state and starts anew. A null amount counts as an
    event only. Run it in update mode and keep the newest row of a user (`events.drain_updates`).
    """
    keep_state_in_rocks(events.sparkSession)
    rows = events.where("ts is not null").select("user_id", micros("ts").alias("at"), F.col(amount).cast("double").alias("amount"))
    days = rows.mapInArrow(_days, _DAY_ROW)
    timed = days.withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", delay)
    return timed.groupBy("user_id").transformWithState(LiveActivity(forget_days), ACTIVITY, "Update", "EventTime")


def live_features(act: DataFrame, as_of_us: Column | int, single_buyer_interval: float | None = None) -> DataFrame:
    """User features of activity rows at an instant: the columns of `features.rfm`.

    `single_buyer_interval` is the interval given to users with one event; taken from the rows unless given
    (a batch of changed users should be given the figure of all users).
    """
    at = F.lit(as_of_us) if isinstance(as_of_us, int) else as_of_us
    act = act.withColumn("as_of_us", at)
    if single_buyer_interval is None:
        single_buyer_interval = features.single_buyer_interval(act)
    users = act.withColumns({
        "ipi_median": F.coalesce(features.gap_median(), F.lit(float(single_buyer_interval))),
        "ipi_std": F.coalesce(features.gap_deviation(), F.lit(0.0)),
    }).select(*features.base_columns(), "ipi_median", "ipi_std")
    users = features.with_interval_scores(users)
    return users.withColumn("monetary_velocity", features.velocity(F.col("monetary"), F.col("account_age_days")))
