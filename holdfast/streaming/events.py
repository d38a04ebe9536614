"""Event streams. Every function takes a streaming or a bounded DataFrame and means the same.

State is kept by Spark's own aggregates, which combine on the map side: a user with a third of the
events costs one state row, and no Python runs per event.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast.functions.columns import DAY_US, micros
from holdfast.functions.fixed import EVENT_RISK_WEIGHTS
from holdfast.operators.learners import ChurnModel
from holdfast.session import scratch_path

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def _typed(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        "value",
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
    )


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Typed event stream over the event files of a folder."""
    raw = (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", "events*.parquet")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
    return _typed(raw)


def batch_events(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark.read.parquet(f"{folder}/events.parquet"))


def dedupe(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per event id; ids are remembered for the delay only."""
    marked = events.withWatermark("ts", delay)
    if events.isStreaming:
        return marked.dropDuplicatesWithinWatermark(["event_id"])
    return marked.dropDuplicates(["event_id"])


def event_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events and value per type and day; rows later than the delay are dropped.

    In append mode only closed windows come out; `drain_updates` gives the open ones too.
    """
    day = F.window("ts", "1 day")
    return (
        events.withWatermark("ts", delay)
        .groupBy(day.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("day_start"), F.col("w.end").alias("day_end"), "event_type", "events", "total")
    )


def failure_rates(
    events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Failed share of a user's events in sliding windows."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", length, slide).alias("w"), "user_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.avg((F.col("status") == "failed").cast("double")).alias("failure_rate"),
        )
        .select(F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "user_id", "events", "failure_rate")
    )


def risk_ledger(events: DataFrame, weights: Mapping[str, float] = EVENT_RISK_WEIGHTS) -> DataFrame:
    """Running churn change per user: the sum of the weights of its events (update mode)."""
    delta = F.lit(0.0)
    for kind, weight in weights.items():
        delta = F.when(F.col("event_type") == kind, F.lit(weight)).otherwise(delta)
    return events.groupBy("user_id").agg(
        F.sum(delta).alias("churn_delta"),
        F.count(F.lit(1)).alias("events"),
        F.max("ts").alias("last_ts"),
    )


def last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("ts").alias("last_ts"))


def ipi_alerts(seen: DataFrame, users: DataFrame, as_of_us: int, factor: float = 3.0) -> DataFrame:
    """Users idle for longer than `factor` times their median interval (at least one day).

    `seen` is the current state of `last_seen`; `users` has user_id and ipi_median.
    """
    usual = users.select("user_id", F.greatest("ipi_median", F.lit(1.0)).alias("usual_days"))
    idle = (F.lit(as_of_us) - micros("last_ts")) / F.lit(float(DAY_US))
    return (
        seen.join(usual, "user_id")
        .withColumn("idle_days", idle)
        .where(F.col("idle_days") > F.col("usual_days") * factor)
    )


def score_stream(events: DataFrame, users: DataFrame, model: ChurnModel) -> DataFrame:
    """Every event with the current churn score of its user; null for an unknown user.

    Users are scored once per batch, not once per event, and the join is a stream–static left join on
    the user, whose hot partitions adaptive execution splits: no state is kept.
    """
    scored = model.probabilities(users).select("user_id", "churn_probability")
    return events.join(scored, "user_id", "left").select("event_id", "user_id", "ts", "event_type", "churn_probability")


# ---- running a stream to its current end ----------------------------------------------------------

def drain(df: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Run all available input; returns the folder of the result table.

    Files and checkpoint live in the shared folder, so a restarted query goes on where it stopped.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", f"{path}-state")
    if each is not None:
        writer = writer.foreachBatch(each)
        query: StreamingQuery = writer.start()
    else:
        query = writer.format("parquet").option("path", path).start()
    query.awaitTermination()
    return path


def drain_updates(df: DataFrame, name: str, key: str | list[str]) -> DataFrame:
    """Latest row per key of an update-mode stream: each batch is written once, under its number.

    Windows that are still open are part of the result, as far as they have come.
    """
    keys = [key] if isinstance(key, str) else list(key)
    path = scratch_path(df.sparkSession, f"{name}-rows")

    def each(batch: DataFrame, number: int) -> None:
        # the same batch after a restart replaces its own files
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    drain(df, name, each, mode="update")
    rows = df.sparkSession.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def ticker_stream(events: DataFrame, name: str = "ticker", n: int = 20) -> DataFrame:
    """Newest events: each batch leaves at most `n` rows, the reader takes the newest of them."""
    path = scratch_path(events.sparkSession, f"{name}-rows")

    def each(batch: DataFrame, number: int) -> None:
        ticker(batch, n).write.mode("overwrite").parquet(f"{path}/batch={number}")

    drain(events, name, each)
    return ticker(events.sparkSession.read.parquet(path).drop("batch"), n)


def ticker(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc(F.col("event_id").cast("bigint"))).limit(n)
