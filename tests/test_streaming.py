"""Streams drained to their end against the same functions on the bounded table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from holdfast.streaming import events as ev


@pytest.fixture(scope="module")
def bounded(spark):
    return ev.batch_events(spark, FOLDER)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_dedupe(spark, bounded):
    stream = ev.read_events(spark, FOLDER)
    got = spark.read.parquet(ev.drain(ev.dedupe(stream.unionByName(stream)), "t-dedupe"))
    assert got.count() == ev.dedupe(bounded.unionByName(bounded)).count() == bounded.count()


def test_closed_windows_equal_the_batch(spark, bounded):
    got = spark.read.parquet(ev.drain(ev.event_counts(ev.read_events(spark, FOLDER)), "t-counts"))
    mark = bounded.agg((F.max("ts") - F.expr("interval 1 hour")).alias("m")).first()["m"]
    want = ev.event_counts(bounded).where(F.col("day_end") <= F.lit(mark))
    cols = ["day_start", "event_type", "events"]
    assert rows(got.select(cols)) == rows(want.select(cols))


def test_open_windows_come_out_in_update_mode(spark, bounded):
    got = ev.drain_updates(ev.event_counts(ev.read_events(spark, FOLDER)), "t-open", ["day_start", "event_type"])
    cols = ["day_start", "event_type", "events"]
    assert rows(got.select(cols)) == rows(ev.event_counts(bounded).select(cols))


def test_ledger_is_the_sum_of_weights(spark, bounded):
    weights = {"purchase": -0.5, "error": 0.25}
    got = ev.drain_updates(ev.risk_ledger(ev.read_events(spark, FOLDER), weights), "t-ledger", "user_id")
    assert rows(got.select("user_id", "churn_delta", "events")) == rows(ev.risk_ledger(bounded, weights).select("user_id", "churn_delta", "events"))


def test_ledger_goes_on_after_a_restart(spark, bounded, tmp_path):
    """Two runs over a growing folder leave the same state as one run over all files."""
    raw = spark.read.parquet(f"{FOLDER}/events.parquet")
    folder, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")
    for part in (0, 1):
        raw.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(folder)
        stream = ev._typed(spark.readStream.schema(ev.EVENT_SCHEMA).parquet(folder))
        query = (
            ev.risk_ledger(stream, {"error": 1.0})
            .writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", state)
            .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    got = spark.read.parquet(out).groupBy("user_id").agg(F.max_by("events", "batch").alias("events"))
    assert rows(got) == rows(ev.risk_ledger(bounded, {"error": 1.0}).select("user_id", "events"))


def test_ticker(spark, bounded):
    got = ev.ticker_stream(ev.read_events(spark, FOLDER))
    assert rows(got) == rows(ev.ticker(bounded)) and got.count() == 20


def test_alerts(spark, bounded):
    users = bounded.select("user_id").distinct().withColumn("ipi_median", F.lit(0.0))
    seen = ev.last_seen(bounded)
    latest = seen.agg(F.max(F.unix_micros("last_ts"))).first()[0]
    got = ev.ipi_alerts(seen, users, latest, 2.0)
    assert all(r["idle_days"] > 2.0 for r in got.collect())
