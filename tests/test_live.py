"""Keyed state over streams cut in several ways, against the same figures of the bounded table."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from holdfast.functions.columns import DAY_US
from holdfast.operators import features as ft
from holdfast.sources import fixtures as fx
from holdfast.streaming import events as ev
from holdfast.streaming import live

START = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()))


def folder_of(spark, made, cuts, path):
    """A stream of the events in files of their order of arrival, one file a batch."""
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(made)])):
        part = spark.createDataFrame([(n, *made[n], "view", 1.0 + n % 7, None) for n in range(a, b)], ev.EVENT_SCHEMA)
        part.coalesce(1).write.parquet(f"{path}/part{i:03d}")
    raw = spark.readStream.schema(ev.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    return ev._typed(raw)


def arrivals(seed, n=240, users=5, days=60, late_hours=20):
    """Events of a few users that arrive up to `late_hours` out of order."""
    rnd = random.Random(seed)
    times = sorted((rnd.uniform(0, days) if rnd.random() < 0.7 else days / 2, rnd.randrange(users)) for _ in range(n))
    order = sorted(times, key=lambda t: t[0] + rnd.uniform(0, late_hours / 24))
    return [(START + dt.timedelta(days=t), u) for t, u in order]


@pytest.mark.parametrize("cuts", [[], [60, 61, 120, 200]])
def test_idle_alerts_do_not_depend_on_the_batches(spark, tmp_path, cuts):
    made = arrivals(3)
    stream = folder_of(spark, made, cuts, str(tmp_path / "in"))
    users = spark.createDataFrame([(str(u), 0.2 + u) for u in range(4)], "user_id string, ipi_median double")
    found = live.idle_alerts(stream, users, 1.5, "1 day")
    bounded = ev._typed(spark.read.option("recursiveFileLookup", True).schema(ev.EVENT_SCHEMA).parquet(str(tmp_path / "in")))
    got = spark.read.parquet(ev.drain(found, "t-idle", mode="append") if not cuts else drained(spark, found, tmp_path))
    until = live.final_watermark(bounded, DAY_US)
    want = rows(live.idle_periods(bounded, users, 1.5, until))
    assert rows(got) == want and want
    brute = set()
    for u in range(4):
        own = sorted((t - START) // dt.timedelta(microseconds=1) for t, w in made if w == u)
        limit = int(max(0.2 + u, 1.0) * 1.5 * DAY_US)
        end = until - int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6
        for a, b in zip(own, [*own[1:], None]):
            if a <= end and (a + limit <= end if b is None or b > end else b - a > limit):
                brute.add((str(u), a))
    assert {(r.user_id, (r.last_ts - START) // dt.timedelta(microseconds=1)) for r in got.collect()} == brute


def drained(spark, df, tmp_path):
    """Run once, stop, and go on from the checkpoint: state and timers survive."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        query = df.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).format("parquet").option("path", out).start()
        query.awaitTermination()
    return out


def same(got, want, cols):
    a, b = ({r.user_id: r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys()
    for user in a:
        for c in cols:
            assert a[user][c] == pytest.approx(b[user][c], rel=1e-9, abs=1e-9), (user, c)


FEATURES = ["frequency", "monetary", "avg_basket_value", "monetary_std", "max_spend", "min_spend", "recency", "account_age_days",
            "ipi_median", "ipi_std", "ipi_consistency", "recency_deviation", "monetary_velocity"]


def test_live_features_equal_the_user_table(spark):
    newest = ev.drain_updates(live.live_activity(ev.read_events(spark, FOLDER)), "t-live", "user_id")
    tx = fx.events_tx(spark, FOLDER)
    last = tx.agg(F.max(F.unix_micros("timestamp"))).first()[0]
    same(live.live_features(newest, last), ft.rfm(tx), FEATURES)


@pytest.mark.parametrize("cuts", [[30, 90, 91, 180]])
def test_live_features_of_late_events(spark, tmp_path, cuts):
    made = arrivals(8, late_hours=40) + [(START + dt.timedelta(days=61), 9)]
    stream = folder_of(spark, made, cuts, str(tmp_path / "in"))
    bounded = spark.read.option("recursiveFileLookup", True).schema(ev.EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    newest = ev.drain_updates(live.live_activity(stream, "2 days"), "t-late", "user_id")
    tx = ev._typed(bounded).select("user_id", F.col("ts").alias("timestamp"), F.col("value").alias("amount"))
    last = tx.agg(F.max(F.unix_micros("timestamp"))).first()[0]
    same(live.live_features(newest, last), ft.rfm(tx), FEATURES)


def test_a_forgotten_user_starts_anew(spark, tmp_path):
    made = [(START + dt.timedelta(days=d), u) for d, u in [(0, 1), (1, 1), (40, 2), (80, 2), (81, 1), (82, 2)]]
    stream = folder_of(spark, made, [2, 3, 4, 5], str(tmp_path / "in"))
    newest = ev.drain_updates(live.live_activity(stream, "0 seconds", forget_days=30), "t-forget", "user_id")
    got = {r.user_id: (r.events, r.gaps) for r in newest.collect()}
    assert got["1"] == (1, []) and got["2"][0] == 3


def test_limits_are_longer_than_a_minute(spark):
    with pytest.raises(ValueError):
        live.limits(spark.createDataFrame([("1", 1.0)], "user_id string, ipi_median double"), 1e-5)
