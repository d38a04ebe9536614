"""Versioned scores over a stream of several batches: bound versions, refits, restarts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from holdfast.operators import drift, learners
from holdfast.sources.registry import ModelRegistry
from holdfast.streaming import events as ev
from holdfast.streaming.scoring import DriftWatch, LiveScores

NAMES = ["recency", "frequency"]


@pytest.fixture(scope="module")
def users(spark):
    rows = [(str(i), float(i % 30), float(i % 7), int(i % 30 > 15)) for i in range(300)]
    return spark.createDataFrame(rows, "user_id string, recency double, frequency double, churned int").cache()


@pytest.fixture(scope="module")
def fits(users):
    learn = learners.weighted(learners.assemble(users, NAMES)).cache()
    return [learners.ChurnModel(f"m{k}", NAMES, [learners.fit_rf(learn, numTrees=k, maxDepth=2)]) for k in (1, 3)]


def stream(spark, path, parts, start=0):
    """One file, hence one batch, per list of users."""
    at = dt.datetime(2024, 1, 1)
    for i, own in enumerate(parts, start):
        rows = [(1000 * i + n, at + dt.timedelta(hours=i), u, "view", 1.0, None) for n, u in enumerate(own)]
        spark.createDataFrame(rows, ev.EVENT_SCHEMA).coalesce(1).write.parquet(f"{path}/part{i:03d}")
    raw = spark.readStream.schema(ev.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    return ev._typed(raw)


def test_a_version_saved_meanwhile_is_used_from_the_next_batch(spark, users, fits, tmp_path):
    store = ModelRegistry(spark, str(tmp_path / "models"))
    first = store.save(fits[0], "x")
    later = []

    class Saves(LiveScores):
        def each(self, batch, number):
            super().each(batch, number)
            if number == 1:
                later.append(store.save(fits[1], "x"))

    events = stream(spark, str(tmp_path / "in"), [[1, 2, 2, 999], [2, 3], [1, 2], [2, 3, 4]])
    table = Saves(users, store, "x", str(tmp_path / "out"))
    table.run(events)
    table.run(events)  # nothing is left to do
    got = sorted((r.user_id, r.version, r.batch) for r in table.scores().collect())
    assert got == sorted([("1", first, 0), ("2", first, 0), ("3", first, 1), ("1", later[0], 2), ("2", later[0], 2), ("3", later[0], 3), ("4", later[0], 3)])
    want = {v: {r.user_id: r.p for r in m.probabilities(users, "p").collect()} for v, m in zip([first, later[0]], fits)}
    rows = table.scored_events().collect()
    assert len(rows) == 11
    for r in rows:
        assert r.version == (first if int(r.event_id) < 2000 else later[0])
        assert r.churn_probability == (None if r.user_id == "999" else pytest.approx(want[r.version][r.user_id]))


def test_a_batch_that_runs_again_keeps_its_version(spark, users, fits, tmp_path):
    store = ModelRegistry(spark, str(tmp_path / "models"))
    first = store.save(fits[0], "x")
    table = LiveScores(users, store, "x", str(tmp_path / "out"))
    batch = ev._typed(spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 5, "view", 1.0, None)], ev.EVENT_SCHEMA))
    table.each(batch, 0)
    store.save(fits[1], "x")
    table.each(batch, 0)
    assert [(r.user_id, r.version, r.batch) for r in table.scores().collect()] == [("5", first, 0)]
    assert table.scored_events().count() == 1


def test_no_model_yet(spark, users, tmp_path):
    table = LiveScores(users, ModelRegistry(spark, str(tmp_path / "models")), "x", str(tmp_path / "out"))
    table.run(stream(spark, str(tmp_path / "in"), [[1, 2]]))
    assert table.scores().count() == 0
    assert {(r.churn_probability, r.version) for r in table.scored_events().collect()} == {(None, None)}


def test_drift_starts_a_fit_once(spark, users, fits, tmp_path):
    store = ModelRegistry(spark, str(tmp_path / "models"))
    first = store.save(fits[0], "x")
    drift.save_baseline(users, NAMES, str(tmp_path / "base"))
    called = []

    def refit(current):
        called.append(current.count())
        return fits[1]

    moved = users.withColumn("recency", F.when(F.col("user_id").cast("int") >= 150, F.col("recency") + 500).otherwise(F.col("recency")))
    moved = moved.withColumn("frequency", F.when(F.col("user_id").cast("int") >= 150, F.col("frequency") + 90).otherwise(F.col("frequency")))
    table = LiveScores(lambda: moved, store, "x", str(tmp_path / "out"), DriftWatch(NAMES, str(tmp_path / "base"), refit))
    parts = [list(range(150)), list(range(150, 300)), list(range(150, 300)), [200]]
    table.run(stream(spark, str(tmp_path / "in"), parts))
    seen = {r.batch: (r.version, r.refit, r.status) for r in table.epochs().where("status is not null").collect()}
    assert called == [150] and seen[0][2] == "STABLE" and seen[1][2] == "HIGH DRIFT"
    second = seen[1][1]
    assert second and second != first and seen[2] == (second, None, "STABLE")
    versions = {(int(r.event_id) // 1000, r.version) for r in table.scored_events().collect()}
    assert versions == {(0, first), (1, first), (2, second), (3, second)}
    twice = table.scores().groupBy("user_id", "version").count().where("count > 1")
    assert twice.count() == 0
