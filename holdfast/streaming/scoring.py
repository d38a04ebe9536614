"""Scores that follow live events: a versioned score table, a watch on the registry, refits on drift."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import drift
from holdfast.operators.learners import ChurnModel
from holdfast.session import hold, release_of, small_table
from holdfast.sources.registry import ModelRegistry

_SCORES = "user_id string, churn_probability double, version string, batch bigint"
_EPOCHS = "batch bigint, version string, refit string, status string"


@dataclass
class DriftWatch:
    """When to fit anew: the columns compared, the baseline they are compared with, and the fit.

    `refit` takes the current users and returns a model, or None to keep the old one. The baseline is
    a folder written by `drift.save_baseline`; a refit replaces it with the users it was called for.
    """

    columns: list[str]
    baseline: str
    refit: Callable[[DataFrame], ChurnModel | None]
    statuses: tuple[str, ...] = ("HIGH DRIFT",)


class LiveScores:
    """Scores of the users that have events, one per user and model version.

    Everything lies under one shared folder, and every batch writes under its own number, so a batch
    that runs again after a failure replaces what it had written: `scores/version=V/batch=N` holds the
    users first seen under V in batch N, `events/batch=N` the scored events, `epochs/batch=N` the version
    a batch was bound to. A batch binds itself to the newest version of the registry when it
    first starts; a version saved meanwhile is used from the next batch on.
    """

    def __init__(
        self, users: DataFrame | Callable[[], DataFrame], registry: ModelRegistry, model_id: str, root: str, watch: DriftWatch | None = None
    ):
        self.users = users if callable(users) else lambda: users
        self.registry, self.model_id, self.root, self.watch = registry, model_id, root.rstrip("/"), watch
        self.spark: SparkSession = registry.spark
        self._model: tuple[str, ChurnModel] | None = None

    # -- tables ------------------------------------------------------------------------------------

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", self.root).parquet(path)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def scores(self, version: str | None = None) -> DataFrame:
        """(user_id, churn_probability, version, batch); all versions unless one is named."""
        try:
            found = self.spark.read.parquet(f"{self.root}/scores")
        except AnalysisException:
            return self.spark.createDataFrame([], _SCORES)
        found = found.select("user_id", "churn_probability", F.col("version").cast("string").alias("version"), F.col("batch").cast("bigint").alias("batch"))
        return found if version is None else found.where(F.col("version") == version)

    def epochs(self) -> DataFrame:
        return self._read(f"{self.root}/epochs/*", _EPOCHS)

    def scored_events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/events").drop("batch")

    # -- one batch ---------------------------------------------------------------------------------

    def _bound(self, number: int) -> tuple[str | None, bool]:
        """Version of a batch, and whether an earlier attempt has refitted already."""
        own = self.epochs().where(F.col("batch") == number).orderBy(F.col("refit").isNull()).first()
        if own is not None:
            return own["version"], own["refit"] is not None
        newest = self.registry.list().where((F.col("model_id") == self.model_id) & (F.col("age") == 1)).first()
        version = newest["version"] if newest else None
        self._note(number, version, None, None, "bound")
        return version, False

    def _note(self, number: int, version: str | None, refit: str | None, status: str | None, step: str) -> None:
        row = small_table(self.spark, [(number, version, refit, status)], _EPOCHS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/epochs/{step}-{number}")

    def _model_of(self, version: str) -> ChurnModel:
        if self._model is None or self._model[0] != version:
            self._model = (version, self.registry.load(version))
        return self._model[1]

    def each(self, batch: DataFrame, number: int) -> None:
        """The body of `foreachBatch`."""
        version, refitted = self._bound(number)
        batch = hold(batch)
        current = self.users().join(batch.select("user_id").distinct(), "user_id", "left_semi")
        if version is None:
            scored = batch.withColumn("churn_probability", F.lit(None).cast("double"))
        else:
            # scores that this batch wrote in an earlier attempt are made again
            known = self.scores(version).where(F.col("batch") != number)
            fresh = current.join(known.select("user_id"), "user_id", "left_anti")
            made = self._model_of(version).probabilities(fresh).select("user_id", "churn_probability")
            made.write.mode("overwrite").parquet(f"{self.root}/scores/version={version}/batch={number}")
            own = self.scores(version).where(F.col("batch") <= number).select("user_id", "churn_probability")
            scored = batch.join(own, "user_id", "left")
        out = scored.select("event_id", "user_id", "ts", "event_type", "churn_probability", F.lit(version).alias("version"))
        out.write.mode("overwrite").parquet(f"{self.root}/events/batch={number}")
        if self.watch is not None and not refitted:
            self._watched(current, number, version)
        release_of(batch)

    def _watched(self, current: DataFrame, number: int, version: str | None) -> None:
        """Compare the users of a batch with the baseline; on drift fit anew and save a version."""
        watch = self.watch
        found = drift.baseline_drift(current, drift.load_baseline(self.spark, watch.baseline), watch.columns)
        if found is None:
            drift.save_baseline(current, watch.columns, watch.baseline)
            return
        status = drift.drift_summary(found).first()["status"]
        saved = None
        if status in watch.statuses:
            model = watch.refit(current)
            if model is not None:
                saved = self.registry.save(model, self.model_id)
                drift.save_baseline(current, watch.columns, watch.baseline)
        self._note(number, version, saved, status, "drift")

    def run(self, events: DataFrame, name: str = "live-scores") -> None:
        """Score all available events; the checkpoint lies with the tables, so a new call goes on there."""
        query = (
            events.writeStream.trigger(availableNow=True)
            .option("checkpointLocation", f"{self.root}/{name}-state")
            .foreachBatch(self.each)
            .start()
        )
        query.awaitTermination()


def live_scores(
    events: DataFrame, users: DataFrame, registry: ModelRegistry, model_id: str, root: str, watch: DriftWatch | None = None
) -> LiveScores:
    """Run a stream to its current end and return its score table."""
    done = LiveScores(users, registry, model_id, root, watch)
    done.run(events)
    return done
