"""Saved models with their metrics and feature schema."""

from __future__ import annotations

import json
import time

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.operators.learners import ChurnModel
from holdfast.session import shared_folder, small_table

_ENTRY = (
    "model_id string, version string, saved_at bigint, model string, threshold double, "
    "features array<string>, schema_hash string, metrics string, path string, roles array<string>"
)
KEPT_PER_ID, KEPT_WITHOUT_ID = 3, 5


def schema_hash(features: Column) -> Column:
    """SHA-256 of the sorted, comma-joined feature names."""
    return F.sha2(F.concat_ws(",", F.array_sort(features)), 256)


class ModelRegistry:
    """Versions of fitted models under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_folder(spark)}/holdfast/models").rstrip("/")

    @property
    def _log(self) -> str:
        return f"{self.root}/log"

    def save(self, model: ChurnModel, model_id: str = "") -> str:
        """Write every fitted stage, append one row to the log, and delete the versions it displaces."""
        at = time.time_ns() // 1000
        version = f"{model_id or 'model'}_v{at}"
        path = f"{self.root}/{version}"
        stages = [("base", b) for b in model.bases] + [("meta", model.meta), ("calibrator", model.calibrator)]
        stages = [(role, stage) for role, stage in stages if stage is not None]
        PipelineModel(stages=[stage for _, stage in stages]).write().overwrite().save(path)
        row = (model_id, version, at, model.name, float(model.threshold), model.features,
               None, json.dumps(model.metrics, default=str), path, [role for role, _ in stages])
        entry = small_table(self.spark, [row], _ENTRY).withColumn("schema_hash", schema_hash(F.col("features")))
        entry.coalesce(1).write.mode("append").parquet(self._log)
        self._prune(model_id)
        return version

    def _prune(self, model_id: str) -> None:
        """Delete the folders of versions that are no longer listed."""
        kept = KEPT_PER_ID if model_id else KEPT_WITHOUT_ID
        mine = self.entries().where(F.col("model_id") == model_id)
        for row in mine.orderBy(F.desc("saved_at"), F.desc("version")).select("path").collect()[kept:]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(row["path"])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def entries(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(_ENTRY).parquet(self._log)
        except AnalysisException:
            return self.spark.createDataFrame([], _ENTRY)

    def list(self) -> DataFrame:
        """Kept versions, newest first per id."""
        newest = W.partitionBy("model_id").orderBy(F.desc("saved_at"), F.desc("version"))
        ranked = self.entries().withColumn("age", F.row_number().over(newest))
        kept = F.when(F.col("model_id") == "", KEPT_WITHOUT_ID).otherwise(KEPT_PER_ID)
        return ranked.where(F.col("age") <= kept)

    def load_latest(self, model_id: str, features: list[str] | None = None) -> ChurnModel | None:
        """Newest version of the id, or None if there is none or its feature schema differs."""
        row = self.list().where((F.col("model_id") == model_id) & (F.col("age") == 1)).first()
        if row is None:
            return None
        if features is not None:
            wanted = self.spark.range(1).select(schema_hash(F.array(*[F.lit(f) for f in features]))).first()[0]
            if wanted != row["schema_hash"]:
                return None
        return self._loaded(row)

    def load(self, version: str) -> ChurnModel:
        """A kept version by its name."""
        row = self.entries().where(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"unknown model version {version}")
        return self._loaded(row)

    def _loaded(self, row: Row) -> ChurnModel:
        parts: dict[str, list] = {"base": [], "meta": [None], "calibrator": [None]}
        for role, stage in zip(row["roles"], PipelineModel.load(row["path"]).stages):
            parts[role].append(stage)
        return ChurnModel(
            row["model"], list(row["features"]), parts["base"], parts["meta"][-1], parts["calibrator"][-1],
            threshold=row["threshold"], metrics=json.loads(row["metrics"]),
        )
