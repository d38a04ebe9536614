"""Clustering and churn models on the user table, fitted with Spark ML.

The reference learners have no distributed twin of the same name: the two boosted candidates are
two settings of the gradient-boosted trees, the forest is balanced through row weights.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.order import dealt_order, draw, facts
from holdfast.operators import evaluation as ev
from holdfast.operators.labels import feature_names, folds, split3
from holdfast.session import cut_lineage, hold, small_table

SEED = 42
#: Users whose silhouette is measured, and rows that meet them at a time in a task.
SILHOUETTE_POINTS, _SILHOUETTE_BLOCK = 5000, 256
FEATURES, LABEL, WEIGHT = "_features", "label", "_weight"
#: Fewer rows than these do not carry the step: tuning, its three folds, calibration (rows of each
#: class), the isotonic map, stacking, and each fold of the cross-validated AUC.
TUNE_ROWS, TUNE_CLASS, THREE_FOLDS_FROM = 100, 5, 1000
CALIBRATE_CLASS, ISOTONIC_FROM = 30, 500
STACK_ROWS, FOLD_ROWS = 300, 10
#: Independent fits that run at a time.
FITS_AT_ONCE = 4

RF_PARAMS = {"numTrees": 200, "maxDepth": 15}
GBT_PARAMS = {
    "Boosted Trees": {"maxIter": 200, "maxDepth": 10, "stepSize": 0.05},
    "Boosted Trees (subsampled)": {
        "maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
    },
}


# ---- F1, F2 --------------------------------------------------------------------------------------

def fit_clusters(users: DataFrame, k: int = 4):
    """The fitted K-means and the users with their standardised values (`_scaled`)."""
    scaled = _scaled(users)
    return KMeans(k=k, seed=SEED, featuresCol="_scaled", predictionCol="cluster").fit(scaled), scaled


def clusters(users: DataFrame, k: int = 4) -> DataFrame:
    """K-means on standardised recency, frequency and monetary."""
    n = facts(users, n=F.count(F.lit(1)))["n"]
    if n < 2:
        return users.withColumn("cluster", F.lit(0))
    model, scaled = fit_clusters(users, min(k, n))
    return model.transform(scaled).drop("_rfm", "_scaled")


def _scaled(users: DataFrame) -> DataFrame:
    vector = VectorAssembler(inputCols=["recency", "frequency", "monetary"], outputCol="_rfm")
    rows = hold(vector.transform(users))
    scaler = StandardScaler(inputCol="_rfm", outputCol="_scaled", withMean=True).fit(rows)
    return scaler.transform(rows)


def silhouette(clustered: DataFrame) -> DataFrame:
    """Squared-Euclidean silhouette of all users; linear in the rows, so nothing is sampled."""
    evaluator = ClusteringEvaluator(featuresCol="_scaled", predictionCol="cluster")
    value = evaluator.evaluate(_scaled(clustered)) if clustered.select("cluster").distinct().count() > 1 else 0.0
    return small_table(clustered.sparkSession, [(float(value),)], "silhouette double")


def silhouette_euclidean(clustered: DataFrame, points: int = SILHOUETTE_POINTS) -> DataFrame:
    """Silhouette with plain Euclidean distances: the mean over `points` users, drawn by the digest of
    their ids, each measured against all users.

    Distances cannot be summed up without the points, so the drawn points (at most `points` rows of
    three numbers) travel with the tasks; a task adds up its distances per point and cluster and gives
    back one row for each. Work is points times users; with at most `points` users it is the exact
    figure. A point alone in its cluster counts 0, a single cluster gives 0. Rows without a value in
    one of the three columns take no part.
    """
    spark = clustered.sparkSession
    cols = ["recency", "frequency", "monetary"]
    seen = facts(clustered.dropna(subset=cols),
                 **{f"m_{c}": F.avg(c) for c in cols}, **{f"s_{c}": F.stddev_samp(c) for c in cols})

    def scaled(c: str):
        return ((F.col(c).cast("double") - F.lit(seen[f"m_{c}"])) / F.lit(seen[f"s_{c}"] or 1.0)).alias(c)

    rows = hold(clustered.dropna(subset=cols).select("user_id", F.col("cluster").cast("int").alias("cluster"), *map(scaled, cols)))
    sizes = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().collect()}
    if len(sizes) < 2:
        return small_table(spark, [(0.0,)], "silhouette double")
    last = draw(rows, min(points, sum(sizes.values())))
    drawn = rows.where(dealt_order("user_id") <= F.lit(last)).toPandas()
    at, names = drawn[cols].to_numpy(dtype="float64"), np.array(sorted(sizes))

    def sums(batches):
        total = np.zeros((len(names), len(at)))
        for batch in batches:
            for start in range(0, len(batch), _SILHOUETTE_BLOCK):
                part = batch.iloc[start : start + _SILHOUETTE_BLOCK]
                away = part[cols].to_numpy(dtype="float64")[:, None, :] - at[None, :, :]
                member = part["cluster"].to_numpy()[None, :] == names[:, None]
                total += member.astype("float64") @ np.sqrt((away * away).sum(axis=2))
        for i, name in enumerate(names):
            yield pd.DataFrame({"point": np.arange(len(at), dtype="int32"), "other": int(name), "total": total[i]})

    far = rows.select("cluster", *cols).mapInPandas(sums, "point int, other int, total double")
    far = far.groupBy("point", "other").agg(F.sum("total").alias("total"))
    owners = [(i, int(c)) for i, c in enumerate(drawn["cluster"])]
    far = far.join(F.broadcast(small_table(spark, owners, "point int, own int")), "point")
    counts = F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair])
    size, mine = counts[F.col("other")], F.col("own") == F.col("other")
    each = far.groupBy("point").agg(
        F.max(F.when(mine, size)).alias("n"),
        F.max(F.when(mine & (size > 1), F.col("total") / (size - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / size)).alias("b"),
    )
    most = F.greatest("a", "b")
    value = F.when((F.col("n") == 1) | (most == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / most)
    return each.agg(F.avg(value).alias("silhouette"))


# ---- F5 ------------------------------------------------------------------------------------------

def assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Feature vector of exactly these columns: missing columns and values are 0."""
    filled = df.withColumns(
        {
            f"_x_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
            if c in df.columns
            else F.lit(0.0)
            for c in cols
        }
    )
    vector = VectorAssembler(inputCols=[f"_x_{c}" for c in cols], outputCol=FEATURES, handleInvalid="keep")
    return vector.transform(filled).drop(*[f"_x_{c}" for c in cols])


def weighted(rows: DataFrame) -> DataFrame:
    """Label as double and a weight that gives both classes the same total."""
    seen = facts(rows, n=F.count(F.lit(1)), pos=F.sum("churned"))
    n, pos = seen["n"], seen["pos"] or 0
    heavy = n / (2.0 * max(pos, 1)), n / (2.0 * max(n - pos, 1))
    return rows.withColumns(
        {
            LABEL: F.col("churned").cast("double"),
            WEIGHT: F.when(F.col("churned") == 1, heavy[0]).otherwise(heavy[1]),
        }
    )


# ---- F7, F8 --------------------------------------------------------------------------------------

def forest(**params) -> RandomForestClassifier:
    options = {**RF_PARAMS, **params}
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, seed=SEED, **options)


def boosted(name: str = "Boosted Trees", **params) -> GBTClassifier:
    options = {**GBT_PARAMS[name], **params}
    return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, seed=SEED, **options)


def fit_rf(train: DataFrame, **params):
    return forest(**params).fit(train)


def fit_gbt(train: DataFrame, name: str = "Boosted Trees", **params):
    return boosted(name, **params).fit(train)


def side_by_side(spark, fits: Sequence[Callable[[], object]]) -> list:
    """Results of independent fits, in their order. A boosted fit is a row of short jobs, a few for every
    tree, which leave cores idle between them: other fits use these."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return [turn.result() for turn in [pool.submit(inheritable_thread_target(spark)(fit)) for fit in fits]]


# ---- F18 and the trained model -------------------------------------------------------------------

@dataclass
class ChurnModel:
    """A fitted candidate with its features, optional meta-learner, calibrator and threshold."""

    name: str
    features: list[str]
    bases: list  # one fitted classifier, or the stacked ones in order
    meta: object | None = None
    calibrator: object | None = None
    threshold: float = 0.5
    metrics: dict = field(default_factory=dict)

    @property
    def base(self):
        return self.bases[0]

    def probabilities(self, df: DataFrame, name: str = "churn_probability") -> DataFrame:
        """Score every row; the whole chain stays inside the JVM."""
        df = df.drop(name)
        rows = assemble(df, self.features)
        keep = df.columns
        for i, base in enumerate(self.bases):
            rows = _positive(base.transform(rows), f"_p{i}")
        rows = rows.drop(FEATURES)
        if self.meta is not None:
            names = [f"_p{i}" for i in range(len(self.bases))]
            stacked = VectorAssembler(inputCols=names, outputCol="_stack").transform(rows)
            rows = _positive(self.meta.transform(stacked), "_raw").drop("_stack")
        else:
            rows = rows.withColumnRenamed("_p0", "_raw")
        rows = apply_calibrator(self.calibrator, rows, "_raw", name)
        return rows.select(*keep, name)


def _positive(df: DataFrame, name: str) -> DataFrame:
    p = vector_to_array("probability")[1]
    return df.withColumn(name, p).drop("rawPrediction", "probability", "prediction")


def score(model: ChurnModel, users: DataFrame) -> DataFrame:
    return model.probabilities(users)


def labelled_scores(model: ChurnModel, rows: DataFrame) -> DataFrame:
    out = model.probabilities(rows.select("user_id", "churned", *model.features), "p")
    return hold(out.select("user_id", "p", F.col("churned").alias("label")))


# ---- F9 ------------------------------------------------------------------------------------------

def tune(train: DataFrame, rf: dict | None = None, gbt: dict | None = None, parallelism: int = 4) -> dict:
    """Best settings by cross-validated AUC; empty when there is too little to tune on.

    `train` carries `_features`, `label`, `_weight`, `user_id` and `churned`.
    """
    seen = facts(train, n=F.count(F.lit(1)), pos=F.sum("churned"))
    if seen["n"] < TUNE_ROWS or min(seen["pos"], seen["n"] - seen["pos"]) < TUNE_CLASS:
        return {}
    k = 3 if seen["n"] >= THREE_FOLDS_FROM else 2
    rows = hold(folds(train, k))
    area = BinaryClassificationEvaluator(labelCol=LABEL, metricName="areaUnderROC")
    best = {}
    rf_model = forest(minInstancesPerNode=5, **(rf or {}))
    rf_grid = ParamGridBuilder().addGrid(rf_model.maxDepth, [10, 20]).build()
    gbt_model = boosted(**(gbt or {}))
    gbt_grid = (
        ParamGridBuilder()
        .addGrid(gbt_model.maxIter, [gbt["maxIter"]] if gbt and "maxIter" in gbt else [100, 200])
        .addGrid(gbt_model.stepSize, [0.05, 0.1])
        .build()
    )
    if rf and "maxDepth" in rf:
        rf_grid = ParamGridBuilder().addGrid(rf_model.maxDepth, [max(2, rf["maxDepth"] // 2), rf["maxDepth"]]).build()
    for key, model, grid in (("rf", rf_model, rf_grid), ("gbt", gbt_model, gbt_grid)):
        search = CrossValidator(
            estimator=model, estimatorParamMaps=grid, evaluator=area, numFolds=k, foldCol="fold",
            seed=SEED, parallelism=parallelism,
        ).fit(rows)
        at = max(range(len(grid)), key=lambda i: search.avgMetrics[i])
        best[key] = {p.name: v for p, v in grid[at].items()}
        best[f"{key}_auc"] = float(search.avgMetrics[at])
    return best


# ---- F11 -----------------------------------------------------------------------------------------

def fit_stack(train: DataFrame, learners: Sequence, fitted: Sequence, k: int = 3):
    """Logistic regression over out-of-fold probabilities of the base learners.

    Each of the k rounds is a full distributed fit; the out-of-fold rows are cut from their
    lineage before the meta-learner iterates over them.
    """
    rows = hold(folds(train, k))
    rounds = [(learner, rows.where(F.col("fold") != fold)) for fold in range(k) for learner in learners]
    made = side_by_side(train.sparkSession, [partial(learner.copy().fit, inside) for learner, inside in rounds])
    parts = []
    for fold in range(k):
        scored = rows.where(F.col("fold") == fold)
        for i in range(len(learners)):
            scored = _positive(made[fold * len(learners) + i].transform(scored), f"_p{i}")
        parts.append(scored.select(LABEL, *[f"_p{i}" for i in range(len(learners))]))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    names = [f"_p{i}" for i in range(len(learners))]
    stacked = VectorAssembler(inputCols=names, outputCol="_stack").transform(cut_lineage(out, "stack"))
    meta = LogisticRegression(featuresCol="_stack", labelCol=LABEL, maxIter=100).fit(stacked)
    return list(fitted), meta


# ---- F12 -----------------------------------------------------------------------------------------

def calibrate(raw: DataFrame):
    """Isotonic (ISOTONIC_FROM rows and more) or sigmoid map of raw scores, or None with too few rows
    of a class.

    `raw` has `p` and `label`. Rows are counted per distinct score first: a forest has at most as many
    scores as combinations of leaves that occur.
    """
    seen = facts(raw, n=F.count(F.lit(1)), pos=F.sum("label"))
    if min(seen["pos"] or 0, seen["n"] - (seen["pos"] or 0)) < CALIBRATE_CLASS:
        return None
    points = raw.groupBy(F.col("p").alias("_point")).agg(
        F.avg(F.col("label").cast("double")).alias("share"), F.count(F.lit(1)).cast("double").alias("n")
    )
    points = cut_lineage(points, "calibration")
    if seen["n"] >= ISOTONIC_FROM:
        return IsotonicRegression(
            featuresCol="_point", labelCol="share", weightCol="n", predictionCol="_mapped"
        ).fit(points)
    sides = points.selectExpr("_point", "stack(2, 1.0D, n * share, 0.0D, n * (1 - share)) as (label, n)").where("n > 0")
    vector = VectorAssembler(inputCols=["_point"], outputCol="_v").transform(sides)
    return LogisticRegression(featuresCol="_v", labelCol="label", weightCol="n").fit(vector)


def apply_calibrator(calibrator, df: DataFrame, raw: str, name: str) -> DataFrame:
    if calibrator is None:
        return df.withColumnRenamed(raw, name)
    if calibrator.__class__.__name__.startswith("Isotonic"):
        rows = calibrator.transform(df.withColumnRenamed(raw, "_point"))
        return rows.drop("_point").withColumnRenamed("_mapped", name)
    vector = VectorAssembler(inputCols=[raw], outputCol="_v").transform(df)
    return _positive(calibrator.transform(vector), name).drop("_v", raw)


# ---- F10, F16, F17, F20 --------------------------------------------------------------------------

def select_best(models: Sequence[ChurnModel], test: DataFrame) -> tuple[ChurnModel, dict[str, float]]:
    """Candidate with the highest exact AUC on the test part."""
    areas = {m.name: ev.auc_value(labelled_scores(m, test)) for m in models}
    return max(models, key=lambda m: areas[m.name]), areas


def cross_val_auc(rows: DataFrame, features: Sequence[str], learner) -> tuple[float, float]:
    """Mean and population deviation of the AUCs of up to five folds; (0, 0) below two folds of FOLD_ROWS."""
    k = min(5, rows.count() // FOLD_ROWS)
    if k < 2:
        return 0.0, 0.0
    parts = hold(folds(weighted(assemble(rows, features)), k))
    areas = []
    for fold in range(k):
        model = learner.fit(parts.where(F.col("fold") != fold))
        scored = _positive(model.transform(parts.where(F.col("fold") == fold)), "p")
        areas.append(ev.auc_value(scored.select("p", F.col("churned").alias("label"))))
    mean = sum(areas) / k
    return mean, (sum((a - mean) ** 2 for a in areas) / k) ** 0.5


def compare(models: Sequence[ChurnModel], test: DataFrame, threshold: float) -> DataFrame:
    """AUC and F1 of every candidate at one threshold."""
    rows = None
    for m in models:
        scored = labelled_scores(m, test)
        one = ev.confusion(scored, threshold).select(
            F.lit(m.name).alias("model"), F.lit(ev.auc_value(scored)).alias("auc"), "f1"
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def importances(model: ChurnModel, spark) -> DataFrame:
    """Feature importances of the base learner; equal shares if it has none."""
    values = getattr(model.base, "featureImportances", None)
    shares = values.toArray().tolist() if values is not None else [1.0 / len(model.features)] * len(model.features)
    rows = [(f, float(v)) for f, v in zip(model.features, shares)]
    return small_table(spark, rows, "feature string, importance double")


# ---- the whole training --------------------------------------------------------------------------

def train(
    rows: DataFrame | None,
    domain: str = "retail",
    rf: dict | None = None,
    gbt: dict | None = None,
    tuned: bool = False,
    stacked: bool = True,
    cv: bool = False,
    features: Sequence[str] | None = None,
) -> ChurnModel | None:
    """Split, fit candidates, pick, stack, calibrate, set the threshold and evaluate.

    None when there are fewer than five rows or only one class: callers use the heuristic score.
    """
    if rows is None:
        return None
    features = list(features) if features else feature_names(rows, domain)
    # some thirty jobs follow: from a written table none of their tasks carries the plan of the features,
    # whose metrics every task would send to the driver
    rows = cut_lineage(rows.select("user_id", "churned", *features), "labelled")
    seen = facts(rows, n=F.count(F.lit(1)), pos=F.sum("churned"))
    if seen["n"] < 5 or seen["pos"] in (0, None, seen["n"]):
        return None
    parts = hold(split3(rows))
    # every boosting and stacking round reads the training part: start it from a written table
    prepared = weighted(assemble(parts.where("part = 'train'"), features))
    learn = cut_lineage(prepared.select("user_id", "churned", FEATURES, LABEL, WEIGHT), "train")
    cal, test = parts.where("part = 'cal'"), parts.where("part = 'test'")

    best = tune(learn, rf, gbt) if tuned else {}
    rf_learner = forest(**{**(rf or {}), **best.get("rf", {})})
    learners = {"Random Forest": rf_learner}
    for name in GBT_PARAMS:
        learners[name] = boosted(name, **{**(gbt or {}), **(best.get("gbt", {}) if name == "Boosted Trees" else {})})
    made = side_by_side(learn.sparkSession, [partial(lr.fit, learn) for lr in learners.values()])
    models = [ChurnModel(n, features, [fitted]) for n, fitted in zip(learners, made)]
    chosen, areas = select_best(models, test)

    if stacked and learn.count() >= STACK_ROWS:
        pair = ["Random Forest", "Boosted Trees (subsampled)"]
        by_name = {m.name: m for m in models}
        bases, meta = fit_stack(learn, [learners[n] for n in pair], [by_name[n].base for n in pair])
        stack = ChurnModel("Stacking", features, bases, meta)
        areas["Stacking"] = ev.auc_value(labelled_scores(stack, test))
        if areas["Stacking"] > areas[chosen.name]:
            chosen = stack

    model = replace(chosen, calibrator=calibrate(labelled_scores(chosen, cal)))
    scored = labelled_scores(model, test)
    model.threshold = ev.best_threshold(scored)
    area = ev.auc_value(scored)
    confusion = ev.confusion(scored, model.threshold).first().asDict()
    model.metrics = {
        "roc_auc": area,
        "gini": 2 * area - 1,
        "train_size": learn.count(),
        "test_size": test.count(),
        "primary_model": model.name,
        "optimal_threshold": model.threshold,
        "threshold_strategy": "balanced_fp_fn",
        "candidate_auc": areas,
        **{k: confusion[k] for k in ("accuracy", "f1", "tp", "fp", "fn", "tn")},
    }
    if cv:
        mean, std = cross_val_auc(rows, features, learners.get(chosen.name, rf_learner))
        model.metrics.update(cv_auc_mean=mean, cv_auc_std=std)
    return model
