"""The whole analysis of one dataset: user table, scores, reports, and their JSON view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.fixed import FALLBACK_DRIVERS
from holdfast.operators import attribution, drift, features, hypotheses, ingest, labels, learners, money, reports
from holdfast.operators.activity import activity, span
from holdfast.session import cut_lineage, hold, small_table
from holdfast.sources.registry import ModelRegistry


@dataclass
class Analysis:
    """Scored users, the model behind them (None for the heuristic) and one table per section."""

    users: DataFrame
    model: learners.ChurnModel | None
    sections: dict[str, DataFrame]


def fallback_drivers(spark) -> DataFrame:
    return small_table(
        spark, FALLBACK_DRIVERS, "feature string, raw_feature string, importance double, direction string, impact string"
    )


def analyse(
    tx: DataFrame,
    domain: str = "retail",
    is_summary: bool = False,
    rf: dict | None = None,
    gbt: dict | None = None,
    explain: bool = True,
    stage: bool = False,
    baseline: str | None = None,
) -> Analysis:
    """Canonical transactions in, scored users and every report section out.

    Each section scans `tx` for the columns it needs. `stage` first writes the prepared rows to the
    shared folder as a columnar table: worth it when `tx` still parses text files. `baseline` is the
    path of a drift baseline; the first run saves it. `explain` adds attributions of all users; the
    model is the same with and without it.
    """
    tx = cut_lineage(tx, "tx") if stage else tx
    act = activity(tx)
    spark = tx.sparkSession
    if is_summary or "target_churn" in tx.columns:
        base = features.user_table(tx, is_summary)
        current = labels.labelled_training_set(tx, base, domain)
        training = current if "target_churn" in tx.columns else None
        users = features.join_users(base, current.drop("churned"))
    else:
        users = labels.current_features(tx, act)
        training = labels.temporal_training_set(tx, domain)
    model = learners.train(training, domain, rf, gbt)
    scored = learners.score(model, users) if model else money.heuristic_churn(users)
    rated = money.financials(scored, domain)
    users = hold(features.join_users(rated, reports.lifecycle(tx, act)))

    threshold = model.threshold if model else 0.5
    auc = model.metrics["roc_auc"] if model else 0.5
    shap = attribution.shap_summary(model, users) if model and explain else None
    drivers = (
        attribution.drivers(learners.importances(model, spark), shap, domain) if model else fallback_drivers(spark)
    )
    drivers = hold(drivers)
    top = [(r["raw_feature"], r["feature"]) for r in drivers.orderBy(F.desc("importance")).limit(8).collect()]
    grouped = hold(learners.clusters(users))
    segments = hold(money.segment_churn(users))
    cohorts = reports.cohort_matrix(tx)
    month = spark.range(1).select(F.month(F.timestamp_micros(F.lit(span(tx)[1])))).first()[0]
    score = model.probabilities if model else None
    sections = {
        "kpis": money.kpis(users),
        "risk_counts": money.risk_counts(users),
        "data_health": reports.data_health(tx),
        "segments": features.value_counts(users, "segment"),
        "clusters": features.value_counts(grouped.withColumn("cluster", F.col("cluster").cast("string")), "cluster"),
        "silhouette": learners.silhouette_euclidean(grouped),
        "lifecycle_stages": features.value_counts(users, "lifecycle"),
        "segment_churn": segments,
        "cohorts": cohorts,
        "revenue_at_risk": money.rar_summary(users, threshold),
        "revenue_by_segment": money.rar_by_segment(users, threshold),
        "potential_recovery": money.potential_recovery(users, threshold, auc),
        "forecast": money.churn_forecast(users, score, month),
        "drivers": drivers,
        "hypotheses": hypotheses.hypotheses(users, top, threshold, domain, score),
        "interventions": reports.interventions(segments, title_top(top)),
    }
    if model:
        sections["metrics"] = small_table(
            spark, [(k, str(v)) for k, v in model.metrics.items()], "metric string, value string"
        )
    if shap is not None:
        sections["shap"] = shap
        sections["shap_segments"] = attribution.shap_segments(model, users)
    if baseline is not None:
        state, found = drift.check_against_baseline(users, ["recency", "frequency", "monetary"], baseline)
        sections["baseline_drift"] = found if found is not None else small_table(spark, [(state,)], "state string")
    if reports.product_column(tx):
        sections["product_mix"] = reports.product_mix_segment(tx, users)
        sections["product_risk"] = reports.product_risk(tx, users)
    if training is not None and "target_churn" not in tx.columns:
        window = labels.label_window(tx, domain)
        sections["drift"] = drift.drift_summary(drift.temporal_drift(tx, window.cutoff_us))
    return Analysis(users, model, sections)


def analyse_files(frames: list[DataFrame], domain: str | None = None, **options) -> Analysis:
    """Several raw tables of one business: each is prepared, their rows are stacked without repeats."""
    tx = ingest.union_dedupe([ingest.prepare(f, domain) for f in frames])
    return analyse(ingest.require_columns(tx), domain or ingest.detect_domain(frames[0].columns), **options)


def score_stored(tx: DataFrame, store: ModelRegistry, model_id: str, domain: str = "retail") -> DataFrame | None:
    """Scores and values of all current users by the newest stored model; None without a usable one.

    Nothing is trained: the features are built from `tx`, and columns that the model does not know
    are carried along.
    """
    model = store.load_latest(model_id)
    if model is None:
        return None
    users = labels.current_features(tx, activity(tx))
    return money.financials(learners.score(model, users), domain)


def title_top(drivers: list[tuple[str, str]]) -> str:
    return drivers[0][1] if drivers else "Engagement"


def report_json(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, body): each section as one JSON array.

    Sections are aggregates of at most a few hundred rows; the user table is an output of its own
    (`users_json`).
    """
    out = None
    for name, df in sections.items():
        rows = F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns))))
        body = F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))
        one = df.agg(body.alias("body")).select(F.lit(name).alias("section"), "body")
        out = one if out is None else out.unionByName(one)
    return out


def users_json(users: DataFrame) -> DataFrame:
    """(user_id, body): one JSON object per user, for all users."""
    return users.select("user_id", F.to_json(F.struct(*users.columns)).alias("body"))
