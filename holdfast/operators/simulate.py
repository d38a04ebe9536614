"""What-if scenarios, counterfactual lift, campaign returns and experiments.

`score` is any function DataFrame -> DataFrame that rewrites `churn_probability` from the other
columns: a fitted model's `probabilities`, or the closed-form heuristic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import fixed_digits, grouped, numeric_columns, ratio
from holdfast.functions.fixed import (
    FEATURE_ALIASES,
    FEATURE_DISPLAY,
    MODEL_LIMITATION_NOTE,
    ROI_BAD,
    ROI_GOOD,
)
from holdfast.functions.order import dealt_order, draw, facts
from holdfast.operators.money import MARGIN, risk_window
from holdfast.session import hold, small_table

Score = Callable[[DataFrame], DataFrame]
RAISING = {"monetary", "frequency", "section_count"}
LOWERING = {"recency", "failure_rate"}


def heuristic_score(longest: float) -> Score:
    """Recency relative to a fixed longest one, kept within [0, 1]."""
    share = F.least(F.greatest(F.col("recency") / F.lit(float(longest or 1.0)), F.lit(0.0)), F.lit(1.0))
    return lambda df: df.withColumn("churn_probability", share)


def feature_key(feature: str) -> str:
    key = FEATURE_ALIASES.get(str(feature).strip().lower())
    if key is None:
        raise ValueError(f"invalid feature: {feature}")
    return key


def touched(df: DataFrame, key: str, exact: bool = False) -> list[str]:
    """Numeric columns a change of `key` moves: itself and everything that starts with it."""
    names = numeric_columns(df)
    cols = [c for c in names if c.lower() == key or (not exact and c.lower().startswith(f"{key}_"))]
    if not cols:
        raise ValueError(f"feature {key} is not a column")
    return cols


def _outcome(rows: DataFrame, domain: str, by: Sequence[str]) -> DataFrame:
    """Churn before and after, users, and the money protected, per group."""
    exposure = F.lit(risk_window(domain) * MARGIN)
    stats = rows.groupBy(*by).agg(
        F.avg("_before").alias("original_churn"),
        F.avg("churn_probability").alias("simulated_churn"),
        F.sum("_velocity").alias("_velocity"),
        F.count(F.lit(1)).alias("users_affected"),
    )
    drop = F.col("original_churn") - F.col("simulated_churn")
    gain = F.greatest(drop, F.lit(0.0))
    return stats.withColumns(
        {
            "churn_reduction_pct": drop / F.greatest("original_churn", F.lit(0.001)) * 100,
            "absolute_reduction": drop * 100,
            "revenue_saved": F.col("_velocity") * exposure * gain,
            "ltv_saved": F.col("_velocity") * 365 * gain,
        }
    ).drop("_velocity")


def _advice(feature: Column, delta: Column, segment: Column) -> Column:
    head = F.concat(
        F.lit("A "), fixed_digits(F.abs(delta), 0), F.lit("% "),
        F.when(delta > 0, "increase").otherwise("decrease"), F.lit(" in "), feature,
        F.lit(" for '"), segment, F.lit("'"),
    )
    drop = F.col("absolute_reduction") / 100
    size = fixed_digits(F.abs("churn_reduction_pct"), 1)
    return (
        F.when(
            drop > 0.0001,
            F.concat(head, F.lit(" could reduce churn by "), size, F.lit("%, protecting ₹"),
                     grouped(F.col("revenue_saved")), F.lit(" in revenue.")),
        )
        .when(drop < -0.0001, F.concat(head, F.lit(" may increase churn by "), size, F.lit("%. Not recommended.")))
        .otherwise(F.concat(head, F.lit(" has no predicted effect on churn. Consider other interventions.")))
    )


def evidence_pct(importance: dict[str, float], cols: Sequence[str]) -> float:
    """Share of the model's importance behind the moved columns, in percent."""
    share = sum(importance.get(c, 0.0) for c in cols)
    if share == 0 and importance:
        share = 1.0 / len(importance)
    return round(share * 100, 1)


# ---- K1 ------------------------------------------------------------------------------------------

def whatif(
    scored: DataFrame,
    score: Score,
    segment: str,
    feature: str,
    delta_pct: float,
    domain: str = "retail",
    importance: dict[str, float] | None = None,
    exact: bool = False,
) -> DataFrame:
    """One row: what a relative change of a feature does to a segment's churn."""
    if not -100 <= delta_pct <= 500:
        raise ValueError("delta_pct must lie between -100 and 500")
    key = feature_key(feature)
    cols = touched(scored, key, exact)
    chosen = scored.where(F.col("segment") == segment)
    if chosen.isEmpty():
        raise ValueError(f"segment not found: {segment}")
    before = chosen.withColumns({"_before": F.col("churn_probability"), "_velocity": F.col("monetary_velocity")})
    moved = before.withColumns({c: F.col(c) * (1 + delta_pct / 100.0) for c in cols})
    rows = _outcome(score(moved), domain, [])
    good = (delta_pct > 0 and key in RAISING) or (delta_pct < 0 and key in LOWERING)
    note = F.when(
        F.lit(good) & (F.col("simulated_churn") >= F.col("original_churn")), MODEL_LIMITATION_NOTE
    )
    return rows.withColumns(
        {
            "segment": F.lit(segment),
            "feature": F.lit(key),
            "feature_display": F.lit(FEATURE_DISPLAY.get(key, key)),
            "delta_pct": F.lit(float(delta_pct)),
            "recommendation": _advice(F.lit(feature), F.lit(float(delta_pct)), F.lit(segment)),
            "model_evidence_pct": F.lit(evidence_pct(importance or {}, cols)),
            "model_limitation_note": note,
        }
    )


# ---- K3 ------------------------------------------------------------------------------------------

def whatif_grid(
    scored: DataFrame, score: Score, scenarios: Sequence[tuple], domain: str = "retail"
) -> DataFrame:
    """Many scenarios in one scoring pass.

    `scenarios` are (name, segment or None for all, feature, delta %, cost per user): a short list
    made by hand, joined to the users by segment.
    """
    spark = scored.sparkSession
    segments = [r["segment"] for r in scored.select("segment").distinct().collect()]  # at most eight names
    rows = [
        (name, seg, feature_key(feature), float(delta), float(cost))
        for name, wanted, feature, delta, cost in scenarios
        for seg in ([wanted] if wanted else segments)
    ]
    plan = small_table(
        spark, rows, "scenario string, segment string, feature string, delta_pct double, cost_per_user double"
    )
    users = scored.withColumns({"_before": F.col("churn_probability"), "_velocity": F.col("monetary_velocity")})
    paired = users.join(F.broadcast(plan), "segment")
    moved = {}
    for key in {r[2] for r in rows}:
        names = [c for c in numeric_columns(scored) if c.lower() == key or c.lower().startswith(f"{key}_")]
        moved.update(
            {c: F.when(F.col("feature") == key, F.col(c) * (1 + F.col("delta_pct") / 100)).otherwise(F.col(c)) for c in names}
        )
    by = ["scenario", "segment", "feature", "delta_pct", "cost_per_user"]
    return _outcome(score(paired.withColumns(moved)), domain, by)


# ---- K2 ------------------------------------------------------------------------------------------

def counterfactual_lift(
    scored: DataFrame, score: Score | None, col: str, target: float, reduce: bool, threshold: float = 0.5
) -> float:
    """Relative churn reduction in percent when risky users reach the target, within [0.5, 25]."""
    if score is None or col not in scored.columns:
        return 5.0
    risky = scored.where(F.col("churn_probability") >= threshold).withColumn("_before", F.col("churn_probability"))
    bound = F.least if reduce else F.greatest
    after = score(risky.withColumn(col, bound(F.col(col).cast("double"), F.lit(float(target)))))
    row = facts(after, before=F.avg("_before"), after=F.avg("churn_probability"))
    if row["before"] is None:
        return 5.0
    lift = (row["before"] - row["after"]) / max(row["before"], 0.001) * 100
    return round(max(0.5, min(25.0, lift)), 1)


# ---- K4 ------------------------------------------------------------------------------------------

def campaign_roi(outcomes: DataFrame, segments: DataFrame, kpi: DataFrame) -> DataFrame:
    """Cost, gain, verdict, wording and the portfolio churn after each campaign."""
    money = segments.select(
        "segment", F.round("est_ltv").alias("_ltv"), F.col("intervention_cost").alias("_cost")
    )
    rows = outcomes.join(F.broadcast(money), "segment", "left").withColumns(
        {
            "_total": kpi.select("total_users").scalar(),
            "_base": kpi.select("baseline_churn_rate").scalar(),
        }
    )
    users = F.col("users_affected")
    drop = F.col("original_churn") - F.col("simulated_churn")
    per_user = F.coalesce("cost_per_user", "_cost", F.lit(50.0))
    gain = F.coalesce("ltv_saved", F.coalesce("_ltv", F.lit(1200.0)) * drop * users)
    rows = rows.withColumns({"cost": F.round(per_user * users), "gain": F.round(gain)})
    rows = rows.withColumn("is_profitable", F.col("gain") > F.col("cost") * 0.85)
    share = fixed_digits(drop * 100, 1)
    good = F.format_string(ROI_GOOD, share, grouped(F.col("gain")), grouped(F.col("cost")))
    bad = F.format_string(ROI_BAD, grouped(F.col("cost")), grouped(F.col("gain")))
    return rows.withColumns(
        {
            "explanation": F.when(F.col("is_profitable"), good).otherwise(bad),
            "portfolio_churn": F.col("_base") - drop * users / F.col("_total"),
        }
    ).drop("_ltv", "_cost", "_total", "_base")


# ---- K5, K6 --------------------------------------------------------------------------------------

def ab_assign(users: DataFrame, seed: int = 42, share: float = 0.2, minimum: int = 100) -> DataFrame:
    """Treatment arm of max(minimum, 20 %) users drawn in the dealt order; the others control."""
    users = hold(users)
    affected = users.count()
    size = min(affected, max(minimum, -int(-affected * share // 1)))
    cut = draw(users, size, seed)
    treated = dealt_order("user_id", seed) <= F.lit(cut) if size else F.lit(False)
    return users.withColumn("arm", F.when(treated, "treatment").otherwise("control"))


def ab_lift(assigned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Churn per arm and the two-proportion z of their difference; `outcomes` has user_id, churned."""
    treated = F.col("arm") == "treatment"
    hit = F.col("churned") == 1
    rows = assigned.join(outcomes, "user_id").agg(
        F.count_if(treated).alias("treated"),
        F.count_if(~treated).alias("control"),
        F.count_if(treated & hit).alias("treated_churned"),
        F.count_if(~treated & hit).alias("control_churned"),
    )
    t, c = ratio(F.col("treated_churned"), F.col("treated")), ratio(F.col("control_churned"), F.col("control"))
    pooled = ratio(
        F.col("treated_churned") + F.col("control_churned"), F.col("treated") + F.col("control")
    )
    error = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), F.col("treated")) + ratio(F.lit(1), F.col("control"))))
    return rows.withColumns(
        {"treated_rate": t, "control_rate": c, "lift": c - t, "z": ratio(c - t, error)}
    )
