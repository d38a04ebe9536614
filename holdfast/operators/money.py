"""Lifetime value, revenue at risk, priorities, tiers and the churn forecast.

Every operator takes a user table with a `churn_probability`, whichever model it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import flag, ratio
from holdfast.functions.order import (
    dealt_order,
    draw,
    facts,
    quantile,
    quantiles,
    ranked_and_clipped,
)
from holdfast.session import hold

RISK_WINDOWS = {"tax": 365.0}  # days of exposure; 90 elsewhere
MARGIN = 1.0
AUDIT_MARGINS = {"tax": 0.05, "upi": 0.005}


def risk_window(domain: str) -> float:
    return RISK_WINDOWS.get(domain, 90.0)


def _p() -> Column:
    return F.col("churn_probability")


# ---- F19 -----------------------------------------------------------------------------------------

def heuristic_churn(users: DataFrame) -> DataFrame:
    """Churn score without a model: recency relative to the longest one, 0.5 when unknown."""
    longest = facts(users, top=F.max("recency"))["top"]
    scale = F.lit(float(longest) if longest and longest > 0 else 1.0)
    return users.withColumn(
        "churn_probability", F.coalesce(F.col("recency") / scale, F.lit(0.5))
    )


# ---- H1–H7 ---------------------------------------------------------------------------------------

def velocity_guard(users: DataFrame) -> DataFrame:
    """Replace a velocity that is missing or zero for everybody by salary or spend per day."""

    def idle(col: str) -> bool:
        if col not in users.columns:
            return True
        return not facts(users, used=F.max(F.when(F.col(col) != 0, 1)))["used"]

    if not idle("monetary_velocity"):
        return users
    if not idle("estimated_salary"):
        daily = F.col("estimated_salary") / 365.0
    elif "monetary" in users.columns:
        daily = F.col("monetary") / 365.0
    else:
        daily = F.lit(0.0)
    return users.withColumn("monetary_velocity", daily)


def predicted_ltv() -> Column:
    return F.col("monetary") + F.col("monetary_velocity") * 365 * (1 - _p())


def revenue_at_risk(domain: str) -> Column:
    """Expected loss over the risk window, never above what the user has spent."""
    exposure = F.col("monetary_velocity") * F.lit(risk_window(domain)) * F.lit(MARGIN) * _p()
    return F.least(exposure, F.greatest(F.col("monetary").cast("double"), F.lit(1.0)))


def intervention_cost() -> Column:
    basket = F.col("monetary") / F.greatest(F.col("frequency").cast("double"), F.lit(1.0))
    share = F.when(_p() > 0.8, 0.25).when(_p() > 0.5, 0.15).when(_p() > 0.2, 0.08).otherwise(0.03)
    return F.round(F.lit(150.0) + basket * share, 2)


def financials(users: DataFrame, domain: str = "retail") -> DataFrame:
    """LTV, revenue at risk, percentile priority, cost and profitability per user."""
    valued = hold(
        velocity_guard(users)
        .withColumns({"predicted_ltv": predicted_ltv(), "revenue_at_risk": revenue_at_risk(domain)})
        .withColumn("_raw_priority", _p() * F.col("revenue_at_risk"))
    )
    clipped = ranked_and_clipped(valued, "_raw_priority", "_pct", ["revenue_at_risk", "predicted_ltv"])
    costed = clipped.withColumn("intervention_cost", intervention_cost())
    return costed.withColumn(
        "is_profitable", F.col("predicted_ltv") > F.col("monetary") + F.col("intervention_cost")
    ).withColumns(
        {
            "priority_score": F.round(F.col("_pct") * 100, 1),
            "revenue_at_risk": F.round("revenue_at_risk", 2),
            "predicted_ltv": F.round("predicted_ltv", 2),
        }
    ).drop("_raw_priority", "_pct")


# ---- H8–H13, H17–H19 -----------------------------------------------------------------------------

def rar_summary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    rar = F.coalesce("revenue_at_risk", F.lit(0.0))
    return scored.agg(
        F.round(F.coalesce(F.sum(rar), F.lit(0.0)), 2).alias("total"),
        F.round(F.coalesce(F.sum(F.when(_p() >= threshold, rar)), F.lit(0.0)), 2).alias("critical"),
    )


def rar_by_segment(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Revenue at risk per segment with plain and velocity-weighted churn."""
    weighted = ratio(F.sum(_p() * F.col("monetary_velocity")), F.sum("monetary_velocity"))
    return scored.groupBy("segment").agg(
        F.sum("revenue_at_risk").alias("revenue_at_risk"),
        F.count("user_id").alias("users"),
        F.avg(_p()).alias("churn_probability"),
        F.coalesce(weighted, F.avg(_p())).alias("avg_churn"),
        F.count_if(_p() >= threshold).alias("high_risk_count"),
    )


def recovery_efficiency(auc: float) -> float:
    return min(0.40, max(0.10, auc * 0.4))


def potential_recovery(
    scored: DataFrame, threshold: float = 0.5, auc: float = 0.75, adaptive: bool = False
) -> DataFrame:
    """Revenue that interventions could win back from users near or above the threshold.

    Nobody above the threshold gives zero, unless `adaptive` asks for the top quarter instead.
    """
    top = facts(scored, top=F.max(_p()))["top"]
    low = top is None or top < threshold
    target = quantile(scored, "churn_probability", 0.75) if low and adaptive else threshold * 0.7
    active = top is not None and (not low or adaptive)
    efficiency = recovery_efficiency(auc) if active else 0.0
    reach = (_p() >= F.lit(target)) & F.lit(active)
    value = F.coalesce(F.sum(F.when(reach, F.col("revenue_at_risk"))), F.lit(0.0)) * F.lit(efficiency)
    return scored.agg(
        F.round(value, 2).alias("value"),
        F.lit(round(efficiency * 100, 1)).alias("efficiency_pct"),
        F.count_if(_p() >= threshold).alias("critical_count"),
        F.count_if(reach).alias("addressable_count"),
        F.lit(bool(active and low)).alias("is_adaptive"),
    )


def kpis(scored: DataFrame) -> DataFrame:
    """Users, revenue-weighted and plain churn risk, mean lifetime value."""
    ltv = F.coalesce("predicted_ltv", "monetary") if "predicted_ltv" in scored.columns else F.col("monetary")
    return scored.agg(
        F.count(F.lit(1)).alias("total_users"),
        (F.sum(_p() * F.col("monetary")) / F.greatest(F.sum("monetary"), F.lit(1.0))).alias("avg_churn_risk"),
        F.avg(_p()).alias("baseline_churn_rate"),
        F.avg(ltv).alias("mean_ltv"),
    )


def risk_counts(scored: DataFrame) -> DataFrame:
    """Users in the top quarter and tenth of risk, and new users in the top quarter."""
    marks = quantiles(scored, ["churn_probability"], [0.75, 0.9]).get("churn_probability", [0.0, 0.0])
    return scored.agg(
        F.count_if(_p() >= marks[0]).alias("total_high_risk_users"),
        F.count_if((_p() >= marks[0]) & (F.col("lifecycle") == "New")).alias("onboarding_risk_users"),
        F.count_if(_p() >= marks[1]).alias("critical_threshold_users"),
    )


def tier_marks(baseline: float, threshold: float) -> tuple[float, float]:
    """(high, critical): multiples of a moderate baseline, else the model threshold."""
    if 0 < baseline <= 0.35:
        return min(baseline * 1.5, 0.9), min(baseline * 2.0, 0.95)
    return threshold, min(threshold + 0.2, 0.95)


def risk_tiers(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    baseline = facts(scored, b=F.avg(_p()))["b"] or 0.0
    high, critical = tier_marks(baseline, threshold)
    tier = F.when(_p() >= critical, "Critical").when(_p() >= high, "High").otherwise("Normal")
    return scored.withColumns({"high_mark": F.lit(high), "critical_mark": F.lit(critical), "risk_tier": tier})


def portfolio_audit(scored: DataFrame, domain: str = "retail", auc: float = 0.75) -> DataFrame:
    margin = AUDIT_MARGINS.get(domain, 1.0)
    return scored.agg(
        F.round(F.sum("monetary"), 2).alias("monitored"),
        F.lit(margin).alias("margin"),
        F.round(F.sum("monetary") * margin, 2).alias("addressable_margin"),
        F.lit(round(recovery_efficiency(auc), 4)).alias("efficiency"),
    )


def warning_cohort(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """When nobody reaches the threshold, flag the top fifth by risk; otherwise flag those above."""
    top = facts(scored, top=F.max(_p()))["top"]
    if top is not None and top < threshold:
        mark = quantile(scored, "churn_probability", 0.8)
    else:
        mark = threshold
    return scored.withColumn("is_warning", flag(_p() >= F.lit(mark)))


# ---- H14 -----------------------------------------------------------------------------------------

def segment_churn(scored: DataFrame) -> DataFrame:
    """Churn, value, cost and status per segment (churn weighted by spend)."""
    weighted = F.when(
        F.sum("monetary") > 0, ratio(F.sum(_p() * F.col("monetary")), F.sum("monetary"))
    ).otherwise(F.avg(_p()))
    rows = scored.groupBy("segment").agg(
        F.count("user_id").alias("count"),
        F.avg("monetary").alias("avg_monetary"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary_velocity").alias("avg_velocity"),
        F.sum("revenue_at_risk").alias("total_revenue_at_risk"),
        weighted.alias("_churn"),
    )
    churn = F.col("_churn")
    share = F.when(churn > 0.8, 0.20).when(churn > 0.5, 0.10).when(churn > 0.2, 0.05).otherwise(0.02)
    basket = F.col("avg_monetary") / F.greatest("avg_frequency", F.lit(1.0))
    ltv = F.col("avg_monetary") + F.col("avg_velocity") * 365 * (1 - churn)
    rows = rows.withColumns(
        {
            "est_ltv": F.round(ltv, 2),
            "intervention_cost": F.round(F.lit(5.0) + basket * share, 2),
            "avg_churn": F.round(churn, 4),
        }
    ).drop("_churn")
    status = (
        F.when(F.col("avg_churn") >= 0.4, "CRITICAL")
        .when(F.col("avg_churn") >= 0.2, "WARNING")
        .otherwise("STABLE")
    )
    return rows.withColumns(
        {
            "is_profitable": F.col("est_ltv") > F.col("avg_monetary") + F.col("intervention_cost"),
            "status": status,
        }
    )


# ---- H15, H16 ------------------------------------------------------------------------------------

def survival_floor(cohorts: DataFrame) -> DataFrame:
    """Mean of all cohort retention rates, kept within [0.1, 0.9]; 0 without any."""
    rates = cohorts.select(F.explode("retention").alias("r"))
    share = F.when(F.col("r") > 1.0, F.col("r") / 100.0).otherwise(F.col("r"))
    mean = F.avg(share)
    clipped = F.least(F.greatest(mean, F.lit(0.1)), F.lit(0.9))
    return rates.agg(F.coalesce(clipped, F.lit(0.0)).alias("survival_floor"))


def adopters(scored: DataFrame, adoption: float = 0.6, seed: int = 42) -> DataFrame:
    """Add `adopts`: a deterministic draw of the given share of the top risk quarter."""
    mark = quantile(scored, "churn_probability", 0.75)
    risky = hold(scored.where(_p() >= F.lit(mark)).select("user_id"))
    size = int(risky.count() * adoption)
    cut = draw(risky, size, seed)
    inside = (_p() >= F.lit(mark)) & (dealt_order("user_id", seed) <= F.lit(cut)) if size else F.lit(False)
    return scored.withColumn("adopts", inside)


def churn_forecast(
    scored: DataFrame,
    score=None,
    as_of_month: int | None = None,
    adoption: float = 0.6,
    floor: float = 0.0,
    months: int = 6,
) -> DataFrame:
    """Revenue-weighted churn for the next months, with and without the retention playbook.

    `score` re-scores the changed users of the optimised path (a function DataFrame -> DataFrame
    that rewrites `churn_probability`); without it their probability stays and only the playbook
    effect applies. All months come out of one aggregate.
    """
    drawn = adopters(scored, adoption).withColumn("_base", _p())
    if score is not None:
        moved = {"recency": 0.75, "frequency": 1.20, "monetary": 1.15}
        kept = F.col("monetary").alias("_weight")
        drawn = drawn.select("*", kept).withColumns(
            {c: F.when(F.col("adopts"), F.col(c) * m).otherwise(F.col(c)) for c, m in moved.items()}
        )
        drawn = score(drawn)
    else:
        drawn = drawn.withColumn("_weight", F.col("monetary"))
    better = F.when(F.col("adopts"), _p() * 0.60).otherwise(_p())
    weight = F.col("_weight")

    def lost(p: Column, month: int) -> Column:
        alive = F.pow(F.lit(1.0) - p, F.lit(month / 3.0))
        return F.sum((1.0 - F.least(F.greatest(alive, F.lit(floor)), F.lit(1.0))) * weight)

    sums = []
    for i in range(1, months + 1):
        sums += [lost(F.col("_base"), i).alias(f"b{i}"), lost(better, i).alias(f"o{i}")]
    totals = drawn.agg(F.sum(weight).alias("total"), *sums).where("total <> 0")
    stacked = ", ".join(f"{i}, b{i}, o{i}" for i in range(1, months + 1))
    rows = totals.selectExpr("total", f"stack({months}, {stacked}) as (step, base, optimised)")
    scale = F.greatest("total", F.lit(1.0))
    rows = rows.withColumns(
        {"_b": F.col("base") / scale * 100.0, "_o": F.col("optimised") / scale * 100.0}
    )
    start = as_of_month if as_of_month is not None else 1
    label = F.date_format(
        F.make_date(F.lit(2000), (F.lit(start - 1) + F.col("step")) % 12 + 1, F.lit(1)), "MMM"
    )
    return rows.select(
        "step",
        label.alias("month"),
        F.round("_b", 1).alias("baseline"),
        F.round("_o", 1).alias("risk"),
        F.round(F.greatest(F.col("_b") - F.col("_o"), F.lit(0.0)), 1).alias("saved"),
    )
