"""Lifecycle, cohorts, product mix, interventions, data health and user lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.columns import (
    fixed_digits,
    flag,
    lookup_text,
    micros,
    numeric_columns,
    whole_days,
)
from holdfast.functions.fixed import PERSONAS, SEGMENT_ACTIONS, SEGMENT_PROBLEMS
from holdfast.functions.order import facts
from holdfast.operators.activity import activity, span


# ---- J1 ------------------------------------------------------------------------------------------

def lifecycle(tx: DataFrame, act: DataFrame | None = None) -> DataFrame:
    """Stage of every user at the last event of the dataset."""
    act = activity(tx) if act is None else act
    as_of = F.col("as_of_us")
    tenure = whole_days(as_of, F.col("first_us"))
    idle = whole_days(as_of, F.col("last_us"))
    # gaps inside a day are zero, so the largest one is between active days
    longest = F.coalesce("gap_max", F.lit(0))
    recent_start = F.col("first_us") >= as_of - F.lit(30 * 86_400_000_000)
    events = F.col("events")
    stage = (
        F.when((longest > 90) & (idle < 30), "Reactivated")
        .when(tenure < 30, "New")
        .when((events == 1) & (tenure < 60), "New")
        .when(recent_start & (events <= 3), "New")
        .when(tenure < 120, "Active")
        .otherwise("Established")
    )
    return act.select(
        "user_id",
        stage.alias("lifecycle"),
        F.timestamp_micros("first_us").alias("first_seen"),
        tenure.alias("tenure"),
    )


def max_gap(tx: DataFrame, act: DataFrame | None = None) -> DataFrame:
    act = activity(tx) if act is None else act
    return act.select("user_id", F.coalesce("gap_max", F.lit(0)).cast("bigint").alias("max_gap"))


# ---- J2 ------------------------------------------------------------------------------------------

MONTHS_A_WORD = 63


def month_bitmaps(tx: DataFrame) -> DataFrame:
    """(user_id, first_month, months): the months in which a user was active, as bits of 64-bit words.

    Months are counted from year 0. Bit i of word w stands for the month MONTHS_A_WORD * w + i after the
    first month of the data, so a user is one row of a map-side combined aggregate, however active.
    """
    first, last = (_month_number(us) for us in span(tx))
    number = (12 * F.year("timestamp") + F.month("timestamp") - 1).alias("number")
    rows = tx.where("timestamp is not null").select("user_id", number)
    since = F.col("number") - F.lit(first)
    words = [
        F.bit_or(F.when((since / MONTHS_A_WORD).cast("int") == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), since % MONTHS_A_WORD))
                 .otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}")
        for w in range((last - first) // MONTHS_A_WORD + 1)
    ]
    users = rows.groupBy("user_id").agg(F.min("number").alias("first_month"), *words)
    return users.select("user_id", "first_month", F.array(*[f"w{w}" for w in range(len(words))]).alias("months"), F.lit(first).alias("base"))


def _month_number(micros_at: int | None) -> int:
    at = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros_at or 0)
    return 12 * at.year + at.month - 1


def cohort_retention(tx: DataFrame) -> DataFrame:
    """(cohort, period, active, size, retention %) with one row per existing pair.

    Users are one bitmap each (`month_bitmaps`), the only rows that are shuffled; their set bits are
    counted per (cohort, period) on the map side. The cohort is a user's first month.
    """
    users = month_bitmaps(tx)
    month = F.explode(F.expr(
        f"filter(sequence(0, size(months) * {MONTHS_A_WORD} - 1), m -> bit_get(months[cast(m div {MONTHS_A_WORD} as int)], cast(m % {MONTHS_A_WORD} as int)) = 1)"))
    active = users.select("first_month", "base", month.alias("month"))
    active = active.groupBy("first_month", (F.col("base") + F.col("month") - F.col("first_month")).alias("period")).agg(F.count(F.lit(1)).alias("active"))
    # the first month of a cohort holds all of its users
    size = F.max(F.when(F.col("period") == 0, F.col("active"))).over(W.partitionBy("first_month"))
    cohort = F.format_string("%04d-%02d", F.expr("cast(first_month div 12 as int)"), F.expr("cast(first_month % 12 + 1 as int)"))
    return active.withColumn("size", size).select(
        cohort.alias("cohort"),
        F.col("period").cast("int").alias("period"),
        "active",
        "size",
        F.round(F.col("active") / F.col("size") * 100, 1).alias("retention"),
    )


def cohort_matrix(tx: DataFrame, periods: int = 12) -> DataFrame:
    """One row per cohort with its retention in periods 0..periods-1, zero where inactive."""
    wide = cohort_retention(tx).groupBy("cohort").pivot("period", list(range(periods)))
    cells = wide.agg(F.first("retention").alias("r"), F.max("size").alias("s"))
    names = [str(i) for i in range(periods)]
    retention = F.array(*[F.coalesce(F.col(f"`{n}_r`"), F.lit(0.0)) for n in names])
    return cells.select("cohort", F.col("`0_s`").alias("size"), retention.alias("retention"))


# ---- J3, J4 --------------------------------------------------------------------------------------

def product_column(tx: DataFrame) -> str | None:
    return next((c for c in ("description", "Description", "product", "Product") if c in tx.columns), None)


def _top_purchases(tx: DataFrame, products: int) -> DataFrame:
    """(user_id, product, rows) for the most frequent products: at most `products` rows per user."""
    col = product_column(tx)
    named = tx.where(F.col(col).isNotNull()).select("user_id", F.col(col).alias("product"))
    counts = named.groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "product").limit(products).select("product")
    kept = named.join(F.broadcast(top), "product", "left_semi")
    return kept.groupBy("user_id", "product").agg(F.count(F.lit(1)).alias("rows"))


def product_mix_segment(tx: DataFrame, scored: DataFrame, products: int = 8, per_segment: int = 5) -> DataFrame:
    """Best-selling products of every segment, among the best-selling products overall."""
    bought = _top_purchases(tx, products).join(scored.select("user_id", "segment"), "user_id")
    counts = bought.groupBy("segment", "product").agg(F.sum("rows").alias("count"))
    order = W.partitionBy("segment").orderBy(F.desc("count"), "product")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= per_segment)


def product_risk(tx: DataFrame, scored: DataFrame, products: int = 8) -> DataFrame:
    """Mean churn of the distinct buyers of each top product against the mean of all users."""
    base = facts(scored, b=F.avg("churn_probability"))["b"] or 0.0
    scores = scored.select("user_id", "churn_probability")
    buyers = _top_purchases(tx, products).join(scores, "user_id", "left")
    rows = buyers.groupBy("product").agg(
        F.count(F.lit(1)).alias("count"), F.avg("churn_probability").alias("_mean")
    )
    diff = (F.col("_mean") - F.lit(base)) / F.lit(max(base, 0.01)) * 100
    rows = rows.withColumn("risk_diff", diff).drop("_mean")
    diff, size = F.col("risk_diff"), fixed_digits(F.abs("risk_diff"), 1)
    insight = (
        F.when(
            diff > 12,
            F.format_string(
                "High churn correlation (%+.1f%% vs avg). Likely 'One-off' gift buyers.", diff
            ),
        )
        .when(
            diff < -40,
            F.concat(F.lit("Strategic Anchor ("), size, F.lit("% lower risk). Critical for long-term retention.")),
        )
        .when(
            diff < -12,
            F.concat(F.lit("Healthy Retention Signal ("), size, F.lit("% lower risk). Core recurring product.")),
        )
        .otherwise("Neutral behavioral footprint.")
    )
    level = F.when(diff > 12, "High").when(diff < -12, "Low").otherwise("Neutral")
    return rows.withColumns({"risk_level": level, "risk_insight": insight}).orderBy(
        F.abs("risk_diff").desc(), F.desc("count"), "product"
    )


# ---- J7, J8 --------------------------------------------------------------------------------------

def interventions(segments: DataFrame, top_driver: str = "Engagement") -> DataFrame:
    """Problem, action, cost and expected reduction per segment of `segment_churn`."""
    churn, spend = F.col("avg_churn"), F.col("avg_monetary")
    pct = fixed_digits(churn * 100, 0)
    heavy = F.least(F.lit(500), (spend * 0.1).cast("bigint"))
    light = F.least(F.lit(200), (spend * 0.05).cast("bigint"))
    critical, elevated = churn > 0.6, churn > 0.3
    return segments.select(
        "segment",
        F.when(critical, F.concat(F.lit("Critical churn at "), pct, F.lit(f"% driven by {top_driver}")))
        .when(elevated, F.concat(F.lit("Elevated risk ("), pct, F.lit(f"%) with declining {top_driver.lower()}")))
        .otherwise(F.concat(F.lit("Stable ("), pct, F.lit("%) but growth opportunity")))
        .alias("problem"),
        F.when(critical, F.concat(F.lit("Emergency ₹"), heavy.cast("string"), F.lit(" cashback + priority support")))
        .when(
            elevated,
            F.concat(F.lit("Personalized ₹"), light.cast("string"), F.lit(" incentive + re-engagement sequence")),
        )
        .otherwise("Loyalty tier upgrade + cross-sell premium products")
        .alias("action"),
        F.lit(top_driver).alias("driver"),
        F.when(critical, heavy).when(elevated, light).otherwise(F.lit(75)).cast("bigint").alias("est_cost_per_user"),
        F.when(critical, 20).when(elevated, 12).otherwise(5).alias("expected_churn_reduction"),
    )


def intervention_roi(segments: DataFrame, auc: float = 0.75) -> DataFrame:
    """Market exposure, return multiplier and segment-specific wording."""
    pct = fixed_digits(F.col("avg_churn") * 100, 1)
    ltv, cost = F.round("est_ltv"), F.round("intervention_cost")
    multiplier = F.least(
        F.lit(8.5),
        F.greatest(F.lit(1.2), ltv / F.when(cost == 0, 1.0).otherwise(cost) * F.lit(auc * 0.08)),
    )
    wording = F.lit(None).cast("string")
    for name, text in SEGMENT_PROBLEMS.items():
        wording = F.when(F.col("segment") == name, F.format_string(text, pct)).otherwise(wording)
    problem = (
        F.when(F.col("avg_churn") > 0.4, F.concat(F.lit("Critical churn at "), pct, F.lit("%")))
        .when(F.col("avg_churn") > 0.2, F.concat(F.lit("Elevated risk at "), pct, F.lit("%")))
        .otherwise(F.coalesce(wording, F.concat(F.lit("Stable performance at "), pct, F.lit("%"))))
    )
    action = F.when(
        F.col("is_profitable"),
        lookup_text(SEGMENT_ACTIONS, F.col("segment"), F.lit("Targeted retention campaign")),
    ).otherwise("Minimize Loss / Debt Recovery")
    return segments.select(
        "segment",
        (F.col("avg_churn") * ltv * F.col("count")).alias("exposure"),
        F.when(F.col("is_profitable"), F.round(multiplier, 1)).alias("roi_multiplier"),
        problem.alias("problem"),
        action.alias("action"),
    )


# ---- J9 ------------------------------------------------------------------------------------------

def data_health(tx: DataFrame) -> DataFrame:
    """0–100 score from history length, null share, user volume and varying columns."""
    numeric = numeric_columns(tx)
    nulls = sum((F.avg(F.col(c).isNull().cast("double")) for c in tx.columns), F.lit(0.0))
    varying = sum(
        (F.coalesce((F.stddev_samp(c) > 0).cast("double"), F.lit(0.0)) for c in numeric), F.lit(0.0)
    )
    days = whole_days(F.max(micros("timestamp")), F.min(micros("timestamp")))
    basics = tx.agg(
        days.alias("days_of_history"),
        (nulls / len(tx.columns)).alias("null_share"),
        (varying / max(len(numeric), 1)).alias("varying"),
    )
    # the distinct count is its own aggregate: mixing it in would expand every row per aggregate
    users = tx.agg(F.countDistinct("user_id")).scalar()
    rows = basics.withColumn("user_volume", users)
    parts = [
        F.least(F.lit(100.0), F.col("days_of_history") / 3.65),
        F.greatest(F.lit(0.0), 100 - F.col("null_share") * 500),
        F.least(F.lit(100.0), F.col("user_volume") / 1000 * 100),
    ]
    if numeric:
        parts.append(F.col("varying") * 100)
    score = sum(parts, F.lit(0.0)) / len(parts)
    rows = rows.withColumn("_score", score)
    status = (
        F.when(F.col("_score") > 85, "Excellent")
        .when(F.col("_score") > 65, "Good")
        .when(F.col("_score") > 40, "Fair")
        .otherwise("Poor")
    )
    return rows.select(
        F.round("_score", 1).alias("score"),
        status.alias("status"),
        "user_volume",
        F.round(F.col("null_share") * 100, 2).alias("null_pct"),
        "days_of_history",
    )


# ---- J10–J15 -------------------------------------------------------------------------------------

def user_sample(scored: DataFrame, n: int = 1000) -> DataFrame:
    """New users first, then the others by risk: a bounded top-n."""
    newest = F.when(F.col("lifecycle") == "New", 0).otherwise(1)
    risk = F.when(newest == 1, F.col("churn_probability"))
    return scored.orderBy(newest, risk.desc_nulls_last(), "user_id").limit(n)


def top_users(scored: DataFrame, n: int = 50) -> DataFrame:
    """Users whose churn, value and engagement make them the first to save."""
    weight = F.coalesce("frequency_score", F.lit(1)) if "frequency_score" in scored.columns else F.lit(1)
    ltv = F.coalesce("predicted_ltv", "monetary", F.lit(0.0))
    most = facts(scored, m=F.max(ltv))["m"] or 0.0
    score = F.col("churn_probability") * (ltv / F.lit(max(most, 1.0))) * weight
    best = facts(scored, m=F.max(score))["m"] or 0.0
    ranked = scored.withColumn("priority", score).orderBy(F.desc("priority"), "user_id").limit(n)
    return ranked.withColumn(
        "priority_pct", F.least(F.lit(100.0), F.col("priority") / F.lit(max(best, 1.0)) * 100)
    )


def onboarding(scored: DataFrame, search: str = "", page: int = 1, size: int = 10) -> DataFrame:
    """One page of new users by risk, optionally filtered by a part of the id."""
    new = scored.where(F.col("lifecycle") == "New")
    if search:
        new = new.where(F.contains(F.lower("user_id"), F.lit(search.lower())))
    ordered = new.orderBy(F.desc("churn_probability"), "user_id")
    return ordered.offset((page - 1) * size).limit(size)


def segment_priority(segments: DataFrame, risk: DataFrame, kpi: DataFrame) -> DataFrame:
    """The segment to act on: onboarding when over 15 % of users are new and risky."""
    worst = segments.orderBy(F.desc("avg_churn"), "segment").limit(1)
    new_risky = risk.select("onboarding_risk_users").scalar()
    total = kpi.select("total_users").scalar()
    rows = worst.select("segment", "avg_churn").withColumns({"_new": new_risky, "_total": total})
    onboard = F.col("_new") > F.col("_total") * 0.15
    return rows.select(
        F.when(onboard, "Onboarding").otherwise(F.col("segment")).alias("priority_segment"),
        flag(onboard).alias("is_onboarding"),
        F.col("segment").alias("worst_segment"),
        "avg_churn",
    )


def personas(users: DataFrame) -> DataFrame:
    return users.withColumn("persona", lookup_text(PERSONAS, F.col("segment"), F.col("segment")))


def roi_status(scored: DataFrame) -> DataFrame:
    cost = F.lit(15.0)
    if "intervention_cost" in scored.columns:
        given = F.col("intervention_cost")
        cost = F.when(given.isNull() | (given == 0), 15.0).otherwise(given)
    if "is_profitable" in scored.columns:
        good: Column = F.col("is_profitable")
    else:
        good = F.col("predicted_ltv") > F.col("monetary") + cost
    return scored.withColumns(
        {
            "roi_status": F.when(good, "Profitable").otherwise("At Risk / Non-Profitable"),
            "roi_cost": cost,
        }
    )
