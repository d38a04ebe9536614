"""Testable hypotheses from the strongest drivers and from segment statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import fixed_digits, grouped, numeric_columns
from holdfast.functions.fixed import (
    CURRENCY_PARTS,
    DEFAULT_HYPOTHESIS,
    GAP_TEXT,
    HYPOTHESIS_TEXT,
    IDENTIFIER_PARTS,
    ONE_SIDED_HYPOTHESIS,
)
from holdfast.functions.order import facts
from holdfast.operators.simulate import Score, counterfactual_lift
from holdfast.session import small_table

_SCHEMA = (
    "rank int, title string, hypothesis string, test string, driver string, stat string, "
    "impact string, expected_lift_pct double"
)
_CONCEPTS = {
    "recency": ("recency", "delay"),
    "frequency": ("frequency", "count", "diversity"),
    "monetary": ("monetary", "velocity", "value", "balance", "amount", "spend"),
}


def concept_of(feature: str) -> str:
    return next((c for c, parts in _CONCEPTS.items() if any(p in feature for p in parts)), feature)


def _shown(value: float, currency: bool) -> str:
    return f"₹{int(value):,}" if currency else f"{value:.1f}"


def hypotheses(
    scored: DataFrame,
    driver_rows: Sequence[tuple[str, str]],
    threshold: float = 0.5,
    domain: str = "retail",
    score: Score | None = None,
    limit: int = 3,
) -> DataFrame:
    """Up to three hypotheses, one per concept, from the eight strongest drivers.

    `driver_rows` are (raw feature, readable name) in order. The means of all drivers on both sides
    of the threshold come out of one aggregate; each accepted driver costs one scoring pass.
    """
    spark = scored.sparkSession
    p = F.col("churn_probability")
    top = list(driver_rows)[:8]
    column = {c.lower(): c for c in numeric_columns(scored)}
    named = {raw: column.get(raw.lower()) or column.get(concept_of(raw.lower())) for raw, _ in top}
    stats = {"users": F.count(F.lit(1)), "high": F.count_if(p >= threshold), "mean": F.avg(p)}
    for i, (raw, _) in enumerate(top):
        if named[raw]:
            value = F.col(named[raw]).cast("double")
            stats[f"h{i}"] = F.avg(F.when(p >= threshold, value))
            stats[f"l{i}"] = F.avg(F.when(p < threshold, value))
    row = facts(scored, **stats)

    if row["high"] in (0, row["users"]):
        churn = (row["mean"] or 0.0) * 100
        title, text, test, driver, stat, impact = ONE_SIDED_HYPOTHESIS
        lift = round(min(18.0, max(2.5, churn / 100 * 25)), 1)
        made = [(1, title, text.format(churn=churn), test, driver, stat.format(churn=churn), impact, lift)]
        return small_table(spark, made, _SCHEMA)

    def lift_of(raw: str, target: float, reduce: bool) -> float:
        return counterfactual_lift(scored, score, named[raw], target, reduce, threshold)

    made, seen = [], set()
    for i, (raw, shown) in enumerate(top):
        if len(made) == limit:
            break
        name, concept = raw.lower(), concept_of(raw.lower())
        skip = any(part in name for part in IDENTIFIER_PARTS)
        if skip or concept in seen or named[raw] is None or row[f"h{i}"] is None:
            continue
        high, low = row[f"h{i}"], row[f"l{i}"]
        words = {"f": shown, "fl": shown.lower()}
        if concept == "recency":
            goal = int(max(7.0, high * 0.8))
            lift = lift_of(raw, goal, True)
            words.update(a=int(high), b=goal)
        elif concept == "frequency":
            goal = int(max(high + 1, high * 1.25))
            goal = max(30, goal) if "tenure" in name or "age" in name else goal
            lift = lift_of(raw, goal, False)
            words.update(a=int(high), b=goal)
        elif concept == "monetary":
            if abs(high - low) < low * 0.05:
                continue
            currency = any(part in name for part in CURRENCY_PARTS)
            if currency and high < 10.0:
                goal = max(high * 1.20, 50.0)
            else:
                goal = high + 1.0 if high < 1.0 else high * 1.20
            lift = lift_of(raw, goal, False)
            words.update(a=_shown(high, currency), b=_shown(goal, currency))
        else:
            lift = lift_of(raw, low, not low > high)
            key = next(k for k in GAP_TEXT if k in name)
            words.update(a=high, b=low, ai=int(high), bi=int(low), lift=lift)
            title, text, test = (t.format(**words) for t in GAP_TEXT[key])
            gap = abs(low - high) / max(abs(low), 0.001) * 100
            impact = "High" if lift > 7 else "Medium"
            made.append((len(made) + 1, title, text, test, shown, f"Gap: {gap:.1f}%", impact, lift))
            seen.add(concept)
            continue
        words["lift"] = lift
        wording = HYPOTHESIS_TEXT.get((concept, domain), HYPOTHESIS_TEXT[(concept, "")])
        title, text, test, stat = (t.format(**words) for t in wording[:4])
        made.append((len(made) + 1, title, text, test, shown, stat, wording[4], lift))
        seen.add(concept)
    if not made:
        title, text, test, driver, stat, impact, lift = DEFAULT_HYPOTHESIS
        made = [(1, title, text, test, driver, stat, impact, lift)]
    return small_table(spark, made, _SCHEMA)


def driver_means(scored: DataFrame, features: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Mean of each feature on both sides of the threshold, as rows."""
    p = F.col("churn_probability")
    long = scored.select("churn_probability", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ["churn_probability"], list(features), "feature", "value"
    )
    return long.groupBy("feature").agg(
        F.avg(F.when(p >= threshold, F.col("value"))).alias("high_risk_mean"),
        F.avg(F.when(p < threshold, F.col("value"))).alias("low_risk_mean"),
    )


def rule_hypotheses(segments: DataFrame, top_feature: str, top_importance: float) -> DataFrame:
    """Worst segment, strongest driver and best segment as three ready-made hypotheses."""
    fields = F.struct("segment", "count", "avg_churn", "avg_monetary")
    # the segment name breaks ties between equally bad or good segments
    picked = segments.agg(
        F.min_by(fields, F.struct(-F.col("avg_churn"), F.col("segment"))).alias("w"),
        F.min_by(fields, F.struct(F.col("avg_churn"), F.col("segment"))).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    w, b = F.col("w"), F.col("b")
    users, churn = w["count"].cast("string"), fixed_digits(w["avg_churn"] * 100, 1)
    best = fixed_digits(b["avg_churn"] * 100, 1)
    worst = picked.select(
        F.lit(1).alias("rank"),
        F.concat(F.lit("Targeted Retention for '"), w["segment"], F.lit("' Segment")).alias("title"),
        F.concat(
            F.lit("The '"), w["segment"], F.lit("' segment ("), users, F.lit(" users) has the highest churn rate at "),
            churn, F.lit("%. Their avg spend is ₹"), grouped(w["avg_monetary"]), F.lit("."),
        ).alias("hypothesis"),
        F.concat(
            F.lit("Reduce churn by 5-8% for "), users, F.lit(" users, protecting ~₹"),
            grouped(w["avg_monetary"] * w["count"] * 0.05), F.lit(" in revenue."),
        ).alias("expected_impact"),
        w["segment"].alias("driver"),
        F.lit("Critical").alias("impact"),
        F.lit("High").alias("confidence"),
    )
    share = f"{top_importance * 100:.1f}"
    driver = picked.select(
        F.lit(2).alias("rank"),
        F.lit(f"Address Primary Churn Driver: {top_feature}").alias("title"),
        F.lit(
            f"{top_feature} is the #1 churn predictor (importance: {share}%). Users with extreme "
            f"{top_feature.lower()} values are disproportionately churning."
        ).alias("hypothesis"),
        F.lit("3-6% reduction in at-risk user churn within 30 days.").alias("expected_impact"),
        F.lit("Behavioral").alias("driver"),
        F.lit("High").alias("impact"),
        F.lit("High").alias("confidence"),
    )
    cross = picked.where("n > 1").select(
        F.lit(3).alias("rank"),
        F.lit("Cross-Sell to Retain High-Value Users").alias("title"),
        F.concat(
            F.lit("'"), b["segment"], F.lit("' users (churn: "), best,
            F.lit("%) have high engagement. Expanding their product portfolio could lock in long-term loyalty."),
        ).alias("hypothesis"),
        F.lit("Increase ARPU by 10% and reduce churn by 3-5% through product stickiness.").alias("expected_impact"),
        F.lit("Product Mix").alias("driver"),
        F.lit("Medium").alias("impact"),
        F.lit("Medium").alias("confidence"),
    )
    return worst.unionByName(driver).unionByName(cross)
