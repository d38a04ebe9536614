"""Exact evaluation of scores without collecting them: thresholds, AUC, confusion counts.

All take rows with `p` (score) and `label` (0/1). Distinct scores are counted first, so the
ordering step sees each of them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import ratio
from holdfast.functions.fixed import THRESHOLD_GRID
from holdfast.functions.order import running_totals
from holdfast.session import small_table

MIN_RECALL = MIN_SPECIFICITY = 0.55


def score_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("p").agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("label")).cast("bigint")).alias("neg"),
    )


def _rate(top: Column, bottom: Column) -> Column:
    return top / F.greatest(bottom, F.lit(1))


def threshold_table(scored: DataFrame) -> DataFrame:
    """Every candidate threshold with its counts and the balanced utility score."""
    spark = scored.sparkSession
    clipped = scored.select(F.least(F.greatest("p", F.lit(0.01)), F.lit(0.99)).alias("p"), "label")
    grid = small_table(spark, [(t, 0, 0) for t in THRESHOLD_GRID], "p double, pos bigint, neg bigint")
    # clipped scores may not be used for counting: count with the raw ones, at every candidate
    marks = score_histogram(clipped).select("p", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    raw = score_histogram(scored).withColumn("candidate", F.lit(0))
    candidates = marks.unionByName(grid).withColumn("candidate", F.lit(1))
    merged = raw.unionByName(candidates).groupBy("p").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("candidate").alias("candidate")
    )
    run = running_totals(merged, "p", ["pos", "neg"]).where("candidate = 1")
    below_pos, below_neg = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    rows = run.select(
        F.col("p").alias("threshold"),
        (F.col("tot_pos") - below_pos).alias("tp"),
        (F.col("tot_neg") - below_neg).alias("fp"),
        below_pos.alias("fn"),
        below_neg.alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = rows.withColumns(
        {
            "precision": _rate(tp, tp + fp),
            "recall": _rate(tp, tp + fn),
            "specificity": _rate(tn, tn + fp),
            "_imbalance": F.abs(_rate(fp, tn + fp) - _rate(fn, tp + fn)),
        }
    )
    both = F.col("precision") + F.col("recall")
    rows = rows.withColumns(
        {
            "f1": 2 * F.col("precision") * F.col("recall") / F.greatest(both, F.lit(1e-9)),
            "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2,
        }
    )
    utility = 0.45 * F.col("f1") + 0.45 * F.col("balanced_accuracy") + 0.10 * (1 - F.col("_imbalance"))
    return rows.withColumn("score", utility).drop("_imbalance")


def optimise_threshold(scored: DataFrame) -> DataFrame:
    """The best candidate among those with enough recall and specificity, if there are any."""
    table = threshold_table(scored)
    fit = (F.col("recall") >= MIN_RECALL) & (F.col("specificity") >= MIN_SPECIFICITY)
    digits = 12  # scores that differ by float noise only are ties
    order = [F.desc(F.round(c, digits)) for c in ("score", "f1", "balanced_accuracy")]
    return table.orderBy(F.when(fit, 0).otherwise(1), *order, "threshold").limit(1)


def best_threshold(scored: DataFrame) -> float:
    row = optimise_threshold(scored).select("threshold").first()
    return float(row["threshold"]) if row else 0.5


def auc(scored: DataFrame) -> DataFrame:
    """Exact rank AUC with average ties, and Gini."""
    run = running_totals(score_histogram(scored), "p", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2))
    area = ratio(wins, F.max("tot_pos").cast("double") * F.max("tot_neg"))
    return run.agg(area.alias("roc_auc")).withColumn("gini", 2 * F.col("roc_auc") - 1)


def auc_value(scored: DataFrame) -> float:
    row = auc(scored).first()
    return float(row["roc_auc"]) if row and row["roc_auc"] is not None else 0.5


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """Counts, class-conditional rates in percent, accuracy and F1 in one aggregate."""
    hit, real = F.col("p") >= threshold, F.col("label") == 1
    counts = scored.agg(
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def pct(top: Column, bottom: Column) -> Column:
        return F.round(_rate(top, bottom) * 100, 1)

    return counts.withColumns(
        {
            "tp_rate": pct(tp, tp + fn),
            "fn_rate": pct(fn, tp + fn),
            "tn_rate": pct(tn, tn + fp),
            "fp_rate": pct(fp, tn + fp),
            "recall": pct(tp, tp + fn),
            "precision": pct(tp, tp + fp),
            "specificity": pct(tn, tn + fp),
            "accuracy": F.round(_rate(tp + tn, tp + fp + fn + tn), 4),
            "f1": F.round(F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), 4),
        }
    )
