"""Two-sample Kolmogorov–Smirnov drift over many columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.columns import numeric_columns, title_name
from holdfast.functions.fixed import DRIFT_ACTIONS, DRIFT_REASONS
from holdfast.functions.order import long_form, running_totals
from holdfast.session import hold

ALPHA = 0.05
SERIES_TERMS = 100


def p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value: the alternating series with lambda = D sqrt(n1 n2 / (n1+n2))."""
    scale = d * F.sqrt(n1 * n2 / (n1 + n2))
    terms = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    total = F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scale * scale),
    )
    # the series needs a positive argument; for tiny ones the probability is 1
    return F.when(scale < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_long(samples: DataFrame, minimum: int = 5) -> DataFrame:
    """(feature, value, in_a, in_b) -> one row per feature with D, p and both sizes.

    Equal values are counted before any shuffle of the ordering step, and the cumulative
    distributions are running totals over distinct values.
    """
    hist = samples.groupBy("feature", "value").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    run = running_totals(hist, "value", ["a", "b"], by=["feature"])
    gap = F.abs(F.col("cum_a") / F.col("tot_a") - F.col("cum_b") / F.col("tot_b"))
    usable = run.where((F.col("tot_a") >= minimum) & (F.col("tot_b") >= minimum))
    rows = usable.groupBy("feature").agg(
        F.max(gap).alias("d"), F.max("tot_a").alias("n_a"), F.max("tot_b").alias("n_b")
    )
    p = p_value(F.col("d"), F.col("n_a").cast("double"), F.col("n_b").cast("double"))
    return rows.withColumn("p", p)


def ks_two_sample(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    side_a = long_form(a, cols).withColumns({"in_a": F.lit(1), "in_b": F.lit(0)})
    side_b = long_form(b, cols).withColumns({"in_a": F.lit(0), "in_b": F.lit(1)})
    return ks_long(side_a.unionByName(side_b))


def flag_drift(ks: DataFrame, features: int) -> DataFrame:
    """Rounded statistic, p-value and the Bonferroni-corrected verdict."""
    return ks.select(
        "feature",
        F.round("d", 4).alias("ks_statistic"),
        F.round("p", 6).alias("p_value"),
        (F.col("p") < F.lit(ALPHA / max(features, 1))).alias("drifted"),
        F.col("p").alias("raw_p"),
    )


_NOT_CHECKED = {"user_id", "target_churn", "_is_summary"}


def temporal_drift(tx: DataFrame, cutoff_us: int) -> DataFrame:
    """Numeric columns before against after the label cutoff: one pass over the rows."""
    cols = numeric_columns(tx, _NOT_CHECKED)
    past = F.unix_micros("timestamp") <= cutoff_us
    sided = tx.withColumns({"in_a": past.cast("int"), "in_b": (~past).cast("int")})
    samples = long_form(sided, cols, ["in_a", "in_b"])
    return flag_drift(ks_long(samples), len(cols))


# ---- A6 ------------------------------------------------------------------------------------------

def baseline_of(users: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, n, mean, std): how often each value occurs among all users, at six decimals."""
    values = long_form(users, cols).withColumn("value", F.round("value", 6))
    rows = hold(values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    means = rows.groupBy("feature").agg(mean.alias("_m"))
    spread = F.sqrt(F.sum(F.col("n") * F.pow(F.col("value") - F.col("_m"), 2)) / F.sum("n"))
    # one row per feature
    moments = rows.join(F.broadcast(means), "feature").groupBy("feature").agg(
        F.round(F.max("_m"), 6).alias("mean"), F.round(spread, 6).alias("std")
    )
    return rows.join(F.broadcast(moments), "feature")


def save_baseline(users: DataFrame, cols: Sequence[str], path: str) -> None:
    baseline_of(users, cols).write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved baseline, or None when there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def baseline_drift(users: DataFrame, baseline: DataFrame | None, cols: Sequence[str]) -> DataFrame | None:
    """Current users against the baseline; None asks the caller to save a first baseline."""
    if baseline is None:
        return None
    current = long_form(users, cols).withColumns({"in_a": F.lit(1), "in_b": F.lit(0)})
    saved = baseline.select("feature", "value", F.lit(0).alias("in_a"), F.col("n").alias("in_b"))
    return flag_drift(ks_long(current.unionByName(saved)), len(cols))


def check_against_baseline(users: DataFrame, cols: Sequence[str], path: str) -> tuple[str, DataFrame | None]:
    """Drift against the baseline at `path`; the first run saves it instead."""
    found = baseline_drift(users, load_baseline(users.sparkSession, path), cols)
    if found is None:
        save_baseline(users, cols, path)
        return "Baseline Saved (first run)", None
    return "Baseline Drift", found


# ---- sketches of unbounded values ------------------------------------------------------------------

SKETCH_K = 4096
#: Quantiles that stand for a side when two are compared.
SKETCH_POINTS = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """Error of a sketch's normalised ranks that holds with 99 % confidence."""
    return 2.296 / k**0.9021


def sketch_baseline(users: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """(by..., feature, sketch): a quantile sketch of bounded size per feature (and day, or any other group).

    Sketches are built on the map side and merge, so a baseline of many days is the merge of theirs
    (`merged_sketches`) and no value histogram is stored.
    """
    values = long_form(users, cols, list(by))
    return values.groupBy(*by, "feature").agg(F.kll_sketch_agg_double("value", k).alias("sketch"))


def merged_sketches(sketches: DataFrame, k: int = SKETCH_K) -> DataFrame:
    return sketches.groupBy("feature").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_ks(a: DataFrame, b: DataFrame, k: int = SKETCH_K, points: int = SKETCH_POINTS, minimum: int = 5) -> DataFrame:
    """One row per feature of two sketch tables: D, its error bound, p and both sizes.

    Each side stands for `points` of its quantiles in equal steps. D is off by no more than the rank
    errors of both sketches and one step a side; a sketch of fewer than k values has no rank error.
    """
    steps = F.lit([i / points for i in range(1, points + 1)])

    def side(sketches: DataFrame, in_a: int) -> DataFrame:
        values = F.explode(F.kll_sketch_get_quantile_double("sketch", steps)).alias("value")
        return sketches.select("feature", values, F.lit(in_a).alias("in_a"), F.lit(1 - in_a).alias("in_b"))

    sizes = a.select("feature", F.kll_sketch_get_n_double("sketch").alias("n_a")).join(
        b.select("feature", F.kll_sketch_get_n_double("sketch").alias("n_b")), "feature")
    rows = ks_long(side(a, 1).unionByName(side(b, 0))).select("feature", "d").join(sizes, "feature")
    rows = rows.where((F.col("n_a") >= minimum) & (F.col("n_b") >= minimum))
    error = sum((F.when(F.col(n) <= k, 0.0).otherwise(rank_error(k)) + F.lit(1.0 / points) for n in ("n_a", "n_b")), F.lit(0.0))
    return rows.withColumns({
        "d_error": error, "p": p_value(F.col("d"), F.col("n_a").cast("double"), F.col("n_b").cast("double"))})


def sketch_drift(users: DataFrame, baseline: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Current users against a sketch baseline: the flags of `flag_drift`, the error of D, and whether
    the verdict would be the same at both ends of it (if not, the exact comparison decides)."""
    found = hold(sketch_ks(hold(sketch_baseline(users, cols)), baseline))
    level = F.lit(ALPHA / max(len(cols), 1))
    sizes = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    ends = [p_value(F.greatest(F.col("d") + side * F.col("d_error"), F.lit(0.0)), *sizes) < level for side in (-1, 1)]
    sure = found.select("feature", F.round("d_error", 6).alias("ks_error"), (ends[0] == ends[1]).alias("sure"))
    return flag_drift(found, len(cols)).join(sure, "feature")


# ---- G5 ------------------------------------------------------------------------------------------

def drift_summary(flagged: DataFrame, top: int = 5) -> DataFrame:
    """One row: counts, severity, top drifted features, reason and actions.

    `flagged` has one row per feature, so its list of structs is small.
    """
    drifted = F.col("drifted")
    worst = F.sort_array(
        F.collect_list(
            F.when(drifted, F.struct((-F.col("ks_statistic")).alias("k"), "feature", "ks_statistic", "p_value"))
        )
    )
    rows = flagged.agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_if(drifted).alias("drifted_count"),
        F.coalesce(F.median("raw_p"), F.lit(1.0)).alias("median_p"),
        F.transform(
            F.slice(worst, 1, top),
            lambda s: F.struct(title_name(s["feature"]).alias("feature"), s["ks_statistic"], s["p_value"]),
        ).alias("top_drifted"),
    )
    share = F.round(F.col("drifted_count") / F.greatest("total_features", F.lit(1)) * 100, 1)
    rows = rows.withColumn("drifted_pct", share)
    high = (F.col("drifted_pct") >= 50) & (F.col("median_p") < 0.01)
    low = (F.col("drifted_pct") >= 25) | (F.col("median_p") < 0.05)
    rows = rows.withColumns(
        {
            "status": F.when(high, "HIGH DRIFT").when(low, "LOW DRIFT").otherwise("STABLE"),
            "data_drift_status": F.when(high, "Drift Detected").otherwise("Stable"),
        }
    )

    def per_status(make) -> Column:
        return (
            F.when(F.col("status") == "HIGH DRIFT", make("HIGH DRIFT"))
            .when(F.col("status") == "LOW DRIFT", make("LOW DRIFT"))
            .otherwise(make("STABLE"))
        )

    pct = F.format_string("%.1f", "drifted_pct")
    return rows.withColumns(
        {
            "avg_p_value": F.round("median_p", 6),
            "severity_reason": per_status(
                lambda s: F.format_string(DRIFT_REASONS[s], "drifted_count", "total_features", pct)
            ),
            "recommended_actions": per_status(lambda s: F.array(*[F.lit(a) for a in DRIFT_ACTIONS[s]])),
        }
    ).drop("median_p")
