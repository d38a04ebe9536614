"""User feature table: RFM, inter-purchase intervals, trends, ratios, scores, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from holdfast.functions.columns import (
    DAY_US,
    log1p_floor,
    micros,
    numeric_columns,
    ratio,
    segment_of,
    segment_of_total,
    whole_days,
)
from holdfast.functions.fixed import RESERVED_COLUMNS
from holdfast.functions.order import (
    facts,
    long_form,
    pct_rank_days,
    positions,
    quantiles,
)
from holdfast.operators.activity import activity, gap_deviation, gap_median, span
from holdfast.session import hold


# ---- C1: plain per-user aggregate ------------------------------------------------------------

def rfm_base(tx: DataFrame) -> DataFrame:
    """Recency, frequency, monetary and basket statistics in one combined aggregate."""
    ref = F.lit((span(tx)[1] or 0) + DAY_US)
    amount = F.col("amount").cast("double")
    users = tx.where("timestamp is not null").groupBy("user_id").agg(
        F.count("amount").alias("frequency"),
        F.sum(amount).alias("monetary"),
        F.avg(amount).alias("avg_basket_value"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("monetary_std"),
        F.max(amount).alias("max_spend"),
        F.min(amount).alias("min_spend"),
        F.min(micros("timestamp")).alias("first_us"),
        F.max(micros("timestamp")).alias("last_us"),
    )
    return users.withColumn("recency", whole_days(ref, F.col("last_us")).cast("double")).withColumn(
        "account_age_days",
        F.greatest(whole_days(ref, F.col("first_us")), F.lit(1)).cast("double"),
    )


# ---- D1 / C2: features that read the activity table --------------------------------------------

def base_columns() -> list[Column]:
    ref = F.col("as_of_us") + F.lit(DAY_US)
    spread = F.col("spread") / (F.col("n") - 1)
    return [
        F.col("user_id"),
        F.col("n").alias("frequency"),
        F.col("spend").alias("monetary"),
        (F.col("spend") / F.col("n")).alias("avg_basket_value"),
        F.when(F.col("n") > 1, F.sqrt(spread)).otherwise(F.lit(0.0)).alias("monetary_std"),
        "max_spend",
        "min_spend",
        whole_days(ref, F.col("last_us")).cast("double").alias("recency"),
        F.greatest(whole_days(ref, F.col("first_us")), F.lit(1)).cast("double").alias("account_age_days"),
    ]


def single_buyer_interval(act: DataFrame) -> float:
    """Interval given to one-time buyers: min(median, 90 %) of the user medians, 30 without any.

    User medians are multiples of half a day, so the histogram is bounded by the calendar.
    """
    hist = act.select(gap_median().alias("v")).where("v is not null").groupBy("v").count()
    both = facts(hist, q=F.expr("percentile(v, array(0.5, 0.9), count)"))["q"]
    return min(both) if both else 30.0


def ipi_columns(act: DataFrame) -> dict[str, Column]:
    return {
        "ipi_median": F.coalesce(gap_median(), F.lit(float(single_buyer_interval(act)))),
        "ipi_std": F.coalesce(gap_deviation(), F.lit(0.0)),
    }


def ipi(tx: DataFrame, act: DataFrame | None = None) -> DataFrame:
    """Inter-purchase interval statistics per user."""
    act = activity(tx) if act is None else act
    users = act.withColumns(ipi_columns(act)).select(*base_columns(), "ipi_median", "ipi_std")
    return with_interval_scores(users).select(
        "user_id", "ipi_median", "ipi_std", "ipi_consistency", "recency_deviation"
    )


def with_interval_scores(users: DataFrame) -> DataFrame:
    return users.withColumns(
        {
            "ipi_consistency": F.lit(1.0) / (F.lit(1.0) + F.col("ipi_std") / F.lit(30.0)),
            "recency_deviation": F.greatest(F.col("recency") - F.col("ipi_median"), F.lit(0.0)),
        }
    )


def velocity(monetary: Column, age: Column) -> Column:
    """Spend per day over at least a week of account age."""
    return F.greatest(monetary / F.greatest(age, F.lit(7.0)), F.lit(0.0))


def engineered_columns(act: DataFrame) -> list[str]:
    return [c for c in ("old_n", "old_spend", "recent_spend", "failures", "checked") if c in act.columns]


def rfm(tx: DataFrame, is_summary: bool = False, act: DataFrame | None = None) -> DataFrame:
    """User table with base, interval and velocity features (no scores yet)."""
    if is_summary:
        return rfm_summary(tx)
    act = activity(tx) if act is None else act
    users = act.withColumns(ipi_columns(act)).select(*base_columns(), "ipi_median", "ipi_std")
    users = with_interval_scores(users)
    return users.withColumn("monetary_velocity", velocity(F.col("monetary"), F.col("account_age_days")))


# ---- C3 / C4: summaries and first attributes ----------------------------------------------------

def earliest(col: str) -> Column:
    """First non-null value by time (the smallest value among equal instants)."""
    return F.min(F.when(F.col(col).isNotNull(), F.struct("timestamp", col)))[col]


def first_attributes(tx: DataFrame, cols: Sequence[str]) -> DataFrame:
    return tx.groupBy("user_id").agg(*[earliest(c).alias(c) for c in cols])


def attach_attributes(users: DataFrame, tx: DataFrame) -> DataFrame:
    """Left join the first value of every further column of `tx`."""
    taken = {*users.columns, *RESERVED_COLUMNS, "user_id", "timestamp"}
    cols = [c for c in tx.columns if c not in taken]
    return users.join(first_attributes(tx, cols), "user_id", "left") if cols else users


def rfm_summary(tx: DataFrame) -> DataFrame:
    """Customer-summary rows: no intervals; tenure and salary stand in for age and velocity."""
    ref = F.lit((span(tx)[1] or 0) + DAY_US)
    amount = F.col("amount").cast("double")
    aggs = [
        F.count("amount").alias("frequency"),
        F.sum(amount).alias("monetary"),
        F.avg(amount).alias("avg_basket_value"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("monetary_std"),
        F.max(amount).alias("max_spend"),
        F.min(amount).alias("min_spend"),
        F.max(micros("timestamp")).alias("last_us"),
    ]
    source = next((c for c in ("monetary_velocity", "estimated_salary") if c in tx.columns), None)
    if "tenure" in tx.columns:
        aggs.append(earliest("tenure").alias("_tenure"))
    if source:
        aggs.append(earliest(source).alias("_velocity"))
    users = tx.where("timestamp is not null").groupBy("user_id").agg(*aggs)
    age = F.col("_tenure").cast("double") * 30.0 if "tenure" in tx.columns else F.lit(365.0)
    users = users.withColumns(
        {
            "recency": whole_days(ref, F.col("last_us")).cast("double"),
            "ipi_consistency": F.lit(1.0),
            "ipi_median": F.lit(0.0),
            "ipi_std": F.lit(0.0),
            "recency_deviation": F.lit(0.0),
            "account_age_days": age,
        }
    )
    if source:
        daily = F.coalesce(F.col("_velocity").cast("double"), F.lit(0.0))
        daily = daily / F.lit(365.0) if source == "estimated_salary" else daily
    else:
        daily = F.col("monetary") / F.greatest(F.col("account_age_days"), F.lit(7.0))
    users = users.withColumn("monetary_velocity", daily)
    return hold(users.drop("last_us", "_tenure", "_velocity"))


# ---- C5–C10 --------------------------------------------------------------------------------------

_NOT_MEANS = {
    "user_id", "timestamp", "amount", "target_churn", "churned", "domain", "_is_summary",
    "description", "status", "customer_id",
}


def numeric_means(tx: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Per-user mean of the further numeric columns."""
    cols = numeric_columns(tx, {*_NOT_MEANS, *exclude})
    return tx.groupBy("user_id").agg(*[F.avg(c).alias(c) for c in cols]) if cols else (
        tx.select("user_id").distinct()
    )


def trend_columns() -> dict[str, Column]:
    """Second half over first half of the observation window, add-one smoothed."""
    old_n, old_spend = F.coalesce("old_n", F.lit(0)), F.coalesce("old_spend", F.lit(0.0))
    new_spend = F.col("spend") - old_spend
    return {
        "frequency_trend": (F.col("n") - old_n + 1) / (old_n + 1),
        "monetary_trend": (new_spend + 1) / (old_spend + 1),
    }


def trend_features(tx: DataFrame, act: DataFrame | None = None) -> DataFrame:
    act = activity(tx) if act is None else act
    return act.select("user_id", *[c.alias(n) for n, c in trend_columns().items()])


def failure_rate(tx: DataFrame) -> DataFrame:
    return tx.groupBy("user_id").agg(
        F.coalesce(F.avg(F.col("is_failure").cast("double")), F.lit(0.0)).alias("failure_rate")
    )


def recent_spend_ratio(tx: DataFrame, act: DataFrame | None = None) -> DataFrame:
    act = activity(tx) if act is None else act
    return act.select("user_id", _recent_ratio().alias("recent_spend_ratio"))


def _recent_ratio() -> Column:
    return F.coalesce(F.col("recent_spend") / (F.col("spend") + F.lit(1e-9)), F.lit(0.0))


def ratio_columns(users: DataFrame, labelled: bool = False) -> dict[str, Column]:
    """Interaction and log features. The labelled variant pads divisors and has fewer of them."""
    tiny = F.lit(1e-9)
    age = F.col("account_age_days")
    made = {
        "ipi_ratio": F.col("recency") / (F.col("ipi_median") + tiny),
        "recency_x_ipi": F.col("recency") * F.col("ipi_median"),
        "monetary_x_frequency": F.col("monetary") * F.col("frequency"),
        "monetary_per_txn": F.col("monetary") / (F.col("frequency") + tiny),
        "frequency_velocity": F.col("frequency") / (age + tiny) if labelled else ratio(F.col("frequency"), age),
    }
    logs = ["monetary", "frequency", "avg_basket_value", "monetary_velocity"]
    if not labelled:
        made["monetary_ratio"] = F.col("monetary") / (F.col("max_spend") + tiny)
        logs.append("max_spend")
    made.update({f"log_{c}": log1p_floor(F.col(c)) for c in logs if c in users.columns})
    return made


def ratio_features(users: DataFrame, labelled: bool = False) -> DataFrame:
    return users.withColumns(ratio_columns(users, labelled))


def engineered(users: DataFrame, act: DataFrame) -> DataFrame:
    """All features of unlabelled training and scoring on top of `rfm`."""
    extra = {**trend_columns(), "recent_spend_ratio": _recent_ratio()}
    if "failures" in act.columns:
        extra["failure_rate"] = F.coalesce(ratio(F.col("failures"), F.col("checked")), F.lit(0.0))
    more = act.select("user_id", *[c.alias(n) for n, c in extra.items()])
    joined = ratio_features(users.join(more, "user_id"))
    return pct_rank_days(joined, "recency", "recency_pct")


def labels_from_flag(tx: DataFrame) -> DataFrame:
    return tx.groupBy("user_id").agg(
        F.coalesce(F.max("target_churn"), F.lit(0)).cast("int").alias("churned")
    )


def total_users(tx: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("user_id") if approximate else F.countDistinct("user_id")
    return tx.agg(count.alias("total_users"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows and share of all rows per value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("users"))
    total = counts.agg(F.sum("users")).scalar()
    return counts.withColumn("share", F.round(F.col("users") / total, 6))


def counterparty_diversity(tx: DataFrame, col: str) -> DataFrame:
    return tx.groupBy("user_id").agg(F.countDistinct(col).alias("counterparties"))


def join_users(left: DataFrame, right: DataFrame, fill: dict | None = None) -> DataFrame:
    """Left join on the user with overlapping columns of `right` dropped; optional fill values."""
    fresh = right.select("user_id", *[c for c in right.columns if c not in left.columns])
    out = left.join(fresh, "user_id", "left")
    return out.fillna(fill) if fill else out


# ---- D3–D5: scores and segments ------------------------------------------------------------------

_SCORED = ["recency", "frequency", "monetary"]
_FIFTHS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def rank_cuts(users: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, list[Row]]]:
    """feature -> (users, the four (value, user_id) rows that end the first four rank fifths)."""
    ranked = positions(long_form(users, cols, ["user_id"]), ["value", "user_id"], by=["feature"])
    wanted = " or ".join(f"_pos = ((_size - 1) * {k}) div 5" for k in (1, 2, 3, 4))
    rows = ranked.where(wanted).collect()  # at most four rows per column
    cuts: dict[str, tuple[int, list[Row]]] = {}
    for col in cols:
        mine = {r["_pos"]: r for r in rows if r["feature"] == col}
        if mine:
            size = next(iter(mine.values()))["_size"]
            cuts[col] = (size, [mine[(size - 1) * k // 5] for k in (1, 2, 3, 4)])
    return cuts


def quintile_scores(users: DataFrame) -> DataFrame:
    """r, f, m scores 1..5.

    A column whose six quintile edges differ is cut at the edges (right-closed). Otherwise users
    are ordered by (value, user_id) and cut at the rank positions; only the four cut rows of such
    a column are looked up, no rank is attached to users.
    """
    users = hold(users)
    edges = quantiles(users, _SCORED, _FIFTHS)
    tied = [c for c in _SCORED if c in edges and len(set(edges[c])) < len(_FIFTHS)]
    cuts = rank_cuts(users, tied) if tied else {}

    def fifth(col: str) -> Column:
        if col not in edges:
            return F.lit(3)
        value = f"cast({col} as double)"
        if col not in cuts:
            above = [f"if({value} > {edges[col][k]!r}D, 1, 0)" for k in (1, 2, 3, 4)]
        else:
            size, rows = cuts[col]
            if size == 1:
                return F.lit(3)
            above = [
                f"if(struct({value}, user_id) > struct({r['value']!r}D, {_quoted(r['user_id'])}), 1, 0)"
                for r in rows
            ]
        return F.expr(f"if({value} is null, 3, 1 + {' + '.join(above)})")

    return users.withColumns(
        {
            "r_score": F.lit(6) - fifth("recency"),
            "f_score": fifth("frequency"),
            "m_score": fifth("monetary"),
        }
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rfm_scores(users: DataFrame) -> DataFrame:
    return users.withColumns(
        {
            "rfm_score": F.col("r_score") + F.col("f_score") + F.col("m_score"),
            "rfm_raw": F.concat_ws("-", *[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]),
        }
    )


def assign_segment(users: DataFrame) -> DataFrame:
    age = F.col("account_age_days") if "account_age_days" in users.columns else None
    return users.withColumn("segment", segment_of(F.col("r_score"), F.col("f_score"), F.col("m_score"), age))


def assign_segment_legacy(users: DataFrame) -> DataFrame:
    return users.withColumn("segment", segment_of_total(F.col("rfm_score"), F.col("r_score")))


def user_table(tx: DataFrame, is_summary: bool = False, act: DataFrame | None = None) -> DataFrame:
    """Features, scores and segment: the table every report starts from."""
    return assign_segment(rfm_scores(quintile_scores(rfm(tx, is_summary, act))))
