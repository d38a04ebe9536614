"""Named queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import features as ft
from holdfast.operators import (
    attribution,
    drift,
    evaluation,
    hypotheses,
    ingest,
    labels,
    learners,
    money,
    reports,
    simulate,
)
from holdfast.operators.activity import activity
from holdfast.functions import fixed, order
from holdfast.functions.columns import DAY_US, micros
from holdfast.session import cut_lineage, hold, release, scratch_path, small_table, tune
from holdfast.sources import files, registry
from holdfast.sources import fixtures as fx
from holdfast.plans import report
from holdfast.streaming import events, live, scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Desk:
    """Tables that many queries start from, built once per session and folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder
        self._made: dict[str, object] = {}

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def tx(self) -> DataFrame:
        return self._once("tx", lambda: fx.orders_tx(self.spark, self.folder))

    @property
    def events(self) -> DataFrame:
        return self._once("events", lambda: fx.events_tx(self.spark, self.folder))

    @property
    def act(self) -> DataFrame:
        return self._once("act", lambda: activity(self.tx))

    @property
    def rfm(self) -> DataFrame:
        return self._once("rfm", lambda: hold(ft.rfm(self.tx, act=self.act)))

    @property
    def users(self) -> DataFrame:
        return self._once("users", lambda: hold(ft.user_table(self.tx, act=self.act)))

    @property
    def scored(self) -> DataFrame:
        """Users with the model-free score, money metrics and lifecycle."""

        def make():
            rated = money.financials(money.heuristic_churn(self.users), "retail")
            return hold(ft.join_users(rated, reports.lifecycle(self.tx, self.act)))

        return self._once("scored", make)

    @property
    def segments(self) -> DataFrame:
        return self._once("segments", lambda: hold(money.segment_churn(self.scored)))


_desks: dict[tuple[str, str], Desk] = {}


def desk(spark: SparkSession, folder: str) -> Desk:
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _desks:
        _desks[key] = Desk(spark, folder.rstrip("/"))
    return _desks[key]


def forget() -> None:
    """Drop all shared tables, so that the next query is timed from the parquet files."""
    _desks.clear()
    release()


def query(name: str):
    def keep(make: Callable[[Desk], DataFrame]):
        QUERIES[name] = lambda spark, folder: make(desk(spark, folder))
        return make

    return keep


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every double column, so that both engines agree on the last digit."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(
        *[
            F.round(F.col(c), special.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(c)
            for c in df.columns
        ]
    )


# ---- features ------------------------------------------------------------------------------------

@query("rfm_base")
def _(d):
    return rounded(ft.rfm_base(d.tx).drop("first_us", "last_us"))


@query("account_age")
def _(d):
    return rounded(d.rfm.select("user_id", "account_age_days", "monetary_velocity"))


@query("ipi")
def _(d):
    return rounded(ft.ipi(d.tx, d.act))


@query("ipi_events")
def _(d):
    return rounded(ft.ipi(d.events))


@query("first_attributes")
def _(d):
    return ft.first_attributes(d.tx, ["description", "status"])


@query("custom_numeric_means")
def _(d):
    lines = fx.retail_raw(d.spark, d.folder).withColumn("user_id", F.col("CustomerID").cast("string"))
    return rounded(ft.numeric_means(lines.select("user_id", "Quantity", "UnitPrice")))


@query("trend_features")
def _(d):
    return rounded(ft.trend_features(d.tx, d.act), 6)


@query("failure_rate")
def _(d):
    return rounded(ft.failure_rate(d.events), 6)


@query("recent_spend_ratio")
def _(d):
    return rounded(ft.recent_spend_ratio(d.tx, d.act), 6)


@query("ratio_features")
def _(d):
    made = ft.ratio_features(d.rfm)
    names = [c for c in made.columns if c not in d.rfm.columns]
    return rounded(made.select("user_id", *names), 3)


@query("total_users")
def _(d):
    return ft.total_users(d.tx)


@query("value_counts_segment")
def _(d):
    return ft.value_counts(d.users, "segment")


@query("value_counts_lifecycle")
def _(d):
    return ft.value_counts(d.scored, "lifecycle")


@query("counterparty_diversity")
def _(d):
    pays = fx.upi_raw(d.spark, d.folder).withColumnRenamed("Sender VPA", "user_id")
    return ft.counterparty_diversity(pays, "Payee VPA")


@query("max_gap")
def _(d):
    return reports.max_gap(d.tx, d.act)


@query("quintile_scores")
def _(d):
    return d.users.select("user_id", "r_score", "f_score", "m_score")


@query("quintile_scores_tied")
def _(d):
    users = ft.quintile_scores(ft.rfm(d.events))
    return users.select("user_id", "r_score", "f_score", "m_score")


@query("rfm_score")
def _(d):
    return d.users.select("user_id", "rfm_score", "rfm_raw")


@query("segment")
def _(d):
    return d.users.select("user_id", "segment")


@query("segment_legacy")
def _(d):
    return ft.assign_segment_legacy(d.users.drop("segment")).select("user_id", "segment")


@query("global_rank")
def _(d):
    ranked = order.global_rank(d.users.select("user_id", "monetary"), ["monetary", "user_id"])
    return ranked.select("user_id", "rank")


@query("pct_rank_avg")
def _(d):
    return rounded(order.pct_rank(d.users.select("user_id", "frequency"), "frequency", "pct"), 6).select(
        "user_id", "pct"
    )


@query("pct_rank_days")
def _(d):
    return rounded(order.pct_rank_days(d.users.select("user_id", "recency"), "recency", "pct"), 6).select(
        "user_id", "pct"
    )


@query("quantile_clip")
def _(d):
    return rounded(order.winsorise(d.users.select("user_id", "monetary"), ["monetary"]))


# ---- joins ---------------------------------------------------------------------------------------

@query("join_left_attrs")
def _(d):
    users = d.users.select("user_id", "segment")
    return ft.attach_attributes(users, d.tx.select("user_id", "timestamp", "description", "status"))


@query("join_inner_segment")
def _(d):
    per_user = d.tx.groupBy("user_id", "description").agg(F.count(F.lit(1)).alias("n"))
    joined = per_user.join(d.users.select("user_id", "segment"), "user_id")
    return joined.groupBy("segment", "description").agg(F.sum("n").alias("n"))


@query("join_semi_top")
def _(d):
    lines = fx.table(d.spark, d.folder, "lineitem").select("l_partkey", "l_quantity")
    top = lines.groupBy("l_partkey").count().orderBy(F.desc("count"), "l_partkey").limit(8)
    kept = lines.join(F.broadcast(top), "l_partkey", "left_semi")
    return rounded(kept.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")))


@query("join_anti_future")
def _(d):
    last = order.facts(d.act, t=F.max("as_of_us"))["t"]
    cut = F.timestamp_micros(F.lit(last - 120 * DAY_US))
    return labels.lapsed_users(d.act.where(F.timestamp_micros("first_us") <= cut), d.tx.where(F.col("timestamp") > cut))


@query("join_scalar")
def _(d):
    mean = d.users.agg(F.avg("monetary")).scalar()
    return rounded(d.users.select("user_id", (F.col("monetary") - mean).alias("above_mean")), 3)


@query("join_label_alignment")
def _(d):
    failing = d.events.where("is_failure = 1").select("user_id", "is_failure").distinct()
    everyone = d.events.select("user_id").distinct()
    return ft.join_users(everyone, failing, {"is_failure": 0})


# ---- money ---------------------------------------------------------------------------------------

@query("heuristic_churn")
def _(d):
    return rounded(money.heuristic_churn(d.users).select("user_id", "churn_probability"), 6)


@query("velocity_guard")
def _(d):
    idle = d.users.select("user_id", "monetary").withColumn("monetary_velocity", F.lit(0.0))
    return rounded(money.velocity_guard(idle).select("user_id", "monetary_velocity"))


@query("predicted_ltv")
def _(d):
    return rounded(money.heuristic_churn(d.users).select("user_id", money.predicted_ltv().alias("predicted_ltv")), 2)


@query("revenue_at_risk")
def _(d):
    p = money.heuristic_churn(d.users)
    return rounded(
        p.select(
            "user_id",
            money.revenue_at_risk("retail").alias("rar_90"),
            money.revenue_at_risk("tax").alias("rar_365"),
        ),
        2,
    )


@query("priority_score")
def _(d):
    return d.scored.select("user_id", "priority_score")


@query("clip_round")
def _(d):
    return d.scored.select("user_id", "revenue_at_risk", "predicted_ltv")


@query("intervention_cost")
def _(d):
    return rounded(d.scored.select("user_id", "intervention_cost"), 1)


@query("is_profitable")
def _(d):
    return d.scored.select("user_id", F.col("is_profitable").cast("int").alias("is_profitable"))


@query("rar_summary")
def _(d):
    return money.rar_summary(d.scored, 0.3)


@query("rar_by_segment")
def _(d):
    return rounded(money.rar_by_segment(d.scored, 0.3), 4, revenue_at_risk=2)


@query("potential_recovery")
def _(d):
    rows = money.potential_recovery(d.scored, 0.5, 0.8)
    return rows.withColumn("is_adaptive", F.col("is_adaptive").cast("int"))


@query("potential_recovery_adaptive")
def _(d):
    calm = d.scored.withColumn("churn_probability", F.col("churn_probability") * 0.4)
    rows = money.potential_recovery(calm, 0.5, 0.8, adaptive=True)
    return rows.withColumn("is_adaptive", F.col("is_adaptive").cast("int"))


@query("kpis")
def _(d):
    return rounded(money.kpis(d.scored), 5, mean_ltv=2)


@query("risk_counts")
def _(d):
    return money.risk_counts(d.scored)


@query("risk_tiers")
def _(d):
    tiers = money.risk_tiers(d.scored, 0.5)
    return rounded(tiers.select("user_id", "high_mark", "critical_mark", "risk_tier"), 6)


@query("segment_churn")
def _(d):
    rows = d.segments.withColumn("is_profitable", F.col("is_profitable").cast("int"))
    return rounded(rows, 4, total_revenue_at_risk=2, avg_monetary=2, est_ltv=1, intervention_cost=1)


@query("churn_forecast")
def _(d):
    return money.churn_forecast(d.scored, as_of_month=8)


@query("survival_floor")
def _(d):
    return rounded(money.survival_floor(reports.cohort_matrix(d.tx)), 5)


@query("portfolio_audit")
def _(d):
    return rounded(money.portfolio_audit(d.scored, "upi", 0.8))


@query("mean_ltv")
def _(d):
    return rounded(money.kpis(d.scored).select("mean_ltv"), 2)


@query("warning_cohort")
def _(d):
    calm = d.scored.withColumn("churn_probability", F.col("churn_probability") * 0.4)
    return money.warning_cohort(calm, 0.5).select("user_id", "is_warning")


# ---- reports -------------------------------------------------------------------------------------

@query("lifecycle")
def _(d):
    rows = reports.lifecycle(d.tx, d.act)
    return rows.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


@query("lifecycle_events")
def _(d):
    rows = reports.lifecycle(d.events)
    return rows.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


@query("cohort_retention")
def _(d):
    return reports.cohort_retention(d.tx)


@query("cohort_matrix")
def _(d):
    rows = reports.cohort_matrix(d.tx)
    return rows.select("cohort", "size", *[F.col("retention")[i].alias(f"m{i:02d}") for i in range(12)])


@query("product_mix_segment")
def _(d):
    return reports.product_mix_segment(d.tx, d.scored)


@query("product_risk")
def _(d):
    return rounded(reports.product_risk(d.tx, d.scored))


@query("interventions")
def _(d):
    return reports.interventions(d.segments, "Recency")


@query("intervention_roi")
def _(d):
    return rounded(reports.intervention_roi(d.segments, 0.8), 1, exposure=0)


@query("data_health")
def _(d):
    return reports.data_health(d.tx)


@query("user_sample")
def _(d):
    return rounded(reports.user_sample(d.scored, 1000).select("user_id", "lifecycle", "churn_probability"), 6)


@query("top_users_to_save")
def _(d):
    rows = reports.top_users(d.scored, 50).select("user_id", "priority", "priority_pct")
    return rounded(rows)


@query("onboarding_list")
def _(d):
    return rounded(reports.onboarding(d.scored, "1", 1, 10).select("user_id", "churn_probability"), 6)


@query("segment_priority")
def _(d):
    return reports.segment_priority(d.segments, money.risk_counts(d.scored), money.kpis(d.scored))


@query("personas")
def _(d):
    return reports.personas(d.users).select("user_id", "persona")


@query("roi_status")
def _(d):
    return rounded(reports.roi_status(d.scored).select("user_id", "roi_status", "roi_cost"), 1)


# ---- sources and ingestion -----------------------------------------------------------------------

@query("read_parquet_tx")
def _(d):
    both = d.tx.select("user_id", "amount").unionByName(d.events.select("user_id", "amount"))
    return rounded(both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")), 2)


def _daily(tx: DataFrame) -> DataFrame:
    return rounded(
        tx.groupBy("user_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")
        ),
        2,
    )


@query("read_csv_any")
def _(d):
    path = scratch_path(d.spark, "orders-csv")
    raw = fx.table(d.spark, d.folder, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    raw.write.option("header", True).option("sep", ";").csv(path)
    back = files.read_csv_any(d.spark, path)
    return rounded(
        back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 1
    )


@query("read_csv_folder")
def _(d):
    """Orders written as three kinds of files into one folder, read back in one pass."""
    path = scratch_path(d.spark, "mixed-csv")
    raw = fx.table(d.spark, d.folder, "orders").select("o_custkey", F.concat("o_orderpriority", F.lit(" é")).alias("priority"), "o_totalprice")
    for part, separator, encoding in ((0, ";", "UTF-8"), (1, ",", "ISO-8859-1"), (2, "\t", "UTF-8")):
        mine = raw.where(F.col("o_custkey") % 3 == part)
        mine = mine if part else mine.select("o_totalprice", "priority", "o_custkey")
        mine.write.option("header", True).option("sep", separator).option("encoding", encoding).mode("append").csv(path)
    back = files.read_csv_folder(d.spark, path, "o_custkey bigint, priority string, o_totalprice double").rows
    return rounded(back.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 1)


@query("append_dedupe")
def _(d):
    raw = fx.retail_raw(d.spark, d.folder)
    stored = hold(ingest.union_dedupe([ingest.prepare_retail(raw.where("StockCode % 10 > 0"), time_mode="text")]))
    fresh = hold(ingest.prepare_retail(raw.where("StockCode % 10 < 2"), time_mode="text"))
    return rounded(ingest.append_dedupe(stored, fresh).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")), 2)


@query("write_users_csv")
def _(d):
    path = scratch_path(d.spark, "users-csv")
    files.write_csv(d.users.select("user_id", "segment", "frequency", "monetary"), path)
    back = files.read_csv_any(d.spark, path, "user_id string, segment string, frequency bigint, monetary double")
    return rounded(back, 2)


@query("union_dedupe")
def _(d):
    raw = fx.retail_raw(d.spark, d.folder)
    half = ingest.prepare_retail(raw.where("StockCode % 2 = 0"), time_mode="text")
    whole = ingest.prepare_retail(raw, time_mode="text")
    kept = ingest.union_dedupe([half, whole])
    return rounded(kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")), 2)


@query("require_columns")
def _(d):
    """Tables that have the core columns with their rows, and what the others miss."""
    made = None
    for name, df in (("orders", d.tx), ("events", d.events), ("customer", fx.table(d.spark, d.folder, "customer"))):
        missing = ingest.missing_columns(df)
        try:
            rows = ingest.require_columns(df).agg(F.count(F.lit(1)).alias("rows"))
        except ValueError:  # refused as a whole
            rows = df.agg((F.count(F.lit(1)) * 0).alias("rows"))
        one = rows.select(F.lit(name).alias("source"), F.lit(",".join(missing)).alias("missing"), "rows")
        made = one if made is None else made.unionByName(one)
    return made


@query("detect_domain")
def _(d):
    frames = {
        "retail": fx.retail_raw(d.spark, d.folder),
        "bank": fx.bank_raw(d.spark, d.folder),
        "upi": fx.upi_raw(d.spark, d.folder),
        "tax": fx.tax_raw(d.spark, d.folder),
        "orders": fx.table(d.spark, d.folder, "orders"),
    }
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("source"), F.lit(ingest.detect_domain(df.columns)).alias("domain"), "rows"
        )
        for name, df in frames.items()
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("map_columns")
def _(d):
    mapped, _found = ingest.map_columns(fx.retail_raw(d.spark, d.folder), fixed.RETAIL_MAPPING)
    return rounded(
        mapped.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(
            F.sum("quantity").alias("quantity"), F.max("timestamp").alias("timestamp"), F.max("unit_price").alias("unit_price"),
            F.min("description").alias("description"),
        ),
        3,
    )


def _dirty(d) -> DataFrame:
    """Orders with values a file may hold: text numbers, bad numbers, blank ids, words for flags."""
    key = F.col("o_orderkey")
    return fx.table(d.spark, d.folder, "orders").select(
        F.col("o_orderkey"),
        F.when(key % 11 == 0, "  ").when(key % 13 == 0, "nan").otherwise(
            F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))
        ).alias("user_id"),
        F.when(key % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("monetary"),
        F.when(key % 3 == 0, "Yes").when(key % 3 == 1, " CHURNED ").otherwise("no").alias("target_churn"),
        F.when(key % 17 == 0, "not a date")
        .when(key % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy HH:mm"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("timestamp"),
        F.col("o_orderpriority").alias("Product"),
    )


@query("coerce_numeric")
def _(d):
    return rounded(ingest.coerce_numeric(_dirty(d)).select("o_orderkey", "monetary"), 2)


@query("align_aliases")
def _(d):
    made = ingest.align_aliases(ingest.coerce_numeric(_dirty(d)))
    return rounded(made.select("o_orderkey", "amount", "transaction_amount", "customer_id"), 2)


@query("standardise_churn_label")
def _(d):
    return ingest.standardise_churn_label(_dirty(d)).select("o_orderkey", "target_churn")


@query("description_fallback")
def _(d):
    return ingest.description_fallback(_dirty(d), "retail").select("o_orderkey", "description")


@query("clean_user_id")
def _(d):
    return ingest.clean_user_id(_dirty(d)).select("o_orderkey", "user_id")


@query("parse_timestamp")
def _(d):
    made = ingest.parse_timestamp(_dirty(d))
    return made.select("o_orderkey", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


LAYOUTS = ["M/d/yyyy H:mm", "dd/MM/yyyy", "dd/MM/yyyy HH:mm", "yyyy/MM/dd HH:mm", "d-M-yyyy", "dd MMM yyyy", "MMM d, yyyy h:mm a", "yyyyMMdd", "M/d/yy H:mm"]


@query("date_layouts")
def _(d):
    """Every order date written in every layout and read back."""
    made = None
    for layout in LAYOUTS:
        dates = fx.table(d.spark, d.folder, "orders").select(
            F.col("o_orderdate").cast("timestamp").alias("day"), F.date_format("o_orderdate", layout).alias("timestamp")
        )
        got = ingest.read_time("timestamp", ingest.look_at_time(dates))
        one = dates.select((F.to_date(got) == F.to_date("day")).alias("same")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("same").alias("read")
        )
        one = one.select(F.lit(layout).alias("layout"), "n", "read")
        made = one if made is None else made.unionByName(one)
    return made


@query("parse_epoch")
def _(d):
    raw = fx.table(d.spark, d.folder, "events").select(
        "event_id", (F.unix_millis(F.col("ts").cast("timestamp"))).alias("timestamp")
    )
    made = ingest.parse_timestamp(raw)
    return made.select("event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("derive_amount")
def _(d):
    lines = fx.table(d.spark, d.folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("unit_price")
    )
    return rounded(ingest.derive_amount(lines).select("l_orderkey", "l_linenumber", "amount"), 4)


@query("expand_summary")
def _(d):
    raw, _found = ingest.map_columns(fx.bank_raw(d.spark, d.folder), fixed.BANK_CHURN_MAPPING)
    made = ingest.expand_summary(raw.drop("timestamp"))
    return rounded(
        made.select(
            F.col("user_id").cast("string").alias("user_id"),
            F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
            "amount",
            "tenure_months",
        ),
        6,
    )


@query("drop_cancellations")
def _(d):
    kept = ingest.drop_cancellations(fx.retail_raw(d.spark, d.folder))
    return kept.groupBy("Invoice").agg(F.count(F.lit(1)).alias("n"))


@query("drop_non_positive")
def _(d):
    rows = fx.table(d.spark, d.folder, "customer").select("c_custkey", F.col("c_acctbal").alias("amount"))
    return rounded(ingest.drop_non_positive(rows), 2)


@query("drop_missing_keys")
def _(d):
    rows = fx.table(d.spark, d.folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("user_id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("amount"),
    )
    return ingest.drop_missing_keys(rows).select("o_orderkey")


@query("sample_users")
def _(d):
    return ingest.sample_users(d.tx, 0.25).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("prepare_upi")
def _(d):
    made = ingest.prepare_upi(fx.upi_raw(d.spark, d.folder))
    return rounded(
        made.groupBy("user_id", "domain").agg(
            F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.sum("is_failure").alias("failures")
        ),
        2,
    )


@query("prepare_tax")
def _(d):
    made = ingest.prepare_tax(fx.tax_raw(d.spark, d.folder))
    return rounded(
        made.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.max("income_diversity").alias("income_diversity"),
            F.max("section_count").alias("section_count"),
            F.min("quarters_active").alias("quarters_active"),
            F.sum("tds_amount").alias("tds_amount"),
            F.avg("tds_rate").alias("tds_rate"),
        ),
        0,
        tds_rate=8,
    )


@query("prepare_bank_churn")
def _(d):
    made = ingest.prepare_bank_churn(fx.bank_raw(d.spark, d.folder))
    return rounded(
        made.select(
            "user_id", "frequency", "amount", "tenure_months", "recency", "target_churn", "estimated_salary",
            F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
        ),
        2,
    )


@query("prepare_retail")
def _(d):
    return _daily(ingest.prepare_retail(fx.retail_raw(d.spark, d.folder)))


@query("prepare_generic")
def _(d):
    raw = fx.table(d.spark, d.folder, "orders").select(
        F.col("o_custkey").alias("member_id"), F.col("o_orderdate").alias("Order Date"), F.col("o_totalprice").alias("revenue")
    )
    return _daily(ingest.prepare_generic(raw))


@query("prepare_auto")
def _(d):
    made = ingest.prepare(fx.tax_raw(d.spark, d.folder))
    return rounded(made.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")), 0)


@query("rfm_summary")
def _(d):
    made = ingest.prepare_bank_churn(fx.bank_raw(d.spark, d.folder))
    users = ft.rfm(made, is_summary=True)
    return rounded(
        users.select("user_id", "frequency", "monetary", "recency", "account_age_days", "monetary_velocity", "ipi_consistency"), 3
    )


# ---- labels, evaluation, drift -------------------------------------------------------------------

def _trained_rows(d) -> DataFrame:
    return d._once("training", lambda: hold(labels.temporal_training_set(d.tx, "retail")))


def _rated(d) -> DataFrame:
    """Past users with the model-free score and the temporal label."""
    rows = money.heuristic_churn(_trained_rows(d))
    return rows.select("user_id", F.col("churn_probability").alias("p"), F.col("churned").alias("label"))


@query("temporal_labels")
def _(d):
    return _trained_rows(d).select("user_id", "churned")


@query("temporal_training_set")
def _(d):
    rows = _trained_rows(d)
    return rounded(
        rows.select(
            "user_id", "frequency", "monetary", "recency", "ipi_median", "r_score", "segment",
            "frequency_trend", "recent_spend_ratio", "recency_pct", "churned",
        ),
        3,
    )


@query("label_churn_flag")
def _(d):
    bank = ingest.prepare_bank_churn(fx.bank_raw(d.spark, d.folder))
    return ft.labels_from_flag(bank)


@query("labelled_training_set")
def _(d):
    bank = ingest.prepare_bank_churn(fx.bank_raw(d.spark, d.folder))
    rows = labels.labelled_training_set(bank, ft.user_table(bank, is_summary=True), "bank_churn")
    return rounded(rows.select("user_id", "monetary", "recency", "log_monetary", "tenure_months", "estimated_salary", "churned"), 2)


@query("feature_matrix")
def _(d):
    names = ["frequency", "monetary", "recency", "ipi_median", "frequency_trend", "recent_spend_ratio", "no_such_column"]
    vector = vector_to_array(learners.FEATURES)
    rows = learners.assemble(_trained_rows(d), names).select("user_id", *[vector[i].alias(f"x{i}") for i in range(len(names))])
    return rounded(rows, 3)


@query("split_60_20_20")
def _(d):
    return labels.split3(_trained_rows(d).select("user_id", "churned")).select("user_id", "part")


@query("threshold_opt")
def _(d):
    return rounded(evaluation.optimise_threshold(_rated(d)).drop("precision"), 6)


@query("roc_auc")
def _(d):
    return rounded(evaluation.auc(_rated(d)), 6)


@query("confusion_metrics")
def _(d):
    return evaluation.confusion(_rated(d), 0.2)


@query("ks_two_sample")
def _(d):
    champions = d.users.where("segment = 'Champions'")
    others = d.users.where("segment = 'Loyalists'")
    rows = drift.ks_two_sample(champions, others, ["recency", "frequency", "monetary", "ipi_median"])
    return rounded(rows, 6)


@query("temporal_drift")
def _(d):
    cutoff = labels.label_window(d.tx, "retail").cutoff_us
    rows = drift.temporal_drift(d.tx, cutoff).drop("raw_p")
    return rows.withColumn("drifted", F.col("drifted").cast("int"))


def _cents(d) -> DataFrame:
    """Users with spend in whole cents: sums differ in the last bits between engines."""
    return d._once("cents", lambda: hold(d.users.withColumn("monetary", F.round("monetary", 2))))


def _baseline_flags(d) -> DataFrame:
    cols = ["recency", "frequency", "monetary", "ipi_median", "account_age_days"]
    base = drift.baseline_of(_cents(d).where("frequency <= 9"), cols)
    return drift.baseline_drift(_cents(d), base, cols)


@query("drift_bonferroni")
def _(d):
    rows = _baseline_flags(d).drop("raw_p")
    return rows.withColumn("drifted", F.col("drifted").cast("int"))


@query("baseline_drift")
def _(d):
    cols = ["recency", "frequency", "monetary"]
    path = scratch_path(d.spark, "baseline")
    state, _found = drift.check_against_baseline(_cents(d), cols, path)
    state, found = drift.check_against_baseline(_cents(d).where("recency > 60"), cols, path)
    return rounded(found.select("feature", F.lit(state).alias("drift_type"), "ks_statistic"), 4)


@query("sketch_drift")
def _(d):
    """Drift by sketches of two halves merged, beside the exact distance: within its error or not."""
    cols = ["recency", "frequency", "monetary"]
    base = drift.sketch_baseline(_cents(d).withColumn("half", F.col("frequency") % 2), cols, ["half"])
    late = _cents(d).where("recency > 60")
    found = drift.sketch_drift(late, drift.merged_sketches(base), cols)
    exact = drift.ks_two_sample(late, _cents(d), cols).select("feature", "d")
    near = F.abs(F.col("ks_statistic") - F.col("d")) <= F.col("ks_error") + 0.00005
    return found.join(exact, "feature").select(
        "feature", near.cast("int").alias("in_bound"), F.round("d", 4).alias("ks_exact"), F.col("drifted").cast("int").alias("drifted"))


@query("drift_summary")
def _(d):
    rows = drift.drift_summary(_baseline_flags(d))
    return rows.select(
        "total_features", "drifted_count", "drifted_pct", "status", "data_drift_status", "avg_p_value",
        "severity_reason", F.array_join("recommended_actions", " ").alias("actions"),
        F.col("top_drifted")[0]["feature"].alias("top_feature"),
    )


@query("drift_baseline_save")
def _(d):
    path = scratch_path(d.spark, "baseline")
    drift.save_baseline(d.users, ["recency", "monetary"], path)
    return rounded(
        drift.load_baseline(d.spark, path)
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.max("mean").alias("mean"), F.max("std").alias("std")),
        2,
    )


# ---- models --------------------------------------------------------------------------------------

SMALL_RF = {"numTrees": 12, "maxDepth": 5}
SMALL_GBT = {"maxIter": 5, "maxDepth": 3}


def _model(d) -> learners.ChurnModel:
    """One small forest and one small boosted model, picked, calibrated and evaluated once."""
    return d._once("model", lambda: learners.train(_trained_rows(d), "retail", SMALL_RF, SMALL_GBT, stacked=False))


def _whole_model(d) -> learners.ChurnModel:
    """All candidates and the stack at their full settings, trained once as `report.analyse` trains them."""
    return d._once("whole_model", lambda: learners.train(_trained_rows(d), "retail"))


def _now(d) -> DataFrame:
    """Current features with the fitted score and the money metrics."""

    def make():
        scored = learners.score(_model(d), labels.current_features(d.tx, d.act))
        rated = money.financials(scored, "retail")
        # written, so that the jobs over it do not send the metrics of all the plans above to the driver
        return cut_lineage(ft.join_users(rated, reports.lifecycle(d.tx, d.act)), "now")

    return d._once("now", make)


def _learn(d) -> DataFrame:
    def make():
        rows = labels.split3(_trained_rows(d)).where("part = 'train'")
        names = labels.feature_names(_trained_rows(d))
        return hold(learners.weighted(learners.assemble(rows, names)))

    return d._once("learn", make)


@query("model_registry_scores")
def _(d):
    """Largest difference between the scores of a saved and a loaded model, and the versions kept."""
    store = registry.ModelRegistry(d.spark, scratch_path(d.spark, "models"))
    for _turn in range(4):
        store.save(_model(d), "r")
    back = store.load_latest("r")
    rows = _trained_rows(d).drop("churn_probability")
    both = _model(d).probabilities(rows, "p").select("user_id", "p").join(back.probabilities(rows, "q").select("user_id", "q"), "user_id")
    found = both.agg(F.count(F.lit(1)).alias("users"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_gap"))
    return found.withColumn("kept", F.lit(store.list().count()))


@query("score_invariants")
def _(d):
    """Rows, nulls and scores outside [0, 1] of every fitted candidate over all labelled users."""
    names, made = labels.feature_names(_trained_rows(d)), None
    for name, fitted in (("forest", learners.fit_rf(_learn(d), **SMALL_RF)), ("boosted", learners.fit_gbt(_learn(d), **SMALL_GBT))):
        scored = learners.ChurnModel(name, names, [fitted]).probabilities(_trained_rows(d).drop("churn_probability"))
        p = F.col("churn_probability")
        one = scored.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("users"), F.countDistinct("user_id").alias("ids"),
                         F.count_if(p.isNull() | (p < 0) | (p > 1)).alias("odd"))
        made = one if made is None else made.unionByName(one)
    return made


@query("shap_additivity")
def _(d):
    """For every user: whether attributions and mean prediction add up to the forest's raw score."""
    names = labels.feature_names(_trained_rows(d))
    model = learners.ChurnModel("Random Forest", names, [learners.fit_rf(_learn(d), **SMALL_RF)])
    base = attribution.base_value(model, d.spark)
    total = F.aggregate("phi", F.lit(base), lambda a, x: a + x)
    whole = attribution.attributions(model, _now(d)).select("user_id", total.alias("whole"))
    raw = model.probabilities(_now(d).drop("churn_probability"), "raw").select("user_id", "raw")
    close = F.abs(F.col("whole") - F.col("raw")) < 1e-6
    return whole.join(raw, "user_id").select("user_id", close.cast("int").alias("adds_up"))


@query("silhouette_fixed")
def _(d):
    """Silhouette of the recency scores taken as clusters."""
    return rounded(learners.silhouette(d.users.withColumn("cluster", F.col("r_score").cast("int"))), 5)


@query("silhouette_euclidean")
def _(d):
    """The same clusters with plain distances: drawn users against all."""
    return rounded(learners.silhouette_euclidean(d.users.withColumn("cluster", F.col("r_score").cast("int"))), 5)


@query("kmeans_nearest")
def _(d):
    """For every user: whether no centre is nearer than that of the own cluster."""
    model, scaled = learners.fit_clusters(d.users)
    at = vector_to_array("_scaled")
    away = [sum((F.get(at, i) - F.lit(float(v))) ** 2 for i, v in enumerate(c)) for c in model.clusterCenters()]
    rows = model.transform(scaled).select("user_id", "cluster", F.array(*away).alias("away"))
    nearest = F.get("away", F.col("cluster")) - F.array_min("away") < 1e-9
    return rows.select("user_id", nearest.cast("int").alias("nearest"))


@query("kmeans_clusters")
def _(d):
    return learners.clusters(d.users).groupBy("cluster").agg(F.count(F.lit(1)).alias("users"))


@query("silhouette")
def _(d):
    return rounded(learners.silhouette(learners.clusters(d.users)))


def _fitted_scores(d, fitted, name: str) -> DataFrame:
    model = learners.ChurnModel(name, labels.feature_names(_trained_rows(d)), [fitted])
    return rounded(model.probabilities(_trained_rows(d).drop("churn_probability")).select("user_id", "churn_probability"), 6)


@query("rf_fit")
def _(d):
    return _fitted_scores(d, learners.fit_rf(_learn(d), **SMALL_RF), "Random Forest")


@query("gbt_fit")
def _(d):
    return _fitted_scores(d, learners.fit_gbt(_learn(d), **SMALL_GBT), "Boosted Trees")


@query("tune")
def _(d):
    best = learners.tune(_learn(d), {"numTrees": 5, "maxDepth": 4}, {"maxIter": 2, "maxDepth": 2})
    rows = [(k, str(v)) for k, v in best.items()]
    return small_table(d.spark, rows, "name string, choice string")


@query("select_model")
def _(d):
    areas = _whole_model(d).metrics["candidate_auc"]
    rows = [(k, round(v, 4), k == _whole_model(d).name) for k, v in areas.items()]
    return small_table(d.spark, rows, "model string, auc double, selected boolean")


@query("stacking")
def _(d):
    pair = [learners.forest(**{**SMALL_RF, "numTrees": 8}), learners.boosted("Boosted Trees (subsampled)", maxIter=4, maxDepth=3)]
    bases, meta = learners.fit_stack(_learn(d), pair, [p.fit(_learn(d)) for p in pair])
    model = learners.ChurnModel("Stacking", labels.feature_names(_trained_rows(d)), bases, meta)
    return rounded(model.probabilities(_trained_rows(d)).select("user_id", "churn_probability"), 6)


@query("calibrate")
def _(d):
    rated = _rated(d)
    fitted = learners.calibrate(rated)
    return rounded(learners.apply_calibrator(fitted, rated, "p", "calibrated").select("user_id", "calibrated"), 6)


@query("cv_auc")
def _(d):
    names = labels.feature_names(_trained_rows(d))
    mean, std = learners.cross_val_auc(_trained_rows(d), names, learners.forest(numTrees=8, maxDepth=4))
    return small_table(d.spark, [(round(mean, 4), round(std, 4))], "cv_auc_mean double, cv_auc_std double")


@query("model_comparison")
def _(d):
    names = labels.feature_names(_trained_rows(d))
    # thousands of jobs follow: see learners.train
    learn = cut_lineage(_learn(d).select("user_id", "churned", learners.FEATURES, learners.LABEL, learners.WEIGHT), "train")
    made = learners.side_by_side(d.spark, [lambda: learners.fit_rf(learn), lambda: learners.fit_gbt(learn)])
    fits = [learners.ChurnModel(n, names, [m]) for n, m in zip(("Random Forest", "Boosted Trees"), made)]
    test = labels.split3(_trained_rows(d)).where("part = 'test'")
    return rounded(learners.compare(fits, test, _whole_model(d).threshold))


@query("score_users")
def _(d):
    return rounded(_now(d).select("user_id", "churn_probability"), 6)


@query("feature_importances")
def _(d):
    return rounded(learners.importances(_model(d), d.spark), 6)


@query("shap_global")
def _(d):
    return rounded(attribution.shap_summary(_model(d), _now(d)), 6)


@query("shap_interactions")
def _(d):
    """Mean joint effect of every pair of features under the picked model."""
    return rounded(attribution.interaction_summary(attribution.interaction_rows(_model(d), _now(d))), 6)


@query("shap_dependence")
def _(d):
    return rounded(attribution.dependence(_model(d), _now(d)), 6)


@query("interaction_additivity")
def _(d):
    """For every user: whether each row of the pair matrix adds up to the attribution of its feature."""
    pairs = attribution.interaction_rows(_model(d), _now(d)).groupBy("user_id", "feature").agg(F.sum("shap_interaction").alias("s"))
    both = pairs.join(attribution.attribution_rows(_model(d), _now(d)), ["user_id", "feature"])
    close = F.abs(F.col("s") - F.col("shap_value")) < 1e-9
    return both.groupBy("user_id").agg(F.min(close.cast("int")).alias("adds_up"))


@query("shap_rule_tree")
def _(d):
    """Attributions under a tree whose cuts, weights and values are figures of the users themselves."""
    names = ["recency", "frequency", "monetary"]
    cuts = order.quantiles(d.rfm, names, [0.5, 0.75])
    (a, c), (b, _b), (m, _m) = (cuts[n] for n in names)
    low, few, small = F.col("recency") <= a, F.col("frequency") <= b, F.col("monetary") <= m
    inside = {1: low, 2: ~low, 3: low & few, 4: low & ~few, 5: ~low & (F.col("recency") <= c), 6: ~low & (F.col("recency") > c),
              7: low & ~few & small, 8: low & ~few & ~small}
    seen = order.facts(d.rfm, n0=F.count(F.lit(1)), **{f"n{i}": F.count_if(w) for i, w in inside.items()},
                       **{f"v{i}": F.avg(F.when(inside[i], F.col("avg_basket_value"))) for i in (3, 5, 6, 7, 8)}).asDict()
    splits = {0: (1, 2, 0, a), 1: (3, 4, 1, b), 2: (5, 6, 0, c), 4: (7, 8, 2, m)}
    rows = [(0, i, *splits.get(i, (-1, -1, -1, 0.0)), float(seen[f"n{i}"]), float(seen.get(f"v{i}") or 0.0)) for i in range(9)]
    schema = "tree int, id int, left int, right int, feature int, threshold double, weight double, value double"
    phi = attribution.attributions_of(small_table(d.spark, rows, schema), names, d.rfm)
    return rounded(phi.select("user_id", *[F.col("phi")[i].alias(f"phi_{n}") for i, n in enumerate(names)]), 4)


@query("shap_user")
def _(d):
    return rounded(attribution.shap_users(_model(d), _now(d)), 6)


@query("shap_segment")
def _(d):
    return rounded(attribution.shap_segments(_model(d), _now(d)), 6)


@query("driver_table")
def _(d):
    """Importance = share of the spread of each feature, so that the table has an exact twin."""
    names = ["recency", "frequency", "monetary", "monetary_velocity", "ipi_median", "avg_basket_value"]
    spread = order.long_form(_cents(d), names).groupBy("feature").agg(
        (F.stddev_pop("value") / F.max(F.abs("value"))).alias("importance")
    )
    total = spread.agg(F.sum("importance")).scalar()
    return rounded(attribution.drivers(spread.withColumn("importance", F.col("importance") / total)), 5)


@query("model_hash")
def _(d):
    """Digest of the columns that models of this data are fitted on, those without any value left out."""
    rows = _trained_rows(d)
    features = order.long_form(rows, labels.feature_names(rows)).select("feature").distinct()
    return features.agg(registry.schema_hash(F.sort_array(F.collect_list("feature"))).alias("schema_hash"))


@query("model_registry")
def _(d):
    store = registry.ModelRegistry(d.spark, scratch_path(d.spark, "models"))
    for _i in range(4):
        store.save(_model(d), "orders")
    again = store.load_latest("orders", _model(d).features)
    back = again.probabilities(_now(d).drop("churn_probability"))
    kept = store.list().agg(F.count(F.lit(1)).alias("versions"))
    return back.agg(F.count(F.lit(1)).alias("scored")).withColumn("versions", kept.scalar())


# ---- what-if, experiments, hypotheses ------------------------------------------------------------

def _heuristic(d) -> simulate.Score:
    return d._once("score", lambda: simulate.heuristic_score(order.facts(d.users, m=F.max("recency"))["m"]))


@query("whatif")
def _(d):
    rows = simulate.whatif(d.scored, _heuristic(d), "At Risk", "order_delay", -30.0)
    return rounded(rows.drop("model_limitation_note", "feature_display"), 3, revenue_saved=0, ltv_saved=0)


@query("whatif_model")
def _(d):
    weights = {r["feature"]: r["importance"] for r in learners.importances(_model(d), d.spark).collect()}
    rows = simulate.whatif(_now(d), _model(d).probabilities, "At Risk", "frequency", 20.0, importance=weights)
    return rounded(rows, 4)


@query("counterfactual_lift")
def _(d):
    lift = simulate.counterfactual_lift(d.scored, _heuristic(d), "recency", 400.0, True, 0.3)
    return d.scored.agg(F.count_if(F.col("churn_probability") >= 0.3).alias("risky")).withColumn("lift", F.lit(lift))


def _grid(d) -> DataFrame:
    plans = [(n, None, f, delta, cost) for n, f, delta, cost in fixed.CAMPAIGNS]
    plans += [p for p in fixed.PRESETS["retail"]]
    return simulate.whatif_grid(d.scored, _heuristic(d), plans)


@query("whatif_grid")
def _(d):
    return rounded(_grid(d), 3, revenue_saved=0, ltv_saved=0)


@query("campaign_roi")
def _(d):
    rows = simulate.campaign_roi(_grid(d), d.segments, money.kpis(d.scored))
    return rounded(
        rows.select(
            "scenario", "segment", "cost", "gain", F.col("is_profitable").cast("int").alias("is_profitable"),
            "explanation", "portfolio_churn",
        ),
        5,
        gain=0,
    )


@query("ab_assign")
def _(d):
    risky = d.scored.where("segment = 'At Risk'").select("user_id")
    return simulate.ab_assign(risky)


@query("ab_lift")
def _(d):
    users = _trained_rows(d).select("user_id", "churned")
    assigned = simulate.ab_assign(users.select("user_id"))
    return rounded(simulate.ab_lift(assigned, users), 6)


@query("hypotheses")
def _(d):
    names = [("recency", "Recency"), ("frequency", "Frequency"), ("monetary_velocity", "Velocity"), ("ipi_median", "Cycle")]
    return hypotheses.hypotheses(d.scored, names, 0.3, "retail", _heuristic(d))


@query("hypothesis_means")
def _(d):
    return rounded(hypotheses.driver_means(d.scored, ["recency", "frequency", "monetary"], 0.3), 3)


@query("rule_hypotheses")
def _(d):
    return hypotheses.rule_hypotheses(d.segments, "Recency", 0.41)


@query("churn_forecast_rescored")
def _(d):
    return money.churn_forecast(_now(d), _model(d).probabilities, 8)


@query("report_json")
def _(d):
    sections = {
        "segments": ft.value_counts(d.users, "segment"),
        "lifecycle_stages": ft.value_counts(d.scored, "lifecycle"),
        "revenue_at_risk": money.rar_summary(d.scored, 0.3),
    }
    rows = report.report_json(sections)
    return rows.select("section", F.size(F.from_json("body", "array<map<string,string>>")).alias("entries"))


@query("report_bodies")
def _(d):
    """Every number of the JSON of six sections, read back: section, item, field, value."""
    sections = {
        "segments": ft.value_counts(d.users, "segment"),
        "lifecycle_stages": ft.value_counts(d.scored, "lifecycle"),
        "kpis": money.kpis(d.scored),
        "risk_counts": money.risk_counts(d.scored),
        "revenue_at_risk": money.rar_summary(d.scored, 0.3),
        "revenue_by_segment": money.rar_by_segment(d.scored, 0.3),
    }
    entries = report.report_json(sections).select(
        "section", F.explode(F.from_json("body", "array<map<string,string>>")).alias("entry")
    )
    item = F.coalesce(F.col("entry")["segment"], F.col("entry")["lifecycle"], F.lit(""))
    fields = entries.select("section", item.alias("item"), F.explode("entry").alias("field", "value"))
    fields = fields.where(~F.col("field").isin("segment", "lifecycle"))
    return fields.select("section", "item", "field", F.round(F.col("value").try_cast("double"), 2).alias("value"))


@query("users_json")
def _(d):
    users = rounded(d.scored.select("user_id", "segment", "lifecycle", "churn_probability"), 6)
    read = F.from_json("body", "user_id string, segment string, lifecycle string, churn_probability double")
    return report.users_json(users).select(read.alias("r")).select("r.*")


# ---- streaming -----------------------------------------------------------------------------------

def _stream(d) -> DataFrame:
    return events.read_events(d.spark, d.folder)


def _back(d, path: str) -> DataFrame:
    return d.spark.read.parquet(path)


def _text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("event_source")
def _(d):
    rows = _back(d, events.drain(_stream(d), "events"))
    return rounded(rows.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 2)


@query("event_dedupe")
def _(d):
    doubled = _stream(d).unionByName(_stream(d))
    rows = _back(d, events.drain(events.dedupe(doubled), "dedupe"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("event_counts")
def _(d):
    rows = events.drain_updates(events.event_counts(_stream(d)), "counts", ["day_start", "event_type"])
    return rounded(rows.select(_text("day_start"), "event_type", "events", "total"), 2)


@query("failure_rate_stream")
def _(d):
    rows = events.drain_updates(events.failure_rates(_stream(d)), "failures", ["from_ts", "user_id"])
    return rounded(rows.select(_text("from_ts"), "user_id", "events", "failure_rate"), 6)


@query("risk_ledger")
def _(d):
    weights = {"purchase": -0.0125, "error": 0.03}
    rows = events.drain_updates(events.risk_ledger(_stream(d), weights), "ledger", "user_id")
    return rounded(rows.select("user_id", "churn_delta", "events", _text("last_ts")), 4)


@query("ipi_alert")
def _(d):
    seen = events.drain_updates(events.last_seen(_stream(d)), "seen", "user_id")
    as_of = order.facts(seen, t=F.max(micros("last_ts")))["t"]
    alerts = events.ipi_alerts(seen, ft.ipi(d.events).select("user_id", "ipi_median"), as_of, 0.1)
    return rounded(alerts.select("user_id", "idle_days"), 4)


@query("ipi_alert_timer")
def _(d):
    """Idle periods longer than a usual interval, told by timers while the stream runs."""
    found = live.idle_alerts(_stream(d), ft.ipi(d.events).select("user_id", "ipi_median"), 1.0)
    return _back(d, events.drain(found, "idle")).select("user_id", _text("last_ts"), _text("due_ts"))


@query("live_user_features")
def _(d):
    """User features from keyed state, after the last event."""
    newest = events.drain_updates(live.live_activity(_stream(d)), "live", "user_id")
    last = order.facts(newest, t=F.max("last_us"))["t"]
    return rounded(live.live_features(newest, last))


@query("ticker")
def _(d):
    return events.ticker_stream(_stream(d)).select("event_id", "user_id", _text("ts"))


@query("stream_scoring")
def _(d):
    scored = events.score_stream(_stream(d), _now(d), _model(d))
    rows = _back(d, events.drain(scored, "scored"))
    return rounded(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("churn_probability").alias("p")), 4)


@query("live_scoring")
def _(d):
    """How often each user with events was scored under how many versions, after two runs over the stream."""
    root = scratch_path(d.spark, "live-scores")
    store = registry.ModelRegistry(d.spark, f"{root}/models")
    store.save(_model(d), "live")
    table = scoring.live_scores(_stream(d), _now(d).drop("churn_probability"), store, "live", root)
    table.run(_stream(d))
    return table.scores().groupBy("user_id").agg(
        F.count(F.lit(1)).alias("scores"), F.countDistinct("version").alias("versions"), F.count_if(F.col("churn_probability").between(0, 1)).alias("valid"))
