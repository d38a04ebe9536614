from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import frame
from holdfast.operators import hypotheses, money, reports, simulate
from holdfast.session import hold

USERS = ("user_id string, segment string, recency double, frequency double, monetary double, monetary_velocity double, "
         "churn_probability double, lifecycle string")


@pytest.fixture()
def users(spark):
    rows = [(f"u{i}", "At Risk" if i % 2 else "Champions", float(i), float(1 + i % 4), 100.0 * (i + 1), 1.0 + i, i / 40, "New" if i % 7 == 0 else "Established")
            for i in range(40)]
    return hold(frame(spark, rows, USERS))


@pytest.fixture()
def rated(users):
    return hold(money.financials(users, "retail"))


def test_money_bounds(rated):
    rows = rated.toPandas()
    assert (rows["revenue_at_risk"] >= 0).all()
    assert (rows["revenue_at_risk"] <= rows["monetary"].clip(lower=1) + 0.01).all()
    assert rows["priority_score"].between(0, 100).all() and rows["priority_score"].max() == 100.0


def test_cost_tiers(users):
    got = users.select("churn_probability", "monetary", "frequency", money.intervention_cost().alias("c")).collect()
    for r in got:
        p = r["churn_probability"]
        share = 0.25 if p > 0.8 else 0.15 if p > 0.5 else 0.08 if p > 0.2 else 0.03
        assert r["c"] == pytest.approx(150 + r["monetary"] / r["frequency"] * share, abs=0.006)


def test_recovery_needs_risky_users(rated):
    calm = rated.withColumn("churn_probability", F.col("churn_probability") * 0.1)
    none = money.potential_recovery(calm, 0.5).first()
    assert none["value"] == 0.0 and none["critical_count"] == 0
    some = money.potential_recovery(hold(calm), 0.5, adaptive=True).first()
    assert some["value"] > 0 and some["is_adaptive"]


@pytest.mark.parametrize(("base", "threshold", "want"), [(0.2, 0.5, (0.3, 0.4)), (0.5, 0.6, (0.6, 0.8)), (0.0, 0.9, (0.9, 0.95))])
def test_tier_marks(base, threshold, want):
    assert money.tier_marks(base, threshold) == pytest.approx(want)


def test_forecast(rated):
    rows = money.churn_forecast(rated, as_of_month=12).orderBy("step").collect()
    assert [r["month"] for r in rows] == ["Jan", "Feb", "Mar", "Apr", "May", "Jun"]
    assert all(r["baseline"] >= r["risk"] for r in rows)
    assert [r["baseline"] for r in rows] == sorted(r["baseline"] for r in rows)
    broke = rated.withColumn("monetary", F.lit(0.0))
    assert money.churn_forecast(hold(broke)).count() == 0


def test_warning_cohort_is_the_top_fifth(rated):
    calm = hold(rated.withColumn("churn_probability", F.col("churn_probability") * 0.1))
    assert money.warning_cohort(calm, 0.5).agg(F.sum("is_warning")).first()[0] == 8


def score(df):
    return simulate.heuristic_score(39.0)(df)


@pytest.mark.parametrize(("feature", "delta"), [("monetary", 20), ("frequency", 15), ("monetary", 25), ("frequency", 30), ("recency", -30)])
def test_campaign_scenarios(rated, feature, delta):
    row = simulate.whatif(rated, score, "At Risk", feature, delta).first()
    assert row["users_affected"] == 20 and row["revenue_saved"] >= 0 and row["ltv_saved"] >= 0
    assert 0 <= row["simulated_churn"] <= 1
    if feature == "recency":
        assert row["simulated_churn"] < row["original_churn"] and row["model_limitation_note"] is None
    else:
        assert row["model_limitation_note"] is not None


def test_zero_delta_changes_nothing(rated):
    row = simulate.whatif(score(rated), score, "At Risk", "order_delay", 0).first()
    assert row["absolute_reduction"] == pytest.approx(0.0)
    assert "no predicted effect" in row["recommendation"]


@pytest.mark.parametrize(("segment", "feature", "delta", "message"), [
    ("Nobody", "recency", 10, "segment"), ("At Risk", "shoe_size", 10, "feature"), ("At Risk", "recency", 501, "delta"), ("At Risk", "recency", -101, "delta")])
def test_bad_requests(rated, segment, feature, delta, message):
    with pytest.raises(ValueError, match=message):
        simulate.whatif(rated, score, segment, feature, delta)


def test_grid_equals_single_scenarios(rated):
    grid = simulate.whatif_grid(rated, score, [("a", "At Risk", "recency", -30.0, 5.0), ("b", None, "recency", -10.0, 5.0)])
    one = simulate.whatif(rated, score, "At Risk", "recency", -30.0).first()
    got = grid.where("scenario = 'a'").first()
    assert got["simulated_churn"] == pytest.approx(one["simulated_churn"]) and grid.count() == 3


def test_experiment(rated):
    assigned = simulate.ab_assign(rated.select("user_id"), minimum=10)
    assert assigned.where("arm = 'treatment'").count() == 10
    outcome = rated.select("user_id", (F.col("churn_probability") > 0.5).cast("int").alias("churned"))
    row = simulate.ab_lift(assigned, outcome).first()
    assert row["treated"] + row["control"] == 40


def test_hypotheses_have_one_concept_each(rated):
    names = [("recency", "Recency"), ("recency_deviation", "Delay"), ("user_id", "Id"), ("frequency", "Frequency"), ("monetary", "Spend")]
    rows = hypotheses.hypotheses(rated, names, 0.5, "retail", score).orderBy("rank").collect()
    assert [r["driver"] for r in rows] == ["Recency", "Frequency", "Spend"]
    assert all(0.5 <= r["expected_lift_pct"] <= 25 for r in rows)
    one_sided = hypotheses.hypotheses(rated, names, 2.0).collect()
    assert len(one_sided) == 1 and one_sided[0]["title"] == "Ask the quiet quarter"


def test_rule_based_rows(rated):
    segments = money.segment_churn(rated)
    assert hypotheses.rule_hypotheses(segments, "Recency", 0.4).count() == 3
    rows = reports.interventions(segments, "Recency").collect()
    assert {r["expected_churn_reduction"] for r in rows} <= {20, 12, 5}


def test_user_lists(rated):
    sample = reports.user_sample(rated, 10).collect()
    assert [r["lifecycle"] for r in sample[:6]] == ["New"] * 6
    top = reports.top_users(rated, 5).collect()
    assert len(top) == 5 and top[0]["priority"] >= top[-1]["priority"]
    page = reports.onboarding(rated, page=2, size=4).collect()
    assert len(page) == 2 and all(r["lifecycle"] == "New" for r in page)
