from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import frame
from holdfast.functions.columns import segment_of
from holdfast.operators import features as ft
from holdfast.operators import reports
from holdfast.operators.activity import activity, daily_ledger

TX = "user_id string, timestamp timestamp, amount double"


def tx_of(spark, rows):
    return frame(spark, [(u, pd.Timestamp(t), a) for u, t, a in rows], TX)


def pandas_gaps(data: pd.DataFrame) -> pd.DataFrame:
    ordered = data.sort_values(["user_id", "timestamp"])
    gap = ordered.groupby("user_id")["timestamp"].diff().dt.days
    return gap.groupby(ordered["user_id"]).agg(["median", "std", "max"])


def test_gaps_match_row_by_row_differences(spark):
    rng = np.random.default_rng(3)
    start = pd.Timestamp("2024-01-01")
    rows = [
        (f"u{rng.integers(0, 12)}", start + pd.Timedelta(minutes=int(rng.integers(0, 60 * 24 * 40))), 1.0)
        for _ in range(700)
    ]
    data = pd.DataFrame(rows, columns=["user_id", "timestamp", "amount"])
    got = ft.ipi(tx_of(spark, rows)).toPandas().set_index("user_id").sort_index()
    want = pandas_gaps(data).sort_index()
    assert np.allclose(got["ipi_median"], want["median"])
    assert np.allclose(got["ipi_std"], want["std"].fillna(0))


def test_hot_user_is_one_row_per_day_after_the_first_step(spark):
    rows = spark.range(20000).select(
        F.lit("hot").alias("user_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 9).cast("int"), (F.col("id") % 24).cast("int"))).alias("timestamp"),
        F.lit(1.0).alias("amount"),
    )
    days = daily_ledger(rows)
    assert days.count() == 9
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan  # combined before the shuffle


def test_day_rows_carry_no_average_beside_sum_and_count(spark):
    """Sum and count give the mean; its own buffers would be shuffled twice more."""
    rows = [("a", "2024-01-01 01:00", 10.0), ("a", "2024-01-01 05:00", 20.0), ("a", "2024-01-03", 60.0), ("a", "2024-01-04", None),
            ("b", "2024-01-02", None), ("b", "2024-01-05", 4.0)]
    tx = tx_of(spark, rows)
    assert "partial_avg" not in daily_ledger(tx)._jdf.queryExecution().executedPlan().toString()
    got = ft.rfm(tx).toPandas().set_index("user_id")
    assert got.loc["a", "monetary_std"] == pytest.approx(pd.Series([10.0, 20.0, 60.0]).std())
    assert got.loc["b", "monetary_std"] == 0.0


def test_single_purchase_users(spark):
    tx = tx_of(spark, [("a", "2024-01-01", 10.0), ("b", "2024-01-01", 5.0), ("b", "2024-01-11", 5.0), ("c", "2024-01-01", 1.0), ("c", "2024-01-05", 1.0)])
    got = ft.rfm(tx).toPandas().set_index("user_id")
    assert got.loc["a", "ipi_median"] == 7.0  # median of 10 and 4
    assert got.loc["a", "monetary_std"] == 0.0 and got.loc["a", "ipi_std"] == 0.0
    assert got.loc["b", "recency"] == 1.0 and got.loc["a", "recency"] == 11.0
    assert got.loc["b", "monetary_velocity"] == pytest.approx(10 / 11)


def test_only_single_purchases_use_thirty_days(spark):
    got = ft.rfm(tx_of(spark, [("a", "2024-01-01", 10.0), ("b", "2024-01-03", 5.0)])).toPandas()
    assert set(got["ipi_median"]) == {30.0}


def test_equal_amounts_have_no_deviation(spark):
    rows = [("a", f"2024-01-{d:02d}", 987654.32) for d in range(1, 20)]
    assert ft.rfm(tx_of(spark, rows)).first()["monetary_std"] == pytest.approx(0.0, abs=1e-6)


def test_rank_path_equals_pandas_qcut_of_ranks(spark, both_ways):
    data = pd.DataFrame({"user_id": [f"u{i:03d}" for i in range(37)], "recency": [float(i % 3) for i in range(37)],
                         "frequency": [1] * 37, "monetary": [float(i) for i in range(37)]})
    got = ft.quintile_scores(spark.createDataFrame(data)).toPandas().sort_values("user_id")
    data = data.sort_values("user_id")
    ranks = data["recency"].rank(method="first")
    want = pd.qcut(ranks, 5, labels=[5, 4, 3, 2, 1]).astype(int)
    assert list(got["r_score"]) == list(want)
    assert list(got["m_score"]) == list(pd.qcut(data["monetary"], 5, labels=[1, 2, 3, 4, 5]).astype(int))
    assert list(got["f_score"]) == list(pd.qcut(data["frequency"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int))


def test_one_user_scores_three(spark):
    row = ft.user_table(tx_of(spark, [("a", "2024-01-01", 10.0)])).first()
    assert (row["r_score"], row["f_score"], row["m_score"]) == (3, 3, 3)


def test_all_score_triples_have_a_segment(spark):
    cube = frame(spark, [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)], "r int, f int, m int")
    cols = (F.col("r"), F.col("f"), F.col("m"))
    rows = cube.select("r", "f", "m", segment_of(*cols, F.lit(15)).alias("young"), segment_of(*cols, F.lit(100)).alias("old")).collect()
    assert {x["young"] for x in rows} == {"New"}
    assert {x["old"] for x in rows} == {"Champions", "Loyalists", "Promising", "At Risk", "About to Sleep", "Hibernating"}
    by = {(x["r"], x["f"], x["m"]): x["old"] for x in rows}
    assert by[4, 4, 4] == "Champions" and by[5, 5, 3] == "Loyalists" and by[3, 3, 2] == "Promising"
    assert by[2, 3, 5] == "At Risk" and by[1, 2, 3] == "About to Sleep" and by[2, 2, 2] == "Hibernating"


def test_summary_velocity_is_salary_per_day(spark):
    rows = [(f"c-{i}", pd.Timestamp("2022-07-15") + pd.Timedelta(days=3 * i), 250.0, 73000.0, 7.0) for i in range(9)]
    tx = frame(spark, rows, TX + ", estimated_salary double, tenure double")
    got = ft.rfm(tx, is_summary=True).toPandas()
    assert np.allclose(got["monetary_velocity"], 73000.0 / 365.0)
    assert set(got["account_age_days"]) == {210.0} and set(got["ipi_consistency"]) == {1.0}


def test_first_attribute_skips_nulls(spark):
    rows = [("a", pd.Timestamp("2024-01-02"), 1.0, "late"), ("a", pd.Timestamp("2024-01-01"), 1.0, None)]
    assert ft.first_attributes(frame(spark, rows, TX + ", note string"), ["note"]).first()["note"] == "late"


def test_lifecycle_stages(spark):
    rows = [("back", "2023-01-01", 1.0), ("back", "2024-01-01", 1.0), ("new", "2023-12-20", 1.0),
            ("once", "2023-11-20", 1.0), ("active", "2023-10-01", 1.0), ("active", "2023-11-01", 1.0),
            ("old", "2022-01-01", 1.0), ("old", "2022-02-01", 1.0)]
    got = {r["user_id"]: r["lifecycle"] for r in reports.lifecycle(tx_of(spark, rows)).collect()}
    assert got == {"back": "Reactivated", "new": "New", "once": "New", "active": "Active", "old": "Established"}


def test_cohort_matrix(spark):
    rows = [("a", "2024-01-05", 1.0), ("a", "2024-03-05", 1.0), ("a", "2024-03-09", 1.0), ("b", "2024-01-06", 1.0), ("c", "2024-02-01", 1.0)]
    got = {r["cohort"]: (r["size"], r["retention"][:3]) for r in reports.cohort_matrix(tx_of(spark, rows)).collect()}
    assert got == {"2024-01": (2, [100.0, 0.0, 50.0]), "2024-02": (1, [100.0, 0.0, 0.0])}


def test_invariants_on_the_seeded_fixture(spark, seeded_tx):
    users = ft.user_table(seeded_tx, act=activity(seeded_tx))
    rows = users.toPandas()
    assert len(rows) == seeded_tx.select("user_id").distinct().count() == 240
    assert rows[["r_score", "f_score", "m_score"]].stack().between(1, 5).all()
    assert rows.isna().mean().max() <= 0.05
    assert sum(r["users"] for r in ft.value_counts(users, "segment").collect()) == 240
