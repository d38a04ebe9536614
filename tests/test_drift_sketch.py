"""Quantile sketches against the exact comparison; month bitmaps against plain distinct months."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import drift, reports


@pytest.fixture(scope="module")
def sides(spark):
    base = spark.range(60_000).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 5).alias("day"),
                                      F.rand(1).alias("same"), F.rand(2).alias("moved"), F.floor(F.rand(3) * 4).cast("double").alias("few"))
    late = base.select("user_id", "day", F.rand(4).alias("same"), (F.rand(5) * 1.1).alias("moved"), F.floor(F.rand(6) * 5).cast("double").alias("few"))
    return base.cache(), late.cache()


COLS = ["same", "moved", "few"]


def test_sketched_distance_lies_in_its_bound(sides):
    base, late = sides
    exact = {r.feature: r.d for r in drift.ks_two_sample(base, late, COLS).collect()}
    days = drift.sketch_baseline(base, COLS, ["day"])
    assert days.count() == 15
    got = drift.sketch_ks(drift.merged_sketches(days), drift.sketch_baseline(late, COLS)).collect()
    assert {r.feature for r in got} == set(COLS)
    for r in got:
        assert r.n_a == r.n_b == 60_000 and 0 < r.d_error < 0.01
        assert abs(r.d - exact[r.feature]) <= r.d_error
    flags = {r.feature: (r.drifted, r.sure) for r in drift.sketch_drift(late, drift.merged_sketches(days), COLS).collect()}
    assert flags["moved"] == flags["few"] == (True, True) and flags["same"][0] is False


def test_small_tables_are_off_by_a_step_at_most(sides):
    base, late = (s.where("user_id < '10900'") for s in sides)
    n = base.count()
    assert 500 < n < drift.SKETCH_K
    exact = {r.feature: r.d for r in drift.ks_two_sample(base, late, COLS).collect()}
    for r in drift.sketch_ks(drift.sketch_baseline(base, COLS), drift.sketch_baseline(late, COLS)).collect():
        assert r.d_error == 2 / drift.SKETCH_POINTS and abs(r.d - exact[r.feature]) <= r.d_error


def test_month_bitmaps_over_more_than_a_word(spark):
    rnd = random.Random(2)
    start = dt.datetime(2009, 11, 20)
    rows = [(str(rnd.randrange(30)), start + dt.timedelta(days=rnd.randrange(4500)), 1.0) for _ in range(900)] + [("x", None, 1.0)]
    tx = spark.createDataFrame(rows, "user_id string, timestamp timestamp, amount double")
    months = {}
    for user, at, _ in rows:
        if at:
            months.setdefault(user, set()).add(12 * at.year + at.month - 1)
    want = {}
    for own in months.values():
        for m in own:
            first = min(own)
            want[first, m - first] = want.get((first, m - first), 0) + 1
    got = {(12 * int(r.cohort[:4]) + int(r.cohort[5:]) - 1, r.period): (r.active, r["size"], r.retention) for r in reports.cohort_retention(tx).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v[1] == want[k[0], 0] and v[2] == pytest.approx(round(100 * v[0] / v[1], 1), abs=0.11) for k, v in got.items())
    assert len(reports.month_bitmaps(tx).first().months) == 3
    assert reports.cohort_retention(tx.limit(0)).count() == 0 and reports.cohort_matrix(tx.limit(0)).count() == 0
