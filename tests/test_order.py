"""Ordering primitives against numpy and pandas, both ways, with ties and heavy values."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.functions import order
from holdfast.session import clear_written, cut_lineage, hold


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    data = pd.DataFrame({"user_id": [f"u{i:04d}" for i in range(600)], "x": rng.normal(size=600).round(3)})
    data.loc[:199, "x"] = 0.25  # a third of the rows share one value
    data["y"] = rng.integers(1, 4, 600).astype(float)
    return data


def test_quantiles(spark, values, both_ways):
    df = hold(spark.createDataFrame(values))
    probs = [0.0, 0.2, 0.5, 0.75, 0.99, 1.0]
    got = order.quantiles(df, ["x", "y"], probs)
    for col in ("x", "y"):
        assert got[col] == pytest.approx(list(np.quantile(values[col], probs)), abs=1e-12)


def test_quantiles_of_nulls(spark, both_ways):
    df = hold(spark.range(3).select(F.lit(None).cast("double").alias("x"), F.col("id").cast("double").alias("y")))
    got = order.quantiles(df, ["x", "y"], [0.5])
    assert got == {"y": [1.0]}


def test_running_totals(spark, values, both_ways):
    hist = spark.createDataFrame(values).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))
    got = order.running_totals(hist, "x", ["n"], by=["y"]).toPandas().sort_values(["y", "x"])
    want = values.groupby(["y", "x"]).size().rename("n").reset_index().sort_values(["y", "x"])
    assert (got["cum_n"].to_numpy() == want.groupby("y")["n"].cumsum().to_numpy()).all()
    assert (got["tot_n"].to_numpy() == want.groupby("y")["n"].transform("sum").to_numpy()).all()


def test_global_rank(spark, values, both_ways):
    got = order.global_rank(spark.createDataFrame(values), ["x", "user_id"]).toPandas().set_index("user_id")["rank"]
    want = values.sort_values(["x", "user_id"]).reset_index(drop=True)
    assert [got[u] for u in want["user_id"]] == list(range(1, 601))


def test_positions_by_group(spark, values, both_ways):
    got = order.positions(spark.createDataFrame(values), ["x", "user_id"], by=["y"]).toPandas()
    for _, part in got.groupby("y"):
        ordered = part.sort_values(["x", "user_id"])
        assert list(ordered["_pos"]) == list(range(len(part)))
        assert set(part["_size"]) == {len(part)}


def test_pct_rank_with_a_heavy_value(spark, values, both_ways):
    got = order.pct_rank(hold(spark.createDataFrame(values)), "x", "pct").toPandas().set_index("user_id")["pct"]
    want = values.set_index("user_id")["x"].rank(pct=True)
    assert len(got) == 600
    assert np.allclose(got.sort_index(), want.sort_index())


def test_salted_lookup_keeps_every_row(spark, both_ways):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1).alias("k"), "id"
    )
    lookup = hold(rows.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("id").alias("top")))
    got = order.salted_lookup(rows, lookup, "k", "w", "id")
    plain = rows.join(lookup.drop("w"), "k")
    assert sorted(map(tuple, got.select("k", "id", "top").collect())) == sorted(
        map(tuple, plain.select("k", "id", "top").collect())
    )


def test_draw(spark, both_ways):
    users = spark.range(100).select(F.col("id").cast("string").alias("user_id"))
    cut = order.draw(users, 30)
    digests = sorted(hashlib.md5(f"{i}:42".encode()).hexdigest() for i in range(100))
    assert cut == digests[29]
    assert order.draw(users, 0) == ""


def test_buckets_are_the_same_in_every_evaluation(spark, monkeypatch):
    """200,000 rows from an unpivot with kept columns: sums and offsets speak of the same rows."""
    monkeypatch.setattr(order, "BUCKET_ROWS", 5_000)
    base = spark.range(100_000).select(
        F.col("id").cast("string").alias("user_id"), (F.col("id") % 2).alias("side"),
        (F.pmod(F.xxhash64("id"), F.lit(90_000)) / 7).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("double").alias("y"),
    )
    long = order.long_form(base, ["x", "y"], ["side"])
    assert long.count() == 200_000
    hist = long.groupBy("feature", "value").agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b"))
    got = order.running_totals(hist, "value", ["a", "b"], by=["feature"])
    for _ in range(3):
        one = got.toPandas().sort_values(["feature", "value"]).reset_index(drop=True)
        for s in "ab":
            assert (one[f"cum_{s}"] == one.groupby("feature")[s].cumsum()).all()
            assert (one[f"tot_{s}"] == one.groupby("feature")[s].transform("sum")).all()
    plan = got._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "BatchEvalPython" not in plan


def test_buckets_follow_the_order_with_nulls_and_odd_numbers(spark, monkeypatch):
    monkeypatch.setattr(order, "BUCKET_ROWS", 20)
    rows = [(None if i % 7 == 0 else float("nan") if i % 11 == 0 else (i * 37 % 100) / 3 - 10, f"é{i:03d}") for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["v", "u"]).astype({"v": object}), "v double, u string")
    got = df.withColumn("part", order.bucket_of(df, ["v", "u"])).orderBy("v", "u").collect()
    parts = [r.part for r in got]
    assert parts == sorted(parts) and len(set(parts)) > 5


def test_pct_rank_keeps_rows_without_a_value(spark, both_ways):
    df = hold(spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0), ("d", 5.0)], "user_id string, x double"))
    got = {r.user_id: r.pct for r in order.pct_rank(df, "x", "pct").collect()}
    assert got == {"a": 0.5, "b": None, "c": 0.5, "d": 1.0}


@pytest.mark.parametrize("cuts", [1, 2, 3, 7, 16, 50, 101])
def test_cuts_below_equals_counting(spark, cuts):
    ends = [3 * i for i in range(cuts)]
    df = spark.range(-2, 3 * cuts + 3).withColumn("own", F.col("id").cast("long"))
    got = df.withColumn("n", order.cuts_below(F.col("own"), [F.lit(e).cast("long") for e in ends])).collect()
    assert [r["n"] for r in got] == [sum(e < r["own"] for e in ends) for r in got]


def test_ranks_and_caps_from_one_histogram(spark, values, both_ways):
    data = values.assign(z=values["x"] * 100 - 20)
    data.loc[5:9, "x"] = None
    df = hold(spark.createDataFrame(data).withColumn("x", F.expr("nullif(x, double('NaN'))")))
    got = order.ranked_and_clipped(df, "x", "pct", ["y", "z"], 0.9).orderBy("user_id").toPandas()
    apart = order.winsorise(order.pct_rank(df, "x", "pct"), ["y", "z"], 0.9, measured=df).orderBy("user_id").toPandas()
    pd.testing.assert_frame_equal(got[apart.columns], apart, check_exact=False, rtol=1e-12)
    assert got["pct"].isna().sum() == 5
    assert order.ranked_and_clipped(hold(df.where("false")), "x", "pct", ["y"]).count() == 0


def test_written_tables_are_cleared(spark):
    clear_written(spark)
    kept = cut_lineage(spark.range(10), "kept")
    assert kept.count() == 10
    folder = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    assert clear_written(spark) == 1 and not os.path.exists(folder)
    assert clear_written(spark) == 0
