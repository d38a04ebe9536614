"""Queries that compare the candidates fit them at the settings of `learners`, stack included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from holdfast.operators import learners
from holdfast.plans import catalog


@pytest.fixture
def folder(seeded_tx, tmp_path):
    rows = seeded_tx.select(
        F.col("user_id").cast("bigint").alias("o_custkey"), F.col("timestamp").alias("o_orderdate"), F.col("amount").alias("o_totalprice"),
        F.col("description").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"),
    )
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    yield str(tmp_path)
    catalog.forget()


@pytest.fixture
def asked(monkeypatch):
    """Settings of every learner that a query makes; what it gets back is small, so that tests are short."""
    seen, forest, boosted = {"forest": [], "boosted": [], "stacks": 0}, learners.forest, learners.boosted
    stack = learners.fit_stack

    def small_forest(**params):
        made = forest(**params)
        seen["forest"].append((made.getNumTrees(), made.getMaxDepth()))
        return forest(numTrees=3, maxDepth=3)

    def small_boosted(name="Boosted Trees", **params):
        made = boosted(name, **params)
        seen["boosted"].append((made.getMaxIter(), made.getMaxDepth(), made.getStepSize(), made.getSubsamplingRate(), made.getFeatureSubsetStrategy()))
        return boosted(name, maxIter=2, maxDepth=2)

    def counted(*args, **params):
        seen["stacks"] += 1
        return stack(*args, **params)

    monkeypatch.setattr(learners, "forest", small_forest)
    monkeypatch.setattr(learners, "boosted", small_boosted)
    monkeypatch.setattr(learners, "fit_stack", counted)
    monkeypatch.setattr(learners, "STACK_ROWS", 50)
    return seen


def whole(seen):
    return (set(seen["forest"]) == {(200, 15)} and seen["stacks"] == 1
            and set(seen["boosted"]) == {(200, 10, 0.05, 1.0, "all"), (300, 6, 0.05, 0.8, "0.8")})


def test_model_comparison_fits_whole_candidates(spark, folder, asked):
    got = catalog.QUERIES["model_comparison"](spark, folder).toPandas().set_index("model")
    assert whole(asked), asked
    assert set(got.index) == {"Random Forest", "Boosted Trees"}
    assert got["auc"].between(0, 1).all() and got["f1"].between(0, 1).all()


def test_select_model_chooses_among_whole_candidates_and_stack(spark, folder, asked):
    got = catalog.QUERIES["select_model"](spark, folder).toPandas().set_index("model")
    assert whole(asked), asked
    assert set(got.index) == {"Random Forest", "Boosted Trees", "Boosted Trees (subsampled)", "Stacking"}
    assert got["auc"].between(0, 1).all() and got["selected"].sum() == 1
    assert got.loc[got["selected"], "auc"].iloc[0] == got["auc"].max()


def test_side_by_side_fits_equal_single_ones(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 7).alias("x"), (F.col("id") % 5 < 2).cast("int").alias("churned"))
    learn = learners.weighted(learners.assemble(rows, ["x"])).repartition(2, "user_id").cache()
    made = [learners.forest(numTrees=3, maxDepth=3), learners.boosted(maxIter=2, maxDepth=2), learners.forest(numTrees=5, maxDepth=2)]
    together = learners.side_by_side(spark, [lambda one=one: one.copy().fit(learn) for one in made])
    assert [m.toDebugString.split("\n", 1)[1] for m in together] == [one.fit(learn).toDebugString.split("\n", 1)[1] for one in made]
