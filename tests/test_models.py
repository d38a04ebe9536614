from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import frame
from holdfast.operators import attribution, drift, evaluation, labels, learners, money
from holdfast.plans import report
from holdfast.session import hold
from holdfast.sources.registry import ModelRegistry

RF = {"numTrees": 12, "maxDepth": 5}
GBT = {"maxIter": 5, "maxDepth": 3}


@pytest.fixture(scope="module")
def training(spark, seeded_tx):
    return labels.temporal_training_set(seeded_tx, "retail").cache()


@pytest.fixture(scope="module")
def model(training):
    return learners.train(training, "retail", RF, GBT, stacked=False)


def test_label_windows(spark):
    def window(days, domain):
        tx = frame(spark, [("a", pd.Timestamp("2020-01-01"), 1.0), ("a", pd.Timestamp("2020-01-01") + pd.Timedelta(days=days), 1.0)],
                   "user_id string, timestamp timestamp, amount double")
        return labels.label_window(tx, domain).days

    assert window(1000, "tax") == 180 and window(250, "tax") == 100 and window(100, "tax") == 90
    assert window(1000, "upi") == 90 and window(200, "upi") == 50 and window(10, "upi") == 30
    assert window(1000, "retail") == 120 and window(300, "retail") == 90 and window(10, "retail") == 45


def test_too_few_users_have_no_training_set(spark):
    tx = frame(spark, [("a", pd.Timestamp("2020-01-01"), 1.0), ("a", pd.Timestamp("2020-12-01"), 1.0)], "user_id string, timestamp timestamp, amount double")
    assert labels.temporal_training_set(tx) is None
    assert learners.train(None) is None


def test_leakage_never_reaches_the_model(training):
    names = labels.feature_names(training)
    assert not {"rfm_score", "churned", "churn_probability", "user_id", "cluster"} & set(names)
    assert names == sorted(names)


def test_split_is_exact_and_stratified(spark, both_ways):
    rows = spark.range(500).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 5 == 0).cast("int").alias("churned"))
    got = labels.split3(rows).groupBy("churned", "part").count().collect()
    assert {(r["churned"], r["part"]): r["count"] for r in got} == {
        (0, "train"): 240, (0, "cal"): 80, (0, "test"): 80, (1, "train"): 60, (1, "cal"): 20, (1, "test"): 20}


def test_quality_gates(model):
    assert model.metrics["roc_auc"] >= 0.55
    assert model.metrics["accuracy"] >= 0.60
    assert 0.0 <= model.threshold <= 1.0


def test_scores_are_probabilities_and_repeatable(model, training):
    first = model.probabilities(training).orderBy("user_id").toPandas()["churn_probability"]
    again = model.probabilities(training).orderBy("user_id").toPandas()["churn_probability"]
    assert first.between(0, 1).all() and np.array_equal(first, again)


def test_missing_features_count_as_zero(model, training):
    dropped = model.probabilities(training.drop(model.features[0]))
    zeroed = model.probabilities(training.withColumn(model.features[0], F.lit(0.0)))
    a = dropped.orderBy("user_id").toPandas()["churn_probability"]
    assert np.allclose(a, zeroed.orderBy("user_id").toPandas()["churn_probability"])


def test_stacking_scores(training):
    names = labels.feature_names(training)
    learn = hold(learners.weighted(learners.assemble(training, names)))
    pair = [learners.forest(numTrees=4, maxDepth=3), learners.boosted(maxIter=2, maxDepth=2)]
    bases, meta = learners.fit_stack(learn, pair, [p.fit(learn) for p in pair])
    got = learners.ChurnModel("Stacking", names, bases, meta).probabilities(training).toPandas()
    assert got["churn_probability"].between(0, 1).all() and len(got) == training.count()


def test_calibration_is_monotone(spark):
    rows = spark.range(3000).select((F.col("id") / 3000).alias("p"), (F.rand(5) < F.col("id") / 3000).cast("int").alias("label"))
    fitted = learners.calibrate(hold(rows))
    got = learners.apply_calibrator(fitted, rows, "p", "q").toPandas()
    assert got["q"].is_monotonic_increasing and got["q"].between(0, 1).all()
    assert learners.calibrate(hold(rows.where("label = 0"))) is None
    same = learners.apply_calibrator(fitted, rows, "p", "p").toPandas()
    assert np.array_equal(same["p"], got["q"])


def test_isotonic_map_equals_pooled_neighbours(spark):
    """Adjacent violators pooled by hand give the calibrated value of every score."""
    rng = np.random.default_rng(5)
    p = rng.integers(0, 40, 900) / 40
    label = (rng.random(900) < 0.2 + 0.5 * p * p).astype(int)
    raw = hold(spark.createDataFrame(pd.DataFrame({"p": p, "label": label})))
    blocks = []  # sum, rows, scores
    for score, group in pd.DataFrame({"p": p, "y": label}).groupby("p"):
        blocks.append([group["y"].sum(), len(group), [score]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, n, scores = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2] + scores]
    want = {score: total / n for total, n, scores in blocks for score in scores}
    got = learners.apply_calibrator(learners.calibrate(raw), raw.withColumn("s", F.col("p")), "p", "q").toPandas()
    assert len(got) == 900
    assert np.allclose(got["q"], got["s"].map(want))


def _silhouette_by_hand(points, cluster, chosen):
    away = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    values = []
    for i in chosen:
        mine = cluster == cluster[i]
        if mine.sum() == 1:
            values.append(0.0)
            continue
        a = away[i][mine].sum() / (mine.sum() - 1)
        b = min(away[i][cluster == c].mean() for c in set(cluster) - {cluster[i]})
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(values)


@pytest.mark.parametrize("points", [5000, 60])
def test_plain_silhouette_equals_brute_force(spark, points):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(400, 3)), columns=["recency", "frequency", "monetary"])
    data["cluster"] = rng.integers(0, 3, 400)
    data.loc[7, "cluster"] = 9  # alone
    data.loc[20:30, ["recency", "frequency", "monetary"]] = 1.0  # repeated rows
    data["user_id"] = [f"u{i}" for i in range(400)]
    got = learners.silhouette_euclidean(spark.createDataFrame(data).repartition(5), points).first()[0]
    at = data[["recency", "frequency", "monetary"]]
    turn = data["user_id"].map(lambda u: hashlib.md5(f"{u}:42".encode()).hexdigest())
    chosen = turn.sort_values().index[:points]
    assert got == pytest.approx(_silhouette_by_hand(((at - at.mean()) / at.std()).to_numpy(), data["cluster"].to_numpy(), chosen), abs=1e-9)


def test_plain_silhouette_of_one_cluster_or_no_row(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 0), ("b", None, 2.0, 3.0, 1)], "user_id string, recency double, frequency double, monetary double, cluster int")
    assert learners.silhouette_euclidean(rows).first()[0] == 0.0
    assert learners.silhouette_euclidean(rows.where("false")).first()[0] == 0.0


def test_lapsed_users(spark):
    past = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "user_id string")
    later = spark.createDataFrame([("b",), ("b",), ("d",)], "user_id string")
    assert sorted(r[0] for r in labels.lapsed_users(past, later).collect()) == ["a", "c"]


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_attributions_add_up_to_the_prediction(spark, training, kind):
    names = ["recency", "frequency", "monetary", "ipi_median"]
    learn = hold(learners.weighted(learners.assemble(training, names)))
    fit = learners.fit_rf(learn, numTrees=6, maxDepth=4) if kind == "forest" else learners.fit_gbt(learn, maxIter=4, maxDepth=3)
    model = learners.ChurnModel(kind, names, [fit])
    base = attribution.base_value(model, spark)
    rows = attribution.attribution_rows(model, training).groupBy("user_id").agg(F.sum("shap_value").alias("s"))
    got = rows.join(model.probabilities(training), "user_id").toPandas()
    total = got["s"] + base
    want = got["churn_probability"] if kind == "forest" else np.log(got["churn_probability"] / (1 - got["churn_probability"])) / 2
    assert np.allclose(total, want, atol=1e-9)


def test_shapley_equals_brute_force():
    """All coalitions of a three-feature tree, by definition."""
    from itertools import combinations
    from math import factorial

    nodes = {0: {"left": 1, "right": 2, "feature": 0, "threshold": 0.5, "weight": 10.0, "value": 0.0},
             1: {"left": 3, "right": 4, "feature": 1, "threshold": 0.3, "weight": 6.0, "value": 0.0},
             2: {"left": 5, "right": 6, "feature": 2, "threshold": 0.7, "weight": 4.0, "value": 0.0},
             3: {"left": -1, "right": -1, "feature": -1, "threshold": 0, "weight": 2.0, "value": 0.1},
             4: {"left": 7, "right": 8, "feature": 0, "threshold": 0.2, "weight": 4.0, "value": 0.0},
             5: {"left": -1, "right": -1, "feature": -1, "threshold": 0, "weight": 1.0, "value": 0.8},
             6: {"left": -1, "right": -1, "feature": -1, "threshold": 0, "weight": 3.0, "value": 0.3},
             7: {"left": -1, "right": -1, "feature": -1, "threshold": 0, "weight": 1.0, "value": 0.9},
             8: {"left": -1, "right": -1, "feature": -1, "threshold": 0, "weight": 3.0, "value": 0.4}}

    def worth(x, known, at=0):
        n = nodes[at]
        if n["left"] < 0:
            return n["value"]
        if n["feature"] in known:
            return worth(x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
        left, right = nodes[n["left"]]["weight"], nodes[n["right"]]["weight"]
        return (left * worth(x, known, n["left"]) + right * worth(x, known, n["right"])) / (left + right)

    rng = np.random.default_rng(0)
    xs = rng.random((20, 3))
    tree = attribution.tree_of(pd.DataFrame([{"id": i, **n} for i, n in nodes.items()]))
    got, pairs = attribution.shapley([tree], xs), attribution.interactions([tree], xs)
    for x, row, pair in zip(xs, got, pairs):
        assert tree.mean == pytest.approx(worth(x, set()))
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            phi = sum(factorial(k) * factorial(2 - k) / 6 * (worth(x, {*s, i}) - worth(x, set(s)))
                      for k in range(3) for s in combinations(rest, k))
            assert row[i] == pytest.approx(phi, abs=1e-12)
            for j in rest:
                other = next(k for k in rest if k != j)
                joint = [worth(x, {*s, i, j}) - worth(x, {*s, i}) - worth(x, {*s, j}) + worth(x, set(s)) for s in ([], [other])]
                assert pair[i, j] == pytest.approx(sum(joint) / 4, abs=1e-12)
    assert np.allclose(pairs.sum(axis=2), got, atol=1e-12)


def grown(rng, depth, width):
    """A random tree whose paths split on a feature again and again."""
    rows = []

    def grow(level, weight):
        at = len(rows)
        rows.append({"id": at, "left": -1, "right": -1, "feature": -1, "threshold": 0.0, "weight": weight, "value": float(rng.normal())})
        if level and weight > 1 and rng.random() < 0.9:
            share = float(rng.integers(1, int(weight))) if weight > 2 else 1.0
            rows[at].update(feature=int(rng.integers(width)), threshold=float(rng.random()))
            rows[at].update(left=grow(level - 1, share), right=grow(level - 1, weight - share))
        return at

    grow(depth, 4000.0)
    return rows


def test_deep_trees_equal_the_definition():
    from math import factorial

    rng, width = np.random.default_rng(4), 4
    for _ in range(6):
        rows = grown(rng, 11, width)
        tree = attribution.tree_of(pd.DataFrame(rows))

        def worth(x, known, at=0):
            n = rows[at]
            if n["left"] < 0:
                return n["value"]
            if n["feature"] in known:
                return worth(x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
            return sum(rows[n[c]]["weight"] * worth(x, known, n[c]) for c in ("left", "right")) / n["weight"]

        xs = rng.random((3, width))
        got = attribution.shapley([tree], xs)
        for x, row in zip(xs, got):
            worths = {bits: worth(x, {f for f in range(width) if bits >> f & 1}) for bits in range(1 << width)}
            for i in range(width):
                phi = sum(factorial(bits.bit_count()) * factorial(width - 1 - bits.bit_count()) / factorial(width) * (worths[bits | 1 << i] - v)
                          for bits, v in worths.items() if not bits >> i & 1)
                assert row[i] == pytest.approx(phi, abs=1e-9)


def test_groups_of_trees_change_nothing(spark, training, monkeypatch):
    names = ["recency", "frequency", "monetary", "ipi_median"]
    fit = learners.fit_rf(hold(learners.weighted(learners.assemble(training, names))), numTrees=5, maxDepth=9)
    model = learners.ChurnModel("forest", names, [fit])
    once = {r.user_id: r.phi for r in attribution.attributions(model, training).collect()}
    pairs = attribution.interaction_rows(model, training)
    sums = {(r.user_id, r.feature): r.s for r in pairs.groupBy("user_id", "feature").agg(F.sum("shap_interaction").alias("s")).collect()}
    monkeypatch.setattr(attribution, "NODES_AT_ONCE", 1)
    monkeypatch.setattr(attribution, "CELLS_AT_ONCE", 1000)
    again = {r.user_id: r.phi for r in attribution.attributions(model, training).collect()}
    assert once.keys() == again.keys() and all(np.allclose(once[u], again[u], atol=1e-12) for u in once)
    assert all(sums[u, f] == pytest.approx(v, abs=1e-9) for u in once for f, v in zip(names, once[u]))
    top = attribution.interaction_summary(pairs).collect()
    assert len(top) == 6 and [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    curve = attribution.dependence(model, training, bins=4).collect()
    total = {f: sum(r.users for r in curve if r.feature == f) for f in names}
    assert set(total.values()) == {training.count()} and all(r.low <= r.high for r in curve)


def test_drivers_and_labels(spark, model):
    rows = attribution.drivers(learners.importances(model, spark)).collect()
    assert len(rows) >= 3 and len({r["feature"] for r in rows}) == len(rows)
    assert all(r["importance"] >= 0 for r in rows) and sum(r["importance"] for r in rows) <= 1.05
    names = attribution.driver_labels("retail")
    assert attribution.label_of("recency", names) == "Recency (Days Since Last Order)"
    assert attribution.label_of("frequency_trend", names) == "Purchase Frequency (Order Count) Trend"
    assert attribution.label_of("zzz", names) is None


def test_registry_keeps_three_and_checks_the_schema(spark, model, training, tmp_path):
    store = ModelRegistry(spark, str(tmp_path / "models"))
    assert store.load_latest("x") is None
    versions = [store.save(model, "x") for _ in range(4)]
    assert store.list().count() == 3
    assert sorted(p.name for p in (tmp_path / "models").iterdir() if p.name != "log") == versions[1:]
    assert store.load_latest("x", [*model.features[1:], "other"]) is None
    back = store.load_latest("x", list(reversed(model.features)))
    assert back.features == model.features and back.threshold == model.threshold


@pytest.mark.parametrize("stacked", [False, True])
def test_registry_gives_the_same_scores(spark, training, tmp_path, stacked):
    names = labels.feature_names(training, "retail")
    rows = learners.weighted(learners.assemble(training, names))
    bases = [learners.fit_rf(rows, **RF), learners.fit_gbt(rows, **GBT)] if stacked else [learners.fit_rf(rows, **RF)]
    meta = None
    if stacked:
        bases, meta = learners.fit_stack(rows, [learners.forest(**RF), learners.boosted(**GBT)], bases, k=2)
    one = learners.ChurnModel("Any", names, bases, meta)
    one.calibrator = learners.calibrate(learners.labelled_scores(one, training))
    one.threshold = 0.31
    store = ModelRegistry(spark, str(tmp_path / "models"))
    store.save(one, "y")
    back = store.load_latest("y")
    assert len(back.bases) == len(bases) and (back.meta is None) == (meta is None)
    assert (back.calibrator is None) == (one.calibrator is None) and back.threshold == 0.31
    odd = training.withColumn(names[0], F.when(F.col("churned") == 1, F.col(names[0])))  # nulls are filled alike
    both = one.probabilities(odd, "p").select("user_id", "p").join(back.probabilities(odd, "q").select("user_id", "q"), "user_id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] == 0.0


def rated(spark, p, y):
    return frame(spark, [(float(a), int(b)) for a, b in zip(p, y)], "p double, label int")


def test_auc_and_threshold_against_brute_force(spark, both_ways):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 300)
    p = np.clip((rng.random(300) + y * 0.4) / 1.4, 0, 1).round(2)
    df = hold(rated(spark, p, y))
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    assert evaluation.auc_value(df) == pytest.approx(wins)

    def utility(t):
        hit = p >= t
        tp, fp, fn, tn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum()
        pr, re, sp = tp / max(tp + fp, 1), tp / max(tp + fn, 1), tn / max(tn + fp, 1)
        f1, ba = 2 * pr * re / max(pr + re, 1e-9), (re + sp) / 2
        return re >= 0.55 and sp >= 0.55, round(0.45 * f1 + 0.45 * ba + 0.1 * (1 - abs(fp / max(tn + fp, 1) - fn / max(tp + fn, 1))), 12), round(f1, 12), round(ba, 12), -t

    best = max(np.unique([*np.clip(p, 0.01, 0.99), *evaluation.THRESHOLD_GRID]), key=utility)
    assert evaluation.best_threshold(df) == pytest.approx(best)


def test_drift_is_found_and_absent(spark, both_ways):
    a = spark.range(500).select((F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("z"))
    b = spark.range(500).select((F.col("id") % 97 + 40).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("z"))
    flags = {r["feature"]: r for r in drift.flag_drift(drift.ks_two_sample(a, b, ["x", "z"]), 2).collect()}
    assert flags["x"]["drifted"] and not flags["z"]["drifted"]
    assert flags["z"]["ks_statistic"] == 0 and flags["z"]["p_value"] == 1.0


def test_known_ks_probability(spark):
    # Q(0.8) of the limiting distribution
    row = spark.range(1).select(drift.p_value(F.lit(0.8), F.lit(2.0), F.lit(2.0)).alias("p")).first()
    assert row["p"] == pytest.approx(0.54414241, abs=1e-8)


def test_first_baseline_run_saves(spark, tmp_path):
    users = spark.range(50).select(F.col("id").cast("string").alias("user_id"), F.col("id").cast("double").alias("x"))
    path = str(tmp_path / "base")
    assert drift.check_against_baseline(users, ["x"], path)[0] == "Baseline Saved (first run)"
    state, found = drift.check_against_baseline(users, ["x"], path)
    assert state == "Baseline Drift" and found.first()["drifted"] is False


def test_full_report(spark, seeded_tx, tmp_path):
    done = report.analyse(seeded_tx, "retail", rf=RF, gbt=GBT, baseline=str(tmp_path / "base"))
    users = done.users.toPandas()
    assert len(users) == 240 and users["churn_probability"].between(0, 1).all() and (users["revenue_at_risk"] >= 0).all()
    assert users[["churn_probability", "predicted_ltv", "segment", "lifecycle"]].isna().sum().sum() == 0
    body = report.report_json(done.sections)
    assert {r["section"] for r in body.collect()} >= {
        "kpis", "segment_churn", "forecast", "hypotheses", "drift", "clusters", "silhouette", "metrics", "shap", "shap_segments", "baseline_drift"}
    assert report.users_json(done.users).count() == len(users)


def test_heuristic_fallback(spark):
    users = frame(spark, [("a", 10.0), ("b", 5.0), ("c", None)], "user_id string, recency double")
    got = {r["user_id"]: r["churn_probability"] for r in money.heuristic_churn(users).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 0.5}


def test_training_starts_from_a_written_table(training, monkeypatch):
    seen = []
    plain = learners.split3
    monkeypatch.setattr(learners, "split3", lambda rows: seen.append(rows.inputFiles()) or plain(rows))
    learners.train(training, "retail", {"numTrees": 2, "maxDepth": 2}, {"maxIter": 1, "maxDepth": 2}, stacked=False)
    assert len(seen) == 1 and all("labelled" in f for f in seen[0]) and seen[0]


def test_held_tables_have_few_partitions_when_small(spark):
    held = hold(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert held.count() == 7 and held.rdd.getNumPartitions() == 1
