"""Shapley attributions of tree models, computed where the rows are.

For one leaf, a coalition of features is worth leaf value x product over the features of its path
(whether the row meets the feature's interval if the feature is known, else the share of training
rows that do). The Shapley value of that product is an integral of a polynomial over [0, 1], which
Gauss-Legendre nodes give exactly. One walk down a tree multiplies the factors of a path, shared by all leaves
below it, one walk up adds the leaves; the work per row is nodes x half the depth, so the trees of a
model are explained as deep as they were trained. Trees travel to the tasks in groups of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.columns import fixed_digits, title_name
from holdfast.functions.fixed import DOMAIN_DRIVER_LABELS, DRIVER_LABELS
from holdfast.functions.order import quantiles
from holdfast.operators.learners import ChurnModel
from holdfast.session import cut_lineage, scratch_path, small_table

CELLS_AT_ONCE = 4_000_000  # numbers held by one step: rows x nodes x points
NODES_AT_ONCE = 1_000_000  # nodes of the trees that travel together

# the functions below run in the Python workers, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Tree:
    """Nodes level by level; the two children of the internal nodes of a level follow in their order."""

    sizes: list[int]  # nodes of each level
    feature: np.ndarray  # of the split that leads to the node, -1 for the root
    left: np.ndarray  # whether the node holds the values up to the threshold
    threshold: np.ndarray
    share: np.ndarray  # of its parent's training rows
    leaf: np.ndarray
    value: np.ndarray

    @property
    def mean(self) -> float:
        """Mean prediction over the training rows."""
        reach, total, start = np.ones(1), 0.0, 0
        for size, below in zip(self.sizes, [*self.sizes[1:], 0]):
            at = slice(start, start + size)
            total += float((reach * self.value[at])[self.leaf[at]].sum())
            start += size
            if below:
                reach = np.repeat(reach[~self.leaf[at]], 2) * self.share[start : start + below]
        return total


def tree_of(nodes: pd.DataFrame) -> Tree:
    """The tree of node rows (id, left, right, feature, threshold, weight, value); the root has id 0."""
    nodes = nodes.sort_values("id")
    ids = nodes["id"].to_numpy()
    left, right, feature = (nodes[c].to_numpy() for c in ("left", "right", "feature"))
    threshold, weight, value = (nodes[c].to_numpy(dtype=float) for c in ("threshold", "weight", "value"))
    level, sizes = np.searchsorted(ids, [0]), []
    parts: list[tuple] = [(np.array([-1]), np.array([False]), np.zeros(1), np.ones(1))]
    order = []
    while len(level):
        sizes.append(len(level))
        order.append(level)
        inner = level[left[level] >= 0]
        level = np.searchsorted(ids, np.stack([left[inner], right[inner]], axis=1).ravel())
        if len(level):
            above = np.repeat(weight[inner], 2)
            share = np.where(above > 0, weight[level] / np.where(above > 0, above, 1.0), 0.5)
            parts.append((np.repeat(feature[inner], 2), np.tile([True, False], len(inner)), np.repeat(threshold[inner], 2), np.maximum(share, 1e-12)))
    whole = np.concatenate(order)
    return Tree(sizes, *(np.concatenate(c) for c in zip(*parts)), leaf=left[whole] < 0, value=value[whole])


def _earlier(tree: Tree, width: int) -> np.ndarray:
    """For every node the last node above it, or 0, whose split is on the same feature."""
    out = np.zeros(len(tree.feature), dtype=np.int64)
    last, start = np.zeros((1, width), dtype=np.int64), 1
    for size, below in zip(tree.sizes, tree.sizes[1:]):
        inner = ~tree.leaf[start - size : start]
        last = np.repeat(last[inner], 2, axis=0)
        nodes, split = np.arange(start, start + below), tree.feature[start : start + below]
        out[nodes] = last[np.arange(below), split]
        last[np.arange(below), split] = nodes
        start += below
    return out


def shapley(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """(rows, features) attributions; their sum is prediction minus mean prediction."""
    out = np.zeros(x.shape, dtype=float)
    for tree in trees:
        if len(tree.sizes) > 1:
            _add_tree(tree, x, out)
    return out


def _add_tree(tree: Tree, x: np.ndarray, out: np.ndarray) -> None:
    earlier = _earlier(tree, x.shape[1])
    most = max(_longest_paths(tree, earlier), 1)
    points, weights = np.polynomial.legendre.leggauss((most + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    n, ends = len(tree.feature), np.cumsum(tree.sizes)
    cover = tree.share.copy()
    for start, end in zip(ends, ends[1:]):  # covers of a feature's intervals multiply down the path
        above = earlier[start:end]
        cover[start:end] *= np.where(above > 0, cover[above], 1.0)
    # factor and slope of a node whose interval a row misses (0) or meets (1), per point
    factor = np.stack([np.outer(cover, 1 - points), np.outer(cover, 1 - points) + points], axis=1)
    slope = (np.array([0.0, 1.0])[None, :, None] - cover[:, None, None]) / factor
    first = earlier == 0
    before = np.where(first[:, None, None], 1.0, factor[earlier])
    slope_before = np.where(first[:, None, None], 0.0, slope[earlier])
    # by state: missed before already, missed from here on, met
    ratio = np.stack([factor[:, 0] / before[:, 0], factor[:, 0] / before[:, 1], factor[:, 1] / before[:, 1]], axis=1)
    gain = np.stack([slope[:, 0] - slope_before[:, 0], slope[:, 0] - slope_before[:, 1], slope[:, 1] - slope_before[:, 1]], axis=1) * weights
    hot = np.zeros((n, x.shape[1]))
    hot[np.arange(1, n), tree.feature[1:]] = 1.0
    step = max(1, CELLS_AT_ONCE // (n * len(points)))
    for begin in range(0, len(x), step):
        rows = x[begin : begin + step]
        met = np.ones((len(rows), n), dtype=bool)
        state, leaves = [None], []
        product = np.ones((len(rows), 1, len(points)))
        for level, (start, end) in enumerate(zip(ends, ends[1:])):
            at = np.arange(start, end)
            above = met[:, earlier[at]]
            met[:, at] = above & ((rows[:, tree.feature[at]] <= tree.threshold[at]) == tree.left[at])
            state.append(above.astype(np.int8) + met[:, at])
            own = ~tree.leaf[start - tree.sizes[level] : start]
            leaves.append(product)
            product = np.repeat(product[:, own], 2, axis=1) * ratio[at, state[-1]]
        leaves.append(product)
        below = None
        for level in range(len(tree.sizes) - 1, 0, -1):
            at = np.arange(ends[level - 1], ends[level])
            sums = leaves[level] * tree.value[at][:, None]
            if below is not None:
                sums[:, ~tree.leaf[at]] = below[:, 0::2] + below[:, 1::2]
            out[begin : begin + step] += np.einsum("rnp,rnp->rn", gain[at, state[level]], sums) @ hot[at]
            below = sums


def _longest_paths(tree: Tree, earlier: np.ndarray) -> int:
    """Distinct features on the path that has most of them."""
    depth = np.zeros(len(tree.feature), dtype=np.int64)
    ends = np.cumsum(tree.sizes)
    for level, (start, end) in enumerate(zip(ends, ends[1:])):
        own = ~tree.leaf[start - tree.sizes[level] : start]
        depth[start:end] = np.repeat(depth[start - tree.sizes[level] : start][own], 2) + (earlier[start:end] == 0)
    return int(depth.max())


# ---- trees of a fitted model ---------------------------------------------------------------------

def saved_nodes(model: ChurnModel, spark: SparkSession) -> DataFrame:
    """Node rows of the base learner: (tree, id, left, right, feature, threshold, weight, value).

    Values carry the weight of their tree: forests add up to the churn probability, boosted trees to the margin.
    """
    path = scratch_path(spark, "trees")
    model.base.write().overwrite().save(path)
    boosted = "GBT" in model.base.__class__.__name__
    weights = list(model.base.treeWeights) if boosted else [1.0 / model.base.getNumTrees] * model.base.getNumTrees
    rows = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    stats = F.col("impurityStats")
    weight = stats[0] if boosted else F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    value = F.col("prediction") if boosted else F.coalesce(F.try_divide(stats[1], weight), F.lit(0.0))
    cut = F.coalesce(F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)), F.lit(0.0))
    scale = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("tree") + 1)
    return rows.select(
        "tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        cut.alias("threshold"), weight.alias("weight"), (value * scale).alias("value"))


def tree_groups(nodes: DataFrame) -> Iterator[list[Tree]]:
    """The trees in groups of at most NODES_AT_ONCE nodes (one tree at least); one group at a time is held."""
    counts = nodes.groupBy("tree").count().orderBy("tree").collect()  # one row per tree
    groups, size = [], 0
    for r in counts:
        if not groups or size + r["count"] > NODES_AT_ONCE:
            groups.append([])
            size = 0
        groups[-1].append(r["tree"])
        size += r["count"]
    for group in groups:
        rows = nodes.where(F.col("tree").between(group[0], group[-1])).toPandas()
        yield [tree_of(own) for _, own in rows.groupby("tree")]


def _matrix(names: list[str], users: DataFrame) -> Column:
    return F.array(
        *[
            F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in users.columns else F.lit(0.0)
            for c in names
        ]
    )


def attributions(model: ChurnModel, users: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, keep..., phi array, x array) of every user; `x` are the feature values scored.

    `keep` names text columns of the users that are carried along, so that later groupings need no join.
    """
    return attributions_of(saved_nodes(model, users.sparkSession), model.features, users, keep)


def attributions_of(nodes: DataFrame, names: list[str], users: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Attributions under trees given as node rows (`saved_nodes`), whose features are places in `names`.

    Every group of trees is one pass over the rows that adds to phi; passes after the first read the
    written result of the one before.
    """
    zeros = F.array_repeat(F.lit(0.0), len(names))
    kept = "".join(f"`{c}` string, " for c in keep)
    schema = f"user_id string, {kept}phi array<double>, x array<double>"
    rows = users.select("user_id", *[F.col(c).cast("string").alias(c) for c in keep], zeros.alias("phi"), _matrix(names, users).alias("x"))

    def pass_over(trees) -> DataFrame:
        def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["x"].to_numpy())
                    yield batch.assign(phi=list(np.stack(batch["phi"].to_numpy()) + shapley(trees.value, x)))

        return rows.mapInPandas(explain, schema)

    spark = users.sparkSession
    for i, trees in enumerate(tree_groups(nodes)):
        rows = cut_lineage(rows, "phi") if i else rows
        rows = pass_over(spark.sparkContext.broadcast(trees))
    return rows


def base_value(model: ChurnModel, spark: SparkSession) -> float:
    """The mean prediction that the attributions of a row add up from."""
    return sum(t.mean for trees in tree_groups(saved_nodes(model, spark)) for t in trees)


def attribution_rows(model: ChurnModel, users: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form: (user_id, keep..., feature, shap_value, value)."""
    names = F.array(*[F.lit(f) for f in model.features])
    zipped = F.explode(F.arrays_zip(names.alias("feature"), F.col("phi").alias("phi"), F.col("x").alias("x")))
    rows = attributions(model, users, keep).select("user_id", *keep, zipped.alias("r"))
    return rows.select("user_id", *keep, F.col("r.feature").alias("feature"), F.col("r.phi").alias("shap_value"), F.col("r.x").alias("value"))


def _direction(sign: Column) -> Column:
    return F.when(sign > 0, "increases_churn").otherwise("decreases_churn")


def summarise(rows: DataFrame, *by: str) -> DataFrame:
    """Mean absolute attribution and the direction in which it moves with the feature value."""
    # the covariance has the sign of the correlation and is defined for constant columns too
    return rows.groupBy(*by, "feature").agg(
        F.avg(F.abs("shap_value")).alias("importance"),
        F.covar_pop("value", "shap_value").alias("_sign"),
    )


def shap_summary(model: ChurnModel, users: DataFrame) -> DataFrame:
    """Mean absolute attribution and direction per feature, over all users."""
    rows = summarise(attribution_rows(model, users))
    return rows.select("feature", "importance", _direction(F.col("_sign")).alias("direction"))


def shap_users(model: ChurnModel, users: DataFrame, top: int = 3) -> DataFrame:
    """The strongest drivers of every user with an explanation; an unknown user has no rows."""
    names = F.array(*[F.lit(f) for f in model.features])
    ranked = F.slice(
        F.sort_array(
            F.transform(
                F.arrays_zip(F.col("phi").alias("phi"), F.col("x").alias("x"), names.alias("f")),
                lambda r: F.struct((-F.abs(r["phi"])).alias("k"), r["f"].alias("f"), r["phi"].alias("phi"), r["x"].alias("x")),
            )
        ),
        1,
        top,
    )
    rows = attributions(model, users).select("user_id", F.posexplode(ranked).alias("pos", "r"))
    name, phi, value = title_name(F.col("r.f")), F.col("r.phi"), fixed_digits(F.col("r.x"), 0)
    size = fixed_digits(F.abs("r.phi"), 3)
    up = F.concat(F.lit("High "), name, F.lit(" ("), value, F.lit(") is pushing churn risk UP by "), size)
    down = F.concat(name, F.lit(" ("), value, F.lit(") is helping RETAIN this user (impact: "), size, F.lit(")"))
    return rows.select(
        "user_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("r.f").alias("feature"),
        phi.alias("shap_value"),
        _direction(phi).alias("direction"),
        F.when(phi > 0, up).otherwise(down).alias("explanation"),
    )


def explanation_summary(shap: DataFrame, scored: DataFrame) -> DataFrame:
    """One sentence per user from the strongest driver."""
    first = shap.where("rank = 1").join(scored.select("user_id", "churn_probability"), "user_id")
    return first.select(
        "user_id",
        F.concat(
            F.lit("This user has "),
            fixed_digits(F.col("churn_probability") * 100, 0),
            F.lit("% churn risk primarily because "),
            F.lower("explanation"),
        ).alias("explanation_summary"),
    )


def shap_segments(model: ChurnModel, users: DataFrame, top: int = 3) -> DataFrame:
    """Strongest drivers of each segment over all of its users."""
    rows = attribution_rows(model, users, ("segment",))
    stats = summarise(rows, "segment")
    order = W.partitionBy("segment").orderBy(F.desc("importance"), "feature")
    up = F.col("_sign") >= 0
    ranked = stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "segment",
        "rank",
        "feature",
        "importance",
        F.when(up, "increases_churn").otherwise("decreases_churn").alias("direction"),
        F.concat(
            F.lit("Churn in this segment is primarily driven by "),
            title_name(F.col("feature")),
            F.when(up, " (increasing) risk.").otherwise(" (decreasing) risk."),
        ).alias("explanation"),
    )


# ---- pairs of features ---------------------------------------------------------------------------

def interactions(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """(rows, features, features): how far two features move the score together beyond each alone.

    Off the diagonal half of the pair's joint effect on either side, on it what is left of a feature's
    attribution: every row of the matrix adds up to the attribution of its feature.
    """
    width = x.shape[1]
    out = np.zeros((len(x), width, width))
    for tree in trees:
        if len(tree.sizes) < 2:
            continue
        leaf, on_path, low, high, cover = _leaf_paths(tree, width)
        most = max(int(on_path.sum(axis=1).max()), 1)
        points, weights = np.polynomial.legendre.leggauss((most + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        step = max(1, CELLS_AT_ONCE // (on_path.size * len(points)))
        for begin in range(0, len(x), step):
            rows = x[begin : begin + step, None, :]
            met = ((rows > low) & (rows <= high)).astype(float)
            for point, weight in zip(points, weights):
                factor = np.where(on_path, (1 - point) * cover + point * met, 1.0)
                slope = np.where(on_path, met - cover, 0.0) / factor
                worth = factor.prod(axis=2) * tree.value[leaf] * weight / 2
                out[begin : begin + step] += np.einsum("rlf,rl,rlg->rfg", slope, worth, slope, optimize=True)
    at = np.arange(width)
    out[:, at, at] = 0.0
    out[:, at, at] = shapley(trees, x) - out.sum(axis=2)
    return out


def _leaf_paths(tree: Tree, width: int) -> tuple[np.ndarray, ...]:
    """Leaves, and for each of them and every feature: whether its path splits on it, the interval, the cover."""
    low, high = np.full((1, width), -np.inf), np.full((1, width), np.inf)
    cover, on_path = np.ones((1, width)), np.zeros((1, width), dtype=bool)
    kept, start = [], 0
    for size, below in zip(tree.sizes, [*tree.sizes[1:], 0]):
        leaf = tree.leaf[start : start + size]
        kept.append((np.arange(start, start + size)[leaf], on_path[leaf], low[leaf], high[leaf], cover[leaf]))
        start += size
        if below:
            low, high, cover, on_path = (np.repeat(a[~leaf], 2, axis=0) for a in (low, high, cover, on_path))
            node, row = np.arange(start, start + below), np.arange(below)
            f, cut, left = tree.feature[node], tree.threshold[node], tree.left[node]
            high[row, f] = np.where(left, np.minimum(high[row, f], cut), high[row, f])
            low[row, f] = np.where(left, low[row, f], np.maximum(low[row, f], cut))
            cover[row, f] *= tree.share[node]
            on_path[row, f] = True
    return tuple(np.concatenate(c) for c in zip(*kept))


def interaction_rows(model: ChurnModel, users: DataFrame) -> DataFrame:
    """(user_id, feature, other, shap_interaction) of every user and pair, the diagonal included.

    The work per row is leaves x features squared x half the depth.
    """
    spark, width = users.sparkSession, len(model.features)
    names = F.array(*[F.lit(f) for f in model.features])
    zeros = F.array_repeat(F.lit(0.0), width * width)
    rows = users.select("user_id", zeros.alias("pairs"), _matrix(model.features, users).alias("x"))

    def pass_over(trees) -> DataFrame:
        def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    found = interactions(trees.value, np.stack(batch["x"].to_numpy()))
                    yield batch.assign(pairs=list(np.stack(batch["pairs"].to_numpy()) + found.reshape(len(batch), -1)))

        return rows.mapInPandas(explain, "user_id string, pairs array<double>, x array<double>")

    for i, trees in enumerate(tree_groups(saved_nodes(model, spark))):
        rows = cut_lineage(rows, "pairs") if i else rows
        rows = pass_over(spark.sparkContext.broadcast(trees))
    cells = rows.select("user_id", F.posexplode("pairs").alias("cell", "shap_interaction"))
    return cells.select(
        "user_id", F.get(names, F.expr(f"cell div {width}").cast("int")).alias("feature"),
        F.get(names, F.expr(f"cell % {width}").cast("int")).alias("other"), "shap_interaction")


def interaction_summary(rows: DataFrame) -> DataFrame:
    """Mean absolute joint effect of every pair (both sides together), the strongest first."""
    pairs = rows.where("feature < other").groupBy("feature", "other")
    return pairs.agg((2 * F.avg(F.abs("shap_interaction"))).alias("importance")).orderBy(F.desc("importance"), "feature", "other")


def dependence(model: ChurnModel, users: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, bin, low, high, users, mean_shap): how the attribution moves with the value.

    The bins lie between the exact quantiles of a feature over all users; equal values share a bin.
    """
    filled = users.select("user_id", _matrix(model.features, users).alias("x"))
    filled = filled.select("user_id", *[F.col("x")[i].alias(c) for i, c in enumerate(model.features)])
    cuts = quantiles(filled, model.features, [k / bins for k in range(1, bins)])
    edges = small_table(users.sparkSession, [(f, sorted(set(c))) for f, c in cuts.items()], "feature string, cuts array<double>")
    rows = attribution_rows(model, users).join(F.broadcast(edges), "feature")
    place = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    return rows.withColumn("bin", place).groupBy("feature", "bin").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("users"), F.avg("shap_value").alias("mean_shap"))


# ---- F24 -----------------------------------------------------------------------------------------

def driver_labels(domain: str) -> dict[str, str]:
    return {**DRIVER_LABELS, **DOMAIN_DRIVER_LABELS.get(domain, {})}


def label_of(feature: str, labels: dict[str, str]) -> str | None:
    """Readable name: equal key, key + trend, or a rate that contains a key; else any contained key.

    Longer keys are tried first, so the most specific one names the feature.
    """
    plain = feature.lower().replace(" ", "").replace("_", "")
    by_length = sorted(labels, key=len, reverse=True)
    bare = {k: k.lower().replace("_", "") for k in by_length}

    def strong(key: str) -> bool:
        return plain == key or plain.startswith(key + "trend") or (plain.endswith("rate") and key in plain)

    hit = next((k for k in by_length if strong(bare[k])), None)
    if hit is not None:
        label = labels[hit]
        return f"{label} Trend" if "trend" in plain and "trend" not in label.lower() else label
    hit = next((k for k in by_length if bare[k] in plain), None)
    return labels[hit] if hit is not None else None


def drivers(importance: DataFrame, shap: DataFrame | None = None, domain: str = "retail") -> DataFrame:
    """Feature importances with readable names, direction and impact class.

    The list of features is as long as the model is wide, so names are settled on the driver.
    """
    spark = importance.sparkSession
    labels, used, named = driver_labels(domain), set(), []
    for r in importance.orderBy(F.desc("importance"), "feature").collect():
        label = label_of(r["feature"], labels) or r["feature"]
        if label in used:
            label = r["feature"].replace("_", " ").title()
        used.add(label)
        named.append((r["feature"], label, float(r["importance"])))
    rows = small_table(spark, named, "raw_feature string, feature string, importance double")
    if shap is not None:
        signs = shap.select(F.col("feature").alias("raw_feature"), "direction")
        rows = rows.join(F.broadcast(signs), "raw_feature", "left")
    else:
        rows = rows.withColumn("direction", F.lit(None).cast("string"))
    weight = F.col("importance")
    return rows.withColumns(
        {
            "direction": F.coalesce("direction", F.lit("unknown")),
            "impact": F.when(weight > 0.2, "Critical").when(weight > 0.1, "High").when(weight > 0.05, "Medium").otherwise("Low"),
        }
    ).orderBy(F.desc("importance"), "raw_feature")
