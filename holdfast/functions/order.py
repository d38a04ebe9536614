"""Ordering at user scale: prefix sums, exact quantiles, positions and tie-averaged ranks.

Nothing here sorts a whole table in one task. Rows are dealt to buckets that follow the order; the
bucket of a row is a comparison of its keys with cut keys that stand in the plan as literals. So a
recomputed task deals its rows exactly as before, and sums of buckets and sums inside a bucket always
speak of the same rows. Equal values are counted before they are shuffled, so a value that a third of
the rows share is one row of the layout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.session import hold, shuffle_width

#: Rows that one bucket should hold, buckets that a table has at most, and rows sampled per cut.
BUCKET_ROWS = 200_000
MOST_BUCKETS = 2048
SAMPLED_PER_CUT = 40
#: A lookup of so many rows at most is broadcast.
BROADCAST_ROWS = 200_000


def facts(df: DataFrame, **columns: Column) -> Row:
    """Dataset-wide statistics as Python numbers: one aggregate, one row to the driver.

    Callers put them into later plans as literals, so filters on them reach the parquet scan.
    """
    return df.agg(*[c.alias(n) for n, c in columns.items()]).first()


def fits_broadcast(df: DataFrame) -> bool:
    """Counted size check of a lookup. Callers hold `df` first."""
    return df.count() <= BROADCAST_ROWS


def _place(value):
    """Sort key of a Python value in Spark's order: null, numbers, NaN."""
    if value is None:
        return (0, 0)
    if isinstance(value, float) and math.isnan(value):
        return (2, 0)
    return (1, value)


def bucket_of(df: DataFrame, keys: Sequence[str]) -> Column | None:
    """Bucket of a row in the order of `keys`: how many cut keys lie below its own. None if one bucket
    holds all rows, so that there are no offsets to add.

    The cuts are taken from rows whose digest is small, a bounded number per cut, sorted on the
    driver. They only decide how even the buckets are; every row lies in exactly one of them.
    """
    n = df.count()
    wanted = min(MOST_BUCKETS, -(-n // BUCKET_ROWS))
    if wanted <= 1:
        return None
    share = min(1.0, 2 * SAMPLED_PER_CUT * wanted / n)
    turn = F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(1 << 20))
    seen = df.where(turn < math.ceil(share * (1 << 20))).select(*keys).limit(8 * SAMPLED_PER_CUT * wanted).collect()
    seen = sorted(seen, key=lambda r: [_place(v) for v in r])
    kinds = [df.schema[k].dataType for k in keys]
    cuts = list(dict.fromkeys(tuple(seen[len(seen) * i // wanted]) for i in range(1, wanted))) if seen else []
    if not cuts:
        return None
    rows = [F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(cut, kinds, keys)]) for cut in cuts]
    return cuts_below(F.struct(*[F.col(k) for k in keys]), rows)


def cuts_below(own: Column, cuts: Sequence[Column]) -> Column:
    """How many of the ascending, literal `cuts` lie below `own`, in two steps of about their root.

    Every width-th cut is compared first; only the cuts between two of them are compared after.
    """
    width = math.isqrt(len(cuts)) + 1
    groups = [list(cuts[i : i + width]) for i in range(0, len(cuts), width)]
    if len(groups) == 1:
        return F.size(F.filter(F.array(*cuts), lambda c: c < own))
    # a group is passed when its last cut lies below the value
    passed = F.size(F.filter(F.array(*[g[-1] for g in groups[:-1]]), lambda c: c < own))
    inside = F.element_at(F.array(*[F.array(*g) for g in groups]), passed + 1)
    return passed * width + F.size(F.filter(inside, lambda c: c < own))


def running_totals(
    hist: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add `cum_<s>` (inclusive running sum by `order`) and `tot_<s>` per `by` group.

    `hist` has one row per (by, order). The offsets table has at most one row per bucket plus one
    per group, which is what makes its broadcast safe.
    """
    by = list(by)
    hist = hold(hist)
    bucket = bucket_of(hist, [*by, order])
    if bucket is None:
        return whole_totals(hist, order, sums, by)
    laid = hist.withColumn("_part", bucket)
    pieces = laid.groupBy("_part", *by).agg(*[F.sum(s).alias(s) for s in sums])
    group = W.partitionBy(*by) if by else W.partitionBy()
    before = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(
        "_part",
        *by,
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"tot_{s}") for s in sums],
    )
    inside = W.partitionBy("_part", *by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = laid.select("*", *[F.sum(s).over(inside).alias(f"_run_{s}") for s in sums])
    joined = local.join(F.broadcast(offsets), ["_part", *by])
    return joined.select(
        *hist.columns,
        *[(F.col(f"_run_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"tot_{s}" for s in sums],
    )


def whole_totals(
    hist: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """The columns of `running_totals` through one window per group: for rows of one bucket, or at most
    one per calendar day."""
    group = W.partitionBy(*by)
    upto = group.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return hist.select(
        "*",
        *[F.sum(s).over(upto).alias(f"cum_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"tot_{s}") for s in sums],
    )


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) without NULLs; every column cast to double."""
    return (
        df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
        .unpivot(list(keep), list(cols), "feature", "value")
        .where("value is not null")
    )


def value_histogram(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return long_form(df, cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(feature, total, distinct, q): exact, linearly interpolated quantiles of each column."""
    return quantiles_of(running_totals(value_histogram(df, cols), "value", ["n"], by=["feature"]), probs)


def quantiles_of(run: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The quantiles of a histogram with running totals."""
    picks, made = [], []
    for i, p in enumerate(probs):
        for side, edge in (("lo", "floor"), ("hi", "ceil")):
            place = f"{edge}((tot_n - 1) * {p}D)"
            hit = f"cum_n - n <= {place} and {place} < cum_n"
            picks.append(F.expr(f"max(case when {hit} then value end)").alias(f"{side}{i}"))
        place = f"(total - 1) * {p}D"
        made.append(f"lo{i} + (hi{i} - lo{i}) * ({place} - floor({place}))")
    picked = run.groupBy("feature").agg(F.max("tot_n").alias("total"), F.count(F.lit(1)).alias("distinct"), *picks)
    return picked.select("feature", "total", "distinct", F.expr(f"array({', '.join(made)})").alias("q"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """feature -> quantiles, one short row per column fetched. NULL-only columns are absent."""
    return {r["feature"]: list(r["q"]) for r in quantile_table(df, cols, probs).collect()}


def quantile(df: DataFrame, col: str, p: float) -> float | None:
    return quantiles(df, [col], [p]).get(col, [None])[0]


def positions(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add `_pos` (0-based position by `keys` within each `by` group) and `_size` of the group.

    `keys` should end in a unique column: that also splits a run of equal leading values over
    buckets.
    """
    by = list(by)
    df = hold(df)
    group = W.partitionBy(*by)
    bucket = bucket_of(df, [*by, *keys])
    if bucket is None:
        at = (F.row_number().over(group.orderBy(*keys)) - 1).cast("bigint")
        return df.withColumns({"_pos": at, "_size": F.count(F.lit(1)).over(group)})
    laid = df.withColumn("_part", bucket)
    sizes = laid.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(group).alias("_size")
    )
    inside = F.row_number().over(W.partitionBy("_part", *by).orderBy(*keys)).cast("bigint")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["_part", *by]]
    joined = laid.withColumn("_row", inside).alias("l").join(F.broadcast(offsets.alias("r")), same)
    return joined.select(*[f"l.{c}" for c in df.columns], (F.col("_row") - 1 + F.col("_off")).alias("_pos"), "_size")


def global_rank(df: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank of every row in the total order given by `keys` (the last one unique)."""
    return positions(df, keys).withColumn(name, F.col("_pos") + 1).drop("_pos", "_size")


def value_ranks(df: DataFrame, col: str) -> DataFrame:
    """One row per distinct value: rows, average rank of its ties, total rows."""
    hist = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(hist, col, ["n"])
    return run.select(
        col,
        "n",
        (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("avg_rank"),
        F.col("tot_n").alias("total"),
    )


def salted_lookup(
    df: DataFrame, lookup: DataFrame, key: str, weight: str, spread: str | Sequence[str], how: str = "inner",
    rows: int | None = None,
) -> DataFrame:
    """Join `lookup` (one row per key, `weight` = rows that hold the key) without a hot partition.

    A lookup of a counted size is broadcast. Beyond it a key with more than 1/width of all
    rows is dealt over several salts: there are fewer than `width` such keys, so the list of them is
    broadcast, and their lookup rows are copied per salt. The salt is a digest of the `spread`
    columns, so rows that agree in one of them still part. Callers hold `lookup`; `rows` is its size
    where it is known.
    """
    spread = [spread] if isinstance(spread, str) else list(spread)
    if rows <= BROADCAST_ROWS if rows is not None else fits_broadcast(lookup):
        return df.join(F.broadcast(lookup.drop(weight)), key, how)
    width = shuffle_width(df.sparkSession)
    total = facts(lookup, total=F.sum(weight))["total"] or 1
    share = F.col(weight) * F.lit(width)
    ways = F.when(share > total, F.ceil(share / F.lit(total))).otherwise(F.lit(1)).cast("int")
    sized = lookup.withColumn("_ways", ways)
    hot = sized.where("_ways > 1").select(key, "_ways")
    dealt = df.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.coalesce("_ways", F.lit(1)).cast("bigint")).cast("int")
    )
    copies = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1)))
    joined = dealt.drop("_ways").join(copies.drop("_ways", weight), [key, "_salt"], how)
    return joined.drop("_salt")


def pct_rank(df: DataFrame, col: str, name: str, spread: str = "user_id") -> DataFrame:
    """Average-tie percentile rank (rank / n) of a continuous column; null values have no rank."""
    ranks = value_ranks(df, col).withColumn(name, F.col("avg_rank") / F.col("total"))
    return salted_lookup(df, hold(ranks.select(col, "n", name)), col, "n", spread, how="left")


def pct_rank_days(df: DataFrame, col: str, name: str) -> DataFrame:
    """`pct_rank` for whole-day columns: one lookup row per calendar day, so it is broadcast."""
    hist = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ranks = whole_totals(hist, col, ["n"]).select(
        col, ((F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2) / F.col("tot_n")).alias(name)
    )
    return df.join(F.broadcast(ranks), col, "left")


def _clipped(cols: Sequence[str], caps: dict[str, float]) -> dict[str, Column]:
    return {c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(caps[c])) for c in cols if c in caps}


def winsorise(
    df: DataFrame, cols: Sequence[str], q: float = 0.99, measured: DataFrame | None = None
) -> DataFrame:
    """Clip to [0, q-quantile]; the quantile of `measured` when given (same rows, already held)."""
    found = quantiles(df if measured is None else measured, cols, [q])
    return df.withColumns(_clipped(cols, {c: v[0] for c, v in found.items()}))


def ranked_and_clipped(
    df: DataFrame, col: str, name: str, clip: Sequence[str], q: float = 0.99, spread: str = "user_id"
) -> DataFrame:
    """`pct_rank` of `col` and `winsorise` of the `clip` columns, by one histogram of all of them.

    Callers hold `df`; `col` is a double and none of the `clip` columns.
    """
    run = running_totals(value_histogram(df, [col, *clip]), "value", ["n"], by=["feature"])
    seen = {r["feature"]: r for r in quantiles_of(run, [q]).collect()}  # a row per column
    share = (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2) / F.col("tot_n")
    ranks = run.where(F.col("feature") == col).select(F.col("value").alias(col), "n", share.alias(name))
    size = seen[col]["distinct"] if col in seen else 0
    ranked = salted_lookup(df, hold(ranks), col, "n", spread, "left", size)
    return ranked.withColumns(_clipped(clip, {c: r["q"][0] for c, r in seen.items()}))


def dealt_order(key: str = "user_id", seed: int = 42) -> Column:
    """Deterministic shuffling order of users: the digest of the id and a seed."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


#: Leading hexadecimal digits of a digest by which users are counted before any are sorted.
PREFIX_DIGITS = 3


def _digests_at(users: DataFrame, wanted: Callable[[int], list[int]], groups: list[str], digest: Column) -> dict:
    """(group, position) -> digest, for the asked positions of every group in the dealt order.

    `wanted` gives the positions from the size of a group. One aggregate counts digests by their first
    digits (4096 counts per group), a second look sorts only those with the digits in question.
    """
    dealt = users.select(*groups, digest.alias("_d")).withColumn("_p", F.substring("_d", 1, PREFIX_DIGITS))
    counts: dict = {}
    for r in dealt.groupBy(*groups, "_p").count().orderBy("_p").collect():
        counts.setdefault(r[groups[0]] if groups else None, []).append((r["_p"], r["count"]))
    asked: dict = {}
    for key, parts in counts.items():
        for at in wanted(sum(n for _, n in parts)):
            before = 0
            for prefix, n in parts:
                if before <= at < before + n:
                    asked[key, at] = (prefix, at - before)
                    break
                before += n
    sizes = {key: sum(n for _, n in parts) for key, parts in counts.items()}
    if not asked:
        return {"sizes": sizes}
    place = F.row_number().over(W.partitionBy(*groups, "_p").orderBy("_d")) - 1
    near = dealt.where(F.col("_p").isin(sorted({p for p, _ in asked.values()}))).withColumn("_at", place)
    near = near.where(F.col("_at").isin(sorted({i for _, i in asked.values()}))).collect()
    found = {(r[groups[0]] if groups else None, r["_p"], r["_at"]): r["_d"] for r in near}
    return {"sizes": sizes} | {(key, at): found[key, *spot] for (key, at), spot in asked.items()}


def draw(users: DataFrame, size: int, seed: int = 42) -> str | None:
    """Digest of the last of `size` users drawn without replacement; None when all are drawn.

    A row belongs to the draw when its user's digest is not above it, so no join is needed.
    """
    if size < 1:
        return ""
    return _digests_at(users, lambda n: [size - 1], [], dealt_order("user_id", seed)).get((None, size - 1))


def dealt_cuts(
    users: DataFrame, ends: Sequence[tuple[int, int]], by: str | None = None, seed: int = 42
) -> dict:
    """Digests that end the given shares of the dealt order, per `by` group.

    `ends` are shares as (numerator, denominator); a group maps to one digest per share, "" for an
    empty one. A handful of rows reach the driver, and the parts are told by comparing digests, so
    nothing has to be joined back to the users.
    """

    def last(size: int) -> list[int]:
        # the last position p with p * denominator < size * numerator
        return [-(-size * top // bottom) - 1 for top, bottom in ends]

    found = _digests_at(users, last, [by] if by else [], dealt_order("user_id", seed))
    return {key: [found.get((key, at), "") for at in last(size)] for key, size in found["sizes"].items()}


def dealt_part(cuts: dict, names: Sequence, by: str | None = None, seed: int = 42) -> Column:
    """The part of the dealt order a user falls into: one name more than there are cuts."""
    digest = dealt_order("user_id", seed)
    out = F.lit(names[-1])
    for key, ends in cuts.items():
        part = F.lit(names[-1])
        for end, name in reversed(list(zip(ends, names))):
            part = F.when(digest <= F.lit(end), F.lit(name)).otherwise(part)
        out = part if by is None else F.when(F.col(by) == F.lit(key), part).otherwise(out)
    return out
