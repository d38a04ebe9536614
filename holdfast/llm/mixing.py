"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import free_name
from holdfast.session import cut_lineage, shuffle_width

#: Weights of the sources in the mixture, relative to each other; any other source has DEFAULT.
WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 0.5, "src3": 1.5}
DEFAULT = 1.0
SEED = 20_250_301
#: Draws with a larger mean are sums of independent draws with means up to this, far from underflow.
LARGEST_MEAN = 200.0
#: Rates of up to so many sources are broadcast; beyond it rows meet them by a salted join.
BROADCAST_SOURCES = 100_000
SALTS = 32


def uniform(seed: Column, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 digest."""
    text = F.concat_ws(":", seed, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson(mean: Column, draw: Column) -> Column:
    """The count whose cumulative probability first exceeds the draw.

    Terms are summed up to where the tail is below the resolution of the draw.
    """
    most = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), (F.exp(-mean) <= draw).cast("int").alias("n"))

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["n"] + (s["c"] + p <= draw).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), most), start, add, lambda s: s["n"])


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float], default: float, total: float | None) -> DataFrame:
    """(source, mean): the target repetition rate of every source that occurs.

    A source's share of the mixture is its weight over the sum of the weights of all sources that
    occur; its rate is its share of `total` rows (by default the rows of the table) over its own.
    """
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    weight = F.lit(float(default))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    counts = cut_lineage(counts.withColumn("weight", weight), "sources")
    sums = counts.agg(F.sum("weight"), F.sum("n")).first()
    if not sums[0]:
        return counts.select("source", F.lit(0.0).alias("mean"))
    goal = float(sums[1] if total is None else total)
    return counts.select("source", (F.col("weight") / F.lit(float(sums[0])) * F.lit(goal) / F.col("n")).alias("mean"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default: float = DEFAULT,
    total: float | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The mixture: every document as often as its draw says, in globally shuffled order.

    Adds `copy` (from 1) and `mix_key` (the shuffle key, a 52-bit number); columns of these names are
    replaced. The count of a document inverts the Poisson distribution with its source's mean rate at
    a uniform number from the seed and the id, so the same seed gives the same mixture whatever the
    partitions. Shares of rows meet the weights in expectation, with the relative deviation of one
    over the square root of the expected rows. Keys of single copies are independent; ranges of the
    key are the partitions, sorted inside, so the files follow one global order.

    A null source counts as the source ''. A source of weight 0 has no copies. Null ids draw like the
    id ''; rows that repeat an id draw alike. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    rates = source_rates(docs, source_col, WEIGHTS if weights is None else weights, default, total)
    from_col, mean, salt, place = (free_name(docs, c) for c in ("_from", "_mean", "_salt", "_place"))
    rates = rates.select(F.col("source").alias(from_col), F.col("mean").alias(mean))
    rows = docs.withColumn(from_col, F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    if rates.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), from_col)
    else:
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        rows = rows.join(rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [from_col, salt])
    key, own = F.lit(str(seed)), F.col(id_col)
    parts = F.greatest(F.lit(1), F.ceil(F.col(mean) / LARGEST_MEAN).cast("int"))
    counts = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson(F.col(mean) / parts, uniform(key, own, j)))
    count = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    # A sequence down to 0 would run backwards: no copies is an empty array, which explodes to no row.
    runs = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*names, F.explode(runs).alias("copy"))
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit("turn"), F.coalesce(own.cast("string"), F.lit("")), F.col("copy"))), 1, 13), 16, 10)
    rows = rows.withColumn("mix_key", turn.cast("long"))
    width = shuffle_width(docs.sparkSession)
    rows = rows.repartitionById(width, F.expr(f"cast(mix_key div {2**52 // width + 1} as int)"))
    return rows.sortWithinPartitions("mix_key")
