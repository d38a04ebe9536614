"""Nearest neighbours by several shifted Hilbert orders of projected vectors, certified by exact bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.session import cut_lineage, shuffle_width

#: Orders, axes of each projection and bits of each axis (axes times bits at most 64).
ORDERS, AXES, BITS = 4, 16, 4
#: Rows of a key window; a query is compared with its own window and both neighbours of each order.
WINDOW = 512
#: Bytes of the queries, in double precision, that go to the tasks together in the last pass.
QUERY_BYTES = 1 << 26
#: Rows that travel to a task at once.
ARROW_ROWS = 2048
#: Distances that a task holds at once.
DISTANCES = 1 << 22
#: Vectors that the middle and the spread of the projections are taken from.
SAMPLE_ROWS = 5000
SALTS = 32
SEED = 11


def usable(name: str):
    """No null, no zero vector, no null or non-finite component."""
    v = F.col(name)
    # NaN sorts above every number, so one comparison rules out NaN and both infinities.
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= F.lit(1.7976931348623157e308)))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _vector(vectors: DataFrame, name: str) -> Column:
    """The vector column; single precision stays as it is and is widened where distances are taken."""
    kind = vectors.schema[name].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(name) if single else F.col(name).cast("array<double>")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of axis numbers below 2**bits.

    The axes are turned into the transposed form of the index bit by bit from the highest (exchange
    or inversion of the lower bits, then Gray decoding), whose bits are then interleaved.
    """
    x = cells.astype(np.uint32).copy()
    axes = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        high, low = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(axes):
            inverted = (x[:, i] & high) != 0
            swapped = np.where(inverted, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inverted, low, swapped)
            x[:, i] ^= swapped
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] & np.uint32(1 << bit)) != 0, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint32(bit)) & np.uint32(1)).astype(np.uint64)
    return key


class Curve:
    """Projection, scale and shift of one order, from a sample of vectors and the order's number."""

    def __init__(self, sample: np.ndarray, number: int, seed: int = SEED):
        rng = np.random.default_rng([seed, number])
        width = sample.shape[1]
        axes = min(AXES, width)
        self.middle = sample.mean(axis=0)
        self.turn = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :axes]
        spread = ((sample - self.middle) @ self.turn).std(axis=0)
        self.scale = np.where(spread > 0, spread, 1.0) * 3
        self.shift = rng.uniform(-0.125, 0.125, size=axes)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        placed = ((vectors - self.middle) @ self.turn / self.scale + 1) / 2 + self.shift
        cells = np.clip(np.nan_to_num(placed) * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert_keys(cells, BITS)


def _classes(vectors: DataFrame, id_col: str, vec_col: str, every: int, most: int) -> DataFrame:
    """One row per distinct vector: its smallest id, its `most` smallest ids, whether it is asked for.

    Rows of one vector are dealt over salts first. The other ids of a vector are at the same
    distance from everything and larger, so no list of fewer than `most` neighbours can hold them.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), _vector(vectors, vec_col).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable("vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.filter(F.size("vector") == (sizes[0] if sizes else 0)).distinct()
    rows = rows.withColumn("asked", (F.col("id") % every == 0).cast("int")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("vector", "salt").orderBy("id"))
    asked = F.max("asked").over(Window.partitionBy("vector", "salt"))
    rows = rows.withColumn("place", place).withColumn("asked", asked).filter(F.col("place") <= most)
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    asked = F.max("asked").over(Window.partitionBy("vector"))
    rows = rows.withColumn("place", place).withColumn("asked", asked).filter(F.col("place") <= most)
    members = F.array_sort(F.collect_list("id")).alias("members")
    return rows.groupBy("vector").agg(F.min("id").alias("id"), members, F.max("asked").alias("asked"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column in double precision, one a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _laid(classes: DataFrame, curves: list[Curve]) -> DataFrame:
    """Every class once per curve, in the order of that curve: (turn, key, vector, id, asked)."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(curves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column(0))
            for turn, curve in enumerate(shared.value):
                keys = (curve.keys(matrix) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), turn, dtype=np.int32)), pa.array(keys), *batch.columns], names=["turn", "key", "vector", "id", "asked"])

    kind = f"turn int, key long, vector {classes.schema['vector'].dataType.simpleString()}, id long, asked int"
    rows = classes.select("vector", "id", "asked").mapInArrow(run, kind)
    return rows.repartitionByRange(shuffle_width(spark), "turn", "key", "id").sortWithinPartitions("turn", "key", "id")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(turn, vectors, ids, asked) of WINDOW consecutive rows of one curve."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        turns = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, turns[1:] != turns[:-1], True])
        for start, end in zip(cuts, cuts[1:]):
            at = start
            while at < end:
                if held and held[0][0] != turns[at]:
                    yield _joined(held)
                    held, size = [], 0
                part = batch.slice(at, min(end - at, WINDOW - size))
                held.append((int(turns[at]), _matrix(part.column(2)), part.column(3).to_numpy(), part.column(4).to_numpy()))
                size, at = size + part.num_rows, at + part.num_rows
                if size == WINDOW:
                    yield _joined(held)
                    held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    return held[0][0], *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))


def _nearest_in(base: np.ndarray, own: np.ndarray, asks: np.ndarray, most: int, bounds: np.ndarray) -> Iterator[tuple]:
    """(query, places, distances) of the `most` nearest rows of `base` within the bound of each query that has any.

    Products of matrices, in single precision where numbers are small enough, leave out rows that are
    surely too far, by more than their rounding; the distances of the others are sums of squared
    differences. Ties go to the smaller id in `own`.
    """
    middle = base.mean(axis=0)
    moved, norms = base - middle, ((base - middle) ** 2).sum(axis=1)
    step = max(1, DISTANCES // len(base))
    for i in range(0, len(asks), step):
        turned = asks[i : i + step] - middle
        lengths = (turned**2).sum(axis=1)
        size = lengths + norms.max()
        single = size.max() < 1e30
        slack = ((base.shape[1] + 8) * 3e-7 if single else 1e-9) * size
        last = bounds[i : i + step] ** 2
        if not np.isfinite(bounds[i : i + step]).all() and len(base) > most:
            far = norms + lengths[:, None] - 2 * (turned @ moved.T)
            last = np.minimum(last, np.partition(far, most - 1, axis=1)[:, most - 1])
        sure = np.isfinite(slack) & ~np.isnan(last)
        # |a - b|^2 = |a|^2 + |b|^2 - 2ab is in the bound where ab - |b|^2 / 2 is large enough
        kind = np.float32 if single else np.float64
        sides = np.c_[turned, np.ones(len(turned))].astype(kind), np.c_[moved, -norms / 2].astype(kind)
        least = np.where(sure, (lengths - last) / 2 - 2 * slack, -np.inf)
        near = sides[0] @ sides[1].T >= least.astype(kind)[:, None]
        near[~sure] = True
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            some = np.flatnonzero(near[k])
            distance = np.sqrt(((base[some] - asks[i + k]) ** 2).sum(axis=1))
            some, distance = some[distance <= bounds[i + k]], distance[distance <= bounds[i + k]]
            first = np.lexsort((own[some], distance))[:most]
            yield i + k, some[first], distance[first]


_PAIRS = "query long, point long, score double"


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(query, points, distances) of several queries as pairs."""
    sizes = [len(points) for _, points, _ in rows]
    query = np.repeat(np.array([q for q, _, _ in rows], dtype=np.int64), sizes)
    points = np.concatenate([np.zeros(0, dtype=np.int64), *(p for _, p, _ in rows)])
    scores = np.concatenate([np.zeros(0), *(s for _, _, s in rows)])
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(points), pa.array(scores)], names=["query", "point", "score"])


def met_in_windows(classes: DataFrame, curves: list[Curve], most: int) -> DataFrame:
    """(query, point, score): the `most` nearest points of every query among its window and the two
    beside it, of every order, each pair once. A window beside a part's edge is met in other orders."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = None, None
        for after in _ended(_windows(batches)):
            if now is not None and now[3].any():
                near = [w for w in (before, now, after) if w is not None and w[0] == now[0]]
                base, own = (np.concatenate([w[i] for w in near]) for i in (1, 2))
                asks = np.flatnonzero(now[3])
                some = _nearest_in(base, own, now[1][asks], most, np.full(len(asks), np.inf))
                yield _found([(now[2][asks[q]], own[at], distance) for q, at, distance in some])
            before, now = now, after

    met = _laid(classes, curves).mapInArrow(look, _PAIRS)
    return met.groupBy("query", "point").agg(F.min("score").alias("score"))


def nearest(
    vectors: DataFrame, every: int = 100, count: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED
) -> DataFrame:
    """The `count` nearest rows of every row whose id is divisible by `every`.

    Columns query_id, rank (from 1), the id column, score: the Euclidean distance in double precision
    on the original vectors; ties go to the smaller id. Equal vectors are one point of the order and
    come back as their ids.

    The vectors are laid out along ORDERS Hilbert curves of different projections and shifts. In each
    order a query is compared with the rows of its key window and the two beside it; the answers of
    all orders are merged by true distance. The last distance wanted then bounds the true one, and a
    last pass over one order makes the result exact at every size: a window is passed over where its
    middle and radius put all its points beyond the bound, else its rows within the bound are taken.
    Where vectors form clusters most windows are passed over; where dimensions are independent none
    are, and this pass compares all queries with all rows (README has figures). It runs once per
    QUERY_BYTES of queries; tasks hold a window and a block of queries, and give back pairs in the bound only.

    Null ids, unusable vectors (`usable`) and vectors of another length than most take no part. Rows
    that repeat id and vector count once. Fewer candidates than `count` give fewer rows, an empty
    table none.
    """
    spark = vectors.sparkSession
    classes = cut_lineage(_classes(vectors, id_col, vec_col, every, count + 1), "points")
    sample = classes.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("vector").toPandas()["vector"]
    out = f"query_id long, rank int, {id_col} long, score double"
    if not len(sample):
        return spark.createDataFrame([], out)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    curves = [Curve(np.stack(sample.to_list()).astype(float), number, seed) for number in range(ORDERS)]

    met = met_in_windows(classes, curves, count + 1)
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))
    bounds = met.withColumn("place", place).filter(F.col("place") == count + 1).select(F.col("query").alias("id"), F.col("score").alias("bound"))
    asks = classes.filter("asked = 1").select("id", "vector").join(bounds, "id", "left")
    asks = cut_lineage(asks.withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "bounds")

    one_order = cut_lineage(_laid(classes, curves[:1]), "order")
    parts = []
    for block in _query_blocks(asks, max(1, QUERY_BYTES // (8 * len(sample[0])))):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """Rows within the bound of a query, of the windows that may hold one."""
            ids, asked, bound = shared.value
            for _, base, own, _ in _windows(batches):
                middle = base.mean(axis=0)
                radius = np.sqrt(((base - middle) ** 2).sum(axis=1)).max()
                away = np.sqrt(((asked - middle) ** 2).sum(axis=1))
                beyond = away - radius > bound + 1e-9 * (away + radius)  # false for what is not a number
                some = np.flatnonzero(~beyond)
                if len(some):
                    yield _found([(ids[some[q]], own[near], distance)
                                  for q, near, distance in _nearest_in(base, own, asked[some], count + 1, bound[some])])

        parts.append(cut_lineage(one_order.mapInArrow(search, _PAIRS), "near"))
    if not parts:
        return spark.createDataFrame([], out)
    found = reduce(DataFrame.unionByName, parts)

    first = F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))
    found = found.withColumn("place", first).filter(F.col("place") <= count + 1)
    found = found.join(classes.select(F.col("id").alias("point"), "members"), "point")
    found = found.select("query", "score", F.explode("members").alias("id"))
    first = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    found = found.withColumn("place", first).filter(F.col("place") <= count + 1).select("query", "score", "id")

    asked = vectors.select(F.col(id_col).cast("long").alias("query_id"), _vector(vectors, vec_col).alias("vector"))
    asked = asked.filter((F.col("query_id") % every == 0) & usable("vector")).distinct()
    asked = asked.join(classes.filter("asked = 1").select("vector", F.col("id").alias("query")), "vector")
    answers = asked.select("query_id", "query").join(found, "query").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    answers = answers.withColumn("rank", rank).filter(F.col("rank") <= count)
    return answers.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _ended(windows: Iterator[tuple]) -> Iterator[tuple | None]:
    """The windows and, behind the last, None."""
    yield from windows
    yield None


def _query_blocks(asks: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, bounds) of at most `most` queries at a time; one block is on the driver."""
    held: list = []
    for r in asks.select("id", "vector", "bound").toLocalIterator():
        held.append((r["id"], r["vector"], r["bound"]))
        if len(held) == most:
            yield tuple(np.array(c, dtype=kind) for c, kind in zip(zip(*held), (np.int64, float, float)))
            held = []
    if held:
        yield tuple(np.array(c, dtype=kind) for c, kind in zip(zip(*held), (np.int64, float, float)))
