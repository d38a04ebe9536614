"""Reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import whole_text
from holdfast.session import cut_lineage

#: Rows are numbered within ranges of their digest, each sorted by one task: so many ranges at least,
#: and so many rows to a range beyond them.
LEAST_BUCKETS, BUCKET_ROWS = 64, 250_000
ROUNDS = 6
SEED = 20_240_229
#: Odd multipliers of the round function, below 2**31 so that products stay below 2**63.
FACTORS = (1_640_531_527, 1_103_515_245, 1_566_083_941, 1_812_433_253, 1_181_783_497, 1_765_455_671)


def sides(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square rectangle with a * b >= n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round_key(i: int, seed: int) -> int:
    return (seed * 31 + (i + 1) * 7_919) % 1_000_003


PRIME = 2_147_483_647


def _permuted_once(rows: np.ndarray, a: int, b: int, seed: int) -> np.ndarray:
    """One pass of the Feistel rounds over numbers below a * b: the sides are moved in turn."""
    left, low = rows // b, rows % b
    for i in range(ROUNDS):
        y = ((left if i % 2 else low) + _round_key(i, seed)) * FACTORS[i]
        y = (y ^ (y >> 17)) % PRIME * FACTORS[i - 1]
        y = (y ^ (y >> 13)) % PRIME
        if i % 2:
            low = (low + y) % b
        else:
            left = (left + y) % a
    return left * b + low


def permuted_array(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The permutation on numpy numbers, with cycle walking."""
    a, b = sides(n)
    out = _permuted_once(rows.astype(np.int64), a, b, seed)
    while (far := out >= n).any():
        out[far] = _permuted_once(out[far], a, b, seed)
    return out


def walk_length(n: int, seed: int = SEED) -> int:
    """Passes of the longest walk: fewer numbers than the shorter side lie outside, all are followed."""
    a, b = sides(n)
    at, most = np.arange(n, a * b, dtype=np.int64), 1
    while len(at):
        at = _permuted_once(at, a, b, seed)
        at, most = at[at >= n], most + 1
    return most


def _pass(df: DataFrame, place: str, a: int, b: int, seed: int) -> DataFrame:
    """One pass of the rounds as plain projections, each value computed once."""
    df = df.withColumn("_low", F.col(place) % b)
    df = df.withColumn("_left", ((F.col(place) - F.col("_low")) / b).cast("long"))
    for i in range(ROUNDS):
        source, moved, side = ("_left", "_low", b) if i % 2 else ("_low", "_left", a)
        df = df.withColumn("_y", (F.col(source) + _round_key(i, seed)) * F.lit(FACTORS[i]))
        df = df.withColumn("_y", F.col("_y").bitwiseXOR(F.shiftright("_y", 17)) % PRIME * F.lit(FACTORS[i - 1]))
        df = df.withColumn("_y", F.col("_y").bitwiseXOR(F.shiftright("_y", 13)) % PRIME)
        df = df.withColumn(moved, (F.col(moved) + F.col("_y")) % side)
    return df.withColumn("_next", F.col("_left") * b + F.col("_low"))


def permuted(df: DataFrame, row: str, place: str, n: int, seed: int = SEED) -> DataFrame:
    """The table with `place`, the place in 0..n-1 of every row number under the permutation.

    The rectangle exceeds n by less than its shorter side; a number that lands outside walks on. The
    longest walk is known from n and the seed, so the passes written into the plan suffice for all.
    """
    a, b = sides(n)
    names = df.columns
    df = _pass(df, row, a, b, seed).withColumn(place, F.col("_next"))
    for _ in range(walk_length(n, seed) - 1):
        df = _pass(df, place, a, b, seed)
        df = df.withColumn(place, F.when(F.col(place) >= n, F.col("_next")).otherwise(F.col(place)))
    return df.select(*names, place)


def buckets_for(n: int) -> int:
    """Ranges for a table of n rows: a function of n alone, so that the numbers do not depend on the cluster."""
    return LEAST_BUCKETS + n // BUCKET_ROWS


def row_numbers(rows: DataFrame, order: list[str], buckets: int, name: str = "row_number") -> DataFrame:
    """The table with a gapless number from 0 in `name`, written to the shared folder.

    Rows are dealt to ranges of a digest of the `order` columns, a pure function of the row, so a
    recomputed task deals them alike. Fully equal rows are counted first and numbered as one run.
    `buckets` (at most 2**24) comes from the number of rows, see `buckets_for`.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("_times"))
    digest = F.xxhash64(*order)
    counted = counted.withColumns({"_digest": digest, "_bucket": F.pmod(F.shiftrightunsigned(digest, 40), F.lit(buckets)).cast("int")})
    window = Window.partitionBy("_bucket").orderBy("_digest", *names)
    counted = counted.withColumn("_until", F.sum("_times").over(window))
    counted = cut_lineage(counted, "numbered")
    totals = counted.groupBy("_bucket").agg(F.sum("_times").alias("_sum"))
    # One row per bucket: one for 250 000 rows of the table, 400 000 of 16 bytes at 1e11 rows.
    before = F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")
    starts = totals.select("_bucket", before.alias("_start"))
    placed = counted.join(F.broadcast(starts), "_bucket")
    last = F.col("_start") + F.col("_until") - 1
    run = F.sequence(last - F.col("_times") + 1, last)
    return placed.select(*names, F.explode(run).alias(name))


def shards(
    docs: DataFrame, count: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    Law `rows`: the permuted row number p has shard p mod count and slot p div count, so the shard
    counts are at most one apart and slots are gapless from 0. Anyone who knows the number of rows
    and the seed can compute both from a row number (`permuted_array`). The split is by rows, so
    equal texts are not kept together: a text may fill a third of the table and no shard could hold
    it. `grown_shard` is null under this law.

    size is the UTF-8 length plus 1; a null text counts as none. Repeated rows each get a slot, null
    ids are dealt like others. An empty table gives an empty result.
    """
    text = whole_text(text_col)
    # The digest of the text keeps apart rows that share an id, so the numbering has no ties but equal rows.
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("_size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("_crc"), F.xxhash64(text).alias("_text"))
    n = max(1, docs.count())
    numbered = row_numbers(rows, ["_id", "_text"], buckets_for(n))
    out = permuted(numbered, "row_number", "_place", n, seed)
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"), F.pmod(F.col("_place"), F.lit(count)).cast("int").alias("shard"),
        F.expr(f"_place div {int(count)}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
