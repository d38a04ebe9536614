"""Mixing and sharding: exact counts, gapless slots, reproducible draws."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import mixing, sharding


def draw(seed, doc, j):
    text = f"{seed}:{'' if doc is None else doc}:{j}"
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def inverted(mean, u):
    p = c = math.exp(-mean)
    n = k = 0
    while c <= u and k < 10_000:
        n, k = n + 1, k + 1
        p = p * mean / k
        c += p
    return n


def test_counts_invert_the_distribution(spark):
    rows = [(i, "a" if i % 3 else "b", "x") for i in range(300)] + [(None, None, "y"), (5, "a", "x"), (5, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copy", F.lit("old")).withColumn("_mean", F.lit(0))
    got = mixing.mix_sources(df, {"a": 1.0, "b": 3.0}, 0.5, total=900)
    sizes = Counter(s or "" for _, s, _ in rows)
    weights = {"a": 1.0, "b": 3.0, "": 0.5}
    means = {s: weights[s] / 4.5 * 900 / n for s, n in sizes.items()}
    want = Counter()
    for i, s, _ in rows:
        want[i] += inverted(means[s or ""], draw(mixing.SEED, i, 1))
    have = Counter(r.doc_id for r in got.collect())
    assert {k: v for k, v in want.items() if v} == dict(have)
    assert set(got.columns) == {"doc_id", "source", "text", "_mean", "copy", "mix_key"}


def test_shares_meet_the_weights_and_order_is_global(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("rare").alias("source"))
    got = mixing.mix_sources(df, {"hot": 1.0, "rare": 1.0}).withColumn("part", F.spark_partition_id())
    assert got.filter("source = 'hot'").count() == pytest.approx(30_000, abs=4 * 30_000**0.5)
    edges = sorted(got.groupBy("part").agg(F.min("mix_key"), F.max("mix_key")).collect())
    assert all(a[2] <= b[1] for a, b in zip(edges, edges[1:])) and len(edges) > 1
    again = mixing.mix_sources(df.repartition(7), {"hot": 1.0, "rare": 1.0})
    assert got.drop("part").exceptAll(again).count() == 0


def test_large_means_zero_weights_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    got = Counter(r.source for r in mixing.mix_sources(df, {"a": 1.0, "b": 0.0}, total=5000).collect())
    assert set(got) == {"a"} and got["a"] == pytest.approx(5000, abs=5 * 5000**0.5)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(df, {"a": 0.0, "b": 0.0}).count() == 0


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 50).cast("string").alias("source"))
    plain = mixing.mix_sources(df)
    want = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert sorted(map(tuple, mixing.mix_sources(df).collect())) == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 1000, 4099])
def test_permutation_reaches_every_place_once(n):
    assert sorted(sharding.permuted_array(np.arange(n), n)) == list(range(n))


def test_columns_and_numpy_permute_alike(spark):
    for n in (3, 1000):
        got = [r.p for r in sharding.permuted(spark.range(n), "id", "p", n).orderBy("id").collect()]
        assert got == sharding.permuted_array(np.arange(n), n).tolist()


@pytest.mark.parametrize("each", [250_000, 7])
def test_shards(spark, monkeypatch, each):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", each)
    rows = [(i, f"text {i}") for i in range(200)] + [(None, None), (None, ""), (7, "text 7"), (7, "text 7"), (7, "é")] + [(1000, "same")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("_times", F.lit(1))
    got = sharding.shards(df).collect()
    assert len(got) == len(rows)
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(16)) and max(by.values()) - min(by.values()) <= 1
    for shard, n in by.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    place = sharding.permuted_array(np.arange(len(rows)), len(rows))
    assert all(divmod(int(place[r.row_number]), 16) == (r.slot, r.shard) for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    again = sharding.shards(df.repartition(5))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    assert sharding.shards(df.limit(0)).count() == 0


def test_ranges_grow_with_the_rows():
    assert sharding.buckets_for(1) == 64
    assert sharding.buckets_for(10**11) == 64 + 400_000 < 2**24
