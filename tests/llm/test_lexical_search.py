"""Ranked search against scoring every document, and the bounds of the signatures."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from holdfast.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, own in asked.items():
        scores = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("w0", F.lit(1))
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("Item", F.lit(2))


def rows(df):
    found = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_DOCS", 16)
    monkeypatch.setattr(ls, "ITEMS_EACH", 70)  # more than one 64-bit word, and several blocks of items
    monkeypatch.setattr(ls, "TERMS_HELD", 50)
    monkeypatch.setattr(ls, "FIRST_DOCS", 3)
    monkeypatch.setattr(ls, "TERMS_AT_ONCE", 4)


def test_ranks_equal_scoring_all(spark, small_blocks):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(120)] + ["Ünï", "日本", "É", "é", "x9"]
    shares = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rnd.choices(words, shares, k=n))
    docs = [(i, text(rnd.choice([1, 3, 10, 40, 300]))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)]  # a third of all: equal scores, ascending ids
    docs += [(2000, None), (2001, ""), (2002, " .,;\n"), (2003, "W1-w1_W1\tw1"), (2004, "the " * 5000), (None, text(30)), (3, text(20)), (3, docs[3][1])]
    items = [(i, text(rnd.choice([1, 2, 8, 30]))) for i in range(150)] + [(500, None), (501, "unseen"), (502, ""), (7, "w3 w4"), (None, "w5 w9")]
    d, q = frames(spark, docs, items)
    got = ls.rank(d.repartition(5), q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute(docs, items)
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) >= len(want)


def test_test_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(ls.rank(docs, items)) == want


def test_empty_tables(spark):
    d, q = frames(spark, [(1, "a b")], [(1, "a")])
    assert rows(ls.rank(d, q)) == brute([(1, "a b")], [(1, "a")])
    assert ls.rank(d.limit(0), q).count() == 0 and ls.rank(d, q.limit(0)).count() == 0
    assert ls.rank(d.select("doc_id", F.lit(None).cast("string").alias("text")), q).count() == 0


def test_bounds_are_never_below_a_score():
    rnd = random.Random(8)
    words = [f"t{i}".encode() for i in range(200)]
    asked = ls.Asked([(i, [(w, rnd.randrange(0, 9000)) for w in rnd.sample(words, 12)]) for i in range(9)], 300, 9000)
    block = ls._Block(1024)
    counts = []
    for i in range(50):
        own = Counter(rnd.choices(words, k=rnd.choice([5, 60, 400])))
        sums = np.fromiter(map(ls.zlib.crc32, own), dtype=np.uint32)
        often = np.fromiter(own.values(), dtype=np.int64)
        counts.append(own)
        block.ids.append(i)
        block.sizes.append(sum(own.values()))
        block.most.append(max(own.values()))
        block.keys.append(np.concatenate([ls._mixed(sums[often >= least], j) for j, least in enumerate(ls.LEVELS)]))
    row = block.row()
    bounds = asked.bounds(np.array(row["sizes"]), np.array(row["most"]), row["rows"], row["slices"])
    for item in range(9):
        for doc, own in enumerate(counts):
            score = asked.score(item, own, asked.length_norm(sum(own.values())))
            assert score <= bounds[item, doc]
