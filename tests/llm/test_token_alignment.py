"""Groups, links and corpus counts of two tokenizers against plain loops over their tokens."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import FOLDER
from holdfast.llm import token_alignment as ta
from holdfast.llm.bpe import byte_letters

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "\n", "a", "Hello world's 123  times\n\n", "日本語テキスト 😀😀 ½", "with ▁ inside", "<|endoftext|> and <s>", "\x00\x01 �",
    "x" * 9_000, "the " * 4_000, " " * 3_000, "no-break\xa0space", "tab\tcr\r\n",
]


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    first, second = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    names = {i: n for n, i in first.get_vocab().items()}
    links, groups, sizes = [], [], []
    for text in texts:
        text = text or ""
        a = [(i, bytes(byte_of[c] for c in names[i])) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[1:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode())
             for i in second.encode(text) for p in [second.id_to_piece(i)]]
        want = (" " + text).encode()
        if not text or b"".join(r for _, r in a) != want or b"".join(r for _, r in b) != want:
            a, b = [], []
        ends = [np.cumsum([len(r) for _, r in side]).tolist() for side in (a, b)]
        own = []
        i = j = 0
        while i < len(a) and j < len(b):
            own.append((a[i][0], b[j][0]))
            ea, eb = ends[0][i], ends[1][j]
            i, j = i + (ea <= eb), j + (eb <= ea)
        links.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        spelt, start = [], 0
        for cut in cuts:
            inside = [",".join(str(t[0]) for t, e in zip(side, es) if start < e <= cut) for side, es in zip((a, b), ends)] if len(a) < 3000 else None
            spelt.append("|".join(inside) if inside else None)
            start = cut
        groups.append(";".join(spelt) if None not in spelt else None)
        sizes.append((len(a), len(b), len(cuts)))
    total = Counter(pair for own in links for pair in own)
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [(*s, len(own), sum(total[p] == most[p[1]] for p in own), sum(total[p] for p in own), g)
            for s, own, g in zip(sizes, links, groups)], total, most


def check(spark, texts, df):
    got = ta.align(df, BYTES, PIECES, keep_groups=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    want, total, most = brute(texts)
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6], texts[r.doc_id]
        assert w[6] is None or r.groups == w[6]
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")
    pairs = {(r.a, r.b): (r.links, r.best) for r in ta.pair_counts(df, BYTES, PIECES).collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in total.items()}


def test_documents_and_odd_texts(spark, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    monkeypatch.setattr(ta, "UNIT_BYTES", 40_000)  # many units a task
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check(spark, texts, df.withColumn("unit", F.lit(1)).withColumn("place", F.lit(2)).withColumn("A", F.lit(3)))


def test_null_and_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "same text"), (7, "same text"), (7, "same text"), (8, None)], "doc_id long, text string")
    got = ta.align(df, BYTES, PIECES).collect()
    assert sorted((r.doc_id is None, r.n_links) for r in got) == [(False, 0), (False, 2), (False, 2), (True, 2)]
    assert {(r.n_best, r.count_sum) for r in got if r.n_links} == {(2, 6)}
    assert ta.align(df.limit(0), BYTES, PIECES).count() == 0
    assert ta.align(df.filter("text is null"), BYTES, PIECES).first().groups_sha256 == ""


def test_byte_level_ids_equal_the_library():
    own, library = ta.ByteLevel(ta.read_models(BYTES, PIECES)[0]), Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    for text in [t for t in ODD if t]:
        assert own.ids([text])[0] == library.encode(" " + text, add_special_tokens=False).ids


def test_packing_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3_000):
        places, counts = np.sort(rng.choice(10**6, n, replace=False)), rng.integers(1, 500, n)
        again = ta.unpack(ta.pack(places, counts))
        assert (again[0] == places).all() and (again[1] == counts).all()
