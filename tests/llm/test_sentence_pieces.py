"""Ids and texts of the prefix table against the library, its pair test against plain merging."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import FOLDER
from holdfast.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", " a", "a ", "a  b   c    d", "\n", "\n\n a", "▁", "▁▁a ▁b", "日本語テキスト 😀😀 ｆｕｌｌ ½", "<s>", "</s> <unk> <0x41>",
    "\x00\x01 �", "x" * 30_000, "the " * 20_000, " " * 1_000, "\t\tdef f():\r\n    return 1", "aaaaaaaaaaaaaaaaaaa", "=" * 47, "ทดสอบ ไทย",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(sp.read_pieces(PATH))


def test_ids_and_texts_equal_the_library(spark, library):
    texts = ODD + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, ""), (None, "a")], "doc_id long, text string")
    df = df.withColumn("IDS", F.lit(1)).withColumn("_pieces_text", F.lit(2))
    got = sp.encode(df, PATH, outputs=("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"))
    assert got.columns[:3] == ["doc_id", "text", "_pieces_text"] and got.count() == len(texts) + 2
    again = {r.doc_id: r.decoded for r in sp.decode_ids(got, PATH).collect()}
    for r in got.filter("doc_id is not null").collect():
        want = library.encode(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want), texts[r.doc_id]
        assert r.decoded == again[r.doc_id] == library.decode(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert sp.encode(df.limit(0), PATH).count() == 0


def test_bytes_that_are_no_text(spark, library):
    raw = spark.sql("select 1 as doc_id, cast(X'61FF62E28220C3' as string) as text")
    assert sp.encode(raw, PATH).first().ids == library.encode(b"a\xffb\xe2\x82 \xc3")


def test_random_pieces_and_letters(library, pieces):
    rnd = random.Random(3)
    names = list(pieces.ids)
    texts = ["".join(rnd.choice(names) for _ in range(rnd.randrange(1, 30))) for _ in range(1500)]
    texts += ["".join(rnd.choice("abtheing ▁\n.") for _ in range(rnd.randrange(1, 60))) for _ in range(1500)]
    encoder = sp.Encoder(pieces)
    for text in texts:
        assert encoder.ids(encoder.numbers(text)).tolist() == library.encode(text), repr(text)


def test_random_ids_decode_like_the_library(library, pieces):
    rnd = random.Random(4)
    for _ in range(1500):
        ids = [rnd.randrange(0, 400) for _ in range(rnd.randrange(0, 12))]
        assert pieces.decode(ids) == library.decode(ids), ids


def plain(pieces, text):
    """The best pair of the whole text is merged until none is left."""
    symbols = list(text)
    while True:
        found = [(-pieces.score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in pieces.score]
        if not found:
            return symbols
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_pairs_fit_when_plain_merging_keeps_them_apart(pieces):
    rnd = random.Random(6)
    names = [n for n in pieces.ids if pieces.merges(n) is not None]
    for _ in range(4000):
        a, b = rnd.choice(names), rnd.choice(names)
        assert pieces.fit(a, b) == (plain(pieces, a + b) == [a, b]), (a, b)


def test_pieces_over_spaces_make_a_text_one_word(monkeypatch):
    rows = (("<unk>", 0.0, "unknown"), *((f"<0x{b:02X}>", 0.0, "byte") for b in range(256)),
            ("▁", -9.0, "normal"), ("a", -10.0, "normal"), ("b", -11.0, "normal"), ("a▁", -1.0, "normal"), ("a▁b", -2.0, "normal"))
    monkeypatch.setattr(sp, "KNOWN_WORDS", 2)
    monkeypatch.setattr(sp, "KNOWN_PAIRS", 2)
    own = sp.Pieces(rows)
    encoder = sp.Encoder(own)
    for text in ("a b", "b a a b", "ba\nab a", "c a c", ""):
        whole = "▁" + text.replace(" ", "▁") if text else ""
        want = [i for t in plain(own, whole) for i in own.token(t)[2]]
        assert encoder.ids(encoder.numbers(text)).tolist() == want
        assert own.decode(want) == text
