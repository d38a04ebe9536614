"""Tokens, near copies, neighbours, languages and page texts against libraries and brute force."""

from __future__ import annotations

import json
import math
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import FOLDER
from holdfast.llm import bpe, html_text, language, near_dedup, neighbours
from holdfast.llm import shingles as sh

VOCAB = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", None, "  ", "aaaaaaaaa aaaa aaa", "Hello WORLD's don't I'll 1234 !!??", "<|endoftext|>x<|startoftext|> y", "<|ENDOFTEXT|> a",
    "ÀÉ é Σας ΟΔΟΣ İstanbul", "a\x1cb\x1d c\x85d\xa0e　f᠎g​h﻿", "日本語テキスト 😀😀 ｆｕｌｌ ½ ² Ⅳ", "\x00\x01 �",
    "ﬁ ǅ ß ẞ ẛ̣", "'S 'T 'Re it'S", " x", "ͅİi̇", "the " * 20_000, "x" * 30_000,
]


def test_ids_and_texts_equal_the_library(spark):
    own = Tokenizer.from_file(VOCAB)
    texts = ODD + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("IDS", F.lit(1)).withColumn("_bpe_text", F.lit(2))
    got = bpe.encode(df, VOCAB, outputs=("ids", "n_tokens", "decoded"))
    assert got.columns == ["doc_id", "text", "_bpe_text", "ids", "n_tokens", "decoded"]
    again = {r.doc_id: r.decoded for r in bpe.decode_ids(got, VOCAB).collect()}
    for r in got.collect():
        want = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want), texts[r.doc_id]
        assert r.decoded == again[r.doc_id] == own.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), VOCAB).count() == 0


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 3)
    own, encoder = Tokenizer.from_file(VOCAB), bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(VOCAB)))
    for batch in (["one two three four", "five"], ["one six", "two"], ["seven"]):
        for text, (ids, _) in zip(batch, encoder.encode(batch)):
            assert ids.tolist() == own.encode(text, add_special_tokens=False).ids


def brute_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute_components(rows, percent=80):
    sets = [brute_set(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def test_near_components(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(120)]
    for i in range(150):  # a star of copies whose edits overlap little, so most meet only near their middle
        own = list(base)
        for _ in range(rnd.randrange(0, 5)):
            own[rnd.randrange(len(own))] = word()
        rows.append((1000 - i, " ".join(own)))
    passage = " ".join(word() for _ in range(60))
    rows += [(2000 + i, passage + " " + " ".join(word() for _ in range(rnd.choice([5, 12, 40])))) for i in range(80)]
    rows += [(3000 + i, " ".join(word() for _ in range(rnd.choice([1, 2, 3, 4, 30])))) for i in range(60)]
    rows += [(4000, ""), (4001, " \t\n"), (4002, "a b"), (4003, "A  B"), (4004, "a b c d"), (4005, "a b c"), (4006, "a b c d a b c d"), (4007, "é É b c")]
    df = spark.createDataFrame(rows + [(4008, None)], "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("digest", F.lit(0))
    got = {r.doc_id: r for r in near_dedup.near_components(df).collect()}
    want = brute_components(rows) | {4008: (0, 4008)}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[1] == i}
    assert near_dedup.near_components(df.limit(0)).count() == 0


def test_a_star_over_many_parts_meets_its_original(spark):
    """Copies that are linked with their original only, in more parts than its neighbours fill."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(203)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):  # 20 of 200 shingles: similarity 0.82 with the original, about 0.7 with each other
        own = list(base)
        for at in rnd.sample(range(4, 196, 4), 5):
            own[at] = word()
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_components(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    first = brute_set(rows[0][1])
    assert all(100 * len(first & brute_set(t)) >= 80 * len(first | brute_set(t)) for _, t in rows)
    assert set(got.values()) == {0}


def test_a_star_sends_few_pairs_to_the_confirmation(spark, monkeypatch):
    """Sister copies that pass the estimate, but are linked with their original only."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(203)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2200):  # 17 of 200 shingles: 0.84 with the original, about 0.72 with each other
        own = list(base)
        for at in rnd.sample(range(4, 196, 4), 4):
            own[at] = word()
        rows.append((i, " ".join(own)))
    sent, plain = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *rest: sent.append(pairs.count()) or plain(pairs, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_components(df).collect()} == {0}
    assert sum(sent) <= 4 * len(rows), sent


def test_texts_are_shingled_in_slices(spark, monkeypatch):
    from holdfast.llm.common import byte_slices

    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "b", "c" * 50, "", "dd"])], names=["t"])
    assert [p.column(0).to_pylist() for p in byte_slices(batch, (0,), 6)] == [["aaaa", None, "b"], ["c" * 50], ["", "dd"]]
    assert list(byte_slices(batch.slice(0, 0), (0,), 6)) == []
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = sorted(map(tuple, near_dedup.near_components(docs).collect()))
    monkeypatch.setattr(near_dedup, "SHINGLED_BYTES", 3_000)
    assert sorted(map(tuple, near_dedup.near_components(docs).collect())) == want


def test_parity_never_rules_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        both, own, other = rng.integers(1, 400), rng.integers(0, 60), rng.integers(0, 60)
        drawn = rng.integers(0, 2**63, both + own + other, dtype=np.uint64)
        a, b = np.unique(drawn[: both + own]), np.unique(np.concatenate([drawn[:both], drawn[both + own :]]))
        bits = [np.frombuffer(sh.parity(x), dtype=np.uint64) for x in (a, b)]
        apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert apart <= len(np.setxor1d(a, b))
        assert not sh.linked(a, b, 80) or apart * 180 <= (len(a) + len(b)) * 20


def test_shingles_of_other_sizes(spark):
    texts = ["a b c d e f", "a b c d e", "A b c d", "", "a b c d e a b c d e"]
    for k in (1, 2, 5):
        sets = sh.shingle_sets(pa.array(texts), k)
        words = [t.lower().split() for t in texts]
        want = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for w in words]
        assert [len(x) for x in sets] == [len(x) for x in want]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])
    rows = [(0, "a b c d e f g h i j k l m n"), (1, "a b c d e f g h i j k l m x"), (2, "a b c d e f g h i j k l m n o")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # 11 shingles of four, 10 in both: 10 / 12; 10 shingles of five, 9 in both: 9 / 11
    assert {r.component_id for r in near_dedup.near_components(df).collect()} == {0}
    assert {r.doc_id: r.component_id for r in near_dedup.near_components(df, percent=82, words=5).collect()} == {0: 0, 1: 1, 2: 0}


def test_the_estimate_loses_few_true_pairs():
    """Pairs at the threshold of 0.8 that the sketch of all orders puts below the cut, by the binomial."""
    equal = 0.8 + 0.2 / 16
    lost = sum(math.comb(near_dedup.HASHES, k) * equal**k * (1 - equal) ** (near_dedup.HASHES - k) for k in range(near_dedup._NEEDED))
    assert lost < 1e-4


def test_near_components_of_null_and_repeated_ids(spark):
    rows = [(None, "p q r s t u"), (None, "alone in the world here"), (3, "p q r s t u"), (3, "p q r s t u"), (2, "other words are found here now"), (3, "other words are found here now")]
    got = [tuple(r) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(
        [(None, 3, 2, False), (None, 2, None, True), (3, 3, 2, False), (3, 3, 2, False), (2, 3, 2, True), (3, 3, 2, False)], key=str)


def test_short_sets_and_signatures():
    texts = ["a", "a b", "b a", "a b c", "a b c d", "x a b c d", "x\x0by\x0cz\rw", None, ""]
    sets = sh.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    assert len({s.tobytes() for s in sets[:6]}) == 6
    assert sh.linked(sets[0], sets[0], 80) and not sh.linked(sets[7], sets[8], 80)
    assert not sh.min_hashes(sets, 8)[7:].any()


def test_hilbert_neighbours_touch():
    """Following the curve, exactly one axis changes by one."""
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)].astype(int), axis=0)).sum(axis=1) == 1).all()


def brute_nearest(rows, every, count=10):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i)[:count]
            out[i] = [(r + 1, j, round(s, 9)) for r, (s, j) in enumerate(near)]
    return out


def test_nearest_on_small_tables_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(40)]  # one very common vector
    rows += [(200, None), (201, [0.0] * 6), (202, [None] + [1.0] * 5), (203, [float("nan")] * 6), (204, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("members", F.lit(2))
    want = brute_nearest(rows, 10)
    got = {}
    for r in neighbours.nearest(df, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert got == want
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 100"), every=10).count() == 0


def test_recall_of_windows_smaller_than_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 256)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], 100)
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = sum(len(got[q] & {j for _, j, _ in near}) for q, near in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))


def test_nearest_beyond_the_own_window_is_exact(spark, monkeypatch):
    """Independent dimensions, and windows of a two-hundredth of the rows: no window order shows the neighbours."""
    monkeypatch.setattr(neighbours, "WINDOW", 16)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 7 * 8 * 32)  # several blocks of queries too
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 32)))]
    want = brute_nearest(rows, 100)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert got == want


def test_orders_alone_find_most_neighbours_in_clusters(spark, monkeypatch):
    """What the windows of all orders find before the last pass; one order finds fewer than four."""
    monkeypatch.setattr(neighbours, "WINDOW", 64)
    rng = np.random.default_rng(9)
    points = (rng.normal(size=(100, 24))[rng.integers(0, 100, 4000)] + 0.05 * rng.normal(size=(4000, 24)))
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    want = {i: {j for _, j, _ in near} for i, near in brute_nearest(rows, 100).items()}
    classes = spark.createDataFrame([(v, i, int(i % 100 == 0)) for i, v in rows], "vector array<double>, id long, asked int")
    shares = []
    for orders in (1, 4):
        got: dict[int, set] = {}
        for r in neighbours.met_in_windows(classes, [neighbours.Curve(points[:500], k) for k in range(orders)], 11).collect():
            got.setdefault(r["query"], set()).add(r.point)
        shares.append(sum(len(got[q] & near) for q, near in want.items()) / sum(map(len, want.values())))
    assert shares[1] >= 0.9 and shares[1] >= shares[0]


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), VOCAB, sample_docs=150)


def test_forward_sums_all_segmentations(model, monkeypatch):
    pieces = language.Pieces(model.file_text)
    number = {int(k): i for i, k in enumerate(pieces.keys)}

    def brute(word, k):
        """The logarithm of the sum over all segmentations into pieces of any length, with exact fractions."""
        chance = [Fraction(1)] + [Fraction(0)] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                at = number.get(language._hash(word[i:j]) ^ (int(language._END) if j == len(word) else 0))
                if at is not None:
                    chance[j] += chance[i] * Fraction(float(model.chances[at, k]))
        return math.log(chance[-1].numerator) - math.log(chance[-1].denominator)

    vocab = json.loads(model.file_text)["model"]["vocab"]
    longest = max((t.removesuffix("</w>") for t in vocab if t.removesuffix("</w>").isascii()), key=len)
    assert pieces.longest >= len(longest) > 12
    words = ["the", "été", "über", "a", "internationalisations", "zzzz", longest, longest + "s", "donaudampfschifffahrtsgesellschaft", "日本語テキスト", "é" * 60]
    words += ["w" * 70, "thequickbrownfoxjumpsoverthelazydog" * 4]
    scores = language.word_scores(pieces, model.chances, [w.encode() for w in words])
    for i, word in enumerate(words):
        for k in range(len(model.languages)):
            assert scores[i, k] == pytest.approx(brute(word.encode(), k), rel=1e-9), word
    monkeypatch.setattr(language, "SEGMENT_BYTES", 23)
    assert np.allclose(language.word_scores(pieces, model.chances, [w.encode() for w in words]), scores, rtol=1e-9)
    assert model.chances[:-1].sum(axis=0) == pytest.approx(np.ones(len(model.languages)))


def test_expected_counts_cover_the_words(model):
    """Pieces used in expectation spell exactly the bytes of the words."""
    pieces = language.Pieces(model.file_text)
    words, times = [b"the", "été".encode(), b"internationalisation", b"abcdefgh" * 60], np.array([3.0, 2.0, 1.0, 2.0])
    uses = language.expected_counts(pieces, model.chances[:, 0], words, times)
    vocab = json.loads(model.file_text)["model"]
    byte = {c: b for b, c in enumerate(bpe.byte_letters())}
    size = np.zeros(len(pieces))
    for token in vocab["vocab"]:
        final = token.endswith(vocab["end_of_word_suffix"])
        piece = bytes(byte[c] for c in token.removesuffix(vocab["end_of_word_suffix"]))
        size[np.searchsorted(pieces.keys, np.uint64(language._hash(piece) ^ (int(language._END) if final else 0)))] = len(piece)
    assert (uses * size).sum() == pytest.approx(sum(len(w) * t for w, t in zip(words, times)))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs.withColumn("held", language.held_out("doc_id")), model).filter("held and lang is not null")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n
    scores = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= scores[0] <= scores[1] <= 1


def test_languages_of_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !? 45"), (4, "the of and"), (None, "le la les des"), (6, "der " * 50_000), (7, "w" * 200_000), (8, "½ ² ① _ 7"), (9, "½the"), (10, "の")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit("old")).withColumn("_text", F.lit(0))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0)
    assert got[9][0] in model.languages and got[10][0] in model.languages
    assert got[4][0] == "en" and got[None][0] == "fr" and got[6][0] == "de" and got[7][0] in model.languages
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} <= {4, None, 6, 7, 9, 10}
    nothing = language.learn(spark.createDataFrame([], "doc_id long, text string, lang string"), VOCAB)
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


CASES = [
    (None, ""),
    ("", ""),
    ("plain  text", "plain text"),
    ("<p>a<p>b", "a\nb"),
    ("<nav><ul><li>m<li>n</ul></nav><article><h1>T &amp; t</h1><p><b>One\n two<br><p>three</article><footer>f</footer>", "T & t\nOne two\nthree"),
    ("<body><div class='sidebar'>s</div><header>h</header><div><p>x</p>y</div><form>z</form></body>", "x\ny"),
    ("<article><header><h1>h</h1></header><p>b</p><div id='comments'><p>c</p></div><aside>z</aside></article><article class=comment>q</article>", "h\nb"),
    ("a<script>var t='</p>'</script>b<style>p{}</style><!-- <p>no</p> -->", "ab"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("a < b &lt;p&gt; &eacute;&#233;&#x41; &nosuch;", "a < b <p> ééA &nosuch;"),
    ("<main><p title=\"a>b\">in</p></main><p>out</p>", "in"),
    ("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep\ner"),
    ("<b " * 5000 + "\"'" * 5000, None),
    ("<div class=cookie-notice>n</div><p>t</p>", "t"),
    ("<div class='wrap has-sidebar'><main class='post menu'><p>t</p></main><div class='sidebar'>s</div></div>", "t"),
    ("<div role=navigation>n</div><div itemprop=articleBody><p>a</p><div class='share-buttons'>s</div></div><ul class=breadcrumbs><li>b</ul>", "a"),
]


def test_texts_of_pages(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.net/", s) for i, (s, _) in enumerate(CASES)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_texts(df.withColumn("host", F.lit(1)).withColumn("text", F.lit("old"))).collect()}
    for i, (_, want) in enumerate(CASES):
        assert want is None or got[i].text == want, i
        assert got[i].n_chars == len(got[i].text)
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_site_tree_removes_what_a_site_repeats(spark, monkeypatch):
    page = "<body><div class=x><p>Read more about our great company</p></div><div class=y><p>story {0} of its own</p><p>and more of {0}</p></div></body>"
    rows = [(i, "http://one.net/" + str(i), page.format(i)) for i in range(30)] + [(100, None, page.format(1)), (101, "http://two.net/", page.format(2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_texts(df).collect()}
    assert got[3] == "story 3 of its own\nand more of 3"
    assert got[101].startswith("Read more") and got[100].startswith("Read more")  # a site of one page says nothing
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    assert {r.page_id: r.text for r in html_text.main_texts(df).collect()} == got


def test_site_tree_weighs_paragraphs_of_articles_and_outer_wrappers(spark):
    note = "<p>Read more about our great company</p>"
    page = "<body><article><h1>title {0}</h1><p>story {0}</p>" + note + "<ul><li>fact {0}</li><li>Follow us</li></ul><p>end {0}</p><table><tr><td>yes<td>{0}</table></article></body>"
    deep = "<body><div class=tip>" + "<div>" * 15 + "<p>same</p><p>words</p>" + "</div>" * 16 + "<div class=y><p>story {0}</p></div></body>"
    rows = [(i, f"http://one.net/{i}", page.format(i)) for i in range(30)] + [(100 + i, f"http://two.net/{i}", deep.format(i)) for i in range(30)]
    rows.append((200, "http://three.net/", page.format(7)))
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "title 3\nstory 3\nfact 3\nend 3\nyes\n3"
    assert got[103] == "story 3"
    assert "great company" in got[200]  # a site of one page says nothing
    # an unimportant wrapper further out than any fixed number of ancestors
    read = html_text.Page("<div class=tip>" + "<div>" * 40 + "<p>in</p>" + "</div>" * 41 + "<p>out</p>")
    tip = next(path for path, mark in read.weighed[1:2])
    assert read.main_text({tip: 0.0}) == "out"


def test_names_of_passages_drop_no_text():
    inside = [
        ("<h2 id=related-work>R</h2><p>r</p>", "R\nr"),
        ("<section id=sharing-data><h2 id='navigation-basics'>N</h2><p class=alert>a</p></section>", "N\na"),
        ("<div id=social-impact><p>s</p></div><section class='cookie-chemistry'>c</section>", "s\nc"),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then</p>", "if x=1 then"),
        ("<object data=f><p>fallback</p></object><noscript>no script</noscript>", "fallback\nno script"),
        ("<div class='social-links'>s</div><div class=relatedPosts>q</div><div id=comments>c</div><section class=related>x</section><p>t</p>", "t"),
    ]
    for source, want in inside:
        assert html_text.Page(f"<article>{source}</article>").main_text({}) == want, source
    assert html_text.Page("<noscript>enable it</noscript><p>t</p>").main_text({}) == "t"


def test_adverts_and_headings_of_articles(spark):
    inside = [
        ("<figure class=ad>adv</figure><p class='ad box'>b</p><span class=sponsored>s</span><p>t<table role=ad><tr><td>x</table>", "t"),
        ("<p id=ad>not by id</p><p class=additive>t</p><figure class='adapted ad-hoc'>f</figure>", "not by id\nt\nf"),
    ]
    for source, want in inside:
        assert html_text.Page(f"<article>{source}</article>").main_text({}) == want, source
    page = "<body><article><h1>Recipes</h1><h2>Ingredients</h2><p>flour {0}</p><div class=tip><h2>Note</h2><p>Always the same</p></div></article></body>"
    only = "<body><article><h1>Recipes</h1><p>Only this notice</p></article></body>"
    told = page.replace("</article>", "<p>Only this notice</p></article>")
    rows = [(i, f"http://one.net/{i}", told.format(i)) for i in range(40)] + [(50, "http://one.net/x", only), (51, "http://one.net/y", only.replace("h1", "p"))]
    rows += [(100 + i, f"http://copy.net/{i}", page.format("for all")) for i in range(30)]  # copies of one page
    rows += [(200 + i, f"http://bare.net/{i}", "<body><p>Same words</p></body>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_texts(df).collect()}
    assert got[3] == "Recipes\nIngredients\nflour 3" and got[50] == "Recipes" and "notice" not in got[51]
    assert got[107] == "Recipes\nIngredients\nflour for all\nNote\nAlways the same" and got[201] == "Same words"


def brute_tree(rows):
    """{host: {path or mark: importance}} by plain dictionaries over whole pages."""
    shapes, contents, on, pages_of = {}, {}, {}, {}
    for host, source in rows:
        seen = set()
        for path, shape, content in html_text.Page(source or "").branches:
            shapes.setdefault((host, path), []).append(shape)
            contents.setdefault((host, path), []).append(content)
            seen |= {(host, path, content)}
        for host_, path, content in seen:
            on[host_, path, content] = on.get((host_, path, content), 0) + 1
        for key in {(h, p) for h, p, _ in seen}:
            pages_of[key] = pages_of.get(key, 0) + 1

    def entropy(values):
        n = len(values)
        shares = [values.count(v) / n for v in set(values)]
        return -sum(p * math.log(p) for p in shares) / math.log(n) if n > 1 else 1.0

    out = {}
    for (host, path), own in shapes.items():
        if len(own) >= html_text.LEAST_PAGES and (value := max(entropy(own), entropy(contents[host, path]))) < 0.5:
            out.setdefault(host, {})[path] = value
    for (host, path, content), n in on.items():
        if n >= html_text.LEAST_PAGES and (value := 1 - math.log(n) / math.log(pages_of[host, path])) < html_text.LEAST_INSIDE:
            out.setdefault(host, {})[content] = value
    return out


def test_texts_equal_a_plain_style_tree(spark, monkeypatch):
    """200 generated pages of five sites: the Spark tree, in both ways of delivery, against dictionaries."""
    rnd = random.Random(13)
    notes = ["Subscribe now", "Follow us", "All rights", "Read more"]
    rows = []
    for i in range(200):
        site = rnd.choice("aaabcde")
        parts = []
        for _ in range(rnd.randrange(1, 7)):
            words = " ".join(rnd.choice("lorem ipsum dolor sit amet elit".split()) for _ in range(rnd.choice([1, 3, 9])))
            parts.append(rnd.choice(["<p>{}</p>", "<div class=box><p>{}</p></div>", "<ul><li>{}</ul>", "<h2>{}</h2>", "<table><tr><td>{}</table>"]).format(
                rnd.choice([words, words, rnd.choice(notes)])))
        body = "".join(parts) + f"<p>{site} repeats this</p>"
        rows.append((i, f"http://{site}.net/{i}", f"<body><div class=top>{site}</div>" + (f"<article>{body}</article>" if rnd.random() < 0.6 else body) + "</body>"))
    rows += [(900 + i, None, "<p>no host</p><p>%d</p>" % i) for i in range(12)] + [(990, "http://a.net/", None), (990, "http://a.net/", None)]
    host = lambda url: url.split("/")[2] if url else ""
    low = brute_tree([(host(u), h) for _, u, h in rows])
    assert len(low) == 6 and all(low.values())
    want = sorted((i, html_text.Page(h or "").main_text(low.get(host(u), {}))) for i, u, h in rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).withColumn("data", F.lit(1)).withColumn("_id", F.lit(2))
    assert sorted((r.page_id, r.text) for r in html_text.main_texts(df).collect()) == want
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(html_text, "UNIT_BYTES", 2_000)
    assert sorted((r.page_id, r.text) for r in html_text.main_texts(df).collect()) == want
