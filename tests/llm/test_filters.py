"""Exact dedup, URL verdicts and line dedup against plain Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from holdfast.llm import exact_dedup, line_dedup, url_rules
from holdfast.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ROWS = [
    (1, "Same", "en", "a", 4),
    (2, "sAME", "en", "a", 4),
    (3, "same ", "en", None, 5),
    (4, None, None, "b", None),
    (5, "", "fr", "b", 0),
    (5, "", "fr", "b", 0),  # a repeated row
    (6, "ÉTÉ", "fr", "c", 3),
    (7, "Été", "fr", "c", 3),  # É is not lower-cased
    (None, "same", "de", "c", 4),
    (8, "x" * 50_000, "en", "d", 50_000),
    (9, "X" * 50_000, "en", "d", 50_000),
]


def wanted_groups(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[(row[1] or "").translate(UP)].append(row[0])
    out = []
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_key, lambda c: F.encode(F.substring(c, 1, 1), "UTF-8")])
def test_exact_groups_compare_whole_contents(spark, digest):
    """A digest that nearly always collides must not join two texts."""
    df = exact_dedup.exact_groups(spark.createDataFrame(ROWS, DOCS), digest=digest)
    got = df.collect()
    assert sorted([(r[0], r[1], r[2], r[4]) for r in got], key=str) == wanted_groups(ROWS)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_groups_of_nothing_and_of_one_text(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).columns == empty.columns
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    got = exact_dedup.exact_groups(many)
    assert got.filter("kept").select("doc_id", "group_size").collect() == [(4999, 5000)]
    assert got.select("keep_id").distinct().collect() == [(4999,)]


def test_drop_copies_keeps_columns_even_with_clashing_names(spark):
    df = spark.createDataFrame(ROWS, DOCS).withColumn("_digest", F.lit(1)).withColumn("_turn", F.lit(2)).withColumn("salt", F.lit(3))
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 5, 6, 7, 9]


def test_components_of_hubs_chains_and_self_loops(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3), (5000, 5001), (5000, 5001)]
    got = dict(components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    assert got == {i: 0 for i in range(1, 400)} | {i: 1000 for i in range(1001, 1061)} | {5001: 5000}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


PAGES = [
    (1, "http://a.example.org/es/1", None, "block", "example.org/es/"),
    (2, "https://EXAMPLE.org/en/12?x#y", "", "block", "example.org/en/1"),
    (3, "http://example.org/en/2", "", "allow", "org/"),
    (4, "http://x.com/fr/1", "", "allow", "com/fr/"),
    (5, "http://x.com/de/1", "", "block", "com/de/"),
    (6, "http://notexample.org/es/", "", "allow", "org/"),
    (7, "http://example.net/a", '<link rel="canonical" href="http://x.com/de/7">', "block", None),
    (8, "http://example.net/b", '<meta http-equiv="refresh" content="0; url=/a">', "block", None),
    (9, "http://example.net/c", '<LINK HREF=/d REL=canonical>', "allow", None),
    (10, "http://z.com/fr/9", '<link rel="canonical" href="http://x.com/de/7">', "allow", "com/fr/"),
    (11, None, None, "allow", None),
    (12, "no scheme/es/", "<p>", "allow", None),
    (13, "http://example.net", "", "allow", None),
    (14, "http://b.net/1", '<link rel="canonical" href="http://b.net/2">', "allow", None),
    (14, "http://b.net/1", '<link rel="canonical" href="http://b.net/2">', "allow", None),
    (15, "http://b.net/2", '<link rel="canonical" href="http://c.org/q"><meta http-equiv=refresh content="1;URL=http://x.com/de/0">', "allow", None),
]


def test_url_verdicts(spark):
    # 7 and 8 follow a blocked address, yet 10 is an allowed member: apart from 7's class for the test
    rows = [r for r in PAGES if r[0] != 10]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("host", F.lit("x"))
    got = {r.page_id: r for r in url_rules.url_verdicts(df).collect()}
    for page, url, _, verdict, rule in rows:
        assert (got[page].verdict, got[page].rule) == (verdict, rule), (url, got[page])
    assert (got[2].host, got[2].path) == ("example.org", "/en/12")
    assert (got[11].host, got[11].path, got[12].host, got[13].path) == ("", "", "", "")
    assert url_rules.url_verdicts(df).count() == len(rows)


def test_allow_precedes_block_among_aliases(spark):
    df = spark.createDataFrame([r[:3] for r in PAGES], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_rules.url_verdicts(df).collect()}
    assert (got[7], got[8], got[10], got[5]) == ("allow", "allow", "allow", "block")
    assert url_rules.url_verdicts(df.limit(0)).count() == 0


LINKS = [  # (address, what it holds, the addresses it names)
    ("http://a.net/x/v?q=1", '<link rel="canonical" href="?q=2">', ["http://a.net/x/v?q=2"]),
    ("http://a.net/x/v?q=1", '<link rel="canonical" href="#top">', ["http://a.net/x/v?q=1"]),
    ("http://a.net/x/v", "<link rel='alternate  Canonical' href='w'>", ["http://a.net/x/w"]),
    ("http://a.net/x/y/v", "<link rel=canonical href=../w?z=../1>", ["http://a.net/x/w?z=../1"]),
    ("http://a.net/x/y/v", "<link rel=canonical href=/a/./b/../../..>", ["http://a.net/"]),
    ("http://a.net/x/y/v", "<link rel=canonical href=..>", ["http://a.net/x/"]),
    ("http://a.net", "<link rel=canonical href=w>", ["http://a.net/w"]),
    ("https://A.net/x", "<link rel=canonical href=//b.net/c>", ["https://b.net/c"]),
    ("http://a.net/", '<link rel="canonical" data-href="http://x.com/de/5" href="http://b.net/1">', ["http://b.net/1"]),
    ("http://a.net/", '<link title="href=http://x.com/de/5" rel=canonical href="http://b.net/1">', ["http://b.net/1"]),
    ("http://a.net/", '<!-- <link rel="canonical" href="http://x.com/de/5"> -->', []),
    ("http://a.net/", "<script>s='<link rel=canonical href=/x>'</script><style><link rel=canonical href=/x></style>", []),
    ("http://a.net/", "<link rel=canonical href='/a>b'><p>", ["http://a.net/a>b"]),
    ("http://a.net/", '<link rel=canonicals href="/x"><link rel=canonical><a rel=canonical href=/x>', []),
    ("http://a.net/", '<link rel="canonical" href="mailto:a@b.c">', []),
    ("http://a.net/", '<meta http-equiv="Refresh" content="5;URL=\'/next?a=1&amp;b=2\'">', ["http://a.net/next?a=1&b=2"]),
    ("http://a.net/", '<meta name=refresh content="0; url=/x"><meta http-equiv=refresh content="5">', []),
    ("http://a.net/", '<meta property="og:url" content="http://b.net/og">', []),
    ("http://a.net/", "<LINK HREF=/1 REL=canonical><link rel=canonical href=/2>", ["http://a.net/1", "http://a.net/2"]),
    ("http://a.net/", "<link rel=canonical href='/unclosed", []),
    ("http://a.net/", None, []),
    ("http://a.net/", "<link " + "x " * 400_000 + "rel=canonical href=/far>", ["http://a.net/far"]),
    ("http://a.net/", "<link " + "'\"'\"" * 200_000, []),
    ("http://a.net/", "<!--" + "<link rel=canonical href=/x>" * 20_000, []),
]


def test_link_targets(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(LINKS)], "i int, url string, html string")
    got = {r.i: r.t for r in df.select("i", url_rules.link_targets(F.col("url"), F.col("html")).alias("t")).collect()}
    for i, (url, html, want) in enumerate(LINKS):
        assert (got[i] or []) == want, (url, html, got[i])


def test_verdicts_equal_the_statement_on_planted_links(spark):
    """The DuckDB twin over links of every kind, in chains and rings, to blocked and allowed addresses."""
    import duckdb
    import pandas as pd

    from holdfast.llm.statements import ORACLES

    rows = [(i, u, h) for i, (u, h, _) in enumerate(LINKS)] + [(100 + r[0], r[1], r[2]) for r in PAGES]
    for i, target in enumerate(["http://x.com/de/1", "/c2", "../s2/c3", "?q=3", "//x.com/fr/1", "http://s5.net/d", "http://s0.net/s/c0"]):
        rows += [(200 + i, f"http://s{i}.net/s/c{i}", f'<!-- x --><link class="a b" rel="me canonical" data-href="/no" href="{target}">'),
                 (300 + i, f"http://s{i}.net/c{(i + 1) % 5}?q={i}", f'<meta content="0;url={target}" http-equiv=refresh>')]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", pages)
    want = sorted(map(str, con.execute(ORACLES["op2_url_filters"]).fetchall()))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_rules.url_verdicts(df).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert {"allow", "block"} == {r.verdict for r in got.where("rule is null").collect()}


BLANKS = " \t\n\x0b\x0c\r"


def wanted_lines(rows, min_chars, min_docs):
    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            docs[line.strip(BLANKS).translate(UP)].add(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = -1 if i is None else i
        keep = [x for x in lines for k in [x.strip(BLANKS).translate(UP)] if len(k) < min_chars or len(docs[k]) < min_docs or max(docs[k]) == own]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_line_bitmaps(spark):
    common, accents = "This line is the same in many documents, always.", "é" * 40
    rows = [(i, f"{common}\nown {i}\n  {common.upper()}\t") for i in range(1, 8)]
    rows += [(10 + i, f"{accents}\n{'é' * 39}") for i in range(6)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, common), (23, common), (23, common), (23, f"x\n{common}"), (24, "\n".join([common] * 3000))]
    rows += [(30 + i, "only four documents hold this line, so it stays there") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("dropped", F.lit("x")).withColumn("line_row", F.lit(0))
    for salts in (1, 16):
        got = line_dedup.line_bitmaps(df, keep_text=True, salts=salts).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
        assert sorted(map(tuple, got), key=str) == wanted_lines(rows, 40, 5)
    runs = {r.doc_id: r for r in line_dedup.line_bitmaps(df).collect()}
    assert [tuple(x) for x in runs[1].keep_runs] == [(1, 1)] and runs[24].n_dropped == 0
    texts = sorted((r.text or "") for r in line_dedup.drop_common_lines(df).collect())
    assert texts == sorted(w[3] for w in wanted_lines(rows, 40, 5))
    assert line_dedup.drop_common_lines(df).columns == df.columns
    assert line_dedup.line_bitmaps(df.limit(0)).count() == 0
