"""URL verdicts from host and path rules, carried to aliases by redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import ascii_lower
from holdfast.llm.components import components
from holdfast.session import cut_lineage

#: (verdict, host followed by the start of the path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none; an allow rule wins a tie."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        made = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, made) if found is None else found.when(fits, made)
    if found is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return found


def alias_key(url: Column) -> Column:
    """What two spellings of one address share: no scheme, no fragment, the host in lower case."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


#: What holds no tags of the page itself, and the tags that may name another address.
UNSEEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script|$)|<style\b.*?(?:</style|$)|<template\b.*?(?:</template|$)"
TAGS = r"""(?is)<(?:link|meta)[\s/](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
#: An attribute's name, and its value with the quotes, read from the left: values are never taken for names.
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
REFRESH = r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)"""


def link_targets(url: Column, html: Column) -> Column:
    """Absolute targets that the page names as its other address: canonical links and refreshes.

    Comments, scripts, styles and templates hold no tags. A link is canonical if one of the words of its rel is.
    Targets are resolved against the page's address; one that names only a fragment is the page itself.
    """
    seen = F.regexp_replace(html, UNSEEN, "")
    tags = F.regexp_extract_all(seen, F.lit(TAGS), F.lit(0))
    parsed = F.transform(tags, lambda tag: F.struct(
        F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower).alias("names"),
        F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)).alias("texts")))

    def attribute(tag: Column, name: str) -> Column:
        at = F.array_position(tag["names"], F.lit(name))
        value = F.when(at > 0, F.get(tag["texts"], (at - 1).cast("int")))
        value = F.btrim(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit(" \t\r\n"))
        return F.replace(F.coalesce(value, F.lit("")), F.lit("&amp;"), F.lit("&"))

    def named(tag: Column) -> Column:
        canonical = F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")
        refresh = F.lower(attribute(tag, "http-equiv")) == "refresh"
        later = F.btrim(F.regexp_extract(attribute(tag, "content"), REFRESH, 1))
        is_link = F.get(tag["names"], F.lit(0)) == "link"
        return F.when(is_link & canonical, attribute(tag, "href")).when(~is_link & refresh, later).otherwise("")

    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)

    def absolute(target: Column) -> Column:
        return (
            F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, without_dots(target)))
            .when(target.startswith("?"), F.concat(site, path, target))
            .when(target.startswith("#"), F.concat(site, path, query))
            .when(target != "", F.concat(site, without_dots(F.concat(folder, target))))
        )

    return F.array_distinct(F.filter(F.transform(F.transform(parsed, named), absolute), lambda t: t.isNotNull()))


def without_dots(address: Column) -> Column:
    """A path (with its query) without the steps `.` and `..`."""
    path, rest = F.regexp_extract(address, r"(?s)^([^?#]*)", 1), F.regexp_extract(address, r"(?s)^[^?#]*(.*)", 1)
    steps = F.split(F.substring(path, 2, 2**31 - 1), "/")
    ends = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")

    def step(done: Column, name: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(name == "..", up).when(name == ".", done).otherwise(F.concat(done, F.array(name)))

    made = F.aggregate(steps, F.array().cast("array<string>"), step)
    clean = F.concat(F.lit("/"), F.array_join(made, "/"), F.when(F.size(made) > 0, ends).otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(clean, rest)).otherwise(address)


def url_verdicts(
    pages: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A page that a rule fits has the rule's verdict. Any other page takes part in redirect
    equivalence: pages and the targets of their canonical links and refreshes form components, and a
    page without a rule of its own is allowed if a rule allows a member of its component, else
    blocked if a rule blocks one, else allowed. Rules judge targets that are no pages, too.

    `rules` is a list written by hand and becomes part of the plan. Null urls, or urls without ://,
    have empty host and path, no rule, no aliases and are allowed. Null html names no alias. Pages
    of equal address share one node and each give a row. Other columns are ignored.
    """
    pages = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("at"),
                         F.col(html_col).cast("string").alias("source"))
    at = F.col("at")
    judged = pages.select("page", host_of(at).alias("host"), path_of(at).alias("path"), F.md5(alias_key(at)).alias("node"))
    judged = judged.withColumn("own", matched_rule(F.col("host"), F.col("path"), rules))
    named = pages.select("at", F.explode(link_targets(at, F.col("source"))).alias("target"))
    named = named.select(alias_key(at).alias("address"), alias_key(F.col("target")).alias("other"),
                         at.alias("url"), "target")
    named = cut_lineage(named.filter("address is not null and other is not null and address <> other").distinct(), "aliases")
    roots = components(named.select(F.md5("address").alias("a"), F.md5("other").alias("b")), "a", "b")
    ends = named.select(F.explode(F.array("url", "target")).alias("url")).distinct()
    ends = ends.select(F.md5(alias_key(F.col("url"))).alias("node"),
                       matched_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("said"))
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    said = whole.join(ends.filter("said is not null"), "node").groupBy("root")
    said = said.agg(F.max((F.col("said") == "allow").cast("int")).alias("allowed"))
    verdicts = whole.join(said, "root").select("node", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("passed"))
    out = judged.join(verdicts, "node", "left")
    return out.select(
        F.col("page").alias(id_col), "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.col("passed"), F.lit("allow")).alias("verdict"),
    )
