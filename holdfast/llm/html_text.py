"""Main text of web pages by the merged style tree of their site."""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from holdfast.llm.bpe import ARROW_ROWS
from holdfast.llm.common import text_batches
from holdfast.llm.url_rules import host_of
from holdfast.session import cut_lineage

#: A branch is removed if its importance in the site's tree is below this, outside and inside the
#: article, or if the importance of its own content is below the latter. Sites that show the branch
#: fewer times, or the content on fewer pages, say nothing about it.
LEAST_OUTSIDE, LEAST_INSIDE, LEAST_PAGES = 0.5, 0.2, 8
#: Removed branches up to this number are sent to every task; beyond it a unit of pages, of so many
#: bytes, gets those that its own pages have.
BROADCAST_ROWS, UNIT_BYTES = 100_000, 2_000_000

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg audio video canvas annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: A new one of the first ends an open one of the second, up to one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
KEEPS_P = frozenset("td th caption button object".split())
#: Elements that are never main text, anywhere; and those that are not outside an article.
NEVER = frozenset("head title nav footer aside form button select menu dialog search".split())
OUTSIDE = frozenset(["header", "noscript", "textarea"])
MAIN = frozenset(["article", "main"])
#: Elements that their names never drop inside an article, and those of which the id names a passage
#: (often made from its heading) and not a part of the page.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre b i em strong a span code table tbody thead tr td th figure figcaption math".split())
PASSAGES = TEXT | frozenset(["section", "li", "dt", "dd"])
#: Words in class, id or role that name a part of the page that is no main text.
NEVER_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice alert popup modal overlay newsletter subscribe subscription signup login sidebar widget menu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager footer comment comments disqus respond reply replies related "
    "recommended share sharing social toolbar skip copyright".split()
)
#: Of these, the ones that name an advert, on whatever element a class or role says so.
ADVERT_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Of these, the ones that count on an article or main element itself.
MAIN_WORDS = frozenset("ad ads advert comment comments reply replies related recommended sponsored".split())
OUTSIDE_WORDS = frozenset("header masthead topbar search".split())
#: Words that may stand beside these in one name: share-buttons and cookie-notice, not sharing-data.
SIDE_WORDS = frozenset(
    "area articles bar block blocks bottom box btn button buttons container content desktop footer form global header icon icons "
    "inner item items left link links list main message mobile outer page panel post posts primary right secondary section site "
    "stories text top wrap wrapper".split()
)
#: Never weighed; and weighed by all their appearances only, as a value of a table may repeat.
WHOLE, CELLS = frozenset(["html", "body"]), frozenset(["td", "th"])
#: Headings of an article are its text however often the site has them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: Possessive throughout: no text makes the search go back.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S
)
_RAW_END = {tag: re.compile(rf"</{tag}[^>]*>?", re.I) for tag in RAW}
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")
_JOINT = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART_WORDS = NEVER_WORDS | OUTSIDE_WORDS | SIDE_WORDS
#: Names that say what a wrapper has or shows name no part: has-sidebar, with-nav.
_STATES = re.compile(r"\b(?:has|with|no|is|show|hide)[-_][a-z]+")


class _Open:
    """An open element: its place in the style tree and on the page, and what has been seen below it."""

    __slots__ = ("tag", "path", "main", "dropped", "children", "content", "number")

    def __init__(self, tag: str, path: int, main: bool, dropped: bool, number: int):
        self.tag, self.path, self.main, self.dropped, self.number = tag, path, main, dropped, number
        self.children = self.content = 0


def _chain(a: int, b: int) -> int:
    return xxh64_intdigest(a.to_bytes(8, "little") + b.to_bytes(8, "little"))


def _mark(tag: str, attributes: str) -> tuple[int, frozenset[str], frozenset[str], bool]:
    """Number of an element's presentation, the words of its names, those that name a part of the
    page, and whether one names an advert: the words of a name count if each names a part or may stand
    beside one."""
    words: set[str] = set()
    parts: set[str] = set()
    advert = False
    if "=" in attributes:
        for kind, value in _NAMES.findall(attributes):
            value = value.strip("\"'")
            words |= set(_PARTS.findall(_STATES.sub(" ", value.lower())))
            if kind.lower() == "id" and tag in PASSAGES:
                continue
            for name in value.split():
                # joined words too: cookieNotice
                own = set(_PARTS.findall(_STATES.sub(" ", _JOINT.sub("-", name).lower())))
                if own <= _PART_WORDS:
                    parts |= own
                    advert = advert or kind.lower() != "id" and bool(own & ADVERT_WORDS)
    return xxh64_intdigest(" ".join([tag, *sorted(words)])), frozenset(words), frozenset(parts), advert


class Page:
    """Blocks and branches of one page.

    blocks: (text, main, dropped, number of the element around it); parents: for each element the number
    of the one around it; weighed: for each element its path and, once closed, the mark of its content
    (None where it is not weighed); wholes: the marks of the body and of its articles; branches: (path,
    presentation, mark of content) of every closed element that holds text.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool, int]] = []
        self.branches: list[tuple[int, int, int]] = []
        self.stack = [_Open("", 0, False, False, 0)]
        self.parents = [0]
        self.weighed: list[tuple[int | None, int | None]] = [(None, None)]
        self.wholes: list[int] = []
        self.text: list[str] = []
        self._read(source)

    def _flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            self.text.clear()
            if words:
                top = self.stack[-1]
                top.content = _chain(top.content, xxh64_intdigest(words.encode("utf-8", "surrogatepass")))
                self.blocks.append((words, top.main, top.dropped, top.number))

    def _close(self, count: int) -> None:
        """Close the innermost `count` elements."""
        for _ in range(count):
            if self.stack[-1].tag in BLOCKS or self.stack[-1].dropped != self.stack[-2].dropped:
                self._flush()
            done = self.stack.pop()
            if done.content:
                mark = _chain(done.path, done.content)
                self.branches.append((done.path, done.children, mark))
                if done.tag in MAIN or done.tag in WHOLE:
                    self.wholes.append(mark)
                if done.tag not in WHOLE and not (done.main and done.tag in HEADINGS):
                    self.weighed[done.number] = (done.path, None if done.tag in CELLS else mark)
                self.stack[-1].content = _chain(self.stack[-1].content, done.content)

    def _close_until(self, tags: set[str] | frozenset[str], stop) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in tags:
                return self._close(len(self.stack) - depth)
            if self.stack[depth].tag in stop:
                return None

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._close_until({"p"}, KEEPS_P)
            if tag in ENDS:
                self._close_until(*ENDS[tag])
        mark, words, parts, advert = _mark(tag, attributes)
        parent = self.stack[-1]
        parent.children = _chain(parent.children, mark)
        if tag in VOID:
            self.text.append(" ")
            return
        named = tag not in WHOLE and not (parent.main and tag in TEXT)
        no = tag in NEVER or advert or named and bool(parts & (MAIN_WORDS if tag in MAIN else NEVER_WORDS))
        if not parent.main:
            no = no or tag in OUTSIDE or named and tag not in MAIN and bool(parts & OUTSIDE_WORDS)
        dropped = parent.dropped or no
        if tag in BLOCKS or dropped != parent.dropped:
            self._flush()
        main = parent.main or not dropped and (tag in MAIN or "main" in words and tag == "div" or "articlebody" in words)
        self.stack.append(_Open(tag, _chain(parent.path, mark), main, dropped, len(self.parents)))
        self.parents.append(parent.number)
        self.weighed.append((None, None))

    def _read(self, source: str) -> None:
        at = 0
        while found := _TOKEN.search(source, at):
            if found.start() > at:
                self._say(source[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                if any(o.tag == tag for o in self.stack[1:]):
                    self._close_until({tag}, ())
                elif tag in BLOCKS:
                    self._flush()
            elif tag in RAW and not found[0].endswith("/>"):
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
            else:
                self._start(tag, found[3])
        if at < len(source):
            self._say(source[at:])
        self._flush()
        self._close(len(self.stack) - 1)

    def _say(self, text: str) -> None:
        self.text.append(html.unescape(text) if "&" in text else text)

    def main_text(self, unimportant: dict[int, float]) -> str:
        """The blocks of the article, or of the whole body where no element is named so.

        `unimportant` has the importance of paths, and of contents by their marks. An element is as
        important as the least important one around it, however far out that is. A site that repeats a
        whole article, or a whole body, shows copies of one page, which say nothing about its parts.
        """
        worst: list[float] = []
        for (path, mark), parent in zip(self.weighed, self.parents):
            own = unimportant.get(path, 1.0)
            if unimportant.get(mark, 1.0) < LEAST_INSIDE:
                own = 0.0
            worst.append(min(own, worst[parent]) if worst else own)

        def kept(main: bool) -> list[str]:
            least = LEAST_INSIDE if main else LEAST_OUTSIDE
            own = [b for b in self.blocks if not b[2] and (b[1] or not main)]
            some = [b[0] for b in own if worst[b[3]] >= least]
            copied = not some and any(unimportant.get(mark, 1.0) < LEAST_INSIDE for mark in self.wholes)
            return [b[0] for b in own] if copied else some

        return "\n".join(kept(any(b[1] and not b[2] for b in self.blocks)))


def _signed(number: int) -> int:
    return number - 2**64 if number >= 2**63 else number


def style_tree(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, path, importance) of the branches and contents that are unimportant on their site.

    Every element that holds text adds its presentation (the marks of its children, in order) and its
    content (the digest of its whole text) to the node of the site's tree that its path leads to. The
    importance of a node is the larger of the two entropies over all its appearances, as a share of
    the largest possible one. The importance of a content (its mark stands for the path) is its own
    part of that entropy over the pages: the logarithm of the share of the node's pages that have it,
    as a share of the largest possible one; a notice that every article repeats has 0 however varied
    its sisters are. Counts are combined per task and by (host, path, value), so a host with a third of
    all pages is no hot key.
    """
    rows = pages.select(host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            on: dict[tuple, int] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = set()
                for path, shape, content in Page(source or "").branches:
                    page |= {(host, path, 1, content), (host, path, 2, 0)}
                    for key in ((host, path, 0, shape), (host, path, 1, content)):
                        counts[key] = counts.get(key, 0) + 1
                for key in page:
                    on[key] = on.get(key, 0) + 1
            for key, n in on.items():
                if key[2] == 2:  # pages that have the path
                    counts[key] = n
            columns = list(zip(*counts)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(map(_signed, columns[1]), pa.int64()), pa.array(columns[2], pa.int32()),
                 pa.array(map(_signed, columns[3]), pa.int64()), pa.array(counts.values(), pa.int64()),
                 pa.array([on.get(key, 0) for key in counts], pa.int64())],
                names=["host", "path", "kind", "value", "n", "on"])

    seen = rows.mapInArrow(run, "host string, path long, kind int, value long, n long, on long")
    # read for the branches and for the contents
    seen = cut_lineage(seen.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"), F.sum("on").alias("on")), "seen")
    weight = F.sum("n").alias("all"), F.sum(F.col("n") * F.ln("n")).alias("logs")
    nodes = seen.filter("kind < 2").groupBy("host", "path", "kind").agg(*weight)
    entropy = F.when(F.col("all") > 1, (F.ln("all") - F.col("logs") / F.col("all")) / F.ln("all")).otherwise(1.0)
    nodes = nodes.groupBy("host", "path").agg(F.max(entropy).alias("importance"), F.max("all").alias("pages"))
    nodes = nodes.filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < max(LEAST_INSIDE, LEAST_OUTSIDE)))
    pages_of = seen.filter((F.col("kind") == 2) & (F.col("on") >= LEAST_PAGES)).select("host", "path", F.col("on").alias("pages"))
    contents = seen.filter((F.col("kind") == 1) & (F.col("on") >= LEAST_PAGES)).join(pages_of, ["host", "path"])
    contents = contents.withColumn("importance", 1 - F.ln("on") / F.ln("pages")).filter(F.col("importance") < LEAST_INSIDE)
    return nodes.select("host", "path", "importance").unionByName(contents.select("host", F.col("value").alias("path"), "importance"))


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    The text holds the blocks of the page's article (or main element; else of its body) in page order,
    one per line, character references decoded and white space inside a block made one space. Left
    out are elements that are no main text by their markup or names (menus, headers, footers,
    sidebars, notices, adverts, forms, reader comments, scripts, styles), and branches that are
    unimportant in the merged tree of the site or whose content the site repeats, inside the article
    as outside, but for the headings of an article. A page that holds nothing else gives an empty
    text; only where the site repeats whole articles, so that its pages are copies, is nothing weighed.

    A null html counts as empty and gives an empty text. Pages without a host form one site. Repeated
    rows each give a row; broken or unclosed markup is read as far as it goes. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    tree = cut_lineage(style_tree(pages, url_col, html_col), "tree")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col).cast("string")).alias("_host"),
                        F.col(html_col).cast("string").alias("_html"))
    kinds = [T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_url", rows.schema["_url"].dataType)]
    schema = T.StructType([*kinds, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    few = tree.count() <= BROADCAST_ROWS
    out = _with_whole_tree(rows, tree, schema) if few else _with_own_branches(rows, tree, schema)
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


def _with_whole_tree(rows: DataFrame, tree: DataFrame, schema: T.StructType) -> DataFrame:
    """Texts where the removed branches of all sites, at most BROADCAST_ROWS, go to every task."""
    sites: dict[str, dict[int, float]] = {}
    for r in tree.toPandas().itertuples(index=False):
        sites.setdefault(r.host, {})[r.path % 2**64] = r.importance
    shared = rows.sparkSession.sparkContext.broadcast(sites)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: dict[int, float] = {}
        for batch in batches:
            low = [shared.value.get(host, none) for host in batch.column(2).to_pylist()]
            texts = [Page(source or "").main_text(own) for source, own in zip(batch.column(3).to_pylist(), low)]
            yield _text_batch(batch.column(0), batch.column(1), texts)

    return rows.mapInArrow(run, schema)


def _with_own_branches(rows: DataFrame, tree: DataFrame, schema: T.StructType) -> DataFrame:
    """Texts where every unit of pages meets the removed branches that its pages have, and no others.

    The join is on (host, branch) with each branch once a unit, so neither the branches of a large
    site nor its pages meet in one place.
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    made = f"unit long, _id {kinds['_id']}, _url {kinds['_url']}, _host string, data binary, path long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in text_batches(batches, 3, UNIT_BYTES):
            keys, data = set(), []
            for host, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(source or "")
                keys |= {(host, key) for pair in page.weighed for key in pair if key is not None}
                keys |= {(host, mark) for mark in page.wholes}
                data.append(zlib.compress(pickle.dumps((page.blocks, page.parents, page.weighed, page.wholes)), 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit] * len(data), pa.int64()), *batch.columns[:3], pa.array(data, pa.binary()), pa.nulls(len(data), pa.int64())],
                names=["unit", "_id", "_url", "_host", "data", "path"])
            hosts, paths = zip(*keys) if keys else ((), ())
            n = len(hosts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit] * n, pa.int64()), pa.nulls(n, batch.column(0).type), pa.nulls(n, batch.column(1).type),
                 pa.array(hosts, pa.string()), pa.nulls(n, pa.binary()), pa.array(map(_signed, paths), pa.int64())],
                names=["unit", "_id", "_url", "_host", "data", "path"])
            unit += 1

    units = cut_lineage(rows.mapInArrow(read, made), "units")
    # two elements of a site may lead to one number as path and as content; the lower importance counts
    low = tree.groupBy(F.col("host").alias("site"), F.col("path").alias("branch")).agg(F.min("importance").alias("importance"))
    own = units.filter("data is null").select(F.col("unit").alias("of"), F.col("_host").alias("site"), F.col("path").alias("branch"))
    own = own.join(low, ["site", "branch"])

    def write(unit: pa.Table, found: pa.Table) -> pa.Table:
        sites: dict[str, dict[int, float]] = {}
        for host, path, importance in zip(*(found[c].to_pylist() for c in ("site", "branch", "importance"))):
            sites.setdefault(host, {})[path % 2**64] = importance
        texts = []
        for host, data in zip(unit["_host"].to_pylist(), unit["data"].to_pylist()):
            page = Page.__new__(Page)
            page.blocks, page.parents, page.weighed, page.wholes = pickle.loads(zlib.decompress(data))
            texts.append(page.main_text(sites.get(host, {})))
        return pa.Table.from_batches([_text_batch(unit["_id"].combine_chunks(), unit["_url"].combine_chunks(), texts)])

    whole = units.filter("data is not null").select("unit", "_id", "_url", "_host", "data")
    return whole.groupBy("unit").cogroup(own.groupBy("of")).applyInArrow(write, schema)


def _text_batch(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["_id", "_url", "text", "n_chars"])
