"""Near-duplicate components by a MinHash LSH forest of sorted signature orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm import shingles as sh
from holdfast.llm.common import byte_slices, free_name
from holdfast.llm.components import components
from holdfast.session import cut_lineage, shuffle_width

#: Orders of the forest and hashes of each label; all hashes together are the signature.
TREES, DEPTH = 16, 8
HASHES = TREES * DEPTH
#: Neighbours taken before each row of an order, in the first and the second walk; the second only
#: looks at pairs of different components. Every pair of near rows meets in several orders.
REACH, FAR_REACH = 16, 64
#: Regions (rows that share so many leading hashes) that also name centres, and how many of them.
CENTRE_DEPTHS, CENTRES = (1, 2, 4), 4
#: Estimated similarity from which a candidate goes to the confirmation, four deviations below 0.8.
LEAST_ESTIMATE = 0.65
#: Parts of a region that are merged at a time.
PARTS_MERGED = 64
PERCENT = 80
ARROW_ROWS = 500
#: Bytes of texts that are shingled at a time: the arrays of their words take some forty times as much.
SHINGLED_BYTES = 2_000_000

#: Equal half bytes in a byte of the difference of two sketches.
_EQUAL = np.array([(v & 15 == 0) + (v >> 4 == 0) for v in range(256)], dtype=np.uint8)
_NEEDED = int(np.ceil(HASHES * (1 / 16 + 15 / 16 * LEAST_ESTIMATE)))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = sh.WORDS_EACH) -> DataFrame:
    """(doc, n, digest, label, sketch, parity): set size, set digest, the hashes in sortable bytes, their
    lowest half bytes, and the set's parity bits. Texts without words have n 0 and no digest."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in byte_slices(whole, (1,), SHINGLED_BYTES)):
            sets = sh.shingle_sets(batch.column(1), words)
            hashes = sh.min_hashes(sets, HASHES)
            low = (hashes & np.uint32(15)).astype(np.uint8)
            sketches = (low[:, 0::2] << 4) | low[:, 1::2]
            digests = [sh.set_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array([h.tobytes() for h in hashes.astype(">u4")], pa.binary()),
                 pa.array([s.tobytes() for s in sketches], pa.binary()), pa.array(map(sh.parity, sets), pa.binary())],
                names=["doc", "n", "digest", "label", "sketch", "parity"],
            )

    return rows.mapInArrow(run, "doc long, n long, digest binary, label binary, sketch binary, parity binary")


def _pairs(
    labels: np.ndarray, sketches: np.ndarray, trees: np.ndarray, nodes: np.ndarray, roots: np.ndarray, far: int,
    possible: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> Iterator[tuple]:
    """Candidates (row, row, equal half bytes, whether the first is a centre) of one sorted part of the forest."""

    def measured(a: np.ndarray, b: np.ndarray, centre: bool):
        for i in range(0, len(a), 200_000):
            p, q = a[i : i + 200_000], b[i : i + 200_000]
            apart = roots[p] != roots[q]
            p, q = p[apart], q[apart]
            same = _EQUAL[sketches[p] ^ sketches[q]].sum(axis=1, dtype=np.int64)
            good = same >= _NEEDED
            p, q, same = p[good], q[good], same[good]
            good = possible(p, q)
            if good.any():
                yield p[good], q[good], same[good], centre

    # together[d][i]: row i shares its tree and its first d + 1 hashes with the row before it
    joined = np.concatenate([[False], (trees[1:] == trees[:-1])])
    together = []
    for d in range(DEPTH):
        joined = joined & np.concatenate([[False], labels[1:, d] == labels[:-1, d]])
        together.append(joined)
    near = together[0]
    reach = near.copy()
    for back in range(1, far + 1):
        rows = np.flatnonzero(reach)
        if not len(rows):
            break
        yield from measured(rows - back, rows, False)
        reach = reach & np.concatenate([np.zeros(back, dtype=bool), near[:-back]])
    for depth in CENTRE_DEPTHS:
        starts = np.flatnonzero(~together[depth - 1])
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(nodes)).tolist()):
            if b - a <= far + 1:
                continue
            agree = _agreement(sketches[a:b], _votes(sketches[a:b]))
            for centre in a + np.lexsort((nodes[a:b], -agree))[:CENTRES]:
                rows = np.arange(a, b)
                yield from measured(np.full(b - a, centre), rows, True)


def _halves(sketches: np.ndarray) -> np.ndarray:
    return np.concatenate([sketches >> 4, sketches & 15], axis=1)


def _votes(sketches: np.ndarray) -> np.ndarray:
    """How many rows have each of the 16 values at each place of the sketch."""
    halves = _halves(sketches)
    return np.stack([(halves == v).sum(axis=0) for v in range(16)])


def _agreement(sketches: np.ndarray, votes: np.ndarray) -> np.ndarray:
    return (_halves(sketches) == votes.argmax(axis=0).astype(np.uint8)).sum(axis=1)


def _edges(labels: np.ndarray, sketches: np.ndarray, trees: np.ndarray, nodes: np.ndarray) -> Iterator[tuple]:
    """(tree, prefix, its rows, votes, its most central rows) of the regions that reach an edge of a sorted part."""
    for depth in CENTRE_DEPTHS:
        seen = set()
        for edge in (0, len(nodes) - 1):
            inside = (trees == trees[edge]) & (labels[:, :depth] == labels[edge, :depth]).all(axis=1)
            rows = np.flatnonzero(inside)
            if rows[0] not in seen:
                seen.add(rows[0])
                votes = _votes(sketches[rows])
                best = rows[np.lexsort((nodes[rows], -_agreement(sketches[rows], votes)))[:CENTRES]]
                yield int(trees[edge]), labels[edge, :depth].tobytes(), rows, votes, best


def _best(p: np.ndarray, q: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the most similar one of either of their rows."""
    rows, pair = np.concatenate([p, q]), np.tile(np.arange(len(p)), 2)
    order = np.lexsort((pair, -same[pair], rows))
    first = np.r_[True, rows[order][1:] != rows[order][:-1]]
    return np.unique(pair[order][first])


def candidates(reps: DataFrame, only_best: bool, percent: int = PERCENT) -> DataFrame:
    """(a, b, same) of distinct candidate pairs, a < b, from rows (node, root, label, sketch).

    Each order is sorted by (tree, label, the following hashes, node) and range-partitioned in that
    order, so a dense region is split like any other rows. Within a part a row meets the rows shortly
    before it as far as they share a prefix: in a dense region these share a long one, in a sparse
    one a short one, which is the depth of the forest adapting to the region. Regions too large for
    that also compare every row with their most central rows, so copies of one original meet it
    however many lie between. A region that reaches over the edge of a part has its central rows chosen
    from all its parts (`_met_centres`). Other pairs that an edge separates meet in other orders.

    Pairs of one root say nothing new and are left out. With `only_best` a row names, in each order, its
    most similar neighbour and its most similar centre, if it has any. Else the rows also hold (n, parity):
    the parity bits of two sets differ in no more places than the sets have members of their own, so
    pairs whose bits differ in more than a link of `percent` allows are left out, and no link with them.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    bits = [] if only_best else ["n", "parity"]
    rows = reps.select("node", "root", tree.alias("tree"), "label", "sketch", *bits)
    part = F.expr(f"substring(label, tree * {4 * DEPTH} + 1, {4 * DEPTH})")
    rows = rows.select("node", "root", "tree", part.alias("label"), "sketch", *bits)
    # Rows of equal labels go on in the order of the hashes behind the label, of which the sketch has half a byte each.
    behind = F.expr(f"concat(substring(sketch, (tree + 1) * {DEPTH // 2} + 1), substring(sketch, 1, tree * {DEPTH // 2}))")
    order = ["tree", "label", behind, "node"]
    rows = rows.repartitionByRange(shuffle_width(reps.sparkSession), *order).sortWithinPartitions(*order)

    def read(held: list[pa.RecordBatch]) -> tuple:
        part = pa.Table.from_batches(held)
        labels = np.frombuffer(b"".join(part["label"].to_pylist()), dtype=">u4").reshape(-1, DEPTH)
        sketches = np.frombuffer(b"".join(part["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, HASHES // 2)

        def possible(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            if only_best:
                return np.ones(len(p), dtype=bool)
            apart = np.bitwise_count(parity[p] ^ parity[q]).sum(axis=1, dtype=np.int64)
            return apart * (100 + percent) <= (sizes[p] + sizes[q]) * (100 - percent)

        if not only_best:
            sizes, parity = part["n"].to_numpy(), np.frombuffer(b"".join(part["parity"].to_pylist()), dtype=np.uint64).reshape(len(labels), -1)
        return *(part[c].to_numpy() for c in ("node", "root", "tree")), labels, sketches, possible

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        nodes, roots, trees, labels, sketches, possible = read(held)
        part = TaskContext.get().partitionId()
        for tree, prefix, rows, votes, best in _edges(labels, sketches, trees, nodes):
            yield _walk_batch(edge=[{
                "part": part, "parts": 1, "tree": tree, "prefix": prefix, "votes": votes.astype("<i4").tobytes(),
                "nodes": nodes[best].tolist(), "sketches": [sketches[i].tobytes() for i in best]}])
            for i in range(0, len(rows), 5_000):
                some = rows[i : i + 5_000]
                yield _walk_batch(member=[
                    {"tree": tree, "prefix": prefix, "node": node, "root": root, "sketch": sketches[row].tobytes()}
                    for row, node, root in zip(some.tolist(), nodes[some].tolist(), roots[some].tolist())])
        kept: dict[bool, list[tuple]] = {False: [], True: []}
        for p, q, same, centre in _pairs(labels, sketches, trees, nodes, roots, REACH if only_best else FAR_REACH, possible):
            if only_best:
                own = kept[centre]
                own.append((p, q, same))
                if len(own) > 50:  # a row has one best pair, so what is held stays small
                    kept[centre] = [_reduced(own)]
            else:
                yield _pair_batch(nodes[p], nodes[q], same)
        for own in kept.values():
            if own:
                p, q, same = _reduced(own)
                yield _pair_batch(nodes[p], nodes[q], same)

    found = cut_lineage(rows.mapInArrow(run, f"a long, b long, same long, edge {_EDGE}, member {_MEMBER}"), "walk")
    pairs = found.filter("a is not null").select("a", "b", "same").unionByName(_met_centres(found, only_best))
    return pairs.groupBy("a", "b").agg(F.max("same").alias("same"))


def _merge_regions(key: tuple, region: pa.Table) -> pa.Table:
    """Parts of a region as one: votes added up, of the rows they name the most central ones."""
    votes = sum(np.frombuffer(v, dtype="<i4").reshape(16, -1) for v in region["votes"].to_pylist())
    nodes = np.concatenate(region["nodes"].to_pylist()).astype(np.int64)
    raw = [s for part in region["sketches"].to_pylist() for s in part]
    agree = _agreement(np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1), votes)
    best = np.lexsort((nodes, -agree))[:CENTRES]
    merged = {"part": 0, "parts": sum(region["parts"].to_pylist()), "tree": region["tree"][0].as_py(), "prefix": region["prefix"][0].as_py(),
              "votes": votes.astype("<i4").tobytes(), "nodes": nodes[best].tolist(), "sketches": [raw[i] for i in best]}
    return pa.Table.from_pylist([merged], schema=pa.schema(_EDGE_ARROW))


def _met_centres(found: DataFrame, only_best: bool) -> DataFrame:
    """(a, b, same): rows with the central rows of the regions that lie in several parts.

    The parts of a region add up their votes, PARTS_MERGED at a time first, and of the rows that they
    name the CENTRES that agree most with all votes are its centres. The rows of such a region are met
    with its centres by a join on the region, which is dealt over salts, as a region may hold any share of the rows.
    """
    spark = found.sparkSession
    edges = found.filter("edge is not null").select("edge.*").withColumn("part", F.expr(f"part div {PARTS_MERGED}").cast("int"))
    merged = edges.groupBy("tree", "prefix", "part").applyInArrow(_merge_regions, _EDGE_FIELDS)
    regions = merged.groupBy("tree", "prefix").applyInArrow(_merge_regions, _EDGE_FIELDS).filter("parts > 1")
    members = found.filter("member is not null").select("member.*")
    # a centre is a row of its region, so its root is known there
    named = regions.select("tree", "prefix", F.posexplode("nodes").alias("turn", "node"), "sketches")
    named = named.select("tree", "prefix", "node", F.expr("sketches[turn]").alias("sketch"))
    own_roots = members.select("tree", "prefix", "node", "root").hint("merge")
    named = named.join(own_roots, ["tree", "prefix", "node"])
    centres = named.groupBy("tree", "prefix").agg(F.collect_list(F.struct("node", "root", "sketch")).alias("centres"))
    salts = shuffle_width(spark)
    salted = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = members.withColumn("salt", F.expr(f"pmod(xxhash64(node), {salts})").cast("int"))
    met = dealt.join(salted, ["tree", "prefix", "salt"]).select("node", "root", "sketch", "centres")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, roots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sketches = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
            lists = batch.column(3)
            flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
            ends, tops = flat.field("node").to_numpy(), flat.field("root").to_numpy()
            marks = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), dtype=np.uint8).reshape(len(ends), -1)
            same = _EQUAL[sketches[row] ^ marks].sum(axis=1, dtype=np.int64)
            good = np.flatnonzero((same >= _NEEDED) & (roots[row] != tops))
            if only_best:  # of the centres of its region a row names one
                good = good[np.lexsort((ends[good], -same[good], row[good]))]
                good = good[np.r_[True, row[good][1:] != row[good][:-1]]] if len(good) else good
            yield _pair_batch(ends[good], nodes[row[good]], same[good]).select(["a", "b", "same"])

    return met.mapInArrow(run, "a long, b long, same long")


def _reduced(kept: list[tuple]) -> tuple:
    p, q, same = (np.concatenate(x) for x in zip(*kept))
    best = _best(p, q, same)
    return p[best], q[best], same[best]


_EDGE_FIELDS = "part int, parts long, tree int, prefix binary, votes binary, nodes array<long>, sketches array<binary>"
_EDGE = f"struct<{', '.join(f.replace(' ', ': ', 1) for f in _EDGE_FIELDS.split(', '))}>"
_MEMBER = "struct<tree: int, prefix: binary, node: long, root: long, sketch: binary>"
_EDGE_ARROW = [
    ("part", pa.int32()), ("parts", pa.int64()), ("tree", pa.int32()), ("prefix", pa.binary()), ("votes", pa.binary()),
    ("nodes", pa.list_(pa.int64())), ("sketches", pa.list_(pa.binary()))]
_WALK = {
    "a": pa.int64(), "b": pa.int64(), "same": pa.int64(), "edge": pa.struct(_EDGE_ARROW),
    "member": pa.struct([("tree", pa.int32()), ("prefix", pa.binary()), ("node", pa.int64()), ("root", pa.int64()), ("sketch", pa.binary())])}


def _walk_batch(**known) -> pa.RecordBatch:
    """Rows of a walk: pairs, or what a part says about a region at its edges, or the rows of such a region."""
    size = len(next(iter(known.values())))
    columns = [pa.array(known[name], kind) if name in known else pa.nulls(size, kind) for name, kind in _WALK.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(_WALK))


def _pair_batch(x: np.ndarray, y: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
    return _walk_batch(a=np.minimum(x, y), b=np.maximum(x, y), same=same)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, words: int = sh.WORDS_EACH) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts has (node, text)."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in byte_slices(whole, (2, 3), SHINGLED_BYTES)):
            left, right = sh.shingle_sets(batch.column(2), words), sh.shingle_sets(batch.column(3), words)
            good = pa.array([sh.linked(x, y, percent) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


#: Links that one task joins into trees before the rounds over all links begin.
LINKS_EACH = 500_000


def _joined(links: DataFrame) -> DataFrame:
    """The components of links (a, b): trees within parts of bounded size first, then star rounds.

    A part replaces its links by one link per node to the least node it reaches there, so the rounds
    over all parts start from fewer and shorter paths. Parts grow in number with the links.
    """
    links = cut_lineage(links, "links")
    parts = -(-links.count() // LINKS_EACH) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes = [x for x in root if root[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], names=["a", "b"])

    trees = links.select("a", "b").coalesce(parts).mapInArrow(run, "a long, b long")
    return components(trees, "a", "b")


def _one_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from an id that rows with different sets share to the classes of these sets."""
    rows = signed.filter("n > 0 and doc is not null")
    mark = F.xxhash64("digest")
    several = rows.groupBy("doc").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high").select("doc")
    own = rows.join(several, "doc").select("doc", "digest").distinct().join(classes, "digest")
    return own.select(F.col("doc").alias("a"), F.col("node").alias("b")).filter("a <> b")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = sh.WORDS_EACH
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of `words` words (A-Z lower-cased); with fewer words the whole
    sequence is its one member; a text without words has an empty set and is linked with nothing.
    Texts are linked when 100 * intersection >= percent * union, confirmed on full sets.
    component_id is the smallest id reachable, kept tells whether it is the document's own.

    Texts of equal sets form one class, so copies enter the forest once. The forest is walked twice:
    first every class names its most similar candidates and these are confirmed and joined, then all
    candidates that still lie in different components are; pairs inside one cannot change it.

    Null ids: such rows belong to the component of their set but never name one; without any id
    component_id is null. Rows that repeat an id count as linked. Other columns are ignored. An
    empty table gives an empty result.
    """
    signed = cut_lineage(signatures(docs, id_col, text_col, words), "signatures")
    classes = signed.filter("n > 0 and doc is not null").groupBy("digest").agg(F.min("doc").alias("node"))
    classes = cut_lineage(classes, "classes")
    reps = signed.join(classes.withColumnRenamed("node", "doc"), ["digest", "doc"])
    reps = cut_lineage(reps.dropDuplicates(["digest", "doc"]).select(F.col("doc").alias("node"), "n", "label", "sketch", "parity"), "points")
    pairs = cut_lineage(candidates(reps.withColumn("root", F.col("node")), only_best=True), "candidates")
    # every class that has a candidate in this walk names one, so these are the texts that its confirmations can need
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows_of = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    # A sorted merge at every size: whether the ids are few enough to be broadcast is a matter of luck.
    texts = cut_lineage(rows_of.join(ends.hint("merge"), "node").dropDuplicates(), "texts")

    # A class confirms its most similar candidate, and the one that most classes have named: copies
    # of one original are often liker to each other than to it, but linked with it alone.
    ways = F.explode(F.array(F.struct("a", "b", "same"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "same"))).alias("w")
    both = cut_lineage(pairs.filter("a <> b").select(ways).select("w.*"), "ways")
    named_by = both.groupBy("b").agg(F.count("*").alias("named"))
    of_a = Window.partitionBy("a")
    ranked = both.join(named_by, "b").withColumn("like", F.row_number().over(of_a.orderBy(F.desc("same"), "b")))
    ranked = ranked.withColumn("hub", F.row_number().over(of_a.orderBy(F.desc("named"), F.desc("same"), "b")))
    named = ranked.filter("like = 1 or hub = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = _joined(confirmed(named, texts, percent, words).unionByName(_one_id(signed, classes)))

    known = reps.join(roots, "node", "left").select(*reps.columns, F.coalesce("root", "node").alias("root"))
    apart = cut_lineage(candidates(cut_lineage(known, "known"), only_best=False, percent=percent).select("a", "b"), "apart")
    # rows that only the second walk found a candidate for
    late = apart.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(ends, "node", "left_anti")
    texts = texts.unionByName(rows_of.join(late.hint("merge"), "node").dropDuplicates())
    links = confirmed(apart, texts, percent, words)
    links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = _joined(links)

    named = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    out = signed.select("doc", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        component.eqNullSafe(F.col("doc")).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = sh.WORDS_EACH
) -> DataFrame:
    """The rows whose id names its component: one document of each group. All columns come back."""
    name = free_name(docs, "_kept_id")
    kept = near_components(docs, id_col, text_col, percent, words).filter("kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept[name]), "left_semi")
