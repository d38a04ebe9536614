"""Ranked lexical search over bit-sliced Bloom signatures, with exact rescoring of what they leave open."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.bpe import small_batches
from holdfast.llm.common import text_batches
from holdfast.session import cut_lineage

#: Term frequencies from which a term also sets the bits of a level.
LEVELS = (1, 2, 4, 8, 16)
#: Bits that a (term, level) sets, and rows of slices per such key (at least; rounded up to a power of 2).
PROBES, ROWS_PER_KEY = 4, 12
#: A block of signatures holds so many documents and bits at most (one document at least).
BLOCK_DOCS, BLOCK_BITS = 1024, 1 << 22
#: Rows of blocks that travel to a task at once.
BLOCKS_PER_BATCH = 40
#: Terms whose partial counts a task holds before it passes them on.
TERMS_HELD = 200_000
#: Items, and terms of items, that are searched together; one item is never divided.
ITEMS_EACH, ITEM_TERMS_EACH = 512, 50_000
#: Documents of the highest bounds that are scored first, so that a 10th-best score is known. No limit of the result.
FIRST_DOCS = 40
#: Whole numbers up to 2^24 add up exactly in single precision; weights are below 2^15.
TERMS_AT_ONCE = 500
BATCH_BYTES = 2_000_000

#: A-Z lower-cased; all other ASCII but digits and a-z divides terms.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order, with repeats."""
    return raw.translate(_TABLE).split(b" ") if raw else []


def term_counts(raw: bytes | None) -> tuple[Counter, int]:
    counts = Counter(terms_of(raw))
    counts.pop(b"", None)
    return counts, sum(counts.values())


def _mixed(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    x = keys.astype(np.uint64) + (np.uint64(level + 1) << np.uint64(33)) if np.isscalar(level) else keys
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rows(mixed: np.ndarray, rows: int) -> np.ndarray:
    """The slices (PROBES for each key) that a key's documents set, of a block with so many slices."""
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    tries = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((mixed + tries * step) & np.uint64(rows - 1)).astype(np.int64)


class _Block:
    """Documents of like size whose signatures are sliced together."""

    def __init__(self, rows: int):
        self.rows = rows
        self.room = max(1, min(BLOCK_DOCS, BLOCK_BITS // rows))
        self.ids: list = []
        self.sizes: list[int] = []
        self.most: list[int] = []
        self.keys: list[np.ndarray] = []

    def row(self) -> dict:
        doc = np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys])
        bits = np.zeros((self.rows, len(self.keys)), dtype=bool)
        for at in _rows(np.concatenate(self.keys), self.rows):
            bits[at, doc] = True
        return {"ids": self.ids, "sizes": self.sizes, "most": self.most, "slices": np.packbits(bits, axis=1).tobytes(), "rows": self.rows}


def index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The written index: rows with `slices` are blocks of signatures, rows with `term` partial counts
    of the documents that hold a term."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, _Block] = {}
        holders: Counter = Counter()
        kind = None
        for batch in text_batches(batches, 1, BATCH_BYTES):
            kind = batch.column(0).type
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts, n = term_counts(raw)
                if not n:
                    continue
                holders.update(counts.keys())
                sums = np.fromiter(map(zlib.crc32, counts), dtype=np.uint32, count=len(counts))
                often = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                keys = np.concatenate([_mixed(sums[often >= least], i) for i, least in enumerate(LEVELS)])
                rows = 1 << max(6, int(ROWS_PER_KEY * len(keys) - 1).bit_length())
                block = open_blocks.setdefault(rows, _Block(rows))
                block.ids.append(doc)
                block.sizes.append(n)
                block.most.append(int(often.max()))
                block.keys.append(keys)
                if len(block.ids) >= block.room:
                    yield _index_batch(kind, [open_blocks.pop(rows).row()], {})
            if len(holders) >= TERMS_HELD:
                yield _index_batch(kind, [], holders)
                holders.clear()
        for block in open_blocks.values():
            yield _index_batch(kind, [block.row()], {})
        if holders:
            yield _index_batch(kind, [], holders)

    schema = f"ids array<{id_type}>, sizes array<long>, most array<long>, rows int, slices binary, term binary, holders long"
    return cut_lineage(source.mapInArrow(run, schema), "signatures")


def _index_batch(kind: pa.DataType, blocks: list[dict], holders: dict[bytes, int]) -> pa.RecordBatch:
    none = [None] * len(holders)
    longs = pa.list_(pa.int64())
    columns = {
        "ids": pa.array([b["ids"] for b in blocks] + none, pa.list_(kind)), "sizes": pa.array([b["sizes"] for b in blocks] + none, longs),
        "most": pa.array([b["most"] for b in blocks] + none, longs), "rows": pa.array([b["rows"] for b in blocks] + none, pa.int32()),
        "slices": pa.array([b["slices"] for b in blocks] + none, pa.binary()),
        "term": pa.array([None] * len(blocks) + list(holders), pa.binary()),
        "holders": pa.array([None] * len(blocks) + list(holders.values()), pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _items(items: DataFrame, indexed: DataFrame, n_docs: int, item_col: str, text_col: str) -> DataFrame:
    """One row per item: id, the terms that some document holds, their weights."""
    source = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    id_type = source.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(term_counts(raw)[0]) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], names=["item", "terms"])

    asked = source.mapInArrow(run, f"item {id_type}, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()
    wanted = asked.select("term").distinct()
    # the few partial counts of asked terms are left before anything is shuffled, if those are small
    held = indexed.filter("term is not null").select("term", "holders").join(wanted, "term")
    held = held.groupBy("term").agg(F.sum("holders").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(held, "term").select("item", F.struct("term", weight.alias("weight")).alias("t"))
    return weighed.groupBy("item").agg(F.collect_list("t").alias("terms"))


class Asked:
    """Items that are searched together, with the corpus figures that scores need."""

    def __init__(self, items: list[tuple], n_docs: int, n_terms: int):
        self.ids = [item for item, _ in items]
        self.terms: dict[bytes, int] = {}
        self.places, self.weights = [], []
        for _, own in items:
            self.places.append(np.array([self.terms.setdefault(t, len(self.terms)) for t, _ in own], dtype=np.int64))
            self.weights.append(np.array([w for _, w in own], dtype=np.int64))
        self.pairs = [list(own) for _, own in items]
        self.n_docs, self.n_terms = n_docs, n_terms
        #: what a document needs to enter the result: a higher score, or this score and no higher id
        self.least = [(0, None)] * len(items)
        sums = np.fromiter(map(zlib.crc32, self.terms), dtype=np.uint32, count=len(self.terms))
        self.keys = [_mixed(sums, i) for i in range(len(LEVELS))]

    def length_norm(self, n):
        return 10 + (90 * n * self.n_docs) // self.n_terms

    def bounds(self, sizes: np.ndarray, most: np.ndarray, rows: int, raw: bytes) -> np.ndarray:
        """No less than the score of every (item, document) of a block.

        A bit of a level may be set by chance, never be missing. So a term counts with the share of
        the highest frequency under the next level, for the highest level whose bits are all set.
        """
        slices = np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1)
        norm = self.length_norm(sizes)
        out = np.zeros((len(self.ids), len(sizes)), dtype=np.int64)
        present, under = None, 0
        for i, keys in enumerate(self.keys):
            top = most if i + 1 == len(LEVELS) else np.minimum(most, LEVELS[i + 1] - 1)
            share = (1_000_000_000 * top) // (1000 * top + 8 * norm)
            tried = _rows(keys, rows)
            own = slices[tried[0]]
            for at in tried[1:]:
                own &= slices[at]
            present = own if present is None else present & own
            if not present.any():
                break
            full = np.unpackbits(present, axis=1, count=len(sizes)).astype(np.float32)
            for item, (places, weights) in enumerate(zip(self.places, self.weights)):
                for cut in range(0, len(places), TERMS_AT_ONCE):
                    some = weights[cut : cut + TERMS_AT_ONCE].astype(np.float32) @ full[places[cut : cut + TERMS_AT_ONCE]]
                    out[item] += some.astype(np.int64) * (share - under)
            under = share
        return out

    def score(self, item: int, counts: Counter, norm: int) -> int:
        total = 0
        for term, weight in self.pairs[item]:
            tf = counts.get(term)
            if tf:
                total += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))
        return total

    def enters(self, item: int, score: int, doc) -> bool:
        least, last = self.least[item]
        return score > least or (score == least > 0 and doc <= last)


def _masks(chosen: np.ndarray) -> list[np.ndarray]:
    """Which items (rows) are chosen for a document (columns), as 64-bit words."""
    words = -(-chosen.shape[0] // 64)
    padded = np.zeros((chosen.shape[1], words * 64), dtype=bool)
    padded[:, : chosen.shape[0]] = chosen.T
    packed = np.packbits(padded, axis=1, bitorder="little")
    return list(np.ascontiguousarray(packed).view("<i8").T)


def _candidates(indexed: DataFrame, asked: Asked, first: bool) -> DataFrame:
    """(id, w0, w1, ...): documents with the items they may rank for, in 64-bit words.

    In the first pass a task names its documents of the highest bounds for each item and the highest
    of all tasks are taken; in the second one it names all that the scores known then do not rule out.
    """
    spark = indexed.sparkSession
    blocks = indexed.filter("slices is not null").select("ids", "sizes", "most", "rows", "slices")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    shared = spark.sparkContext.broadcast(asked)
    words = [f"w{i}" for i in range(-(-len(asked.ids) // 64))]

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for ids, sizes, most, rows, raw in zip(*(c.to_pylist() for c in batch.columns)):
                named = np.array([i is not None for i in ids], dtype=bool)
                bounds = shared.value.bounds(np.array(sizes), np.array(most), rows, raw)
                yield np.array(ids, dtype=object), np.where(named, bounds, 0)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object))] * len(shared.value.ids)
        for ids, bounds in read(batches):
            for item, row in enumerate(bounds):
                floor = best[item][0].min() if len(best[item][0]) >= FIRST_DOCS else 0
                some = np.flatnonzero(row > floor)
                if len(some) > FIRST_DOCS:
                    some = some[np.argpartition(-row[some], FIRST_DOCS - 1)[:FIRST_DOCS]]
                if len(some):
                    values, names = np.append(best[item][0], row[some]), np.append(best[item][1], ids[some])
                    keep = np.argsort(-values, kind="stable")[:FIRST_DOCS]
                    best[item] = values[keep], names[keep]
        for item, (values, names) in enumerate(best):
            if len(values):
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(names.tolist(), batch_type(id_type)), "item": pa.array([item] * len(values), pa.int32()),
                    "bound": pa.array(values)})

    def open_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        least = np.array([score for score, _ in own.least], dtype=np.int64)[:, None]
        for ids, bounds in read(batches):
            chosen = bounds > least
            for item, doc in np.argwhere((bounds == least) & (least > 0)).tolist():
                chosen[item, doc] = own.enters(item, int(bounds[item, doc]), ids[doc])
            some = np.flatnonzero(chosen.any(axis=0))
            if len(some):
                columns = [pa.array(ids[some].tolist(), batch_type(id_type)), *(pa.array(w) for w in _masks(chosen[:, some]))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *words])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCKS_PER_BATCH))
    if first:
        found = blocks.mapInArrow(highest, f"id {id_type}, item int, bound long")
        turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "id"))
        found = found.withColumn("turn", turn).filter(F.col("turn") <= FIRST_DOCS)
        bit = [F.when((F.col("item") / 64).cast("int") == i, F.expr("shiftleft(1L, item % 64)")).otherwise(F.lit(0).cast("long")).alias(w)
               for i, w in enumerate(words)]
        found = found.select("id", *bit)
    else:
        found = blocks.mapInArrow(open_ones, f"id {id_type}, " + ", ".join(f"{w} long" for w in words))
    # rows that repeat an id share what is known of each
    found = cut_lineage(found.groupBy("id").agg(*(F.bit_or(w).alias(w) for w in words)), "open")
    small_batches(spark)
    return found


def batch_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[name]


def _scored(docs: DataFrame, found: DataFrame, asked: Asked, id_col: str, text_col: str) -> DataFrame:
    """(item, doc, score): exact scores of the named documents that enter the result as far as is known."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    words = found.columns[1:]
    rows = source.join(found, "id").select("id", "text", *words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            masks = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1).astype("<i8")
            wanted = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")
            made: list[tuple] = []
            for doc, raw, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), wanted):
                counts, n = term_counts(raw)
                norm = own.length_norm(n)
                for item in np.flatnonzero(mask).tolist():
                    score = own.score(item, counts, norm)
                    if score > 0 and own.enters(item, score, doc):
                        made.append((item, doc, score))
            items, names, scores = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), pa.array(names, batch.column(0).type), pa.array(scores, pa.int64())], names=["item", "doc", "score"])

    return rows.mapInArrow(run, f"item int, doc {kind}, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", turn).filter(F.col("rank") <= k)


def _search(docs: DataFrame, indexed: DataFrame, asked: Asked, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, doc, score) of items that are searched together; item is a place among them."""
    first = _best(_scored(docs, _candidates(indexed, asked, first=True), asked, id_col, text_col), k)
    # the k-th best of some documents is a floor for the k-th best of all; one row per item
    for r in first.filter(F.col("rank") == k).select("item", "score", "doc").collect():
        asked.least[r["item"]] = (r["score"], r["doc"])
    return _best(_scored(docs, _candidates(indexed, asked, first=False), asked, id_col, text_col), k)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in items.toLocalIterator():
        own = [(bytes(t["term"]), t["weight"]) for t in r["terms"]]
        if held and (len(held) >= ITEMS_EACH or size + len(own) > ITEM_TERMS_EACH):
            yield held
            held, size = [], 0
        held.append((r["item"], own))
        size += len(own)
    if held:
        yield held


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item id, rank, document id, score): the k documents of the highest score for each item.

    Terms are runs of ASCII letters and digits and of all other characters, A-Z lower-cased. With N
    documents that have terms, L terms in all, n in a document and df documents holding a term: its weight w is
    floor(1000 ln((2N+2)/(2df+1))), m is 10 + 90 n N div L, and a document scores the sum of
    w * (10^9 tf div (1000 tf + 8 m)) over the item's distinct terms. Equal scores rank by ascending id;
    documents of score 0 are left out, so an item may have fewer rows or none.

    Documents of like size share a block of bit slices. A term, and the levels its frequency reaches, sets
    some slices of its document; the slices of an item's terms, weighted and added up, bound all scores
    of a block from above. The documents of the highest bounds are scored first; every document whose
    bound still reaches an item's k-th best score is then scored from its whole text.

    Null texts have no terms. Rows without an id count in N, L and df but cannot be named. Rows that
    repeat an id are documents of their own and may both be ranked. Items that repeat an id are one
    item with the terms of all; an item with a null id is ranked under it. Items are searched in
    blocks of bounded size. Other columns are ignored; empty tables give an empty one.
    """
    spark = docs.sparkSession
    indexed = index(docs, id_col, text_col)
    sizes = indexed.filter("slices is not null").select(
        F.size("sizes").alias("n"), F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("l"))
    total = sizes.agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    item_type = items.select(item_col).schema[0].dataType
    id_type = docs.select(id_col).schema[0].dataType
    done = spark.createDataFrame([], f"{item_col} {item_type.simpleString()}, rank int, {id_col} {id_type.simpleString()}, score long")
    if not total["n"]:
        return done
    parts = []
    for block in _item_blocks(cut_lineage(_items(items, indexed, total["n"], item_col, item_text_col), "items")):
        asked = Asked(block, total["n"], total["l"])
        found = cut_lineage(_search(docs, indexed, asked, k, id_col, text_col), "ranked")
        parts.append(_named(spark, found, asked, item_col, item_type.simpleString(), id_col))
    return reduce(DataFrame.unionByName, parts) if parts else done


def _named(spark: SparkSession, found: DataFrame, asked: Asked, item_col: str, item_type: str, id_col: str) -> DataFrame:
    """Places of a block's items replaced by their ids; at most ITEMS_EACH, so they are a literal."""
    ids = F.array(*(F.lit(i).cast(item_type) for i in asked.ids))
    return found.select(
        F.element_at(ids, F.col("item") + 1).alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
