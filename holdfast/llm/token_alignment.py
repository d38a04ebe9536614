"""Alignment of the tokens of two tokenizers by their byte ranges, in Arrow columns."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.bpe import byte_letters, small_batches
from holdfast.llm.common import python_texts, text_batches
from holdfast.session import cut_lineage

#: Texts that are aligned at once: memory grows with it, results do not.
UNIT_BYTES = 3_000_000
SPACE = "▁"


class ByteLevel:
    """Byte-level pairs: ids of a text without special tokens, and the bytes of every id."""

    def __init__(self, text: str):
        data = json.loads(text)
        byte_of = {letter: i for i, letter in enumerate(byte_letters())}
        special = {t["content"] for t in data["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, name)): i for name, i in data["model"]["vocab"].items() if name not in special}
        self.model = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(data["model"]["vocab"].values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """SentencePiece: ids of a text, which gets a space in front, and the bytes of every id."""

    def __init__(self, raw: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(n[1:-1], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)
        ]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _both(byte_level: str, pieces: bytes) -> tuple:
    """Both tokenizers, with the bytes and the decimal form of every id as Arrow columns."""
    sides = ByteLevel(byte_level), Pieces(pieces)
    tables = [(pa.array(s.bytes, pa.large_binary()), pa.array(map(str, range(len(s.bytes))), pa.large_string())) for s in sides]
    return sides, tables


def read_models(byte_level_path: str, pieces_path: str) -> tuple[str, bytes]:
    """Contents of both files: a few MB, fixed, shipped to the tasks."""
    with open(byte_level_path, encoding="utf-8") as file, open(pieces_path, "rb") as other:
        return file.read(), other.read()


class Side:
    """The tokens of all texts of a unit under one tokenizer."""

    def __init__(self, ids: pa.LargeListArray, table: tuple[pa.Array, pa.Array]):
        self.ids = pc.list_flatten(ids)
        self.doc = pc.list_parent_indices(ids)
        self.starts = ids.offsets.to_numpy()
        spelt = table[0].take(self.ids)
        self.joined = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, spelt), pa.scalar(b"", pa.large_binary()))
        # a running sum over the whole unit, and over each document by taking off what stood before it
        self.running = pc.cumulative_sum(pc.binary_length(spelt).cast(pa.int64())).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], self.running])[self.starts[:-1]]
        self.ends = self.running - before[self.doc.to_numpy()]
        self.printed = table[1]

    def keyed(self, name: str) -> pa.Table:
        return pa.table({"doc": self.doc, "end": self.ends, name: np.arange(len(self.ids))})

    def groups(self, cuts: np.ndarray) -> pa.Array:
        """Decimal ids joined by commas, of the tokens between consecutive cuts (places of last tokens)."""
        offsets = pa.array(np.concatenate([[0], cuts + 1]), pa.int64())
        lists = pa.LargeListArray.from_arrays(offsets, self.printed.take(self.ids))
        return pc.binary_join(lists, pa.scalar(",", pa.large_string()))


def _lists(ids: list[list[int]], keep: np.ndarray | None = None) -> pa.LargeListArray:
    if keep is not None:
        ids = [own if k else [] for own, k in zip(ids, keep.tolist())]
    return pa.array(ids, pa.large_list(pa.int32()))


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places and their counts: differences in byte planes, deflated."""
    both = np.stack([np.diff(places, prepend=0), counts]).astype("<u4")
    return zlib.compress(np.ascontiguousarray(both.reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def align_unit(texts: list[str], sides: tuple, tables: list) -> tuple[dict[str, list], pa.Table]:
    """Columns per text, and the unit's partial counts of id pairs (place, a, b, n).

    `links` holds a text's distinct pairs, as places in the partial counts, with their numbers.
    """
    ids = [side.ids(texts) for side in sides]
    whole = pa.array([b" " + t.encode() if t else b"" for t in texts], pa.large_binary())
    found = [Side(_lists(own), table) for own, table in zip(ids, tables)]
    same = [pc.equal(side.joined, whole).to_numpy(zero_copy_only=False) for side in found]
    keep = same[0] & same[1] & np.array([len(t) > 0 for t in texts], dtype=bool)
    if not keep.all():
        found = [Side(_lists(own, keep), table) for own, table in zip(ids, tables)]
    a, b = found

    # groups end where tokens of both end in the same document
    met = a.keyed("a").join(b.keyed("b"), ["doc", "end"], join_type="inner", use_threads=False)
    last_b = np.full(len(a.ids), -1, dtype=np.int64)
    last_b[met["a"].to_numpy()] = met["b"].to_numpy()
    cut_a = np.flatnonzero(last_b >= 0)
    cut_b = last_b[cut_a]
    spelt = pc.binary_join_element_wise(a.groups(cut_a), b.groups(cut_b), pa.scalar("|", pa.large_string()))
    first_group = np.searchsorted(cut_a, a.starts)
    spelt = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first_group, pa.int64()), spelt), pa.scalar(";", pa.large_string()))

    # between two neighbouring ends lies one token of each side: the end's byte tells which
    size = int(a.running[-1]) if len(a.ids) else 0
    ends_a, ends_b = np.zeros(size, dtype=np.int8), np.zeros(size, dtype=np.int8)
    ends_a[a.running - 1] = 1
    ends_b[b.running - 1] = 1
    at = np.flatnonzero(ends_a | ends_b)
    of_a = (np.cumsum(ends_a, dtype=np.int64)[at] - ends_a[at])
    of_b = (np.cumsum(ends_b, dtype=np.int64)[at] - ends_b[at])
    links = pa.table({"a": a.ids.take(pa.array(of_a)), "b": b.ids.take(pa.array(of_b))})
    doc = a.doc.to_numpy()[of_a]

    counts = links.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by([("count_all", "descending")])
    code = lambda t: pc.add(pc.multiply(t["a"].cast(pa.int64()), 1 << 32), t["b"].cast(pa.int64()))
    place = pc.index_in(code(links), value_set=code(counts).combine_chunks()).to_numpy()
    keys = np.sort((doc.astype(np.int64) << 32) | place)
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(heads, len(keys)))
    own = keys[heads]
    cuts = np.searchsorted(own, np.arange(len(texts) + 1, dtype=np.int64) << 32)
    packed = [pack(own[i:j] & 0xFFFFFFFF, times[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    n_a, n_b, n_groups = np.diff(a.starts), np.diff(b.starts), np.diff(first_group)
    columns = {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(texts)),
        "groups": spelt.to_pylist(), "links": packed,
    }
    partial = pa.table({
        "place": pa.array(np.arange(counts.num_rows, dtype=np.int32)), "a": counts["a"], "b": counts["b"], "n": counts["count_all"]})
    return columns, partial


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _aligned(docs: DataFrame, models: tuple[str, bytes], id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    """The documents of all units and their partial counts, in one written table: rows with `links`
    are documents, rows with `place` are counts."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(models)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc"].dataType.simpleString()
    schema = f"unit long, doc {id_type}, {_DOC}, groups string, links binary, place int, a int, b int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, tables = _both(*shared.value)
        unit = TaskContext.get().partitionId() << 32
        for batch in text_batches(batches, 1, UNIT_BYTES):
            columns, partial = align_unit(python_texts(batch.column(1)), sides, tables)
            groups = columns["groups"]
            yield _row_batch(unit, batch.num_rows, {
                "doc": batch.column(0), **{c: pa.array(columns[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]),
                "groups": pa.array(groups if keep_groups else [None] * len(groups), pa.string()),
                "links": pa.array(columns["links"], pa.binary())}, batch.column(0).type)
            for part in partial.combine_chunks().to_batches():
                yield _row_batch(unit, part.num_rows, dict(zip(part.schema.names, part.columns)), batch.column(0).type)
            unit += 1

    return cut_lineage(rows.mapInArrow(run, schema), "aligned")


_KINDS = {
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "groups": pa.string(), "links": pa.binary(), "place": pa.int32(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64(),
}


def _row_batch(unit: int, rows: int, known: dict[str, pa.Array], id_type: pa.DataType) -> pa.RecordBatch:
    columns = {"unit": pa.array(np.full(rows, unit)), "doc": known.get("doc", pa.nulls(rows, id_type))}
    for name, kind in _KINDS.items():
        columns[name] = known[name].cast(kind) if name in known else pa.nulls(rows, kind)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _totals(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best): corpus-wide links of every id pair, and whether no pair of its b has more."""
    totals = cut_lineage(aligned.filter("place is not null").groupBy("a", "b").agg(F.sum("n").alias("links")), "pairs")
    most = totals.groupBy("b").agg(F.max("links").alias("most"))
    return totals.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def pair_counts(
    docs: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(a, b, links, best): how many links of the corpus hold an id of the first and one of the second
    tokenizer, and whether that is the most for b (ties included). Texts as in `align`."""
    return _totals(_aligned(docs, read_models(byte_level_path, pieces_path), id_col, text_col, keep_groups=False))


def align(
    docs: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text",
    keep_groups: bool = False,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a are the ids of the space and the text under byte-level pairs, b those of the text under
    SentencePiece, both without special tokens. Offsets where tokens of both end cut them into groups,
    written `a1,a2|b1;a3|b2`; `keep_groups` adds the written groups as a column. A link is a pair of
    tokens whose byte ranges overlap. n_best counts the links whose id pair has the most links of its
    b in the corpus, ties included; count_sum adds up the links that the pairs of a document's links
    have in the corpus.

    A text that is null or empty, or that one of the tokenizers changes, has no tokens: zeros and an
    empty groups_sha256. Rows that repeat an id or a text count each; a null id stays null; other
    columns are ignored; an empty table gives an empty one.

    Texts are aligned in units of bounded size inside a task. A unit passes on its partial counts,
    which Spark adds up, and every unit gets back only the totals of its own pairs, so neither the pair table
    nor the links of one frequent pair ever meet in one place.
    """
    aligned = _aligned(docs, read_models(byte_level_path, pieces_path), id_col, text_col, keep_groups)
    own = aligned.filter("place is not null").select(F.col("unit").alias("of"), "place", "a", "b")
    looked_up = own.join(_totals(aligned), ["a", "b"]).select("of", "place", "links", "best")
    rows = aligned.filter("place is null").drop("place", "a", "b", "n")
    id_type = aligned.schema["doc"].dataType.simpleString()

    def run(unit: pa.Table, counts: pa.Table) -> pa.Table:
        links, best = np.zeros(counts.num_rows, dtype=np.int64), np.zeros(counts.num_rows, dtype=np.int64)
        place = counts["place"].to_numpy()
        links[place] = counts["links"].to_numpy()
        best[place] = counts["best"].cast(pa.int8()).to_numpy()
        sums, bests = [], []
        for raw in unit["links"].to_pylist():
            at, times = unpack(raw)
            sums.append(int(links[at] @ times))
            bests.append(int(best[at] @ times))
        done = unit.drop_columns(["unit", "links"])
        return done.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    schema = f"doc {id_type}, {_DOC}, groups string, n_best long, count_sum long"
    out = rows.groupBy("unit").cogroup(looked_up.groupBy("of")).applyInArrow(run, schema)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])]
    return out.select(F.col("doc").alias(id_col), *names)
