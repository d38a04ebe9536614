"""Byte-pair encoding and decoding with a pair occurrence index over the words of a partition."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from holdfast.llm.common import free_name

#: White space of the Unicode standard; Python's own split() also cuts at the four file separators.
WHITE = "\t-\r \x85\xa0  -     　"
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Fixed pattern of the vocabulary's word splitter.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
#: Texts are encoded together until they have so many characters; pieces known to a task are
#: forgotten beyond so many. Both bound memory and change no result.
BATCH_CHARS = 2_000_000
KNOWN_PIECES = 150_000
ARROW_ROWS = 500


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file with word ends."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        end = model["end_of_word_suffix"]
        ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names: dict[int, str] = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([ids[c + end] for c in letters], dtype=np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = (self.left << 20) | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge exists."""
        keys = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the offsets of the words.

        All words form one row of symbols. The index holds, for every rank, the positions of its
        pair. The lowest active rank is applied to all its positions at once; each application
        changes the pairs to its left and right, which join the lists of their own ranks.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        full = ends[sizes > 0]
        symbols[full - 1] = self.last[raw[full - 1]]
        n = len(symbols)
        after = np.arange(1, n + 1)
        after[full - 1] = -1
        before = np.arange(-1, n - 1)
        before[full - sizes[sizes > 0]] = -1
        alive = np.ones(n, dtype=bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            ranks = self.ranks(symbols[positions], symbols[after[positions]])
            known = ranks >= 0
            positions, ranks = positions[known], ranks[known]
            if not len(positions):
                return
            by = np.argsort(ranks, kind="stable")
            positions, ranks = positions[by], ranks[by]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for part, rank in zip(np.split(positions, cuts), ranks[np.r_[0, cuts]].tolist()):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        enter(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            at = at[alive[at] & (symbols[at] == a) & (after[at] >= 0)]
            at = at[symbols[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair, from the left
                starts = np.r_[True, after[at[:-1]] != at[1:]]
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follows = after[gone]
            symbols[at] = self.made[rank]
            alive[gone] = False
            after[at] = follows
            has = follows >= 0
            before[follows[has]] = at[has]
            lefts = before[at]
            enter(np.unique(np.concatenate([lefts[lefts >= 0], at[has]])))
        counts = np.concatenate([[0], np.cumsum(alive)])
        return symbols[alive], np.concatenate([[0], counts[ends]])


class Encoder:
    """Encodes batches of texts; remembers the pieces between white space that a task has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str | int, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(1, dtype=np.int64)
        self.fresh: list[str | int] = []
        self.shown: list[str] = []

    def _pieces(self, text: str) -> Iterator[str | int]:
        cut = self.vocabulary.cut
        if cut is None or "<|" not in text:
            yield from normal_pieces(text)
            return
        done = 0
        for found in cut.finditer(text):
            yield from normal_pieces(text[done : found.start()])
            yield self.vocabulary.special[found[0]]
            done = found.end()
        yield from normal_pieces(text[done:])

    def _number(self, piece: str | int) -> int:
        self.fresh.append(piece)
        self.known[piece] = number = len(self.known)
        return number

    def _learn(self) -> None:
        """Encode the pieces met for the first time."""
        words: dict[bytes, int] = {}
        parts: list[list[int]] = []
        for piece in self.fresh:
            if isinstance(piece, int):
                parts.append([-1 - piece])
                continue
            own = [w.encode("utf-8", "surrogatepass") for w in WORDS.findall(piece)]
            parts.append([words.setdefault(w, len(words)) for w in own])
        ids, starts = self.vocabulary.merge(list(words))
        ids = ids.astype(np.uint32)
        made, names = [], self.vocabulary.names
        for own in parts:
            found = [ids[starts[w] : starts[w + 1]] if w >= 0 else np.array([-1 - w], dtype=np.uint32) for w in own]
            made.append(found[0] if len(found) == 1 else np.concatenate(found) if found else ids[:0])
        sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, *made])
        self.shown.extend(decode(names, m.tolist()) for m in made)
        self.fresh = []

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids and decoded text of every text."""
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        known, number, numbered = self.known, self._number, []
        for text in texts:
            if "<|" in text:
                pieces = list(self._pieces(text))
            else:
                pieces = normal_pieces(text)
            numbered.append(np.array([known[p] if p in known else number(p) for p in pieces], dtype=np.int64))
        if self.fresh:
            self._learn()
        for at in numbered:
            first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
            total = np.cumsum(sizes)
            place = np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - sizes), sizes)
            shown = self.shown
            yield self.ids[place], " ".join([shown[i] for i in at[sizes > 0].tolist()])


def normal_pieces(text: str) -> list[str]:
    """Normalised text between white space: composed, then lower-cased letter by letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # str.lower() would look at the letter's neighbours
            text = text.replace("Σ", "σ")
    if SEPARATORS.search(text):
        return [p for p in regex.split(f"[{WHITE}]+", text.lower()) if p]
    return text.lower().split()


def decode(names: dict[int, str], ids: list[int]) -> str:
    """Token strings joined by spaces, as the tokenizer file names no decoder."""
    return " ".join([names[i] for i in ids])


@lru_cache(maxsize=2)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def read_vocabulary(path: str) -> str:
    """Content of a tokenizer file; a few MB, fixed, shipped to the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined up to BATCH_CHARS characters; a longer single batch passes as it is."""
    held: list[pa.RecordBatch] = []
    chars = 0
    for batch in batches:
        held.append(batch)
        chars += batch.column(column).nbytes
        if chars >= BATCH_CHARS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, chars = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rest[0]


def encode(
    docs: DataFrame, path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")
) -> DataFrame:
    """The table with the columns named in `outputs`, computed from the whole text of every row.

    ids (array of int), n_tokens, decoded (text), ids_sha256 (of the ids as little-endian unsigned
    32-bit numbers), decoded_sha256 (of the UTF-8 bytes). A null text counts as empty: no ids and an
    empty decoded text. The strings of special tokens in a text become their ids. A column of the
    table that has the name of an output is replaced. Rows are independent, so repeated rows and
    ids give equal results, and an empty table an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "decoded": T.StringType(),
             "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    lowered = {o.lower() for o in outputs}
    passed = [c for c in docs.columns if c.lower() not in lowered]
    source = docs.select(*passed, docs[text_col].cast("string").alias(free_name(docs, "_bpe_text")))
    schema = T.StructType([source.schema[c] for c in passed] + [T.StructField(o, kinds[o]) for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(vocabulary.value))
        for batch in _batches(batches, len(passed)):
            texts = [t or "" for t in batch.column(len(passed)).to_pylist()]
            made: dict[str, list] = {o: [] for o in outputs}
            for ids, shown in encoder.encode(texts):
                for o in outputs:
                    made[o].append(_output(o, ids, shown))
            arrays = [_array(o, made[o]) for o in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*passed, *outputs])

    return source.mapInArrow(run, schema)


def _output(name: str, ids: np.ndarray, shown: str):
    if name == "ids":
        return ids
    if name == "n_tokens":
        return len(ids)
    if name == "decoded":
        return shown
    if name == "ids_sha256":
        return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
    return hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest()


def _array(name: str, values: list) -> pa.Array:
    if name == "ids":
        ends = np.cumsum([0, *map(len, values)])
        flat = np.concatenate([np.zeros(0, dtype=np.uint32), *values]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    return pa.array(values, pa.int64() if name == "n_tokens" else pa.string())


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The table with the decoded text of an id array; a null array decodes to the empty text."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    passed = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([df.schema[c] for c in passed] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _vocabulary(vocabulary.value).names
        for batch in batches:
            texts = [decode(names, ids or []) for ids in batch.column(passed.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*passed, out])

    return df.select(*passed).mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that long texts do not meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
