"""SentencePiece encoding and decoding by a table of the last token of every prefix."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from holdfast.llm.bpe import small_batches
from holdfast.llm.common import free_name, lenient_text, python_texts, text_batches

#: What stands for a space inside pieces.
SPACE = "▁"
#: Shown for the unknown id when ids are decoded.
UNKNOWN_SHOWN = " ⁇ "
#: Bounds of memory that change no result: texts of a batch, words and pairs that a task remembers.
BATCH_BYTES = 2_000_000
KNOWN_WORDS = 150_000
KNOWN_PAIRS = 1_000_000


class Pieces:
    """Pieces, scores and kinds of a byte-fallback model whose symbols merge in the order of scores.

    The model must be of the merge kind, with the identity normaliser and a dummy prefix.
    """

    def __init__(self, rows: tuple[tuple[str, float, str], ...]):
        self.names = [name for name, _, _ in rows]
        self.kinds = [kind for _, _, kind in rows]
        self.score = {name: score for name, score, kind in rows if kind == "normal"}
        self.ids = {name: i for i, (name, _, kind) in enumerate(rows) if kind == "normal"}
        self.bytes = {int(name[1:-1], 16): i for i, (name, _, kind) in enumerate(rows) if kind == "byte"}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        several = [name for name in self.ids if len(name) > 1]
        inner = {b for name in several for a, b in zip(name, name[1:]) if a != SPACE}
        joined = {c for name in several for c in name}
        # No piece goes on with a space after another character, or over a line end: words are independent.
        self.words = re.compile(".+", re.DOTALL)
        if SPACE not in inner:
            self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
            if "\n" not in joined:
                self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self._merges: dict[str, tuple | None] = {}
        self._pairs = 0
        #: (piece, its length, ids, printed ids, shown text, which pieces fit behind it) of every token
        self.tokens: dict[str, tuple] = {}
        self.automaton = ahocorasick.Automaton()
        for name in self.ids:
            if self.merges(name) is not None:
                self.automaton.add_word(name, self.token(name))
        self.automaton.make_automaton()

    def token(self, piece: str) -> tuple:
        """The entry of a piece, or of a character that is none and becomes its bytes."""
        if piece not in self.tokens:
            own = self.ids.get(piece)
            ids = [self.bytes[b] for b in piece.encode()] if own is None else [own]
            shown = piece.replace(SPACE, " ")
            entry = (piece, len(piece), ids, ",".join(map(str, ids)), shown, {})
            if own is None:  # characters are without bound, so they are not remembered
                return entry
            self.tokens[piece] = entry
        return self.tokens[piece]

    def merges(self, piece: str) -> tuple | None:
        """How a piece comes about alone: (scores, its last symbol, its first symbol) before each merge
        and at the end. None if merging its characters does not end in the piece."""
        if piece in self._merges:
            return self._merges[piece]
        symbols, scores = list(piece), []
        lasts, firsts = [symbols[-1]], [symbols[0]]
        while len(symbols) > 1:
            found = [(-self.score[s], i) for i, s in enumerate(map("".join, zip(symbols, symbols[1:]))) if s in self.score]
            if not found:
                break
            worst, at = min(found)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            scores.append(-worst)
            lasts.append(symbols[-1])
            firsts.append(symbols[0])
        made = (scores, lasts, firsts) if len(symbols) == 1 else None
        self._merges[piece] = made
        return made

    def fit(self, left: str, right: str) -> bool:
        """Whether the two stay apart when their text is encoded: no merge over the border is ever due.

        Inside each the merges run as they do alone, the higher score first, of equal scores the left
        one. The border's pair is due when it comes before the next merge of either side.
        """
        scores_a, lasts, _ = self.merges(left)
        scores_b, _, firsts = self.merges(right)
        i, j, out = 0, 0, True
        while True:
            next_a = scores_a[i] if i < len(scores_a) else None
            next_b = scores_b[j] if j < len(scores_b) else None
            border = self.score.get(lasts[i] + firsts[j])
            if border is not None and (next_a is None or border > next_a) and (next_b is None or border >= next_b):
                out = False
                break
            if next_a is None and next_b is None:
                break
            if next_b is None or (next_a is not None and next_a >= next_b):
                i += 1
            else:
                j += 1
        return out

    def split(self, word: str) -> list[tuple]:
        """The tokens of a text whose spaces are replaced.

        An encoding is right if and only if all its neighbouring tokens fit, so every prefix of the text has one
        last token: the piece that ends there and fits the last token of what stands before it. One
        walk of the automaton fills the table, the tokens are read from its end.
        """
        last: list[tuple | None] = [None] * (len(word) + 1)
        filled = 0  # prefixes up to this length have their token
        for end, entry in self.automaton.iter(word):
            if end < filled:
                continue
            while filled < end:  # no piece ends there: a character of its own
                filled += 1
                last[filled] = self.token(word[filled - 1])
            start = end + 1 - entry[1]
            if start:
                before = last[start]
                fits = before[5].get(entry[0])
                if fits is None:
                    fits = self.fit(before[0], entry[0])
                    self._pairs += 1
                    before[5][entry[0]] = fits
                if not fits:
                    continue
            filled = end + 1
            last[filled] = entry
        while filled < len(word):
            filled += 1
            last[filled] = self.token(word[filled - 1])
        out, at = [], len(word)
        while at:
            entry = last[at]
            out.append(entry)
            at -= entry[1]
        out.reverse()
        if self._pairs > KNOWN_PAIRS:
            self._pairs = 0
            for entry in self.tokens.values():
                entry[5].clear()
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes in a row are read as UTF-8, a first space is the dummy prefix, control
        ids show nothing."""
        out: list[str] = []
        held = bytearray()
        begun = False
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(lenient_text(bytes(held)))
                held.clear()
                begun = True
            kind, name = self.kinds[i], self.names[i]
            if kind == "control":
                continue
            if kind == "unknown":
                shown = UNKNOWN_SHOWN
            else:
                shown = name
                if not begun and shown.startswith(SPACE):
                    shown = shown[1:]
                shown = shown.replace(SPACE, " ")
            begun = True
            out.append(shown)
        if held:
            out.append(lenient_text(bytes(held)))
        return "".join(out)


def read_pieces(path: str) -> tuple[tuple[str, float, str], ...]:
    """(piece, score, kind) of every id of a model file: fixed size, shipped to the tasks."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def kind(i: int) -> str:
        if model.is_byte(i):
            return "byte"
        if model.is_control(i):
            return "control"
        return "unknown" if model.is_unknown(i) else "unused" if model.is_unused(i) else "normal"

    return tuple((model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size()))


@lru_cache(maxsize=2)
def pieces_of(rows: tuple) -> Pieces:
    return Pieces(rows)


class Encoder:
    """Encodes texts; remembers the words that a task has met, with their ids and what they decode to."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.made: list[list[int]] = []
        self.printed: list[str] = []
        self.shown: list[str] = []

    def _learn(self, word: str) -> int:
        tokens = self.pieces.split(word)
        self.known[word] = number = len(self.made)
        self.made.append([i for t in tokens for i in t[2]])
        self.printed.append(",".join([t[3] for t in tokens]))
        self.shown.append("".join([t[4] for t in tokens]))
        return number

    def numbers(self, text: str) -> list[int]:
        """The numbers of the words of a text; forgets between texts only."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        if not text:
            return []
        known, learn = self.known, self._learn
        words = self.pieces.words.findall(SPACE + text.replace(" ", SPACE))
        return [known[w] if w in known else learn(w) for w in words]

    def ids(self, numbers: list[int]) -> np.ndarray:
        made = self.made
        return np.array([i for n in numbers for i in made[n]], dtype=np.int32)


def _output(encoder: Encoder, name: str, numbers: list[int]):
    if name == "ids":
        return encoder.ids(numbers)
    if name == "n_tokens":
        made = encoder.made
        return sum([len(made[n]) for n in numbers])
    if name == "ids_sha256":
        printed = encoder.printed
        return hashlib.sha256(",".join([printed[n] for n in numbers]).encode()).hexdigest()
    shown = encoder.shown
    # the space that every text gets in front is no part of it
    text = "".join([shown[n] for n in numbers])[1:]
    return text if name == "decoded" else hashlib.sha256(text.encode()).hexdigest()


KINDS = {
    "ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "decoded": T.StringType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def encode(
    docs: DataFrame, path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")
) -> DataFrame:
    """The table with the columns named in `outputs`, computed from the whole text of every row.

    ids (array of int), n_tokens, decoded (text of the ids), ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the UTF-8 bytes). No begin or end ids; pieces of special names in a
    text are ordinary text. Null counts as empty: no ids, an empty decoded text. Bytes that are no
    UTF-8 count as U+FFFD. Rows are independent: repeated rows and ids give equal results, an empty
    table an empty one. A column of the table that has the name of an output is replaced.

    Words are encoded once a task, by the prefix table; where the vocabulary has pieces that reach over spaces
    a whole text is one word. Time and memory are linear in its length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = spark.sparkContext.broadcast(read_pieces(path))
    lowered = {o.lower() for o in outputs}
    passed = [c for c in docs.columns if c.lower() not in lowered]
    source = docs.select(*passed, docs[text_col].cast("string").alias(free_name(docs, "_pieces_text")))
    schema = T.StructType([source.schema[c] for c in passed] + [T.StructField(o, KINDS[o]) for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces_of(rows.value))
        for batch in text_batches(batches, len(passed), BATCH_BYTES):
            made: dict[str, list] = {o: [] for o in outputs}
            for text in python_texts(batch.column(len(passed))):
                numbers = encoder.numbers(text)
                for o in outputs:
                    made[o].append(_output(encoder, o, numbers))
            arrays = [_array(o, made[o]) for o in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*passed, *outputs])

    return source.mapInArrow(run, schema)


def _array(name: str, values: list) -> pa.Array:
    if name == "ids":
        ends = np.cumsum([0, *map(len, values)])
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *values])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    return pa.array(values, pa.int64() if name == "n_tokens" else pa.string())


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The table with the decoded text of an id array; a null array decodes to the empty text, a null
    id shows nothing."""
    rows = df.sparkSession.sparkContext.broadcast(read_pieces(path))
    passed = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([df.schema[c] for c in passed] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(rows.value)
        for batch in batches:
            arrays = batch.column(passed.index(ids_col)).to_pylist()
            texts = [pieces.decode([i for i in ids or [] if i is not None]) for ids in arrays]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*passed, out])

    return df.select(*passed).mapInArrow(run, schema)
