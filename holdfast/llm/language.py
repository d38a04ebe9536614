"""Language identification by unigram piece models, summed over all segmentations of a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.bpe import ARROW_ROWS, byte_letters, read_vocabulary
from holdfast.llm.common import free_name
from holdfast.session import cut_lineage

#: Labelled documents per language that the piece probabilities are learned from, at most; those
#: with the smallest digests of their ids. More change the probabilities little.
SAMPLE_DOCS = 1500
EM_ROUNDS = 2
#: Added to every expected piece count, so that no piece of the vocabulary is impossible.
SMOOTHING = 0.02
#: Places (byte and piece size) that are held at a time, and bytes of a word that is longer than that.
CELLS, SEGMENT_BYTES = 4_000_000, 65_536
#: Positions after which running chances are brought back to 1, so that none vanishes.
RESCALED_EVERY = 16
UNKNOWN = "und"
KNOWN_WORDS = 150_000

#: A letter with the letters and marks that follow it.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_STEP = np.uint64(1_099_511_628_211)
_END = np.uint64(0x5851F42D4C957F2D)


def _hash(piece: bytes) -> int:
    h = 14_695_981_039_346_656_037
    for b in piece:
        h = (h * int(_STEP) + b + 1) % 2**64
    return h


class Pieces:
    """The fixed vocabulary as byte strings, inside a word or at its end, found by their hashes."""

    def __init__(self, file_text: str):
        import json

        model = json.loads(file_text)["model"]
        end = model["end_of_word_suffix"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        keys, self.longest = [], 1
        for token in model["vocab"]:
            final = token.endswith(end)
            piece = bytes(byte[c] for c in (token[: -len(end)] if final else token))
            keys.append(_hash(piece) ^ (int(_END) if final else 0))
            self.longest = max(self.longest, len(piece))
        self.keys = np.unique(np.array(keys, dtype=np.uint64))

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[word, j, size - 1]: the number of the piece of that size that ends behind byte j of the
        padded word; the number behind the last piece where there is none."""
        width = words.shape[1]
        most = min(self.longest, width)
        out = np.full((len(words), width + 1, most), len(self.keys), dtype=np.int32)
        h = np.full(words.shape, 14_695_981_039_346_656_037, dtype=np.uint64)
        for size in range(1, most + 1):
            h = h[:, : width - size + 1] * _STEP + (words[:, size - 1 :].astype(np.uint64) + np.uint64(1))
            stop = np.arange(size, width + 1)[None, :]
            key = np.where(stop == sizes[:, None], h ^ _END, h)
            inside = stop <= sizes[:, None]
            asked = key[inside]
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            out[:, size:, size - 1][inside] = np.where(self.keys[at] == asked, at, len(self.keys))
        return out


def _padded(words: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, matrix, sizes) of words of similar length, up to SEGMENT_BYTES."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    low, width = 0, 4
    while low < min(int(sizes.max(initial=0)), SEGMENT_BYTES):
        places = np.flatnonzero((sizes > low) & (sizes <= width))
        each = max(1, CELLS // (width * min(width, longest)))
        for i in range(0, len(places), each):
            part = places[i : i + each]
            raw = b"".join([words[p].ljust(width, b"\0") for p in part])
            yield part, np.frombuffer(raw, dtype=np.uint8).reshape(len(part), width), sizes[part]
        low, width = width, width + 4 if width < 16 else width * 3 // 2


def _forward(ends: np.ndarray, chances: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """alpha[word, j, language]: the chance of the first j bytes, over all their segmentations, and the
    logarithm of what it was divided by. `first` are the chances of earlier positions, the nearest last."""
    n, width, most = ends.shape
    start = 1 if first is None else first.shape[1]
    alpha = np.zeros((n, start + width - 1, chances.shape[1]))
    alpha[:, :start] = 1.0 if first is None else first
    scale = np.zeros_like(alpha)
    for j in range(1, width):
        at = start - 1 + j
        reach = min(most, at)
        alpha[:, at] = np.einsum("nsl,nsl->nl", chances[ends[:, j, :reach]], alpha[:, at - reach : at][:, ::-1])
        scale[:, at] = scale[:, at - 1]
        if j % RESCALED_EVERY == 0:
            near = slice(max(0, at - most + 1), at + 1)
            top = alpha[:, near].max(axis=1)
            top[top == 0] = 1.0
            alpha[:, near] /= top[:, None]
            scale[:, near] += np.log(top)[:, None]
    return alpha[:, start - 1 :], scale[:, start - 1 :]


def _long_score(pieces: Pieces, chances: np.ndarray, word: bytes) -> np.ndarray:
    """Log chance of a word of any length: segments in turn, each with the last chances of the one before."""
    whole = np.frombuffer(word, dtype=np.uint8)
    first, total, done = np.ones((1, 1, chances.shape[1])), np.zeros(chances.shape[1]), 0
    while done < len(whole):
        start, stop = done - first.shape[1] + 1, min(done + SEGMENT_BYTES, len(whole))
        part = whole[None, start:stop]
        size = np.array([len(whole) - start])  # a piece is final only at the end of the word
        ends = pieces.find(part, size)[:, done - start :]
        alpha, scale = _forward(ends, chances, first)
        keep = min(pieces.longest, alpha.shape[1] + first.shape[1] - 1)
        both = np.concatenate([first[:, :-1], alpha], axis=1)[:, -keep:]
        shift = np.concatenate([np.zeros_like(first[:, :-1]), scale], axis=1)[:, -keep:]
        total += scale[0, -1]
        first = both * np.exp(shift - scale[:, -1:])
        done = stop
    return total + np.log(first[0, -1])


def word_scores(pieces: Pieces, chances: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log chance of every word in every language. chances has a zero row behind the last piece."""
    out = np.zeros((len(words), chances.shape[1]))
    for part, matrix, sizes in _padded(words, pieces.longest):
        alpha, scale = _forward(pieces.find(matrix, sizes), chances)
        rows = np.arange(len(part))
        out[part] = np.log(alpha[rows, sizes]) + scale[rows, sizes]
    for i, word in enumerate(words):
        if len(word) > SEGMENT_BYTES:
            out[i] = _long_score(pieces, chances, word)
    return out


def expected_counts(pieces: Pieces, chances: np.ndarray, words: list[bytes], times: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the words of one language, over all segmentations.

    Words above SEGMENT_BYTES are scored like others, but nothing is learned from them.
    """
    total = np.zeros(len(pieces) + 1)
    for part, matrix, sizes in _padded(words, pieces.longest):
        ends = pieces.find(matrix, sizes)
        width, most = matrix.shape[1], ends.shape[2]
        alpha, scale = (x[:, :, 0] for x in _forward(ends, chances[:, None]))
        # from the end of each word backwards, in the same scales as from its start
        rows = np.arange(len(part))
        whole = np.log(alpha[rows, sizes]) + scale[rows, sizes]
        beta, held = np.zeros_like(alpha), np.zeros_like(alpha)
        beta[rows, sizes] = 1.0
        for i in range(width - 1, -1, -1):
            reach = min(most, width - i)
            after = np.arange(1, reach + 1)
            own = chances[ends[:, i + after, after - 1]] * beta[:, i + 1 : i + 1 + reach]
            inside = i < sizes
            beta[inside, i] = own[inside].sum(axis=1)
            held[:, i] = held[:, i + 1]
            if (width - i) % RESCALED_EVERY == 0:
                near = slice(i, min(i + most, width + 1))
                top = beta[:, near].max(axis=1)
                top[top == 0] = 1.0
                beta[:, near] /= top[:, None]
                held[:, near] += np.log(top)[:, None]
        for size in range(1, most + 1):
            numbers = ends[:, size:, size - 1]
            shift = np.exp(scale[:, : width - size + 1] + held[:, size:] - whole[:, None])
            uses = alpha[:, : width - size + 1] * chances[numbers] * beta[:, size:] * shift * times[part][:, None]
            total += np.bincount(numbers.ravel(), uses.ravel(), minlength=len(total))
    return total[:-1]


def words_of(piece: str) -> list[bytes]:
    """The letter runs of a lower-cased piece of text as UTF-8."""
    return [run.encode("utf-8", "surrogatepass") for run in ([piece] if piece.isalpha() else _LETTERS.findall(piece))]


@dataclass
class Model:
    languages: list[str]
    chances: np.ndarray
    file_text: str


def held_out(id_col: str):
    """Documents that nothing is learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """(lang, text) of at most `most` labelled documents of each language that are not held out."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(id_col), F.lit(5)).alias("turn"), F.col(id_col).alias("doc"))
    # One number per language: the share of its documents whose digests are small enough to matter.
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(None).cast("double")
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * most / n + 0.001))).otherwise(share)
    place = (F.col("turn").cast("double") / 2.0**64) + 0.5
    rows = rows.filter(place <= share)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "doc", "text"))
    return rows.withColumn("place", first).filter(F.col("place") <= most).select("lang", "text")


def learn(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
) -> Model:
    """Piece probabilities of every language by expectation-maximisation over the word counts.

    The word counts of the sample are written to the shared folder; each round is one job whose
    result has a number per language and piece, bounded by the vocabulary. Without labelled
    documents the model has no languages.
    """
    spark = docs.sparkSession
    file_text = read_vocabulary(path)
    pieces = Pieces(file_text)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bytes], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in text.lower().split():
                    for word in words_of(piece):
                        counts[lang, word] = counts.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()),
                 pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    sample = _sample(docs, id_col, text_col, lang_col, sample_docs)
    words = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words, "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    chances = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    chances[-1] = 0.0
    for _ in range(EM_ROUNDS if languages else 0):
        model = spark.sparkContext.broadcast(Model(languages, chances, file_text))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = model.value
            own = _pieces(now.file_text)
            total = np.zeros((len(own), len(now.languages)))
            for batch in batches:
                langs = np.array(batch.column(0).to_pylist())
                every, times = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for k, lang in enumerate(now.languages):
                    at = np.flatnonzero(langs == lang)
                    if len(at):
                        total[:, k] += expected_counts(own, now.chances[:, k], [every[i] for i in at], times[at])
            number, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[number, language])],
                names=["piece", "language", "uses"])

        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
        uses = words.mapInArrow(expect, "piece int, language int, uses double")
        uses = uses.groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toPandas()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        counts = np.full((len(pieces), len(languages)), SMOOTHING)
        counts[uses["piece"], uses["language"]] += uses["uses"]
        chances = np.vstack([counts / counts.sum(axis=0), np.zeros((1, len(languages)))])
    return Model(languages, chances, file_text)


_LOADED: dict[int, Pieces] = {}


def _pieces(file_text: str) -> Pieces:
    """The vocabulary of this task, read once."""
    key = hash(file_text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(file_text)
    return _LOADED[key]


class Scorer:
    """Scores texts; remembers the word pieces that a task has met."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, _pieces(model.file_text)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, dtype=bool)
        self.fresh: list[str] = []

    def _number(self, piece: str) -> int:
        self.fresh.append(piece)
        self.known[piece] = number = len(self.known)
        return number

    def _learn(self) -> None:
        words: dict[bytes, int] = {}
        owner, member = [], []
        for i, piece in enumerate(self.fresh):
            for word in words_of(piece):
                owner.append(i)
                member.append(words.setdefault(word, len(words)))
        scores = word_scores(self.pieces, self.model.chances, list(words))
        own = np.zeros((len(self.fresh), scores.shape[1]))
        np.add.at(own, np.array(owner, dtype=np.int64), scores[np.array(member, dtype=np.int64)])
        has = np.bincount(np.array(owner, dtype=np.int64), minlength=len(self.fresh)) > 0
        self.scores, self.letters = np.concatenate([self.scores, own]), np.concatenate([self.letters, has])
        self.fresh = []

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        known, number, rows = self.known, self._number, []
        for text in texts:
            pieces = (text or "").lower().split()
            rows.append(np.array([known[p] if p in known else number(p) for p in pieces], dtype=np.int64))
        if self.fresh:
            self._learn()
        for at in rows:
            if not self.model.languages or not self.letters[at].any():
                yield UNKNOWN, 0.0
                continue
            total = self.scores[at].sum(axis=0)
            best = int(total.argmax())
            yield self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The table with a predicted language and its posterior chance (0 to 1) for every row.

    The score of a language is the product over all words of the whole text of the summed chances of
    all segmentations of the word into pieces; equal priors. Nothing but the text is looked at. A null
    text, a text without letters, or a model without languages gives `und` and 0. Ties go to the
    first language by name. Columns of the output names are replaced.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lowered = {o.lower() for o in out}
    passed = [c for c in docs.columns if c.lower() not in lowered]
    rows = docs.select(*passed, docs[text_col].cast("string").alias(free_name(docs, "_text")))
    fields = [rows.schema[c] for c in passed]
    schema = T.StructType([*fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = list(scorer.predict(batch.column(len(passed)).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*passed, *out])

    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least the given chance; the columns stay as they are."""
    pred, score = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    judged = identify(docs, model, text_col, (pred, score))
    return judged.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
