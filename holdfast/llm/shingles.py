"""Word shingles, set digests and MinHash signatures of whole Arrow columns of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

WORDS_EACH, MOST_WORDS = 4, 8
#: A power of 2. Sets of more members than about this rule out few pairs.
PARITY_BITS = 1024
_RNG = np.random.default_rng(20_250_101)
_BYTES = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_PLACES = _RNG.integers(1, 2**63, size=MOST_WORDS, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHORT = _RNG.integers(1, 2**63, size=MOST_WORDS, dtype=np.uint64)
#: Bytes lower-cased in A-Z; \t to \r and the space divide words.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    binary = texts.cast(pa.large_string()).cast(pa.large_binary())
    if binary.null_count:
        binary = binary.fill_null(b"")
    ends = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = binary.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and for every text the place of its first word (and the end)."""
    data, ends = _buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    solid = ~_BLANK[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    starts[heads] |= solid[heads]
    at = np.flatnonzero(solid)
    first = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    opening = np.searchsorted(at, first)
    sizes = np.diff(np.append(opening, len(at)))
    within = np.arange(len(at)) - np.repeat(opening, sizes)
    powers = np.ones(int(sizes.max()), dtype=np.uint64)
    powers[1:] = _STEP
    powers = np.multiply.accumulate(powers)
    terms = _BYTES[_LOW[data[at]]] * powers[within]
    return _mix(np.add.reduceat(terms, opening)), np.searchsorted(first, ends)


def shingle_sets(texts: pa.Array, k: int = WORDS_EACH) -> list[np.ndarray]:
    """The sorted distinct hashes of every text's shingles of k words (MOST_WORDS at most); of fewer
    words, the whole sequence as one."""
    words, at = word_hashes(texts)
    rolled = np.zeros(0, np.uint64)
    if len(words) >= k:
        n = len(words) - k + 1
        rolled = _mix(sum(words[j : j + n] * _PLACES[j] for j in range(k)))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            total = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(total + _SHORT[b - a : b - a + 1]))
        else:
            out.append(rolled[:0])
    return out


def set_digest(own: np.ndarray) -> bytes:
    return hashlib.sha256(own.astype("<u8").tobytes()).digest()[:16]


def parity(own: np.ndarray) -> bytes:
    """Bits that say of how many members an odd number falls on each of PARITY_BITS places."""
    odd = np.bincount((own & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def min_hashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """One row of `count` 32-bit minima per set; rows of empty sets are zero."""
    rng = np.random.default_rng(77)
    factors = rng.integers(1, 2**32, size=count, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 2**32, size=count, dtype=np.uint32)
    out = np.zeros((len(sets), count), dtype=np.uint32)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    full = np.flatnonzero(sizes)
    begin = 0
    while begin < len(full):  # groups of sets whose hashes stay in the processor's cache
        end, total = begin, 0
        while end < len(full) and (end == begin or total + sizes[full[end]] <= 65_536):
            total += sizes[full[end]]
            end += 1
        part = full[begin:end]
        values = (np.concatenate([sets[i] for i in part]) >> np.uint64(32)).astype(np.uint32)
        cuts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
        for p in range(count):
            out[part, p] = np.minimum.reduceat(values * factors[p] + shifts[p], cuts)
        begin = end
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted distinct arrays."""
    if not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
