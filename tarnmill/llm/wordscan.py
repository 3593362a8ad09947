"""Vectorised word scanning over Arrow string columns.

A column's texts are scanned together, straight from Arrow's data buffer: no Python object is made per
word.  A word is named by a 64-bit hash of its bytes, so every worker names it alike.

Word hash: the word's length, then its bytes eight at a time, each step mixed by a bijection of 64 bits (words
of up to eight bytes and one length never collide); longer words than LONG go through blake2b. Other seeds
name the same words independently, for who needs more than 64 bits. Null texts have no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of the longest words that are hashed eight bytes at a time, all words together.
LONG = 64
#: Bytes of text that are scanned at once (a longer text is scanned whole).
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Masks of the first k bytes of eight, little-endian.
LEADING = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the words data[starts:ends]; each seed is another family."""
    length = ends - starts
    out = mix(length.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # eight bytes from each place on
    out = mix(out ^ (lanes[starts] & LEADING[np.minimum(length, 8)]))
    some = np.flatnonzero(length > 8)
    for at in range(8, LONG, 8):
        if not len(some):
            break
        out[some] = mix(out[some] ^ (lanes[starts[some] + at] & LEADING[np.minimum(length[some] - at, 8)]))
        some = some[length[some] > at + 8]
    for k in np.flatnonzero(length > LONG).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


@dataclass(frozen=True)
class Alphabet:
    """Which bytes make words, and whether A-Z count as a-z."""

    inside: np.ndarray
    folds: bool

    @staticmethod
    def build(separators: list[tuple[int, int]], fold_case: bool) -> Alphabet:
        inside = np.ones(256, bool)
        for low, high in separators:
            inside[low : high + 1] = False
        if fold_case:
            inside[65:91] = True
        return Alphabet(inside, fold_case)

    def folded(self, data: np.ndarray) -> np.ndarray:
        return _LOWER[data] if self.folds else data


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Fixed values, from the contracts of the operators.
SPACES = [(0x20, 0x20), (0x09, 0x0D)]
NOT_ALNUM = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]

PLAIN_WORDS = Alphabet.build(SPACES, fold_case=False)
FOLDED_WORDS = Alphabet.build(SPACES, fold_case=True)
FOLDED_ALNUM = Alphabet.build(NOT_ALNUM, fold_case=True)


@dataclass
class Words:
    """Words of consecutive texts. offsets[d]:offsets[d + 1] are those of text d, data[starts:ends] their bytes."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    first: int
    alphabet: Alphabet

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def named(self, seed: int) -> np.ndarray:
        """The words' hashes of another family."""
        return spelled(self.alphabet.folded(self.data), self.starts, self.ends, seed)

    def bytes_of(self, k: int) -> bytes:
        """Word k as it is compared."""
        return self.alphabet.folded(self.data[self.starts[k] : self.ends[k]]).tobytes()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def scan(column: pa.Array, alphabet: Alphabet) -> Iterator[Words]:
    """Words of a string column in chunks of about CHUNK_BYTES; a text is never split."""
    if not len(column):
        return
    raw, offsets = _buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, n)
        at = offsets[first : last + 1] - offsets[first]
        data = raw[offsets[first] : offsets[last]]
        inside = alphabet.inside[data]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        heads = at[:-1][at[:-1] < len(data)]
        begins[heads] = inside[heads]  # a text's first byte begins a word, whatever the text before ends with
        closes[heads[heads > 0] - 1] = inside[heads[heads > 0] - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        del inside, begins, closes
        hashes = spelled(alphabet.folded(data), starts, ends)
        yield Words(hashes, np.searchsorted(starts, at).astype(np.int64), starts, ends, data, first, alphabet)
        first = last


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` consecutive words within one text, and the index of each run's first word."""
    h, n = words.hashes, len(words.hashes)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    ends = np.repeat(words.offsets[1:], words.counts)[: n - size + 1]
    at = np.flatnonzero(np.arange(n - size + 1) + size <= ends)
    return rolled(h, size)[at], at


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive values, by doubling: log(size) passes."""
    n = len(h) - size + 1
    out, width, span, block, have = None, size, 1, h, 0
    while width:
        if width & 1:
            part = block[have : have + n]
            out = part.copy() if out is None else mix(out * U64(0x9E3779B97F4A7C15) + part)
            have += span
        width >>= 1
        if width:
            block = mix(block[:-span] * U64(0xD1B54A32D192ED03) + block[span:])
            span *= 2
    return out if size > 1 else out[:n]


def plain_words(text: str | None, alphabet: Alphabet) -> list[bytes]:
    """The same words, one text at a time: for small tables and tests."""
    raw = (text or "").encode()
    table = bytes(b if alphabet.inside[b] else 0x20 for b in range(256))
    if alphabet.folds:
        table = table[:65] + table[97:123] + table[91:]
    return [w for w in raw.translate(table).split(b" ") if w]
