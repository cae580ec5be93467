"""Words of whole texts as numpy arrays, cut and hashed a slice of rows at a time.

Texts stay in Arrow's buffers; a word is a pair of byte positions and a 64-bit hash. Nothing
here is per-row Python, and memory is bounded by the slice (or by one text, if it is longer).

No words are built to share a hash. A word below LONG_WORD bytes adds up one random number for
each place and byte, so two different words agree with probability 2 ** -64, whatever they are; a
longer one has a keyed digest. A run of words is a polynomial of their hashes at a random point,
modulo the prime 2 ** 61 - 1: two different runs of n words agree for at most n of all points.
(Sums modulo 2 ** 64 would not do: the Thue-Morse words agree at every odd point.)
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
HASH_BYTES = 1 << 19
LONG_WORD = 256

_U = np.uint64
#: A random number for each place of a word and each byte there.
_TABLE = np.random.default_rng(0x9E3779B97F4A7C15).integers(
    0, 1 << 64, LONG_WORD * 256, dtype=_U)
_KEY = b"words of LONG_WORD bytes or more"
_PRIME = (1 << 61) - 1
_STEP = 0x16E8FEB86659FD93
_STEP_INVERSE = pow(_STEP, -1, _PRIME)

#: [^\x20\x09-\x0D]+ on UTF-8 bytes.
SPACED = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on UTF-8 bytes of a text whose A-Z are lower case.
LETTERS_DIGITS = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
                           for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, as a number below it."""
    x = (x & _U(_PRIME)) + (x >> _U(61))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it: 2 ** 61 counts as 1."""
    low = _U(0xFFFFFFFF)
    a1, a0, b1, b0 = a >> _U(32), a & low, b >> _U(32), b & low
    middle = a1 * b0 + a0 * b1                    # below 2 ** 62, times 2 ** 32
    part = (a1 * b1 << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32))
    return _reduced(_reduced(part) + _reduced(a0 * b0))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime."""
    out = np.ones(max(n, 1), _U)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = _product(out[:more], _U(pow(base, done, _PRIME)))
        done += more
    return out


@dataclass
class Words:
    data: np.ndarray   # bytes of all rows, end to end
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    first: np.ndarray  # first word of each row, and the number of words
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets); a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str,
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about `size` bytes of text."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(n, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(n)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system, as workers outlive their tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # where the C library has it
    if trim is not None:
        trim(0)


def cut(texts: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Words of each row; with lower, A-Z count as a-z."""
    data, off = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[(off > 0) & (off < len(data))]
    before[edge] = False
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, off), _hashes(data, inside, start, end))


def _hashes(data, inside, start, end) -> np.ndarray:
    out = np.empty(len(start), _U)
    size = end - start
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(data) + HASH_BYTES, HASH_BYTES)))
    for a, b in zip(cuts, cuts[1:]):
        s = start[a:b]
        span = slice(s[0], end[b - 1])
        at = np.arange(span.start, span.stop) - np.repeat(s, np.diff(np.append(s, span.stop)))
        value = _TABLE[np.minimum(at, LONG_WORD - 1) * 256 + data[span]] * inside[span]
        out[a:b] = np.add.reduceat(value, s - span.start)
    for i in np.flatnonzero(size >= LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(
            data[start[i]:end[i]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return mix(out ^ mix(size.astype(_U)))


class Spans:
    """Hashes of any run of neighbouring words, from running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self._back = powers(_STEP_INVERSE, n + 1)
        terms = _product(_reduced(hashes), powers(_STEP, n)[:n])
        # halves are summed apart, so that no sum of fewer than 2 ** 32 words overflows
        high = _reduced(np.cumsum(terms >> _U(32), dtype=_U))
        low = _reduced(np.cumsum(terms & _U(0xFFFFFFFF), dtype=_U))
        self._sums = np.zeros(n + 1, _U)
        self._sums[1:] = _reduced(_product(high, _U(1 << 32)) + low)

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        size = np.broadcast_to(np.asarray(size), np.shape(start))
        apart = _reduced(self._sums[start + size] + (_U(_PRIME) - self._sums[start]))
        return mix(_product(apart, self._back[start]) + mix(size.astype(_U)))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles, in order of both, and their number by row.

    A row of fewer words has its whole sequence as its one shingle; a row without words none.
    """
    counts = words.counts
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + words.first[:-1][row]
    h = Spans(words.hash).hash(at, np.minimum(counts, k)[row])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return row, h, np.bincount(row, minlength=len(counts))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
