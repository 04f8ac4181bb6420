"""Words and their hashes for whole Arrow string columns, without a Python loop over words.

A word's hash is a polynomial over its (lower-cased) bytes modulo 2**64, taken
from one running sum over the buffer: the sum up to the word's end less that up
to its start, times the inverse power of its start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW = 1 << 17
_LETTERS = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a word between white space: all but \x20 and \x09-\x0D.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of an alphanumeric word: ASCII letters and digits and whatever is beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n or more of each."""
    size = max(_WINDOW * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        if len(_powers) > 1:
            _powers.clear()
        out = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[size] = tuple(out)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts (one more than rows); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of several texts: hashes, byte starts and ends, and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """The words of each text; ``kind`` says which bytes are in words."""
    total = int(at[-1])
    parts, a = [], 0
    while a < total:
        b = min(total, a + _WINDOW)
        if b < total:  # cut where no word goes on
            tail = np.flatnonzero(~kind[data[a:b]])
            if len(tail):
                b = a + int(tail[-1]) + 1
            else:
                while b < total and kind[data[b]]:
                    b = min(total, b + _WINDOW)
                    ahead = np.flatnonzero(~kind[data[b - 1 : b + _WINDOW]])
                    if len(ahead):
                        b = b - 1 + int(ahead[0]) + 1
                        break
                b = min(b, total)
        piece = data[a:b]
        inside = kind[piece]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edge = at[np.searchsorted(at, a) : np.searchsorted(at, b, "left")] - a
        begins[edge] = inside[edge]
        edge = edge[edge > 0] - 1
        stops[edge] = inside[edge]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        power, inverse = _pow(len(piece))
        value = _LETTERS[_LOWER[piece] if lower else piece]
        value *= power[: len(piece)]
        run = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(value, out=run[1:])
        h = mix((run[e] - run[s]) * inverse[s] + (e - s).astype(np.uint64))
        parts.append((h, s + a, e + a))
        a = b
    if parts:
        h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        h, s, e = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return Words(h, s, e, np.searchsorted(s, at))


def slices(texts: pa.Array, most: int = 1 << 19):
    """Row ranges of at most ``most`` bytes of text each; a longer single text is a range of its own."""
    _, at = buffers(texts)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(at, at[begin] + most, "right")) - 1
        end = min(len(texts), max(end, begin + 1))
        yield begin, end
        begin = end


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word runs that start at each word, and whether the text has that many words left."""
    n = len(w.hashes)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        out[: n - j] = out[: n - j] * np.uint64(_BASE) + w.hashes[j:]
    return mix(out + np.uint64(k)), w.room() >= k


def shingle_sets(w: Words, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; fewer words make one shingle; none, an empty set."""
    g, whole = grams(w, k)
    out = []
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for h in w.hashes[a:b]:
                    x = x * np.uint64(_BASE) + h
                out.append(mix(np.array([x + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
