"""Words of whole Arrow batches at once: positions, document numbers and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Rows of intermediate tables at a time.
BLOCK = 1 << 16
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTES = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
FOLDED = BYTES.copy()
FOLDED[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of BASE and of its inverse, as many as the longest chunk so far needed."""

    up = down = np.ones(1, U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(BASE, n), powers(INVERSE, n)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Words:
    """Words of consecutive documents. first[i]:first[i+1] are those of the i-th document; start and end are byte offsets in data."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def hashes(self) -> np.ndarray:
        return self.prefix(self.end)

    def prefix(self, end: np.ndarray, words: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the bytes from the words' starts to `end`."""
        start = self.start[words]
        return mix((self.sums[end] - self.sums[start]) * _Powers.get(len(self.sums))[1][start] + U(1))

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def binary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0): runs of rows of about `most` bytes; a longer text is a run of its own."""
    data, at = binary(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def split(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE, fold: bool = False) -> Words:
    n = len(data)
    word = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before &= ~edge[:-1]
    after &= ~edge[1:]
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum((FOLDED if fold else BYTES)[data] * _Powers.get(n + 1)[0][:n], out=sums[1:])
    return Words(data, start, end, np.searchsorted(start, at).astype(np.int64), sums)


def rolling(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all runs of n successive values, one for each start."""
    if len(h) < n:
        return np.zeros(0, U)
    base |= 1
    up, down = powers(base, len(h)), powers(pow(base, -1, 1 << 64), len(h))
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of h[start:end] for many spans."""
    base |= 1
    up, down = powers(base, len(h) + 1), powers(pow(base, -1, 1 << 64), len(h) + 1)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
