"""Array work on Arrow string columns: bytes, words and rolling hashes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at a time (a longer text is taken alone).
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finalizer (xor, shift, multiply) that spreads the bits of 64-bit values."""
    x = x ^ U64(0x9E3779B97F4A7C15 * (salt * 2 + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """base**i, or its inverse (modulo 2**64), for i below n."""
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        full = np.full(max(n, CHUNK + 1), base, U64)
        full[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.multiply.accumulate(full)
    return _powers[kind][:n]


class Rolling:
    """Hashes of any slices of a byte array, from prefix sums of table[byte] * base**i modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, U64)
            np.cumsum(_TABLE[data] * _power("up", len(data)), out=self.sums[1:])
        self.down = _power("down", len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its offsets (one more than there are rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most `limit` bytes together; at least one row each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """The words of some texts: doc (row of each word), start, end, hash; count (words of each row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        """data: the bytes of the texts, one after the other; offsets: their bounds, from 0."""
        self.data = _LOWER[data] if lower else data
        solid = ~_SPACE[self.data]
        follows = np.zeros(len(solid), bool)
        follows[1:] = solid[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        follows[inner] = False
        precedes = np.zeros(len(solid), bool)
        precedes[:-1] = solid[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        precedes[ends] = False
        self.start = np.flatnonzero(solid & ~follows)
        self.end = np.flatnonzero(solid & ~precedes) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.rolling = Rolling(self.data)
        self.hash = self.rolling.of(self.start, self.end)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of `size` words that stay within a text, and the windows' hashes."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        out = np.zeros(len(at), U64)
        with np.errstate(over="ignore"):
            for i in range(size):
                out = out * U64(0xD6E8FEB86659FD93) + self.hash[at + i]
        return at, mix(out, size)
