"""One long text over many tasks.

A file is cut into splits of bytes. A first job counts, for each split, the tokens that begin in it; from the sums
follows which token is the first of an equation in each split. A second job reads the splits again: each gives the equations
whose first tokens begin in it, and reads on behind its end until the last of them is whole. So nothing is shuffled, no
task holds more than a piece (and the longest equation), and rows come in the order of the file.

The driver holds one number a split, as it holds the splits. The path must be one that driver and executors share.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tesserine.sources.inputs import InputError

#: Bytes of a split (a task's work), and of a piece (a row).
SPLIT, PIECE = 32 << 20, 128 << 10
#: Tokens of an equation.
ARITY = 3

# The bytes of the characters that separate tokens (white space in the Unicode sense, and commas).
ASCII_SEPARATORS = b"\t\n\x0b\x0c\r ,"
WIDE_SEPARATORS = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Bytes of the longest separator.
WIDEST = 3
_IS_GAP = np.isin(np.arange(256), list(ASCII_SEPARATORS))


@dataclass
class Split(InputPartition):
    start: int
    end: int
    tokens: int  # that begin before it; -1 when they are to be counted


def _token_starts(f, start: int, end: int) -> tuple[np.ndarray, bytes]:
    """Places from `start` to before `end` at which tokens begin, and the bytes there (fewer at the end of the file)."""
    before = min(start, WIDEST)
    f.seek(start - before)
    raw = f.read(end - start + before + WIDEST - 1)
    clean = raw if raw.isascii() else WIDE_SEPARATORS.sub(lambda m: b" " * len(m[0]), raw)
    gap = _IS_GAP[np.frombuffer(clean, np.uint8)]
    begins = ~gap
    begins[1:] &= gap[:-1]
    if before:
        begins[0] = False
    at = np.flatnonzero(begins[before : before + end - start])
    return at + start, raw[before : before + end - start]


def _rest(raw: bytes) -> int:
    """Bytes at the beginning that go on with a character (which has 3 such at most)."""
    return next((i for i, c in enumerate(raw[:4]) if c & 0xC0 != 0x80), min(len(raw), 4))


def _valid(f, at: int, raw: bytes) -> bool:
    """Is a part of a text UTF-8? The rest of a character that began before belongs to the part before."""
    if raw.isascii():
        return True
    f.seek(max(at - 1, 0))
    begun = at > 0 and f.read(1)[0] > 127
    own = raw[_rest(raw) if begun else 0 :]
    f.seek(at + len(raw))
    more = f.read(4)
    try:
        (own + more[: _rest(more)] if own else b"").decode()
    except UnicodeDecodeError:
        return False
    return True


def _count(f, split: Split) -> tuple[int, bool]:
    n, good = 0, True
    for at in range(split.start, split.end, PIECE):
        starts, raw = _token_starts(f, at, min(at + PIECE, split.end))
        n += len(starts)
        good = good and _valid(f, at, raw)
    return n, good


def _pieces(f, split: Split, size: int) -> Iterator[tuple[int, bytes]]:
    """Number of the first equation and text, for pieces of whole equations that begin in the split."""
    at, tokens, held, first = split.start, split.tokens, [], None
    while at < size:
        last = min(at + PIECE, split.end if at < split.end else size)
        starts, raw = _token_starts(f, at, last)
        cuts = np.arange(-tokens % ARITY, len(starts), ARITY)  # first tokens of equations
        if len(cuts):
            inside = at < split.end
            cut = cuts[-1] if inside else cuts[0]
            edge = int(starts[cut]) - at
            begun = first if first is not None else (tokens + int(cuts[0])) // ARITY
            number = (tokens + int(cut)) // ARITY
            if number > begun:
                lead = 0 if first is not None else int(starts[cuts[0]]) - at
                yield begun, b"".join(held) + raw[lead:edge]
            if not inside:
                return
            held, first = [raw[edge:]], number
        elif first is not None:
            held.append(raw)
        elif at >= split.end:
            return  # nothing begins in this split
        tokens, at = tokens + len(starts), last
    if first is not None:
        yield first, b"".join(held)


class _Reader(DataSourceReader):
    def __init__(self, path: str, splits: list[Split], count: bool) -> None:
        self.path, self.splits, self.count, self.size = path, splits, count, os.path.getsize(path)

    def partitions(self) -> list[Split]:
        return self.splits

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            if self.count:
                n, good = _count(f, split)
                yield pa.RecordBatch.from_pydict({"start": pa.array([split.start]), "n": pa.array([n]), "good": pa.array([good])})
                return
            for number, raw in _pieces(f, split, self.size):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([number], pa.int64()), "raw": pa.array([raw.decode()])})


class LongText(DataSource):
    """Read-only source `long_text`: with option `tokens` (those before each split, by commas) pieces of whole equations:
    doc_id (number of the first one), raw. Without: start, n (tokens that begin there), good (UTF-8) of each split."""

    @classmethod
    def name(cls) -> str:
        return "long_text"

    def schema(self) -> str:
        return "doc_id long, raw string" if "tokens" in self.options else "start long, n long, good boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        path, split = self.options["path"], int(self.options["split"])
        starts = range(0, os.path.getsize(path), split)
        tokens = [int(x) for x in self.options.get("tokens", "").split(",") if x] or [-1] * len(starts)
        size = os.path.getsize(path)
        splits = [Split(a, min(a + split, size), t) for a, t in zip(starts, tokens, strict=True)]
        return _Reader(path, splits, "tokens" not in self.options)


def read_long_text(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """A text file of any size -> doc_id (number of the first equation), raw (text of whole equations), in the order
    of the file. Text that isn't UTF-8 is an error. An empty file has no rows."""
    if not os.path.isfile(path):
        raise InputError(f"cannot read file: {path}: not a regular file")
    spark.dataSource.register(LongText)
    source = lambda: spark.read.format("long_text").option("path", path).option("split", split)
    if not os.path.getsize(path):
        return spark.createDataFrame([], "doc_id long, raw string")
    found = sorted(source().load().collect())  # a row a split
    if not all(r["good"] for r in found):
        raise InputError(f"cannot read file: {path}: not valid UTF-8")
    before = np.cumsum([0, *[r["n"] for r in found[:-1]]])
    return source().option("tokens", ",".join(map(str, before))).load()
