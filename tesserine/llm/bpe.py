"""Byte-level BPE encoding and decoding with a pair occurrence index.

The symbols of all words that a block of rows brings for the first time stand in one array. An index
maps each pair that can merge to all its positions there; the ranks that are active are applied in
ascending order, each to all its positions at once, and the pairs that a merge makes are added to the
index under their (higher) ranks. Words that came before are looked up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import small_batches, table
from tesserine.llm.textkit import chunks

# Fixed value: the split pattern of this public vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of text in a block, and entries of the table of known pieces before it starts anew.
BLOCK = 2 << 20
KNOWN = 400_000


def byte_names() -> dict[int, str]:
    """Byte -> the character that stands for it in the vocabulary file: printable bytes stand for
    themselves, the others get the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class PairIndexBPE:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        names = byte_names()
        back = {c: b for b, c in names.items()}
        self.byte_id = np.array([vocab[names[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right = key >> 32, key & 0xFFFFFFFF
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max(max(vocab.values()), max(self.special.values(), default=0)) + 1
        self.piece = [b""] * size
        for token, i in vocab.items():
            self.piece[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.piece[i] = token.encode()
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where there is none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merge(self, symbols: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: ids of the bytes of all words; word_starts: where words begin (ascending).
        Returns the symbols and which of them are left."""
        n = len(symbols)
        sym = symbols.copy()
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        if n:
            before[word_starts] = -1
            after[word_starts[1:] - 1] = n
            after[n - 1] = n
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enters the pairs that begin at these positions into the index."""
            rank = self._rank(sym[at], sym[after[at]])
            can = rank < len(self.keys)
            at, rank = at[can], rank[can]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            firsts = np.concatenate(([0], cuts)) if len(rank) else cuts
            for part, r in zip(np.split(at, cuts), rank[firsts].tolist() if len(rank) else [], strict=False):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        add(np.flatnonzero(after < n))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            # a position is stale if its symbol has been merged since, or the pair after it is another
            at = at[alive[at] & (sym[at] == a)]
            at = at[after[at] < n]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:  # in a run only every other pair can merge, from the left
                linked = np.concatenate(([False], after[at[:-1]] == at[1:]))
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(linked, 0, place))
                at = at[(place - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at] = self.merged[r]
            alive[gone] = False
            nxt = after[gone]
            after[at] = nxt
            has = nxt < n
            before[nxt[has]] = at[has]
            left = before[at]
            left = left[left >= 0]
            add(np.unique(np.concatenate((left, at[has]))))
        return sym, alive

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces that aren't known yet."""
        cut: list[bytes] = []
        owner: list[int] = []
        for i, piece in enumerate(pieces):
            for word in self.pattern.findall(piece):
                cut.append(word.encode("utf-8", "replace"))
                owner.append(i)
        length = np.fromiter(map(len, cut), np.int64, len(cut))
        starts = np.concatenate(([0], np.cumsum(length)))[:-1]
        sym, alive = self.merge(self.byte_id[np.frombuffer(b"".join(cut), np.uint8)], starts)
        left = np.concatenate(([0], np.cumsum(alive)))
        ids = sym[alive].astype("<u4").tobytes()
        first = np.searchsorted(np.array(owner, np.int64), np.arange(len(pieces) + 1))
        bounds = np.concatenate((starts, [len(sym)]))[first]
        cuts = (left[bounds] * 4).tolist()
        self.known.update(zip(pieces, (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Cuts before single spaces between other characters, where the pattern cuts anyway."""
        parts = SINGLE_SPACE.split(text)
        return parts[:1] + [" " + p for p in parts[1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = []
        new: dict[str, None] = {}
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        for text in texts:
            parts = self.specials.split(text) if any(s in text for s in self.special) else [text]
            row: list[str | bytes] = []
            for i, part in enumerate(parts):
                if i % 2:
                    row.append(self.special[part].to_bytes(4, "little"))
                elif part:
                    own = self.pieces(part)
                    new.update((p, None) for p in own if p not in known)
                    row += own
            cut.append(row)
        if new:
            self._learn(list(new))
        return [b"".join([known[p] if isinstance(p, str) else p for p in row]) for row in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, PairIndexBPE] = {}


def load(path: str) -> PairIndexBPE:
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def encode_docs(docs: DataFrame, path: str, decode: bool = False, keep_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, [ids binary: little-endian unsigned 32-bit], ids_sha256,
    [decoded_sha256]. Null text counts as empty; rows may repeat; other columns are dropped. No shuffle:
    each task encodes its rows in blocks of bounded size; a single longer text is a block of its own.
    path must name the vocabulary file on every executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids binary" * keep_ids + ", ids_sha256 string" + ", decoded_sha256 string" * decode

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], np.int64)
            for lo, hi in chunks(np.concatenate(([0], np.cumsum(sizes))), BLOCK):
                ids = bpe.encode([x or "" for x in texts.slice(lo, hi - lo).to_pylist()])
                cols = [batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if keep_ids:
                    cols.append(pa.array(ids, pa.binary()))
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                if decode:
                    cols.append(pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids]))
                yield pa.RecordBatch.from_arrays(cols, names=[f.split(" ")[0] for f in schema.split(", ")])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_docs(table(spark, sf_dir, "documents"), vocabulary(), decode=True, keep_ids=False)
