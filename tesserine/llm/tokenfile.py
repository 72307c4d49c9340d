"""Token ids as patched frame-of-reference blocks, written and read back through Spark.

A shard is one binary value: a header, the index of block starts, then the blocks. A block holds BLOCK
ids as: their minimum (uint32), the bit width (uint8), the number of exceptions (uint16), the low bits
of id - minimum packed at that width, then the exceptions' places (uint16) and high parts (uint32).
The width is a percentile of the bits that the block's differences need, so a few large ones don't
widen all. Shards are rows of a Parquet table, so they are written by Spark's committer to any file
system, and a task that is lost is run again without leaving half a file.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.llm.bpe import byte_names
from tesserine.llm.common import partitions, settle, table
from tesserine.llm.textkit import as_bytes, chunks, mix

MAGIC = b"PFR1"
BLOCK = 256
PERCENTILE = 0.9
#: Ids in a shard (a longer document is a shard of its own), and bytes of text encoded at a time.
SHARD = 1 << 20
TEXT = 2 << 20


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """ids: unsigned 32-bit values. The last block is filled up with its first value."""
    n = len(ids)
    count = -(-n // block)
    grid = np.full(count * block, 0, np.int64)
    grid[:n] = ids
    if n < len(grid):
        grid[n:] = grid[(count - 1) * block]
    grid = grid.reshape(count, block)
    low = grid.min(axis=1) if count else np.zeros(0, np.int64)
    rest = grid - low[:, None]
    bits = bit_length(rest)
    place = max(0, math.ceil(block * percentile) - 1)
    width = np.partition(bits, place, axis=1)[:, place] if count else low
    over = bits > width[:, None]
    n_over = over.sum(axis=1)
    size = 7 + (width * block + 7) // 8 + 6 * n_over
    starts = np.concatenate(([0], np.cumsum(size)))
    head = MAGIC + np.array([n, count], "<u8").tobytes() + np.array([block], "<u4").tobytes() + starts.astype("<u8").tobytes()
    out = np.zeros(int(starts[-1]), np.uint8)

    def put(rows: np.ndarray, shift: int, values: np.ndarray) -> None:
        """values: for each row some bytes, which go to its block at `shift`."""
        out[(starts[rows] + shift)[:, None] + np.arange(values.shape[1])] = values

    every = np.arange(count)
    put(every, 0, low.astype("<u4").view(np.uint8).reshape(count, 4))
    put(every, 4, width.astype(np.uint8)[:, None])
    put(every, 5, n_over.astype("<u2").view(np.uint8).reshape(count, 2))
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            low_bits = np.ascontiguousarray((rest[rows] & ((1 << w) - 1)).T.astype(np.uint64))
            put(rows, 7, _pack_columns(low_bits, w))
    row, place = np.nonzero(over)
    nth = np.arange(len(row)) - np.concatenate(([0], np.cumsum(n_over)))[row]
    tail = starts[row] + 7 + (width[row] * block + 7) // 8
    out[(tail + 2 * nth)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[(tail + 2 * n_over[row] + 4 * nth)[:, None] + np.arange(4)] = (rest[row, place] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
    return head + out.tobytes()


def _pack_columns(values: np.ndarray, w: int) -> np.ndarray:
    """values: block x rows, each below 2**w -> rows x bytes, the low bit of the first value first. Value i
    of every row begins at the same bit, so each takes one or two shifts for all rows."""
    block, rows = values.shape
    words = np.zeros((w * block // 64 + 1, rows), np.uint64)
    for i in range(block):
        word, shift = divmod(i * w, 64)
        words[word] |= values[i] << np.uint64(shift)
        if shift + w > 64:
            words[word + 1] |= values[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(rows, -1)[:, : (w * block + 7) // 8]


def _unpack_columns(data: np.ndarray, w: int, block: int) -> np.ndarray:
    """rows x bytes -> block x rows."""
    rows = len(data)
    padded = np.zeros((rows, 8 * (w * block // 64 + 2)), np.uint8)
    padded[:, : data.shape[1]] = data
    words = np.ascontiguousarray(padded.view("<u8").T)
    out = np.zeros((block, rows), np.uint64)
    for i in range(block):
        word, shift = divmod(i * w, 64)
        out[i] = words[word] >> np.uint64(shift)
        if shift + w > 64:
            out[i] |= words[word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << w) - 1)).astype(np.int64)


def unpack(shard: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from start up to stop; only the blocks that hold them are read."""
    if shard[:4] != MAGIC:
        raise ValueError("not a shard")
    n, count = (int(x) for x in np.frombuffer(shard, "<u8", 2, 4))
    block = int(np.frombuffer(shard, "<u4", 1, 20)[0])
    starts = np.frombuffer(shard, "<u8", count + 1, 24).astype(np.int64)
    data = np.frombuffer(shard, np.uint8, int(starts[-1]), 24 + 8 * (count + 1))
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // block, -(-stop // block)
    at = starts[first:last]

    def take(rows: np.ndarray, shift: int, size: int) -> np.ndarray:
        return data[(at[rows] + shift)[:, None] + np.arange(size)]

    every = np.arange(last - first)
    low = np.ascontiguousarray(take(every, 0, 4)).view("<u4")[:, 0].astype(np.int64)
    width = take(every, 4, 1)[:, 0].astype(np.int64)
    n_over = np.ascontiguousarray(take(every, 5, 2)).view("<u2")[:, 0].astype(np.int64)
    grid = np.zeros((last - first, block), np.int64)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            grid[rows] = _unpack_columns(take(rows, 7, (w * block + 7) // 8), w, block).T
    row = np.repeat(every, n_over)
    nth = np.arange(len(row)) - np.concatenate(([0], np.cumsum(n_over)))[row]
    tail = at[row] + 7 + (width[row] * block + 7) // 8
    place = np.ascontiguousarray(data[(tail + 2 * nth)[:, None] + np.arange(2)]).view("<u2").reshape(-1).astype(np.int64)
    high = np.ascontiguousarray(data[(tail + 2 * n_over[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1).astype(np.int64)
    grid[row, place] |= high << width[row]
    return (grid + low[:, None]).reshape(-1)[start - first * block : stop - first * block].astype(np.uint32)


class WordEncoder:
    """The tokenizers library over the different words of many texts.

    Texts are cut at white space, around digits, and between ASCII letters and ASCII marks (but not beside
    an apostrophe or another character), where the vocabulary's pattern always cuts. The pieces are looked
    up in a table of fixed size: a row holds up to 24 bytes of a piece, which are compared in whole, and its
    ids; a new piece takes the place of what was there. All pieces of many texts are looked up at once.
    Those that aren't found are cut with the pattern itself, so that each word is a pre-token; these words
    are handed to the library together, with spaces between, and the ids are dealt back by those that end a
    word. Where a text has characters outside the Latin blocks (whose case and composition the normalizer
    may change in context), control characters, or what may begin a special token, the library gets the
    whole text.
    """

    # white space 0, letters 1, digits 2, other ASCII 3, what isn't cut from its neighbours 4
    _class = np.array([0 if b in b" \t\n\r" else 4 if b > 127 or b == 0x27 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
    _control = np.array([b < 0x20 and b not in b"\t\n\r" for b in range(256)])
    _lower = np.arange(256, dtype=np.uint8)
    _lower[65:91] += 32
    _masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    END = "</w>"
    KEY, IDS, SLOT_BITS = 24, 9, 21  # a row: key 24 bytes, meta 4 bytes (size << 8 | number of ids), ids

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else [spec["pre_tokenizer"]]
        self.pattern = self._plain(next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split"))
        # words are pre-tokens in the byte alphabet already: the same model without what comes before it
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.normalizer = None
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        self.names = {b: c for b, c in byte_names().items() if b != 0x20}
        self.begins = {t["content"].encode()[:2] for t in spec["added_tokens"]}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.END)]] = True
        self.end = np.array([end_id], "<u4")
        self.table = np.zeros((1 << self.SLOT_BITS, 16), "<u4")

    @staticmethod
    def _plain(pattern: str) -> re.Pattern:
        """The pattern for the Latin blocks, with their letters, numbers and white space spelled out."""
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            found = regex.compile(name)
            pattern = pattern.replace(name, "".join(re.escape(chr(c)) for c in range(0x250) if found.match(chr(c))))
        return re.compile(pattern)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        text = " ".join(words).encode().decode("latin-1").translate(self.names)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words) and cuts[-1] == len(ids):
            return ids, np.diff(cuts, prepend=0)
        each = self._whole(words)  # a word gave no end or several: each by itself
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces between white space, A to Z in lower case already."""
        words: list[str] = []
        n = []
        for p in b" ".join(pieces).decode().lower().split(" "):
            if p.isalpha():
                words.append(p)
                n.append(1)
            else:
                found = self.pattern.findall(p)
                words += found
                n.append(len(found))
        ids, sizes = self._words(words)
        at = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(n)))]
        return ids, np.diff(at)

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that the library gets whole: with a character above U+024F, U+0130, a control character, or the
        first two bytes of a special token."""
        after = np.append(data[1:], np.uint8(0))
        marks = self._control[data] | (data >= 0xCA) | ((data == 0xC9) & (after >= 0x90)) | ((data == 0xC4) & (after == 0xB0))
        for x, y in self.begins:
            marks |= (data == x) & (after == y)
        places = np.flatnonzero(marks)
        return np.unique(np.searchsorted(offsets, places, "right") - 1) if len(places) else places

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """data: the bytes of some texts, one after the other; offsets: their bounds, from 0 -> ids of each."""
        odd = self._odd(data, offsets)
        low = np.zeros(len(data) + self.KEY, np.uint8)
        low[: len(data)] = self._lower[data]
        for i in odd:
            low[offsets[i] : offsets[i + 1]] = 0x20
        kind = self._class[low[: len(data)]]
        cut = np.ones(len(data) + 1, bool)  # before each byte
        left, right = kind[:-1], kind[1:]
        cut[1:-1] = ((left != right) & (left != 4) & (right != 4)) | (left == 2) & (right == 2) | (left == 0) | (right == 0)
        cut[offsets] = True
        solid = kind > 0
        start, size = np.flatnonzero(cut[:-1] & solid), np.flatnonzero(cut[1:] & solid) + 1
        size -= start
        ids, n = self._look_up(low, start, size)
        at = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, offsets)].tolist()
        out = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        for i, x in zip(odd.tolist(), self._whole([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in odd]), strict=True):
            out[i] = x
        return out

    def _look_up(self, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has."""
        eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        key = np.zeros((len(start), 3), np.uint64)
        for k in range(3):
            some = slice(None) if k == 0 else np.flatnonzero(size > 8 * k)
            key[some, k] = eight[start[some] + 8 * k] & self._masks[np.minimum(size[some] - 8 * k, 8)]
        with np.errstate(over="ignore"):
            named = mix(key[:, 0] ^ mix(key[:, 1], 1) ^ (key[:, 2] * np.uint64(0xD6E8FEB86659FD93)) ^ size.astype(np.uint64))
        slot = (named >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        rows = self.table[slot]
        wide, short = rows.view("<u8"), size <= self.KEY
        found = (wide[:, :3] == key).all(axis=1) & ((rows[:, 6] >> 8) == size) & short
        new = np.flatnonzero(~found & short)
        if len(new):
            _, at, of = np.unique(named[new], return_index=True, return_inverse=True)
            kind = new[at]
            same = (key[kind][of] == key[new]).all(axis=1) & (size[kind][of] == size[new])
            short[new[~same]] = False  # different pieces of one name
            raw = low.tobytes()
            got, n = self._pieces([raw[s:e] for s, e in zip(start[kind].tolist(), (start[kind] + size[kind]).tolist(), strict=True)])
            made = np.zeros((len(kind), 16), "<u4")
            made.view("<u8")[:, :3] = key[kind]
            fits = n <= self.IDS
            made[:, 6] = (size[kind] << 8) | n
            begin = np.cumsum(n) - n
            for j in range(self.IDS):
                has = np.flatnonzero(n > j)
                made[has, 7 + j] = got[begin[has] + j]
            self.table[slot[kind[fits]]] = made[fits]
            rows[new] = made[of]
            short[new[~fits[of]]] = False
        n = np.where(short, rows[:, 6] & 255, 0).astype(np.int64)
        ids = rows[:, 7:][np.arange(self.IDS) < n[:, None]]
        rest = np.flatnonzero(~short)
        if len(rest):
            got, sizes = self._pieces([low[start[i] : start[i] + size[i]].tobytes() for i in rest])
            cuts = np.split(ids, np.cumsum(n)[rest])
            whole = np.split(got, np.cumsum(sizes))
            ids = np.concatenate([x for pair in zip(cuts, whole, strict=True) for x in pair])
            n[rest] = sizes
        return ids, n


_loaded: dict[tuple[str, int], WordEncoder] = {}


def write_shards(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """docs(doc_id, text) -> the table of shards, read back: shard (ascending with doc_id), doc_ids,
    lengths (ids of each document, the end id included), payload.

    Documents are dealt by ranges of doc_id, equal ids by a hash of the text, so an id that is very
    frequent is spread; null ids come first. Null text counts as empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"shard long, doc_ids array<{kind}>, lengths array<long>, payload binary"
    # Text is dealt out before it is encoded: the sampling of the ranges then only reads the table.
    dealt = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = dealt.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end_id) not in _loaded:
            _loaded[path, end_id] = WordEncoder(path, end_id)
        encoder, part, serial = _loaded[path, end_id], TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[pa.Array] = []

        def shard() -> pa.RecordBatch:
            nonlocal serial
            ids = pa.concat_arrays(names)
            lengths = np.array([len(x) + 1 for x in held], np.int64)
            bounds = pa.array([0, len(ids)], pa.int32())
            data = pack(np.concatenate([x for own in held for x in (own, encoder.end)]))
            cols = [pa.array([(part << 32) + serial], pa.int64()), pa.ListArray.from_arrays(bounds, ids), pa.ListArray.from_arrays(bounds, pa.array(lengths)), pa.array([data], pa.binary())]
            serial += 1
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays(cols, names=["shard", "doc_ids", "lengths", "payload"])

        filled = 0
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in chunks(offsets, TEXT):
                done = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ends = np.cumsum([len(x) + 1 for x in done])
                # close a shard at the first document that fills it
                first = 0
                while first < len(done):
                    base = ends[first - 1] if first else 0
                    last = min(len(done), int(np.searchsorted(ends, base + SHARD - filled, "left")) + 1)
                    held += done[first:last]
                    names.append(batch.column(0).slice(lo + first, last - first))
                    filled += int(ends[last - 1] - base)
                    first = last
                    if filled >= SHARD:
                        yield shard()
                        filled = 0
        if names:
            yield shard()

    return settle(dealt.mapInArrow(run, schema), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """shards -> doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, _shard long, _within long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                data = unpack(batch.column("payload")[i].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                view = memoryview(data)
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [batch.column("doc_ids")[i].values, pa.array(np.full(len(lengths), batch.column("shard")[i].as_py())), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "_shard", "_within", "n_tokens", "ids_crc32"])

    sizes = shards.select(F.col("shard").alias("_of"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.shiftright("shard", 32).alias("part"))
    # Running sums within a task's shards and over the tasks: no window holds more than the shards of a task, or one row a task.
    within = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tasks = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    tasks = tasks.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    bases = within.join(tasks, "part").select("_of", (F.col("before") + F.col("earlier")).alias("base"))
    rows = shards.select("shard", "doc_ids", "lengths", "payload").mapInArrow(run, schema)
    return rows.join(bases, F.col("_shard") == F.col("_of")).select("doc_id", (F.col("base") + F.col("_within")).alias("start"), "n_tokens", "ids_crc32")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_shards(write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))
