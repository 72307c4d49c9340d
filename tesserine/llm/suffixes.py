"""Exact substring deduplication with longest-previous-factor arrays.

A byte position's longest previous factor is the longest string that starts there and also starts
earlier in the corpus. In suffix order the only places to look for it are the nearest suffixes before
and after that start earlier (previous and next smaller positions). A 200-byte string that starts at
a position is a later copy if that factor has 200 bytes, and an earlier one if the mirrored array has.

A suffix order of the whole corpus isn't needed: only suffixes whose first bytes occur elsewhere matter.
Anchors find them: of each 200-byte window the 48-byte gram with the least hash, which windows with
equal bytes share. The windows of one text with the same anchor make a segment. Segments that are equal
throughout decide all their windows at once; of the rest (passages begin or end in them) one of each
kind is kept, and the suffixes of those with the same anchor are put in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import bitmap, bits_of, release, settle, table
from tesserine.llm.textkit import Rolling, as_bytes, chunks, mix

U64 = np.uint64
LENGTH, GRAM = 200, 48
#: Bits of the tables of fixed size that keep most unwanted rows from being shuffled.
SLOTS = 1 << 25
#: Bytes of one text whose windows are taken at a time, and the most segments of an anchor that one task orders.
PIECE, GROUP = 4 << 20, 1024
#: Segments that are put in order together, on average.
LOT = 500


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts that stand one after the other: row, first window start, windows, anchor hash of each segment."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, np.zeros(0, U64)
    at = np.arange(n - gram + 1)
    hashes = Rolling(data).of(at, at + gram)
    least = least_in_windows(((hashes >> U64(24)) << U64(24)) | at.astype(U64), length - gram + 1)
    edge = np.zeros(n + 1, np.int64)
    fits = bounds[1:] - bounds[:-1] >= length
    np.add.at(edge, bounds[:-1][fits], 1)
    np.add.at(edge, bounds[1:][fits] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(edge)[: len(least)] > 0)
    if not len(start):
        return empty, empty, empty, np.zeros(0, U64)
    anchor = (least[start] & U64((1 << 24) - 1)).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(start)])))
    row = np.searchsorted(bounds, start[first], "right") - 1
    return row, start[first], count, hashes[anchor[first]]


def pieces(column: pa.Array, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, bounds, rows, shifts: the texts in parts of bounded size; a longer text comes in several,
    which overlap so that each of its windows lies in one."""
    data, offsets = as_bytes(column)
    for lo, hi in chunks(offsets, PIECE):
        if hi - lo > 1 or offsets[hi] - offsets[lo] <= PIECE + length:
            yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64)
            continue
        for at in range(int(offsets[lo]), int(offsets[hi]), PIECE):
            part = data[at : min(at + PIECE + length - 1, int(offsets[hi]))]
            yield part, np.array([0, len(part)]), np.array([lo]), np.array([at - offsets[lo]])


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bounds, _, _ in pieces(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(segments(data, bounds)[3].view(np.int64))], names=["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long")


ROW = "anchor long, s1 long, s2 long, k1 long, k2 long, p long"


def _segments(docs: DataFrame, wanted: object) -> DataFrame:
    """Segments whose anchor's slot is set: anchor, s1, s2 (the segment's bytes), k1, k2, p (256 * first
    window + windows - 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_of(wanted.value)
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for data, bounds, rows, shifts in pieces(batch.column(2)):
                row, start, count, anchor = segments(data, bounds)
                keep = bits[(anchor & U64(SLOTS - 1)).astype(np.int64)]
                row, start, count, anchor = row[keep], start[keep], count[keep], anchor[keep]
                if not len(row):
                    continue
                view = memoryview(data)
                ends = (start + count + LENGTH - 1).tolist()
                names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), ends, strict=True)]), np.int64).reshape(-1, 2)
                place = (start - bounds[row] + shifts[row]) * 256 + count - 1
                cols = [anchor.view(np.int64), names[:, 0], names[:, 1], k1[rows[row]], k2[rows[row]], place]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["anchor", "s1", "s2", "k1", "k2", "p"])

    return docs.select("k1", "k2", "text").mapInArrow(run, ROW)


def _slot_of(k1: np.ndarray, k2: np.ndarray, p: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(k1.view(U64)) + mix(k2.view(U64), 1) + mix(p.view(U64), 2)
    return (mix(h) & U64(SLOTS - 1)).astype(np.int64)


def _contexts(docs: DataFrame, pool: DataFrame) -> DataFrame:
    """pool(anchor, k1, k2, p) with the segments' bytes, from the texts again."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(_slot_of(*cols))], names=["slot"])

    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(pool.select("k1", "k2", "p").mapInArrow(slots, "slot long"), SLOTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_of(wanted.value)
        for batch in batches:
            k1, k2 = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            for data, bounds, rows, shifts in pieces(batch.column(2)):
                row, start, count, _ = segments(data, bounds)
                if not len(row):
                    continue
                a, b, p = k1[rows[row]], k2[rows[row]], (start - bounds[row] + shifts[row]) * 256 + count - 1
                keep = np.flatnonzero(bits[_slot_of(a, b, p)])
                view = memoryview(data)
                text = [bytes(view[x:y]) for x, y in zip(start[keep].tolist(), (start + count + LENGTH - 1)[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(p[keep]), pa.array(text, pa.binary())], names=["k1", "k2", "p", "bytes"])

    found = docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, p long, bytes binary").dropDuplicates(["k1", "k2", "p"])
    return pool.join(found, ["k1", "k2", "p"])


def _nearest_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """In suffix order: how many bytes each suffix shares with the nearest one before it that has a smaller
    position (0 if none). common: bytes shared with the one before.

    All suffixes point to the one before. Where that has a larger position, so have all between it and the
    one it points to, so they go on to there, all at once, until every pointer has found its place.
    """
    n = len(position)
    to, shared = np.arange(-1, n - 1), common.copy()
    open_ = np.flatnonzero(to >= 0)
    open_ = open_[position[to[open_]] > position[open_]]
    while len(open_):
        at = to[open_]
        best, ahead = np.minimum(shared[open_], shared[at]), to[at]
        shared[open_], to[open_] = best, ahead
        open_ = open_[ahead >= 0]
        open_ = open_[position[to[open_]] > position[open_]]
    return np.where(to >= 0, shared, 0)


def factor_arrays(keys: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes (rows of bytes, cut at one length) at distinct positions: the length of the longest previous
    factor and that of the longest following one, at most the cut.

    In suffix order the suffix that shares most with one among those at smaller positions is the previous
    or the next smaller one; the common bytes are the least that neighbours share on the way. The following
    factor is the same with positions turned round.
    """
    n, length = keys.shape
    wide = np.ascontiguousarray(keys).view(f"V{length}").ravel()
    order = np.argsort(wide, kind="stable")
    ordered = keys[order]
    common = np.zeros(n, np.int64)
    apart = ordered[1:] != ordered[:-1]
    common[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), length)
    out = []
    for place in (position[order], -position[order]):
        found = np.zeros(n, np.int64)
        # before, and after: the same on the order turned round
        turned = np.concatenate(([0], common[:0:-1])) if n else common
        found[order] = np.maximum(_nearest_smaller(place, common), _nearest_smaller(place[::-1], turned)[::-1])
        out.append(found)
    return out[0], out[1]


def _suffix_groups(rows: pd.DataFrame) -> pd.DataFrame:
    """All windows of the segments of some anchors: runs of windows with their flags (1: an earlier copy
    exists, 2: a later one). Equal windows have equal anchors, so one order serves all of them."""
    rows = rows.sort_values(["k1", "k2", "p"], ignore_index=True)
    place = rows["p"].to_numpy()
    count = (place % 256 + 1).astype(np.int64)
    data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    base = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    owner = np.repeat(np.arange(len(rows)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = base[owner] + within
    # windows whose hash occurs once have no factor of the whole length; the others are put in suffix order
    hashes = Rolling(data).of(start, start + LENGTH)
    order = np.argsort(hashes)
    alike = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(start), bool)
    twice[order[1:][alike]] = True
    twice[order[:-1][alike]] = True
    flags = np.zeros(len(start), np.int32)
    at = np.flatnonzero(twice)
    if len(at):
        earlier, later = factor_arrays(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start[at]], at)
        flags[at] = (earlier >= LENGTH) * 1 + (later >= LENGTH) * 2
    k1, k2, p, flags = _runs(rows["k1"].to_numpy(), rows["k2"].to_numpy(), (place // 256)[owner] + within, owner, flags)
    return pd.DataFrame({"k1": k1, "k2": k2, "p": p, "flags": flags})


WINDOW = "lot int, packed binary, k1 long, k2 long, p long, flags int"


def _runs(k1: np.ndarray, k2: np.ndarray, at: np.ndarray, owner: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows for the flagged windows, those that follow one another in a segment as one."""
    edge = np.flatnonzero(np.concatenate(([True], (flags[1:] != flags[:-1]) | (owner[1:] != owner[:-1]))))
    size = np.diff(np.concatenate((edge, [len(flags)])))
    hit = flags[edge] > 0
    row, first = owner[edge[hit]], at[edge[hit]]
    return k1[row], k2[row], first * 256 + size[hit] - 1, flags[edge[hit]]


def _ends_of_classes(lots: int):
    """The windows of segments under very frequent anchors, named by 128 bits of their bytes. Of equal ones
    in a batch all but the first and the last have an earlier and a later copy; only these two go on, packed
    by lots of names, so a window that very many texts hold costs each batch two entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts = batch.column(3).to_pylist()
            count = p % 256 + 1
            owner = np.repeat(np.arange(len(p)), count)
            at = (p // 256)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t[j : j + LENGTH]) for t, n in zip(texts, count.tolist(), strict=True) for j in range(n)]), np.int64).reshape(-1, 2)
            order = np.lexsort((at, k2[owner], k1[owner], names[:, 1], names[:, 0]))
            new = np.concatenate(([True], (names[order][1:] != names[order][:-1]).any(axis=1))) if len(order) else np.zeros(0, bool)
            first, last = np.zeros(len(order), bool), np.zeros(len(order), bool)
            first[order[new]] = True
            last[order[np.concatenate((new[1:], [True])) if len(order) else new]] = True
            a, b, runs, flags = _runs(k1, k2, at, owner, np.where(first | last, 0, 3))
            none = pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1, np.int32)), none, pa.array(a), pa.array(b), pa.array(runs), pa.array(flags.astype(np.int32))], names=["lot", "packed", "k1", "k2", "p", "flags"])
            ends = np.flatnonzero(first | last)
            rows = np.stack([names[ends, 0], names[ends, 1], k1[owner[ends]], k2[owner[ends]], at[ends]], axis=1)
            lot = (rows[:, 0].astype(U64) % U64(lots)).astype(np.int32)
            held = np.unique(lot)
            packed = [rows[lot == x].tobytes() for x in held.tolist()]
            empty = [pa.nulls(len(held), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(packed, pa.binary()), *empty], names=["lot", "packed", "k1", "k2", "p", "flags"])

    return run


def _classes_of_lot(rows: pd.DataFrame) -> pd.DataFrame:
    """Which of a lot's windows have earlier and later copies."""
    w = np.frombuffer(b"".join(rows["packed"]), np.int64).reshape(-1, 5)
    w = w[np.lexsort((w[:, 4], w[:, 3], w[:, 2], w[:, 1], w[:, 0]))]
    full = (w[1:, :2] == w[:-1, :2]).all(axis=1)
    flags = np.zeros(len(w), np.int32)
    flags[1:][full] += 1
    flags[:-1][full] += 2
    hit = flags > 0
    return pd.DataFrame({"k1": w[hit, 2], "k2": w[hit, 3], "p": w[hit, 4] * 256, "flags": flags[hit]})


def repeated_windows(docs: DataFrame) -> DataFrame:
    """docs(k1, k2, text; k1, k2 name the text and give the order) -> k1, k2, p, flags: runs of windows
    (p: 256 * first + windows - 1) that also start earlier (1), later (2) or both (3)."""
    held = _anchors(docs).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(held.select(F.col("anchor").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")), SLOTS))
    segs = settle(_segments(docs, wanted), "suffix-segments")
    place = F.struct("k1", "k2", "p")
    kinds = segs.groupBy("anchor", "s1", "s2").agg(F.min(place).alias("least"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    kinds = settle(kinds, "suffix-kinds")
    # equal segments: all but the first have earlier copies, all but the last later ones
    same = segs.join(kinds.filter("n > 1"), ["anchor", "s1", "s2"])
    flags = lambda first, last: (~first).cast("int") + 2 * (~last).cast("int")
    whole = same.select("k1", "k2", "p", flags(place == F.col("least"), place == F.col("last")).alias("flags"))
    # different segments with the same anchor: their suffixes in order
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    pool = settle(kinds.join(anchors, "anchor").select("anchor", "kinds", "least.k1", "least.k2", "least.p"), "suffix-pool")
    bare, pool = pool, settle(_contexts(docs, pool), "suffix-contexts")
    release(bare)
    part = "k1 long, k2 long, p long, flags int"
    few = pool.filter(F.col("kinds") <= GROUP)
    lots = max(1, few.count() // LOT)
    small = few.select(F.pmod(F.xxhash64("anchor"), F.lit(lots)).alias("lot"), "k1", "k2", "p", "bytes").groupBy("lot").applyInPandas(_suffix_groups, part)
    many = pool.filter(F.col("kinds") > GROUP).select("k1", "k2", "p", "bytes")
    each = settle(many.mapInArrow(_ends_of_classes(max(1, many.count() // LOT)), WINDOW), "suffix-windows")
    inner = each.filter("lot < 0").select("k1", "k2", "p", "flags")
    ends = each.filter("lot >= 0").select("lot", "packed").groupBy("lot").applyInPandas(_classes_of_lot, part)
    out = settle(whole.union(small).union(inner).union(ends), "suffix-runs")
    release(segs, kinds, pool, each)
    return out


def _text_key(docs: DataFrame) -> tuple[Column, Column]:
    """The order of documents: doc_id where it is a number, then a hash of id and text."""
    number = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    first = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) if number else F.xxhash64("doc_id")
    return first, F.xxhash64(F.lit("suffix"), "doc_id", "text")


def dedup(docs: DataFrame, keep: str = "none", texts: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, [text]: one row a row.

    keep="none" removes each byte that a 200-byte string covers which also starts anywhere else;
    keep="first" only later copies, so the first in document order stays. Texts are UTF-8 bytes, matches
    don't cross documents, null counts as empty, and what is removed is judged on the input. With `texts`
    the remaining bytes come too (binary: a cut may split a character). Rows with equal id and text are
    copies of each other: for keep="none" all lose what a 200-byte string covers, for keep="first" all but
    one. Where ids aren't numbers, "first" goes by a hash of the id. Texts under 200 bytes lose nothing.
    """
    k1, k2 = _text_key(docs)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    base = base.withColumn("k1", k1).withColumn("k2", k2)
    runs = repeated_windows(base.select("k1", "k2", "text"))
    runs = runs.filter("flags > 0" if keep == "none" else "flags % 2 = 1")
    by_text = runs.groupBy("k1", "k2").agg(F.collect_set("p").alias("runs"))
    # equal rows have equal places: they are counted, and all of them, or all but one, are copies throughout
    rows = base.groupBy("k1", "k2").agg(F.first("doc_id", ignorenulls=False).alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).cast("int").alias("m"))
    joined = rows.join(by_text, ["k1", "k2"], "left").select("doc_id", "text", "runs", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("nth"), "m")
    joined = joined.withColumn("again", F.col("m") > 1 if keep == "none" else F.col("nth") > 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text binary" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, kept_texts = [], [], [], [], []
            data, offsets = as_bytes(batch.column(1))
            again = batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(text) + 1, np.int32)
                p = batch.column(2)[i].values
                if again[i] and len(text) >= LENGTH:
                    gone[0] += 1
                elif p is not None and len(p):
                    at = p.to_numpy(zero_copy_only=False)
                    np.add.at(gone, at // 256, 1)
                    np.add.at(gone, at // 256 + at % 256 + LENGTH, -1)
                cut = np.cumsum(gone[:-1]) > 0
                kept = text[~cut].tobytes()
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(kept))
                n_spans.append(int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(len(cut) > 0 and cut[0]))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_texts, pa.binary())] * texts, names=names + ["text"] * texts)

    return joined.select("doc_id", "text", "runs", "again").mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
