"""Quality rules and n-gram perplexity with language-specific bands.

The language model is a modified Kneser-Ney model of order 5 over UTF-8 bytes (ASCII letters in lower
case, white space as one symbol). Spark counts in how many documents each n-gram occurs; what the model
counts is the documents beside the one that asks, so no document is explained by itself, and an n-gram
of one document alone is unseen. Lower orders count in how many different places an n-gram occurs.

The model's table has every n-gram of the corpus, so it grows with it. It is cut by hash into parts of
bounded size; each is stored as arrays sorted by hash and laid over the texts in turn, and as a text's
log-probability is a sum over its n-grams, the parts' sums add up. A corpus of few million different
n-grams needs one part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import release, settle, table
from tesserine.llm.textkit import Words, as_bytes, chunks, mix

U64 = np.uint64
ORDER = 5
#: Different n-grams that a task holds before it sends them on, and entries of a part of the model.
HELD, PART = 1 << 21, 1 << 21
#: Width of the bands, in median absolute deviations of the logarithm of perplexity, and the length (in
#: characters of words) at which a text's own chance deviation counts as much: short texts get wider bands.
LOWER, UPPER, CHANCE = 5.0, 5.0, 1000.0
# Fixed value: the symbols that the rules count.
SYMBOLS = "#*$%&|<>"

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += U64(32)
_FOLD[0x09:0x0E] = U64(0x20)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte of some texts, as ORDER bytes of a number, the last one lowest; before
    a text there is white space."""
    folded = _FOLD[data]
    first = offsets[:-1][offsets[:-1] < len(data)]
    out, before = folded.copy(), folded
    for k in range(1, ORDER if len(data) else 1):
        before = np.concatenate((before[:1], before[:-1]))
        before[first] = U64(0x20)
        out |= before << U64(8 * k)
    return out


def name_of(lang: Column) -> Column:
    """A language as a number; null is a language of its own."""
    return F.when(lang.isNull(), F.lit(0)).otherwise(F.xxhash64(lang))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> l (name_of the language), g, n: in how many documents each n-gram occurs. Tasks send
    each n-gram once or a few times, so a frequent language or text costs no more than any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            g, of = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return g, np.bincount(of, np.concatenate([n for _, n in parts]), minlength=len(g)).astype(np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                g, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k)), pa.array(g.view(np.int64)), pa.array(n)], names=["l", "g", "n"])
            held.clear()

        for batch in batches:
            lang = batch.column(0).to_numpy()
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                every = grams(part, at)
                doc = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(at))
                kinds, of = np.unique(lang[lo:hi], return_inverse=True)
                for i, k in enumerate(kinds.tolist()):
                    own = np.repeat(of == i, np.diff(at)) if len(kinds) > 1 else slice(None)
                    # one entry a document: 40 bits of the n-gram above the document's number
                    both = np.sort((every[own] << U64(24)) | doc[own])
                    g = both[np.concatenate(([True], both[1:] != both[:-1]))] >> U64(24) if len(both) else both
                    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
                    held.setdefault(k, []).append((g[first], np.diff(np.append(first, len(g)))))
                    size += len(first)
            if size > HELD:
                for k, parts in held.items():
                    held[k] = [merged(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from sent()
                    size = 0
        yield from sent()

    named = docs.select(name_of(F.col("lang").cast("string")).alias("l"), F.col("text").cast("string"))
    return named.mapInArrow(run, "l long, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))


def discounts(level: DataFrame) -> DataFrame:
    """level(l, g, c) -> l, d1, d2, d3: Chen and Goodman's three discounts from the counts of counts of each
    language; where one of these is zero (few n-grams, or none that are rare) the usual 0.5, 1, 1.5."""
    n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]
    found = level.groupBy("l").agg(*n)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    whole = reduce(lambda a, b: a & b, [F.col(f"n{i}") > 0 for i in range(1, 5)])
    d = [F.when(whole, F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)]
    return found.select("l", *d)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """counts(l, g, n) -> l, g, cost: -log P(last byte | the ones before) of every n-gram of the corpus."""
    low = lambda k: F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
    levels = {ORDER: counts.filter("n > 1").select("l", "g", (F.col("n") - 1).alias("c"))}
    asked = {ORDER: counts.select("l", "g")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = settle(levels[k + 1].groupBy("l", low(k).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"quality-level-{k}")
        asked[k] = settle(asked[k + 1].select("l", low(k).alias("g")).distinct(), f"quality-asked-{k}")
    lower = None
    for k in range(1, ORDER + 1):
        priced = levels[k].join(settle(discounts(levels[k]), "quality-discounts"), "l")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        priced = priced.select("l", "g", "c", off.alias("off"), F.shiftright("g", 8).alias("h"))
        context = priced.groupBy("l", "h").agg(F.sum("c").alias("total"), F.sum("off").alias("freed"))
        rows = asked[k].withColumn("h", F.shiftright("g", 8)).withColumn("s", low(k - 1))
        rows = rows.join(priced.select("l", "g", (F.col("c") - F.col("off")).alias("own")), ["l", "g"], "left").join(context, ["l", "h"], "left")
        if lower is None:
            rows = rows.withColumn("back", F.lit(1 / 256))
        else:
            rows = rows.join(lower.select("l", F.col("g").alias("s"), F.col("p").alias("back")), ["l", "s"])
        p = F.when(F.col("total").isNull(), F.col("back")).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("freed") * F.col("back")) / F.col("total"))
        below, lower = lower, settle(rows.select("l", "g", p.alias("p")), f"quality-p-{k}")
        if below is not None:
            release(below)
    release(*[x[k] for k in range(1, ORDER) for x in (levels, asked)])
    out = settle(lower.select("l", "g", (-F.log("p")).alias("cost")), "quality-costs")
    release(lower)
    return out


def hash_of(l: np.ndarray, g: np.ndarray) -> np.ndarray:  # noqa: E741
    return mix(g ^ mix(l.view(U64), 3), 4)


class Part:
    """A part of the model: hashes of (language, n-gram) in order, with their costs, and where each of the
    2**bits ranges of hashes begins."""

    def __init__(self, hashes: np.ndarray, costs: np.ndarray) -> None:
        self.bits = max(1, min(22, len(hashes).bit_length()))
        self.hashes = np.append(hashes, ~U64(0))
        self.costs = np.append(costs, np.float32(0))
        self.starts = np.searchsorted(hashes, np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)).astype(np.int32)

    def costs_of(self, hashes: np.ndarray) -> np.ndarray:
        """0 where the part doesn't hold an n-gram."""
        at = self.starts[(hashes >> U64(64 - self.bits)).astype(np.int64)]
        behind = np.flatnonzero(self.hashes[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < hashes[behind]]
        return np.where(self.hashes[at] == hashes, self.costs[at], np.float32(0))


def parts_of(model: DataFrame, size: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The model's parts: hashes in order and costs, `size` entries or fewer each (nearly)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l, g, cost = (np.ascontiguousarray(c.to_numpy()) for c in batch.columns)  # noqa: E741
            h = hash_of(l, g.view(U64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cost.astype(np.float32))], names=["h", "cost"])

    named = settle(model.mapInArrow(pack, "h long, cost float"), "quality-model")
    count = max(1, -(-named.count() * 9 // (8 * size)))  # parts are dealt by hash, so none is much larger than the others
    for i in range(count):
        rows = named.filter(F.pmod(F.xxhash64("h"), F.lit(count)) == i).toArrow()
        h, cost = rows.column(0).to_numpy().view(U64), rows.column(1).to_numpy()
        order = np.argsort(h)
        yield h[order], cost[order]
    release(named)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def equal_spans(data: np.ndarray, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of spans (their starts, and their common size) hold the same bytes."""
    eight = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    same = np.ones(len(size), bool)
    left, shift = np.flatnonzero(size > 0), 0
    while len(left):
        mask = _MASKS[np.minimum(size[left] - shift, 8)]
        same[left] &= ((eight[first[left] + shift] ^ eight[second[left] + shift]) & mask) == 0
        shift += 8
        left = left[(size[left] > shift) & same[left]]
    return same


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The rules' counts for each of some texts that stand one after the other."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    summed = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    per_doc = lambda x: np.diff(summed(x)[offsets])
    solid = np.zeros(len(data) + 1, np.int8)
    solid[words.start] += 1
    np.subtract.at(solid, words.end, 1)
    in_word = np.cumsum(solid[:-1]).astype(bool)
    chars = per_doc(in_word & ((data & 0xC0) != 0x80))
    marks = np.zeros(256, bool)
    marks[[ord(c) for c in SYMBOLS]] = True

    # windows of five words that occur twice: all their words count
    at, h = words.windows(5)
    repeat = np.zeros(len(words.start), np.int64)
    if len(at):
        order = np.lexsort((h, words.doc[at]))
        same = (h[order][1:] == h[order][:-1]) & (words.doc[at][order][1:] == words.doc[at][order][:-1])
        twice = np.zeros(len(at), bool)
        x, y = order[1:][same], order[:-1][same]
        for i in range(5):  # the words themselves decide
            u, v = at[x] + i, at[y] + i
            size = words.end[u] - words.start[u]
            alike = (size == words.end[v] - words.start[v]) & equal_spans(data, words.start[u], words.start[v], size)
            x, y = x[alike], y[alike]
        twice[x] = True
        twice[y] = True
        edge = np.zeros(len(words.start) + 5, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + 5, -1)
        repeat = (np.cumsum(edge)[: len(words.start)] > 0).astype(np.int64)
    n_repeat = np.bincount(words.doc, repeat, minlength=n).astype(np.int64)

    # lines: cut at line feeds and at the ends of texts
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate((offsets[:-1], feeds + 1))
    ends = np.concatenate((feeds, offsets[1:]))
    owner = np.concatenate((np.arange(n), np.searchsorted(offsets, feeds, "right") - 1))
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = ends[np.lexsort((ends, np.concatenate((np.searchsorted(offsets, feeds, "right") - 1, np.arange(n)))))]
    word_at = np.concatenate(([0], np.cumsum(np.bincount(words.start, minlength=len(data) + 1))))
    holds = word_at[ends] > word_at[starts]
    starts, ends, owner = starts[holds], ends[holds], owner[holds]
    h = words.rolling.of(starts, ends)
    order = np.lexsort((ends - starts, h, owner))
    h, size, own = h[order], (ends - starts)[order], owner[order]
    dup = np.flatnonzero((h[1:] == h[:-1]) & (size[1:] == size[:-1]) & (own[1:] == own[:-1]))
    begin = starts[order]
    dup = dup[equal_spans(data, begin[dup], begin[dup + 1], size[dup])]
    n_dup = np.bincount(own[1:][dup], minlength=n)
    return {"n_words": words.count, "word_chars": chars, "n_symbols": per_doc(marks[data]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, part: int = PART) -> DataFrame:
    """docs(doc_id, lang, text, ...) -> doc_id, lang, the counts, log_perplexity (mean cost of a byte; null
    without a word). One pass counts the corpus's n-grams, and one for each part of the model scores whole
    texts; `part` is the most entries of one."""
    spark = docs.sparkSession
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    keys = F.xxhash64("doc_id", "lang", "text"), F.xxhash64(F.lit("quality"), "doc_id", "lang", "text")
    base = base.select(keys[0].alias("k1"), keys[1].alias("k2"), name_of(F.col("lang")).alias("l"), "text", "doc_id", "lang")
    counts = settle(count_ngrams(base), "quality-ngrams")
    model = kneser_ney(counts)
    release(counts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "k1 long, k2 long, cost double"
    full = f"{more}, doc_id {kind}, lang string, n_bytes long, " + ", ".join(f"{c} long" for c in COUNTS)
    loaded: dict[int, Part] = {}

    def scoring(shared, number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang = batch.column(2).to_numpy()
                data, offsets = as_bytes(batch.column(3))
                for lo, hi in chunks(offsets):
                    own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                    if number not in loaded:
                        loaded.clear()
                        loaded[number] = Part(*shared.value)
                    cost = loaded[number].costs_of(hash_of(np.repeat(lang[lo:hi], np.diff(at)), grams(own, at)))
                    cols = [*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(np.diff(np.concatenate(([0.0], np.cumsum(cost, dtype=np.float64)))[at]))]
                    names = ["k1", "k2", "cost"]
                    if not number:
                        found = base_counts(own, at) | {"n_bytes": np.diff(at)}
                        cols += [*(batch.column(i).slice(lo, hi - lo) for i in (4, 5)), *(pa.array(found[c].astype(np.int64)) for c in ("n_bytes", *COUNTS))]
                        names += ["doc_id", "lang", "n_bytes", *COUNTS]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        return run

    out, rest = None, []
    for i, entries in enumerate(parts_of(model, part)):
        run = scoring(spark.sparkContext.broadcast(entries), i)
        if out is None:
            out = settle(base.mapInArrow(run, full), "quality-scores")
        else:  # repeated rows share the key and the cost
            rest.append(settle(base.select("k1", "k2", "l", "text").mapInArrow(run, more).dropDuplicates(["k1", "k2"]), f"quality-scores-{i}"))
    release(model)
    if rest:
        added = reduce(DataFrame.union, rest).groupBy("k1", "k2").agg(F.sum("cost").alias("added"))
        out = out.join(added, ["k1", "k2"]).withColumn("cost", F.col("cost") + F.col("added"))
    return out.select("doc_id", "lang", *COUNTS, F.when(F.col("n_words") > 0, F.col("cost") / F.col("n_bytes")).alias("log_perplexity"))


def judge(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, part: int = PART) -> DataFrame:
    """docs(doc_id, lang, text, ...) -> doc_id, counts, base_failed, log_perplexity, kept; a row a row.

    base_failed: under 10 words, or over 20 % of the words in repeated windows. Of the others those are
    kept whose perplexity lies within their language's band around the median (over all documents that
    pass the base; in median absolute deviations of the logarithm). Null text: no words, so it fails.
    Null lang is a language of its own, for the model and for the bands. Empty docs: no rows.
    """
    slim = measure(docs, part).withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    slim = settle(slim, "quality-measures")
    passed = slim.filter(~F.col("base_failed"))
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    mid = passed.groupBy(F.col("lang").alias("l")).agg(median("log_perplexity").alias("mid"))
    mad = passed.join(mid, F.col("lang").eqNullSafe(F.col("l"))).groupBy("l", "mid").agg(median(F.abs(F.col("log_perplexity") - F.col("mid"))).alias("mad"))
    # a band of some width even where most documents are alike
    bands = settle(mad.select("l", "mid", F.greatest("mad", F.lit(0.005)).alias("mad")), "quality-bands")
    out = slim.join(bands, F.col("lang").eqNullSafe(F.col("l")), "left")
    width = F.col("mad") * F.sqrt(1 + F.lit(CHANCE) / F.greatest(F.col("word_chars"), F.lit(1)))
    out = out.withColumn("low", F.col("mid") - lower * width).withColumn("high", F.col("mid") + upper * width)
    within = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & within).alias("kept"), "log_perplexity", "low", "high")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("low", "high")
