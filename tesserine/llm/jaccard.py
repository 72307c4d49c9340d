"""N-gram Jaccard join with token-combination prefixes.

Documents with equal shingle sets are one vertex. A set's tokens (its shingles' hashes) are ordered,
those that a first pass finds to be frequent last; of a set that may miss d tokens in a partner, the
first d + extra(d) are its prefix, so partners share at least extra(d) tokens of their prefixes (the
smaller set's number). Tokens that few prefixes hold (RARE) are indexed by themselves, the others by
pairs: a pair's tokens fall into the same of extra(d) - 2 buckets, so sets that share more frequent
tokens than there are buckets share a pair, and all other partners share two rare tokens.

Candidates are verified in two steps. A parity sketch (for each slot, whether a set has an odd number
of tokens in it) differs in at most as many slots as the sets differ in tokens, so a pair whose sketches
differ in more is no link; sketches are a small part of their sets. Of the pairs that are left, those
which could still join two components are compared on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import bitmap, bits_of, keyed, release, row_key, settle, table
from tesserine.llm.graph import components
from tesserine.llm.textkit import Words, as_bytes, chunks

U64 = np.uint64
#: Prefixes that hold a token which is indexed by itself, at most.
RARE = 16
#: Sets that are compared with the same set by one task.
CHUNK = 256
#: Slots in which frequent shingles are counted, and by which rows are picked: bits of a fixed-size table.
SLOTS = 1 << 22
#: Bytes of sketches in a block when a large group is compared, of all members and of those not yet linked.
BLOCK, MINOR = 8 << 20, 1 << 20
#: Sizes in a band grow by this power of the ratio that partners' sizes may have.
BAND = 3


def extra(misses: int) -> int:
    """How many tokens a prefix is longer than the misses: the more, the fewer sets that share but a
    passage become candidates."""
    return 4 + misses // 6


def prefix_of(tokens: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set in the common order: those that aren't late, by value, then the others.

    A partner has percent * n / 100 of the n tokens at least, so it may miss n minus that. A set so small
    that one token more or less is too much has no partner but its equal, and no prefix.
    """
    n = len(tokens)
    if n * (100 - percent) < percent:
        return tokens[:0]
    misses = n - (percent * n + 99) // 100
    take = misses + extra(misses)
    prefix = tokens[~late][:take]
    return prefix if len(prefix) == take else np.concatenate((prefix, tokens[late][: take - len(prefix)]))


def parity_sketch(tokens: np.ndarray, each: int = 1) -> bytes:
    """One bit a slot; slots are the low bits of a token, their number the power of two from `each` times the set's size
    on (64 at least), so a narrower sketch is the xor of a wider one's halves."""
    width = max(64, 1 << (each * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_apart(na: np.ndarray | int, nb: np.ndarray | int, percent: int):
    """The most tokens in which linked sets of these sizes differ."""
    return (100 - percent) * (na + nb) // (100 + percent)


def _differ(left: bytes, right: bytes) -> int:
    """In how many slots two sketches differ, the wider one folded to the narrower one's width."""
    if len(left) > len(right):
        left, right = right, left
    a, b, bits = int.from_bytes(left, "little"), int.from_bytes(right, "little"), 8 * len(right)
    while bits > 8 * len(left):
        bits //= 2
        b = (b >> bits) ^ (b & ((1 << bits) - 1))
    return (a ^ b).bit_count()


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: `size` words, or all words where there are fewer."""
    data, offsets = as_bytes(texts)
    for lo, hi in chunks(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
        at, hashes = words.windows(size)
        bounds = np.searchsorted(at, words.first)
        short = {k: dict(zip(*(x.tolist() for x in words.windows(k)), strict=True)) for k in range(1, size)} if (words.count[words.count > 0] < size).any() else {}
        for i, n in enumerate(words.count.tolist()):
            if n >= size:
                yield np.unique(hashes[bounds[i] : bounds[i + 1]])
            elif n:
                yield np.array([short[n][int(words.first[i])]], U64)
            else:
                yield np.zeros(0, U64)


def _slot(x: np.ndarray) -> np.ndarray:
    return (x & U64(SLOTS - 1)).astype(np.int64)


def frequent_slots(docs: DataFrame, size: int) -> bytes:
    """Slots of shingles that stand out in some partition. Only the order of tokens depends on it, so
    counts need not be exact; it must be the same for all sets, so it is taken once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for s in sets_of(batch.column(0), size):
                counts[_slot(s)] += 1
        mean = counts.mean()
        found = np.flatnonzero(counts >= max(4, mean + 6 * mean**0.5))
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["slot"])

    return bitmap(docs.select(F.col("text").cast("string")).mapInArrow(run, "slot long"), SLOTS)


def sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """docs(doc_id, k1, k2, text) -> doc_id, k1, k2, n, sid (names the set; null if empty),
    v (a short name: joins by it are settled by sid), prefix, parity."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_slots(docs, size))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k1 long, k2 long, n long, sid binary, v long, prefix array<long>, parity binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = bits_of(frequent.value)
        for batch in batches:
            n: list[int] = []
            sids: list[bytes | None] = []
            short: list[int | None] = []
            parity: list[bytes | None] = []
            prefixes = [np.zeros(0, U64)]
            for s in sets_of(batch.column(3), size):
                n.append(len(s))
                sids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                short.append(int.from_bytes(sids[-1][:8], "little", signed=True) if len(s) else None)
                prefixes.append(prefix_of(s, late[_slot(s)], percent))
                parity.append(parity_sketch(s) if len(prefixes[-1]) else None)
            ends = np.cumsum([len(x) for x in prefixes])
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64)))
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(sids, pa.binary()), pa.array(short, pa.int64()), arrays, pa.array(parity, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k1", "k2", "n", "sid", "v", "prefix", "parity"])

    return settle(docs.select("doc_id", "k1", "k2", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "jaccard-sketch")


def sets_by_name(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted(sid, k1, k2, ...) -> wanted with tokens (binary): each set is made again from one text, whose row
    key is given. A bitmap of fixed size keeps most other texts from being cut; the join drops the rest."""
    picked = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("k1").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")), SLOTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_of(picked.value)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(0).to_numpy() & (SLOTS - 1)]))
            tokens = [s.astype("<u8").tobytes() for s in sets_of(batch.column(2), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.large_binary())], names=["k1", "k2", "tokens"])

    made = docs.select("k1", "k2", F.col("text").cast("string")).mapInArrow(run, "k1 long, k2 long, tokens binary")
    # equal rows make equal sets: one of them is enough
    return made.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"])


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs(a, b, a1, a2, b1, b2, ra, rb) of set ids, their row keys and roots -> ra, rb of the pairs that are links.

    The partners of a set are dealt to chunks, and the set goes to each of its chunks once, so a set's
    tokens are shipped once for each set that asks for it, not for each pair.
    """
    wide = settle(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > CHUNK).select("a", F.ceil(F.col("m") / F.lit(CHUNK)).cast("int").alias("nc")), "jaccard-wide")
    dealt = pairs.join(wide, "a", "left").withColumn("chunk", F.pmod(F.xxhash64("b"), F.coalesce("nc", F.lit(1))).cast("int"))
    asks = dealt.select(F.col("a").alias("hub"), "chunk", F.col("b").alias("sid"), F.col("b1").alias("k1"), F.col("b2").alias("k2"), "ra", "rb")
    hubs = dealt.select(F.col("a").alias("hub"), "chunk", F.col("a").alias("sid"), F.col("a1").alias("k1"), F.col("a2").alias("k2")).distinct()
    roles = settle(asks.union(hubs.withColumn("ra", F.lit(None).cast("binary")).withColumn("rb", F.lit(None).cast("binary"))), "jaccard-roles")
    rows = sets_by_name(docs, roles, size)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        is_hub, kept = g["sid"] == g["hub"], []
        own = np.frombuffer(g[is_hub].iloc[0]["tokens"], "<u8")
        asking = g[~is_hub]
        for raw, ra, rb in zip(asking["tokens"], asking["ra"], asking["rb"], strict=True):
            other = np.frombuffer(raw, "<u8")
            both = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * both >= percent * (len(own) + len(other) - both):
                kept.append((ra, rb))
        return pd.DataFrame(kept, columns=["a", "b"])

    out = settle(rows.groupBy("hub", "chunk").applyInPandas(run, "a binary, b binary"), "jaccard-verified")
    release(wide, roles)
    return out


def close(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b, na, nb, pa, pb, more) of set ids, sizes and sketches -> those whose sketches allow a link: a, b, more."""
    more = [c for c in pairs.columns if c not in ("a", "b", "na", "nb", "pa", "pb")]
    out = pairs.select("a", "b", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_apart(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            apart = np.array([_differ(x, y) for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "b", *more]).filter(pa.array(apart <= most))

    return pairs.mapInArrow(run, out.schema)


class Block:
    """Members of a group by the width of their sketches; those within reach of an asking set are found at once."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes], roots: np.ndarray) -> None:
        self.parts: dict[int, tuple] = {}
        widths = np.array([len(x) for x in sketches])
        for w in np.unique(widths).tolist():
            own = np.flatnonzero(widths == w)
            own = own[np.argsort(sizes[own], kind="stable")]
            self.parts[w] = own, sizes[own], np.frombuffer(b"".join([sketches[i] for i in own]), "<u8").reshape(len(own), -1), roots[own]
        self.narrow: dict[int, np.ndarray] = {}

    def partners(self, n: int, raw: bytes, root: bytes, percent: int) -> np.ndarray:
        """Places of the members of other roots whose sketches allow a link."""
        found = []
        for w, (own, sizes, grid, roots) in self.parts.items():
            lo, hi = np.searchsorted(sizes, -(-n * percent // 100)), np.searchsorted(sizes, n * 100 // percent, "right")
            if hi <= lo:
                continue
            asks = np.frombuffer(raw, "<u8")
            while len(asks) * 8 > w:
                asks = asks[: len(asks) // 2] ^ asks[len(asks) // 2 :]
            there = grid
            if len(raw) < w:
                if w not in self.narrow or self.narrow[w].shape[1] != len(asks):
                    folded = grid
                    while folded.shape[1] > len(asks):
                        folded = folded[:, : folded.shape[1] // 2] ^ folded[:, folded.shape[1] // 2 :]
                    self.narrow[w] = folded
                there = self.narrow[w]
            apart = np.bitwise_count(there[lo:hi] ^ asks).sum(axis=1, dtype=np.int64)
            found.append(own[lo:hi][(apart <= most_apart(sizes[lo:hi], n, percent)) & (roots[lo:hi] != root)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


#: What a set brings into a block.
MEMBER = ["g", "band", "sid", "n", "k1", "k2", "parity", "root"]


def place(there: DataFrame, asking: DataFrame, weight: Column, name: str) -> DataFrame:
    """The sets of each group and band, and those of them that ask, both with MEMBER -> the rows of blocks (x, y) of
    bounded size: each set that asks meets each set of its group and band in one of them."""
    weigh = lambda rows, held, asks: rows.select("g", "band", (weight * F.lit(held)).alias("held"), (weight * F.lit(asks)).alias("asks"))
    sums = weigh(there, 1, 0).union(weigh(asking, 0, 1)).groupBy("g", "band").agg(F.sum("held").alias("held"), F.sum("asks").alias("asks")).filter("held > 0 AND asks > 0")
    blocks = lambda c, size: F.ceil(F.col(c) / F.lit(size)).cast("int")
    sized = settle(sums.select("g", "band", blocks("held", BLOCK).alias("nb"), blocks("asks", MINOR).alias("nm")), f"{name}-blocks")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    major = there.join(sized, ["g", "band"]).select(*MEMBER, of("nb").alias("x"), spread("nm").alias("y"), F.lit(False).alias("asks"))
    return major.union(asking.join(sized, ["g", "band"]).select(*MEMBER, spread("nb").alias("x"), of("nm").alias("y"), F.lit(True).alias("asks")))


def may_link(members: DataFrame, percent: int) -> DataFrame:
    """members(g, sid, n, k1, k2, parity, root, minor) -> MEMBER, asks: the minor members of groups for which sketches
    allow a link (asks), and those of other roots in their groups that they could link with."""
    there = members.withColumn("band", band_of(F.col("n"), percent)).select(*MEMBER)
    asking = members.filter("minor").withColumn("band", F.explode(near_bands(F.col("n"), percent))).select(*MEMBER)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, asking = rows[~rows["asks"]], rows[rows["asks"]]
        found, met = [], np.zeros(len(held), bool)
        if len(held) and len(asking):
            block = Block(held["n"].to_numpy(), held["parity"].tolist(), held["root"].to_numpy())
            for r in asking.itertuples():
                at = block.partners(r.n, r.parity, r.root, percent)
                met[at] = True
                found.append(len(at) > 0)
        return pd.concat((held[met], asking[np.array(found, bool)] if found else asking[:0]))[[*MEMBER, "asks"]]

    placed = place(there, asking, F.octet_length("parity") + 64, "jaccard-may-link")
    kind = placed.select(*MEMBER, "asks").schema
    return settle(placed.groupBy("g", "band", "x", "y").applyInPandas(run, kind).dropDuplicates(["g", "band", "sid", "asks"]), "jaccard-asked")


def links_across(asked: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The sets of `asked`, as may_link gives it, on whole sets -> a, b: roots that links connect. A block decides its pairs
    itself, and gives a link only where those before don't lead to the same."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, asking = rows[~rows["asks"]], rows[rows["asks"]]
        out: list[tuple[bytes, bytes]] = []
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (y := up.get(x)) is not None:
                up[x] = x = up.get(y, y)
            return x

        if len(held) and len(asking):
            roots = held["root"].to_numpy()
            tokens = [np.frombuffer(x, "<u8") for x in held["tokens"]]
            known, place_of = np.unique(np.concatenate(tokens), return_inverse=True)
            places = np.split(place_of, np.cumsum([len(x) for x in tokens])[:-1])
            mark = np.zeros(len(known), bool)
            block = Block(held["n"].to_numpy(), held["parity"].tolist(), roots)
            for r in asking.itertuples():
                own = np.frombuffer(r.tokens, "<u8")
                mine = np.minimum(np.searchsorted(known, own), len(known) - 1)
                mine = mine[known[mine] == own]
                mark[mine] = True
                for i in block.partners(r.n, r.parity, r.root, percent).tolist():
                    x, y = top(r.root), top(roots[i])
                    if x == y:
                        continue
                    both = np.count_nonzero(mark[places[i]])
                    if 100 * both >= percent * (len(own) + len(places[i]) - both):
                        up[x] = y
                        out.append((r.root, roots[i]))
                mark[mine] = False
        return pd.DataFrame(out, columns=["a", "b"])

    chosen = lambda side: asked.filter(side).select(*MEMBER)
    wanted = settle(place(chosen("NOT asks"), chosen("asks"), F.octet_length("parity") + F.col("n") * 8 + 64, "jaccard-across"), "jaccard-placed")
    out = settle(sets_by_name(docs, wanted, size).groupBy("g", "band", "x", "y").applyInPandas(run, "a binary, b binary"), "jaccard-across")
    release(wanted)
    return out


def band_of(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(BAND * float(np.log(100 / percent)))).cast("int")


def near_bands(n: Column, percent: int) -> Column:
    """The bands in which a set of n tokens can have partners."""
    return F.array_distinct(F.array(band_of(F.floor(n * percent / 100), percent), band_of(n, percent), band_of(F.ceil(n * 100 / percent), percent)))


def rare_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that share two rare tokens of their prefixes; lists have RARE members at most."""
    lists = held.filter(F.col("c") <= RARE).groupBy("t").agg(F.collect_list(F.struct("n", "v")).alias("m"))
    first = lists.select("m", F.explode("m").alias("x"))
    pairs = first.select("x", F.explode(F.filter("m", lambda y: (y > F.col("x")) & (F.col("x.n") * 100 >= y["n"] * percent))).alias("y"))
    counted = pairs.groupBy(F.col("x.v").alias("a"), F.col("y.v").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return counted.filter("shared >= 2").select("a", "b")


def signatures(held: DataFrame, percent: int) -> DataFrame:
    """sig, v, n: the frequent class, by pairs of tokens of a bucket. A signature also holds a band of sizes:
    each set stands in its own, and in the next one where it can have larger partners there."""
    bands = F.array_distinct(F.array(band_of(F.col("n"), percent), band_of(F.ceil(F.col("n") * 100 / percent), percent)))
    placed = held.filter(F.col("c") > RARE).select("v", "n", "t", F.explode(bands).alias("band"))
    # buckets by the smallest size that can stand in the band, so all its members have the same
    least = F.greatest(F.floor(F.pow(F.lit(100 / percent), F.col("band") * BAND - 1)) - 1, F.lit(0))
    misses = least - F.ceil(least * percent / 100)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("t"), F.lit(2) + F.floor(misses / 6)))
    own = placed.groupBy("v", "n", "band", "bucket").agg(F.sort_array(F.collect_set("t")).alias("ts")).filter(F.size("ts") > 1)
    each = own.select("v", "n", "band", "ts", F.explode("ts").alias("x"))
    pairs = each.select("v", "n", "band", "x", F.explode(F.filter("ts", lambda y: y > F.col("x"))).alias("y"))
    return pairs.select("v", "n", F.xxhash64("x", "y", "band").alias("sig"))


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """classes(v, n, prefix) -> pairs (a, b) of short names that share what links share, and stars (a, b, ...):
    the members of each frequent signature with one of them."""
    tokens = classes.select("v", "n", F.explode("prefix").alias("t"))
    counts = settle(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "jaccard-counts")
    held = settle(tokens.join(counts, "t"), "jaccard-held")
    release(counts)
    marked = settle(signatures(held, percent), "jaccard-marked")
    centres = settle(marked.groupBy("sig").agg(F.min(F.struct("v", "n")).alias("centre"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("sig", "centre"), "jaccard-centres")
    stars = marked.join(centres, "sig").filter("v <> centre.v").select(F.col("centre.v").alias("a"), F.col("v").alias("b"), F.col("centre.n").alias("na"), F.col("n").alias("nb")).distinct()
    stars = settle(stars, "jaccard-stars")
    release(marked, centres)
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    pairs = settle(rare_pairs(held, percent).union(stars.filter(fits).select("a", "b")), "jaccard-pairs")
    release(held)
    return pairs, stars


def relabel(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """labels(sid, root, ...), links(a, b) of roots -> labels after the links; only roots that links touch are worked on."""
    moved = components(links, name).select(F.col("node").alias("root"), F.col("root").alias("to")).filter("root <> to")
    rest = [c for c in labels.columns if c != "root"]
    return settle(labels.join(moved, "root", "left").select(*rest, F.coalesce("to", "root").alias("root")), f"{name}-labels")


def label(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """classes(sid, v, n, k1, k2, prefix, parity, least) -> sid, least, root: equal for the sets that links connect.

    Each set is first verified with one of its candidates. Then the candidates that are still in different
    components; then, in the groups that frequent signatures connect, the members outside the group's
    largest component against all others: sketches leave few sets, and these are decided in blocks.
    """
    pairs, stars = candidates(classes, percent)
    touched = pairs.union(stars.select("a", "b")).select(F.explode(F.array("a", "b")).alias("v")).distinct()
    slim = settle(classes.select("sid", "v", "n", "k1", "k2", "parity", "least").join(touched, "v"), "jaccard-slim")
    side = lambda x: slim.select(F.col("v").alias(f"v{x}"), *(F.col(c).alias(f"{to}{x}") for c, to in (("sid", "s"), ("n", "n"), ("parity", "p"))), F.struct("k1", "k2").alias(f"k{x}"))
    both = pairs.select(F.col("a").alias("va"), F.col("b").alias("vb")).join(side("a"), "va").join(side("b"), "vb").filter("sa <> sb")
    less = F.col("sa") < F.col("sb")
    ends = lambda c, x, y: F.when(less, F.col(f"{c}{x}")).otherwise(F.col(f"{c}{y}"))
    keys = [ends("k", x, y)[f"k{i}"].alias(f"{x}{i}") for x, y in (("a", "b"), ("b", "a")) for i in (1, 2)]
    near = close(both.select(ends("s", "a", "b").alias("a"), ends("s", "b", "a").alias("b"), "na", "nb", "pa", "pb", *keys), percent)
    near = settle(near.dropDuplicates(["a", "b"]), "jaccard-near")
    release(pairs)
    first = near.groupBy("b").agg(F.min(F.struct("a", "a1", "a2")).alias("a"), F.first("b1").alias("b1"), F.first("b2").alias("b2"))
    first = settle(first.select("a.a", "b", "a.a1", "a.a2", "b1", "b2", F.col("a.a").alias("ra"), F.col("b").alias("rb")), "jaccard-first")
    labels = relabel(slim.select("sid", "least", F.col("sid").alias("root")), verify(first, docs, size, percent), "jaccard-first")
    of = lambda c, r: labels.select(F.col("sid").alias(c), F.col("root").alias(r))
    # of the first pairs those that are no links come again, which is less work than to leave them out
    apart = settle(near.join(of("a", "ra"), "a").join(of("b", "rb"), "b").filter("ra <> rb"), "jaccard-apart")
    release(near, first)
    if not apart.isEmpty():
        labels = relabel(labels, verify(apart, docs, size, percent), "jaccard-second")
    release(apart)
    if stars.isEmpty():
        return labels
    groups = components(stars, "jaccard-groups").select(F.col("node").alias("v"), F.col("root").alias("g"))
    placed = settle(slim.drop("least").join(groups, "v").drop("v").join(labels.drop("least"), "sid"), "jaccard-placed")
    counts = placed.groupBy("g", "root").agg(F.count(F.lit(1)).alias("m"))
    top = settle(counts.groupBy("g").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots"), "jaccard-top")
    members = settle(placed.join(top, "g").withColumn("minor", F.col("root") != F.col("top")).drop("top"), "jaccard-members")
    asked = may_link(members, percent)
    if not asked.isEmpty():
        labels = relabel(labels, links_across(asked, docs, size, percent), "jaccard-third")
    release(slim, stars, placed, top, members, asked)
    return labels


def join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, k1, k2 (the row's key), n_shingles, component_id.

    Two documents link where 100 * intersection >= percent * union of their shingle sets (words in lower
    ASCII case). component_id is the smallest doc_id that links lead to, the own one included; null ids
    don't count unless all are null. Null and empty texts have no shingles and stand alone; texts of
    fewer than `size` words have one. Equal texts and repeated rows fall together. Empty docs: no rows.
    """
    k1, k2 = row_key("doc_id", "text")
    base = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    fat = sketch(base, size, percent)
    some = lambda c: F.first(c).alias(c)
    classes = fat.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("k"), some("n"), some("v"), some("prefix"), some("parity"))
    classes = settle(classes.select("sid", "least", "k.k1", "k.k2", "n", "v", "prefix", "parity"), "jaccard-classes")
    rows = settle(fat.select("doc_id", "k1", "k2", "n", "sid"), "jaccard-rows")
    release(fat)
    labels = label(base, classes.filter("parity IS NOT NULL"), size, percent)
    smallest = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = labels.join(smallest, "root").select("sid", "component_id")
    named = settle(classes.select("sid", "least").join(linked, "sid", "left").select("sid", F.coalesce("component_id", "least").alias("component_id")), "jaccard-named")
    out = rows.join(named, "sid", "left")
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (then of the smallest row key;
    of rows that are equal throughout in id and text, one). Rows with a null id stand alone unless an
    equal or near one has an id. Same columns."""
    found = settle(join(docs, **options), "jaccard-found")
    named = found.filter("n_shingles > 0 AND component_id IS NOT NULL")
    first = named.filter("doc_id IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("best")).select("best.k1", "best.k2")
    lost = named.join(first, ["k1", "k2"], "left_anti").select("k1", "k2").distinct()
    again = found.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("k1", "k2")
    kept = keyed(docs).join(lost, ["k1", "k2"], "left_anti")
    once = kept.join(again, ["k1", "k2"], "left_anti").union(kept.join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return once.select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
