"""Near duplicates by circulant MinHash.

Two permutations make all coordinates of a signature. The first scatters a set's shingles over a circle of
2**32 places; the second ranks the places, and coordinate k is the least rank of the set's places moved on
by k. BANDS bands of ROWS coordinates make candidates: two sets of similarity s share none with probability
(1 - s**ROWS)**BANDS, 1e-9 at 0.8, less above. A parity sketch goes along with a set, and pairs whose sketches
differ too much for a link are left out, which is exact; all others are decided on whole sets.

Links only matter for what they connect. So each set is first compared with one of its candidates, then with
those that are still in other components. Where a band holds sets of several components after that, those
outside its largest are compared with its other sets in blocks of bounded size: first by their sketches, which
tells the sets that may have a link there, then those on whole sets. A block gives one row for a set at most, and
no more links than it has components, however many of its pairs are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import release, row_key, settle, table
from tesserine.llm.graph import components
from tesserine.llm.jaccard import Block, close, parity_sketch, sets_by_name, sets_of

U32, U64 = np.uint32, np.uint64
#: Bands, and coordinates in each, for a threshold of 80 percent.
BANDS, ROWS = 52, 5
#: Slots of a parity sketch for each shingle of a set, at least.
SLOTS_EACH = 2
#: Shingles whose coordinates are computed at a time: the arrays stay in the processor's cache.
LOT = 1 << 15
#: Bytes of partners in a lot; bytes of a block of sets, and of those that ask.
PARTNERS, BLOCK, ASKING = 16 << 20, 8 << 20, 1 << 20


def permute(x: np.ndarray, multipliers: tuple[int, int]) -> np.ndarray:
    """A permutation of 32-bit values (each step can be undone)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U32(16))
        x *= U32(multipliers[0])
        x ^= x >> U32(15)
        x *= U32(multipliers[1])
        x ^= x >> U32(16)
    return x


# Odd multipliers that spread bits well, of the two permutations.
SCATTER, RANK = (0x7FEB352D, 0x846CA68B), (0x85EBCA6B, 0xC2B2AE35)


def signatures_of(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of `coordinates` 32-bit values for each set (none may be empty)."""
    out = np.empty((len(sets), coordinates), U32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= LOT):
            size += len(sets[last])
            last += 1
        lot = sets[first:last]
        at = permute(np.concatenate([(s ^ (s >> U64(32))).astype(U32) for s in lot]), SCATTER)
        starts = np.cumsum([0, *[len(s) for s in lot[:-1]]])
        with np.errstate(over="ignore"):
            for k in range(coordinates):
                out[first:last, k] = np.minimum.reduceat(permute(at + U32(k), RANK), starts)
        first = last
    return out


def band_names(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit name of each band: its number, and the low bytes of its coordinates (5 at most). So sets share a
    band where they have equal bytes in it."""
    cut = low[:, : bands * rows].astype(np.int64).reshape(len(low), bands, rows)
    name = np.broadcast_to(np.arange(bands, dtype=np.int64), cut.shape[:2]).copy()
    for i in range(rows):
        name = name << 8 | cut[:, :, i]
    return name


def sign(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """docs(doc_id, k1, k2, text) -> doc_id, k1, k2, n, sid (names the set; null if empty), bands, bytes (of each
    coordinate), parity (the set's sketch); these are null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k1 long, k2 long, n long, sid binary, bands array<long>, bytes binary, parity binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(sets_of(batch.column(3), size))
            full = [s for s in sets if len(s)]
            made = signatures_of(full, bands * rows)
            low = (made & U32(255)).astype(np.uint8)
            names = band_names(low, bands, rows)
            at, sids, lists, raws, parity = 0, [], [], [], []
            for s in sets:
                sids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                lists.append(names[at] if len(s) else None)
                raws.append(low[at].tobytes() if len(s) else None)
                parity.append(parity_sketch(s, SLOTS_EACH) if len(s) else None)
                at += len(s) > 0
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(raws, pa.binary()), pa.array(parity, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=["doc_id", "k1", "k2", "n", "sid", "bands", "bytes", "parity"])

    return docs.select("doc_id", "k1", "k2", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs(a, b), sets(sid, n, k1, k2) -> the pairs that are links: 100 * intersection >= percent * union.

    A set's partners are dealt to lots by their bytes, so that a set with many doesn't make one task's work; a set is
    shipped once for each lot that it is in, not for each pair. Tasks read partners in a row, and hold the set alone."""
    sized = pairs.join(sets.select(F.col("sid").alias("b"), (F.col("n") * 8).alias("w")), "b")
    weights = sized.groupBy("a").agg(F.ceil(F.sum("w") / F.lit(PARTNERS)).cast("int").alias("lots"))
    dealt = settle(pairs.join(weights, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot")), "minhash-dealt")
    asks = dealt.select(F.col("b").alias("sid"), F.col("a").alias("hub"), "lot", F.lit(False).alias("is_hub"))
    hubs = dealt.select(F.col("a").alias("sid"), F.col("a").alias("hub"), "lot", F.lit(True).alias("is_hub")).distinct()
    roles = settle(asks.union(hubs).join(sets.select("sid", "k1", "k2"), "sid"), "minhash-roles")
    rows = sets_by_name(docs, roles, size).select("hub", "lot", "is_hub", "sid", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, U64)  # of the hub whose partners follow
        for batch in batches:
            kept: list[tuple[bytes, bytes]] = []
            for hub, is_hub, sid, raw in zip(*(batch.column(i) for i in (0, 2, 3, 4)), strict=True):
                tokens = np.frombuffer(raw.as_buffer(), "<u8")
                if is_hub.as_py():
                    own = tokens.copy()
                    continue
                both = len(np.intersect1d(own, tokens, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(tokens) - both):
                    kept.append((hub.as_py(), sid.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.binary()) for i in (0, 1)], names=["a", "b"])

    ordered = rows.repartition("hub", "lot").sortWithinPartitions("hub", "lot", F.desc("is_hub"))
    out = settle(ordered.mapInArrow(run, "a binary, b binary"), "minhash-links")
    release(dealt, roles)
    return out


class Labels:
    """sid, root: equal roots for the sets that the links so far connect."""

    def __init__(self, sets: DataFrame) -> None:
        self.table = settle(sets.select("sid", F.col("sid").alias("root")), "minhash-labels")

    def add(self, links: DataFrame) -> None:
        edges = settle(self.rooted(links).select(F.col("ra").alias("a"), F.col("rb").alias("b")), "minhash-edges")
        moved = settle(components(edges, "minhash-graph").select(F.col("node").alias("root"), F.col("root").alias("to")), "minhash-moved")
        new = settle(self.table.join(moved, "root", "left").select("sid", F.coalesce("to", "root").alias("root")), "minhash-labels")
        release(self.table, edges, moved, links)
        self.table = new

    def rooted(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b) + ra, rb."""
        of = lambda x: self.table.select(F.col("sid").alias(x), F.col("root").alias(f"r{x}"))
        return pairs.join(of("a"), "a").join(of("b"), "b")


#: What a set brings into a block.
MEMBER = ["sid", "n", "bytes", "parity", "root"]


def place(there: DataFrame, asking: DataFrame, weight: Column, *more: str) -> DataFrame:
    """The sets of each band, and those of them that ask, both with MEMBER and `more` -> the rows of the band's blocks
    (x, y): each set that asks meets each set of its band in one of them."""
    blocks = lambda rows, size, name: rows.groupBy("band").agg(F.ceil(F.sum(weight) / F.lit(size)).cast("int").alias(name))
    sized = settle(blocks(there, BLOCK, "nx").join(blocks(asking, ASKING, "ny"), "band"), "minhash-blocks")
    of = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["band", *MEMBER, *more]
    held = there.join(sized, "band").select(*cols, of("nx").alias("x"), each("ny").alias("y"), F.lit(False).alias("asks"))
    return held.union(asking.join(sized, "band").select(*cols, each("nx").alias("x"), of("ny").alias("y"), F.lit(True).alias("asks")))


def in_blocks(placed: DataFrame, compare: Callable[[int, list[tuple], list[tuple]], Iterator[tuple]], schema: str, *more: str) -> DataFrame:
    """placed(band, x, y, asks, MEMBER, more) -> what `compare` gives for each block: it gets the band, the sets there, and
    those that ask."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            out = list(compare(now[0], *sides)) if sides[0] and sides[1] else []
            for x in sides:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=list(names))

        for batch in batches:
            for *key, asks, sid, size, raw, parity, root, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    yield done()
                    now = key
                sides[asks].append((sid, size, raw, parity, root, tokens))
        yield done()

    rows = placed.select("band", "x", "y", "asks", *MEMBER, *more) if more else placed.select("band", "x", "y", "asks", *MEMBER, F.lit(None).cast("binary").alias("tokens"))
    return rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(run, schema)


def partners(band: int, held: list[tuple], asking: list[tuple], percent: int, rows: int) -> Iterator[tuple[tuple, list[int]]]:
    """Each set that asks, and the places of the sets of other roots whose sketches allow a link with it. A pair is
    found in the first band that it shares and not in the others."""
    number: dict[bytes, int] = {}
    roots = np.array([number.setdefault(r[4], len(number)) for r in held])
    block = Block(np.array([r[1] for r in held]), [r[3] for r in held], roots)
    grid = np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(len(held), -1)
    for ask in sorted(asking, key=lambda r: r[1]):
        at = block.partners(ask[1], ask[3], number.get(ask[4], -1), percent)
        if len(at):
            shared = (grid[at] == np.frombuffer(ask[2], np.uint8)).reshape(len(at), -1, rows).all(axis=2).argmax(axis=1)
            at = at[shared == band >> 8 * rows]
        if len(at):
            yield ask, at.tolist()


def may_link(members: DataFrame, percent: int, rows: int) -> DataFrame:
    """members(band, MEMBER, minor) -> band, sid, asks of the minor sets for which sketches allow a link (asks), and of the
    sets of other roots that they could link with."""

    def compare(band: int, held: list[tuple], asking: list[tuple]) -> Iterator[tuple]:
        found = set()
        for ask, at in partners(band, held, asking, percent, rows):
            found.update(at)
            yield band, ask[0], True
        for i in found:
            yield band, held[i][0], False

    placed = place(members, members.filter("minor"), F.octet_length("bytes") + F.octet_length("parity") + 64)
    return settle(in_blocks(placed, compare, "band long, sid binary, asks boolean").distinct(), "minhash-may-link")


def links_across(members: DataFrame, asked: DataFrame, docs: DataFrame, size: int, percent: int, rows: int) -> DataFrame:
    """The sets of `asked`, as may_link gives it, on whole sets -> links (a, b) that connect the components which have any
    link: a block decides its pairs itself, and gives a link only where those before don't lead to the same."""

    def compare(band: int, held: list[tuple], asking: list[tuple]) -> Iterator[tuple]:
        tokens = [np.frombuffer(r[5], "<u8") for r in held]
        known, place_of = np.unique(np.concatenate(tokens), return_inverse=True)
        places = np.split(place_of, np.cumsum([len(x) for x in tokens])[:-1])
        mark = np.zeros(len(known), bool)
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (y := up.get(x)) is not None:
                up[x] = x = up.get(y, y)
            return x

        for ask, at in partners(band, held, asking, percent, rows):
            own = np.frombuffer(ask[5], "<u8")
            mine = np.minimum(np.searchsorted(known, own), len(known) - 1)
            mine = mine[known[mine] == own]
            mark[mine] = True
            for i in at:
                x, y = top(ask[4]), top(held[i][4])
                if x == y:
                    continue
                both = np.count_nonzero(mark[places[i]])
                if 100 * both >= percent * (len(own) + len(places[i]) - both):
                    up[x] = y
                    yield min(ask[0], held[i][0]), max(ask[0], held[i][0])
            mark[mine] = False

    chosen = lambda side: members.join(asked.filter(side).select("band", "sid"), ["band", "sid"])
    placed = place(chosen("NOT asks"), chosen("asks"), F.octet_length("bytes") + F.octet_length("parity") + F.col("n") * 8 + 64, "k1", "k2")
    wanted = settle(placed, "minhash-placed")
    out = settle(in_blocks(sets_by_name(docs, wanted, size), compare, "a binary, b binary", "tokens").distinct(), "minhash-across")
    release(wanted)
    return out


def label(docs: DataFrame, classes: DataFrame, size: int, percent: int, rows: int) -> DataFrame:
    """classes(sid, n, k1, k2, bands, bytes, parity) -> sid, root for the sets that share a band with another."""
    marked = classes.select("sid", "n", F.explode("bands").alias("band"))
    full = settle(marked.groupBy("band").agg(F.min("sid").alias("centre"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "minhash-bands")
    held = settle(marked.join(full, "band"), "minhash-held")
    sets = settle(classes.select("sid", "n", "k1", "k2", "bytes", "parity").join(held.select("sid").distinct(), "sid"), "minhash-sets")
    release(full)
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    stars = held.filter("sid <> centre").select(F.col("centre").alias("a"), F.col("sid").alias("b")).distinct()
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    near = settle(close(stars.join(side("a"), "a").join(side("b"), "b").filter(fits), percent), "minhash-near")
    labels = Labels(sets)
    first = settle(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "minhash-first")
    labels.add(verify(first, docs, sets, size, percent))
    apart = settle(labels.rooted(near).filter("ra <> rb").select("a", "b").join(first, ["a", "b"], "left_anti"), "minhash-apart")
    if not apart.isEmpty():
        labels.add(verify(apart, docs, sets, size, percent))
    release(first, apart, near)
    # bands whose sets aren't all in one component, and their largest one
    counts = held.join(labels.table, "sid").groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"))
    top = settle(counts.groupBy("band").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("band", "top"), "minhash-top")
    placed = held.select("band", "sid").join(top, "band").join(labels.table, "sid").join(sets, "sid")
    members = settle(placed.select("band", *MEMBER, "k1", "k2", (F.col("root") != F.col("top")).alias("minor")), "minhash-members")
    asked = may_link(members, percent, rows)
    if not asked.isEmpty():
        labels.add(links_across(members, asked, docs, size, percent, rows))
    release(top, members, asked, held, sets)
    return labels.table


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, k1, k2 (the row's key), n_shingles, component_id, kept.

    Two documents link where 100 * intersection >= percent * union of their sets of `size`-word shingles, in lower
    ASCII case; bands and rows are set for 80 percent, and higher percentages need no other. component_id is the smallest
    doc_id that links lead to, its own included; null ids don't count unless all are null. kept: the row's doc_id
    is the component's (rows that share this id are all kept; so are rows without an id that stand alone). Texts
    without words, null or empty, have no shingles and stand alone; those of fewer than `size` words have one. Equal
    sets and repeated rows are one vertex. Texts of any length are taken whole. An empty table gives no rows.
    """
    k1, k2 = row_key("doc_id", "text")
    base = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    signed = settle(sign(base, size, bands, rows), "minhash-signed")
    some = lambda c: F.first(c).alias(c)
    merged = signed.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("k"), some("n"), some("bands"), some("bytes"), some("parity"))
    classes = settle(merged.select("sid", "least", "k.k1", "k.k2", "n", "bands", "bytes", "parity"), "minhash-classes")
    slim = settle(signed.select("doc_id", "k1", "k2", "n", "sid"), "minhash-rows")
    release(signed)
    labels = label(base, classes, size, percent, rows)
    final = classes.select("sid", "least").join(labels, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = final.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(final.join(smallest, "root").select("sid", "component_id"), "minhash-named")
    release(classes, labels)
    found = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = slim.join(named, "sid", "left").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), found.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2).select("doc_id", "n_shingles", "component_id", "kept")


#: Prefixes in order of rarity make candidates here; whole sets decide.
OP11_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s
  FROM cut),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
often AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
placed AS (SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY c, t) AS place FROM tokens JOIN often USING (t)),
early AS (SELECT doc_id, n, t FROM placed WHERE place <= n - (4 * n + 4) // 5 + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM early a JOIN early b ON a.t = b.t AND a.doc_id < b.doc_id
  WHERE 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
shared AS (
  SELECT x, y, a.n + b.n AS total, count(*) AS common FROM pairs
  JOIN tokens a ON a.doc_id = x JOIN tokens b ON b.doc_id = y AND b.t = a.t GROUP BY x, y, a.n + b.n),
links AS (SELECT x, y FROM shared WHERE 100 * common >= 80 * (total - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reached r JOIN edges e ON r.y = e.x),
least_of AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM sets LEFT JOIN least_of ON doc_id = x
"""
