"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve projects the vectors to a few dimensions of a random rotation, shifts them, and orders them
by their key on a Hilbert curve; Spark deals the keys out by ranges. A query's candidates are those that
stand near it on any of the curves; they are ranked by the exact cosine of the original vectors.

How near is fitted: for a bounded sample of the vectors the true neighbours are found by an exact scan,
and the window is the least one that holds the wanted share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.llm.common import partitions, release, settle, table

CURVES = 12
#: Dimensions of a projection, and bits a dimension of its key (together 62 at most).
DIMENSIONS, BITS = 8, 7
#: Share of the sample's true neighbours that the windows must hold, and vectors in the sample.
RECALL, SAMPLE = 0.96, 192
#: Rows in a block of consecutive keys, and queries that meet it in one task, about.
BLOCK, QUERIES = 2048, 2048


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of points (rows) with coordinates below 2**bits: Skilling's transform
    of the coordinates, then their bits interleaved."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        top, below = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & top) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


def rotation(width: int, curve: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions of a curve and its shift. Curves in a row share a rotation, of which each
    takes other directions while they last."""
    per = max(1, width // dimensions)
    full = np.linalg.qr(np.random.default_rng([seed, curve // per, width]).normal(size=(width, width)))[0]
    at = (curve % per) * dimensions
    shift = np.random.default_rng([seed, curve, width, 1]).uniform(-0.5, 0.5, min(dimensions, width))
    return full[:, at : at + dimensions], shift


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: nothing is rounded, and norms of very
    small or large vectors neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_reach(entries: DataFrame, ranks: DataFrame, k: int, recall: float, sample: int, width: int) -> int:
    """Rows on each side of a query, on every curve, that hold `recall` of the true neighbours of a sample.

    entries(entry, embedding), ranks(curve, entry, place). The sample is fixed by a hash and has `sample` vectors
    at most; each partition sends its nearest k of each, so nothing that is collected grows with the table.
    """
    asked = entries.select("entry", "embedding").orderBy(F.xxhash64("entry"), "entry").limit(sample).collect()
    names = np.array([r["entry"] for r in asked], np.int64)
    shared = entries.sparkSession.sparkContext.broadcast(unit(np.array([r["embedding"] for r in asked], float).reshape(-1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            score = shared.value @ unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)).T
            score[names[:, None] == own] = -2
            best = np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, :k]
            q = np.repeat(names, best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(own[best.ravel()]), pa.array(np.take_along_axis(score, best, axis=1).ravel())], names=["q", "entry", "score"])

    near = entries.select("entry", "embedding").mapInArrow(run, "q long, entry long, score double").filter("score > -2")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "entry")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("q", "entry")
    placed = near.join(ranks, "entry").join(ranks.select("curve", F.col("entry").alias("q"), F.col("place").alias("own")), ["curve", "q"])
    apart = [r["d"] for r in placed.groupBy("q", "entry").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("d")).collect()]
    return max(k, int(np.quantile(apart, recall, method="higher"))) if apart else k


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, embedding (array of double) of the rows that take part."""
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("embedding")).filter("id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def search(
    vectors: DataFrame, is_query: str, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    curves: int = CURVES, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK, queries: int = QUERIES, seed: int = 7,
) -> DataFrame:
    """The k nearest found of each row that `is_query` (SQL on `id`) picks, against every other row:
    query_id, rank, vec_id, score (cosine in double precision), nearest first, ties to smaller ids.

    Rows whose vector is null, empty, zero, or has null or non-finite components take no part; vectors
    of another width than the most frequent one don't either. Equal vectors are one entry of the index,
    with their k + 1 smallest ids (no answer can need more), so a vector that very many rows share costs
    as much as any other. Repeated rows count once. The windows are fitted to `recall` on a sample (fit_reach):
    narrow where vectors have structure, a share of all rows where they have none. Queries that meet a block
    of rows are dealt to several tasks, with `queries` each.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    widths = rows.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "w").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths[0]["w"]
    rows = rows.filter(F.size("embedding") == width)
    few = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    # the smallest ids, first within each of 64 shares of the ids, so that no list grows with a vector's rows
    part = rows.select("embedding", "id").distinct()
    ranked = part.withColumn("r", F.row_number().over(Window.partitionBy("embedding", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = ranked.groupBy("embedding").agg(few.alias("ids"), F.min("id").alias("entry"))
    entries = settle(entries, "ann-entries")
    asked = rows.filter(is_query).select("embedding", F.col("id").alias("query_id")).distinct()
    asked = settle(asked.join(entries.select("embedding", "entry"), "embedding"), "ann-queries")

    dims = min(DIMENSIONS, width)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = batch.column(0)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = unit(x)
            for c in range(curves):
                axes, shift = rotation(width, c, dims, seed)
                y = x @ axes
                # about three standard deviations of a random direction each way, moved by part of a cell's octave
                cells = np.clip((y * width**0.5 + shift + 3.5) / 7.0 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_key(cells, BITS)), entry], names=["curve", "h", "entry"])

    placed = entries.select("entry", "embedding").mapInArrow(keys, "curve int, h long, entry long")
    n = partitions(spark)
    placed = settle(placed.repartitionByRange(n, "curve", "h", "entry").withColumn("part", F.spark_partition_id()), "ann-keys")
    # rank of each entry on its curve: its place in its part, plus what earlier parts hold of the curve
    inner = F.row_number().over(Window.partitionBy("part", "curve").orderBy("h", "entry")) - 1
    sizes = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("curve", "part", "before")
    ranks = placed.withColumn("inner", inner).join(before, ["curve", "part"]).select("curve", "entry", (F.col("before") + F.col("inner")).alias("place"))
    ranks = settle(ranks, "ann-places")
    release(placed)
    total = entries.count()
    reach = fit_reach(entries, ranks, k, recall, sample, width)
    parts = max(1, round(asked.count() * min(1.0, (2 * reach + block) / max(total, 1)) / queries))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = ranks.join(entries.select("entry", "embedding", "ids"), "entry").select("curve", F.floor(F.col("place") / block).alias("b"), part.alias("part"), "place", "ids", "embedding", F.lit(None).cast("long").alias("query_id"))
    last = max(0, (total - 1) // block)
    low = F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / block)
    high = F.least(F.floor((F.col("place") + reach) / block), F.lit(last))
    from_queries = asked.join(ranks, "entry").select("curve", F.explode(F.sequence(low, high)).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "place", F.lit(None).cast("array<long>").alias("ids"), "embedding", "query_id")

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        there, asks = group[group["query_id"].isna()], group[group["query_id"].notna()]
        if there.empty or asks.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        base = scaled(np.stack(there["embedding"].to_numpy()).astype(np.float64))
        norm = np.sqrt(np.einsum("ij,ij->i", base, base))
        place, ids = there["place"].to_numpy(), there["ids"].to_list()
        out_q, out_v, out_s = [], [], []
        for lo in range(0, len(asks), 256):
            part = asks.iloc[lo : lo + 256]
            q = scaled(np.stack(part["embedding"].to_numpy()).astype(np.float64))
            own = np.sqrt(np.einsum("ij,ij->i", q, q))
            near = np.abs(place[None, :] - part["place"].to_numpy()[:, None]) <= reach
            score = np.where(near, (q @ base.T) / own[:, None] / norm[None, :], -np.inf)
            # entries that may tie with the k-th must stay: an own entry may give nothing, so k + 1
            size = min(k + 1, score.shape[1])
            bound = np.partition(score, score.shape[1] - size, axis=1)[:, score.shape[1] - size]
            for i, query in enumerate(part["query_id"].astype("int64").tolist()):
                best = np.flatnonzero((score[i] >= bound[i] - 1e-12) & near[i])
                found = []
                for j in best.tolist():
                    # summed in one order for all entries, so equal pairs get equal scores everywhere
                    s = float(np.dot(q[i], base[j]) / (own[i] * norm[j]))
                    found += [(-s, int(v)) for v in ids[j] if v != query]
                for s, v in sorted(found)[:k]:
                    out_q.append(query)
                    out_v.append(v)
                    out_s.append(-s)
        return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s}, dtype=object).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = held.unionByName(from_queries).groupBy("curve", "b", "part").applyInPandas(nearest, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "id % 50 = 0")
