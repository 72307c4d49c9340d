"""Whitening of embeddings: a singular value decomposition of centred, distributed rows.

Vectors become whole numbers, so sums and deviations are exact. The fit takes each distinct vector once;
MLlib's computeSVD gives singular values s and right vectors of the centred rows, and s * s / n are the
eigenvalues of their covariance with divisor n. The total variance is not a sum of those (only the first
few are asked for): it comes from the exact squared deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import release, settle, small_batches, table

#: Whole numbers: floor(SCALE * entry) + SHIFT. Entries that scaling takes to REACH or beyond can't be told from
#: their neighbours as doubles.
SCALE, SHIFT, REACH = 64, 1_000_000, float(1 << 52)
#: Components whose singular value is a smaller share of the largest are noise of double arithmetic.
SMALLEST = 1e-5
DIGITS = "decimal(38,0)"


def whole(rows: DataFrame, vector: str) -> DataFrame:
    """rows + x (array<long>), without those whose vector is null, empty, or holds a null, an entry that isn't
    finite, or one of 2**52 / 64 or more."""
    c = F.transform(vector, lambda v: v.cast("double") * SCALE)
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < REACH))
    return rows.filter(F.coalesce(usable, F.lit(False))).withColumn("x", F.transform(c, lambda v: F.floor(v).cast("long") + SHIFT))


class Fit:
    """What the fit gives: n, sums (one a dimension), total (trace of the covariance), components (a column each),
    eigenvalues. Its size depends on the number of dimensions alone."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.total, self.components, self.eigenvalues = 0.0, np.zeros((len(sums), 0)), np.zeros(0)

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S as whole numbers, and x - S / n. x: a row a vector."""
        near = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * m for s, m in zip(self.sums, near.tolist(), strict=True)]
        steps = x - near
        if float(np.abs(steps).max(initial=0) + 1) * self.n < 2**62:
            exact = steps * np.int64(self.n) - np.array(rest, np.int64)
        else:
            exact = steps.astype(object) * self.n - np.array(rest, object)
        return exact, exact.astype(np.float64) / self.n

    def deviations(self, exact: np.ndarray) -> pa.Array:
        """Sums of squares, exact (null where 38 digits don't hold one)."""
        if float((exact.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < 2**62:
            return pa.array((exact * exact).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
        sums = (exact.astype(object) ** 2).sum(axis=1)
        return pa.array([str(s) if s < 10**38 else None for s in sums]).cast(pa.decimal128(38, 0))

    def white(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / np.sqrt(self.eigenvalues)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _centred(fit: DataFrame, found: Fit) -> RowMatrix:
    """The distributed rows x - S / n."""
    means = F.array(*[F.struct(F.lit(s // found.n).alias("whole"), F.lit(s % found.n / found.n).alias("part")) for s in found.sums])
    rows = fit.select(array_to_vector(F.zip_with("x", means, lambda x, m: (x - m["whole"]).cast("double") - m["part"])).alias("row"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), found.n, len(found.sums))


def _total(fit: DataFrame, found: Fit) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, _ = found.apart(_vectors(batch.column(0), len(found.sums)))
            yield pa.RecordBatch.from_arrays([found.deviations(exact)], names=["d"])

    total = fit.select("x").mapInArrow(run, f"d {DIGITS}").agg(F.sum("d")).first()[0]
    return 0.0 if total is None else float(total) / found.n**3


def learn(fit: DataFrame, most: int) -> Fit | None:
    """fit(x), distinct and of one length -> the first components, `most` of them at most; None without rows."""
    sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    if not sums:
        return None
    found = Fit(sums[0]["n"], [r["s"] for r in sums])
    found.total = _total(fit, found)
    if found.total > 0:
        svd = _centred(fit, found).computeSVD(min(most, len(sums)), computeU=False, rCond=SMALLEST)
        found.components, found.eigenvalues = svd.V.toArray(), svd.s.toArray() ** 2 / found.n
    return found


def identity_error(fit: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance (divisor n) minus the identity."""
    if not len(found.eigenvalues):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, centred = found.apart(_vectors(batch.column(0), len(found.sums)))
            made = found.white(centred)
            flat, offsets = pa.array(made.ravel()), np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["w"])

    rows = fit.select("x").mapInArrow(run, "w array<double>").select(array_to_vector("w").alias("row"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), found.n, len(found.eigenvalues))
    covariance = matrix.computeCovariance().toArray() * (found.n - 1) / found.n  # centred first; its divisor is n - 1
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 16) -> DataFrame:
    """rows -> key, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error: a
    row for each usable row (repeated rows each have theirs) and component.

    Not usable: vectors that are null, empty, or hold nulls, entries that aren't finite or of 2**46 and more;
    where lengths differ, all but the commonest length (of equally common ones, the longest). Components of no
    variance (a singular value under 1e-5 of the largest) have none to be scaled to and give no row; so there
    are none where all vectors are equal, and none in an empty table. A deviation beyond 64 bits is null. Null
    keys stay; other columns may have any names.
    """
    spark = rows.sparkSession
    small_batches(spark)
    base = whole(rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")), "v").drop("v")
    distinct = settle(base.select("x").distinct(), "whitening-fit")
    kind = f"{key} {rows.schema[key].dataType.simpleString()}"
    schema = f"{kind}, component int, n long, deviation {DIGITS}, whitened double, explained double, identity_error double"
    lengths = distinct.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), F.desc("width")).first()
    found = None
    if lengths:
        fit = distinct.filter(F.size("x") == lengths["width"])
        found = learn(fit, most)
        base = base.filter(F.size("x") == lengths["width"])
    if found is None or not len(found.eigenvalues):
        release(distinct)
        return spark.createDataFrame([], schema).withColumn("deviation", F.col("deviation").cast("long"))
    error, k = identity_error(fit, found), len(found.eigenvalues)
    release(distinct)
    explained = found.eigenvalues / found.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, centred = found.apart(_vectors(batch.column(1), len(found.sums)))
            m = len(exact)
            each = pa.array(np.repeat(np.arange(m), k))
            cols = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)), found.deviations(exact).take(each)]
            cols += [pa.array(x) for x in (found.white(centred).ravel(), np.tile(explained, m), np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return base.select("key", "x").mapInArrow(run, schema).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
