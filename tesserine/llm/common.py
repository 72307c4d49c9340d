"""Helpers shared by the corpus operators: tables, row keys, cut lineage, words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of rows that a Python worker gets at a time, and its value here: whole texts
#: come in batches, and 10,000 of them can be very large.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); an own one only where that is unset and Spark runs
    in one process, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("tesserine.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("a cluster needs a shared folder: set spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="tesserine-")
        spark.conf.set("tesserine.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Python workers get few bytes at a time, where the session leaves that at Spark's default."""
    now = spark.conf.get(BATCH).removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table that reads it: lineage ends here,
    so a lost executor costs a reread and not a recomputation. What was shuffled for it isn't needed any
    more, so Spark may remove those files when the table is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*cols: str) -> tuple[Column, Column]:
    """128 bits that name a row by its values; nulls are allowed. Equal rows share the key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("tesserine"), *cols)


def keyed(docs: DataFrame) -> DataFrame:
    """docs -> row (a struct of all columns, so no name can clash), k1, k2. select("row.*") gives docs again."""
    k1, k2 = row_key("doc_id", "text")
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), k1.alias("k1"), k2.alias("k2"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(rows: DataFrame, size: int) -> bytes:
    """rows(slot below size) -> `size` bits, set where a row has the slot. The result has the same size
    however many rows there are; each of 64 parts is packed where its rows are."""
    part = size // 64

    def pack(key: tuple, slots: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(part, bool)
        bits[slots["slot"].to_numpy() // 64] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    packed = rows.distinct().groupBy((F.col("slot") % 64).cast("int").alias("part")).applyInPandas(pack, "part int, bits binary")
    out = np.zeros((part, 64), bool)
    for r in packed.collect():
        out[:, r["part"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:part]
    return np.packbits(out).tobytes()


def bits_of(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
