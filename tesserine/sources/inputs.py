"""Text inputs: a path to a regular file, or the text itself; event sources from the events table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InputError(ValueError):
    """An input that exists but can't be read as text."""


class NoValidEquations(ValueError):
    """Not one equation of the run parses."""


def resolve_input(spark: SparkSession, argument: str | None) -> DataFrame:
    """One row (doc_id, raw). A regular file is read whole; another existing path is an error; anything
    else is the text. Bytes that aren't UTF-8 are an error, where Spark's text reader would replace them."""
    if argument is None:
        raise ValueError("usage: an equation text or a file path is needed")
    if os.path.isfile(argument):
        found = spark.read.format("binaryFile").load(argument).select(F.is_valid_utf8(F.col("content").cast("string")).alias("ok"), F.col("content").cast("string").alias("raw"))
        row = found.first()
        if not row["ok"]:
            raise InputError(f"cannot read file: {argument}: not valid UTF-8")
        return found.select(F.lit(0).cast("long").alias("doc_id"), "raw")
    if os.path.exists(argument):
        raise InputError(f"cannot read file: {argument}: not a regular file")
    return spark.createDataFrame([(0, argument)], "doc_id long, raw string")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Many whole files: doc_id (from the path), raw. A file that isn't UTF-8 stops the query."""
    text = F.col("content").cast("string")
    failed = F.raise_error(F.concat(F.lit("cannot read file: "), F.col("path"), F.lit(": not valid UTF-8"))).cast("string")
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), F.when(F.is_valid_utf8(text), text).otherwise(failed).alias("raw"))


def button_events(events: DataFrame, one_device: bool = False) -> DataFrame:
    """events -> device_id, ts, seq, button of the five-state machine."""
    button = F.create_map(*[F.lit(x) for pair in (("signup", "test"), ("view", "enable"), ("click", "ready"), ("purchase", "launch")) for x in pair])[F.col("event_type")]
    cancel = F.when(F.col("value") >= 50, "cu_cancel").otherwise("lpu_cancel")
    device = F.lit(0).cast("long") if one_device else F.col("user_id")
    return events.select(device.alias("device_id"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", cancel).otherwise(button).alias("button"))


def input_events(events: DataFrame) -> DataFrame:
    """events -> device_id, ts, seq, input, arg of the seven-state machine."""
    k = F.col("event_id") % 8
    kind = F.col("event_type")
    by_k = F.array(*map(F.lit, ("lp_cancel", "cu_cancel", "circuit", "circuit", "igniter", "igniter", "circuit", "full_reset")))
    name = (
        F.when(kind == "signup", F.when(k < 5, "test").otherwise("igniter"))
        .when(kind == "view", F.when(k < 6, "enable").otherwise("igniter"))
        .when(kind == "click", "ready").when(kind == "purchase", "launch").when(kind == "error", F.get(by_k, k.cast("int")))
    )
    arg = F.when((kind == "error") & k.isin(2, 3, 6), k != 2)
    return events.select(F.col("user_id").alias("device_id"), "ts", F.col("event_id").alias("seq"), name.alias("input"), arg.alias("arg"))
