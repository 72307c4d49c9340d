"""Inputs that the queries derive from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.sources.inputs import button_events, input_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows with lhs, op, rhs: whole numbers, one of seven operators (the last isn't valid)."""
    rows = table(spark, sf_dir, "lineitem")
    op = F.get(F.array(*map(F.lit, ("+", "-", "*", "/", "%", "//", "^"))), (F.col("l_linenumber") - 1).cast("int"))
    return rows.select("*", F.col("l_quantity").cast("long").alias("a"), op.alias("sign"), F.round(F.col("l_discount") * 100).cast("long").alias("b"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text an order: its equations, joined by commas; open orders end in half an equation."""
    rows = operands(spark, sf_dir)
    text = F.concat_ws(" ", "a", "sign", "b")
    cols = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    texts = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*cols, text.alias("text")))).alias("t"))
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    joined = F.array_join(F.transform("t", lambda x: x["text"]), ", ")
    tail = F.when(F.col("o_orderstatus") == "P", " 1 +").otherwise("")
    return texts.join(status, "l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.concat(joined, tail).alias("raw"))


def presses(spark: SparkSession, sf_dir: str, one_device: bool = False) -> DataFrame:
    return button_events(table(spark, sf_dir, "events"), one_device)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return input_events(table(spark, sf_dir, "events"))
