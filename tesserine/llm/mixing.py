"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.llm.common import settle, table, word_count

#: Hex digits of the sampling hash that make a histogram bucket: 16**4 buckets a source at most.
BUCKET_DIGITS = 4
#: Columns that repetitions() adds.
MADE = ("size", "source_size", "target", "reps")


def weigh(sources: DataFrame, weights: Sequence[int] = (3, 1, 2)) -> DataFrame:
    """Adds `weight`: the weights repeat over the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.array(*map(F.lit, weights))[rank % len(weights)].cast("double"))


def water_fill(sources: DataFrame, budget_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """sources(source, source_size, weight) -> the same with `target`.

    budget_share * sum(source_size) is shared by weight; a source stops at max_epochs times its size
    and what it can't take is reshared by weight. Sources ordered by cap / weight fill up in that
    order, so one pass of running sums finds the level. The table has one row a source.
    """
    capped = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = (
        capped.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(budget_share)))
        .withColumn("level", level)
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    # the level of the first source that stays below its cap holds for all that do
    lowest = F.min_by("level", F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(whole)
    return filled.withColumn("open_level", lowest).select(
        "source", "source_size", "weight",
        F.when(F.col("full"), F.col("cap")).otherwise(F.col("open_level") * F.col("weight")).alias("target"),
    )


def ticket(doc_id: str, seed: str) -> Column:
    """The place of a document in its source's seeded order; documents without an id are told apart by their text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))))


def _cut(rows: DataFrame, bucket: str) -> DataFrame:
    """rows(_s, _need, _base, words, bucket): of each source the bucket in which _base and the words up to
    it reach _need (_cut), and what comes before (_before)."""
    run = Window.partitionBy("_s").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    reached = rows.withColumn("_upto", F.col("_base") + F.sum("words").over(run)).withColumn("_low", F.col("_upto") - F.col("words"))
    at = reached.filter((F.col("_upto") >= F.col("_need")) & (F.col("_low") < F.col("_need")))
    return at.groupBy("_s", "_need").agg(F.min(bucket).alias("_cut"), F.min_by("_low", bucket).alias("_before"))


def repetitions(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), budget_share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", doc_id: str = "doc_id"
) -> DataFrame:
    """Adds `size`, `source_size`, `target`, `reps` to docs(doc_id, text, source, ...).

    Each source's documents come floor(target / source_size) times, and those that stand first in the
    seeded order once more until the source's words are as near its target as whole documents allow.
    A histogram of the order (fixed buckets of the hash) finds the one bucket where the source's words
    end; only that bucket's documents are sorted. Null text: size 0. Null source: a source of its own.
    Equal doc_id: neighbours in the order, the shorter first; null doc_id: by a hash of the text. Empty docs:
    no rows. Columns of docs with the names added here are replaced, others stay, whatever their names (mix() keeps all).
    """
    kept = [c for c in docs.columns if c.lower() not in MADE]
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in kept)).alias("row"), docs[f"`{doc_id}`"].alias("doc_id"), "text", "source")
    return _drawn(rows, weights, budget_share, max_epochs, seed).select("row.*", *MADE)


def _drawn(base: DataFrame, weights: Sequence[int] = (3, 1, 2), budget_share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", doc_id: str = "doc_id") -> DataFrame:
    """repetitions() of a table that has no names of its own beside row, doc_id, text and source."""
    sized = base.withColumn("size", word_count(F.col("text"))).withColumn("_ticket", ticket(doc_id, seed))
    sized = sized.withColumn("_bucket", F.substring("_ticket", 1, BUCKET_DIGITS))
    buckets = settle(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = water_fill(weigh(sources, weights), budget_share, max_epochs)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    need = plan.select(F.col("source").alias("_p"), "_need")
    # where each source's words end: first among 256 coarse buckets, then among the 256 within that one
    coarse = buckets.groupBy(F.col("source").alias("_s"), F.substring("_bucket", 1, BUCKET_DIGITS // 2).alias("_part")).agg(F.sum("words").alias("words"))
    coarse = _cut(coarse.join(need, F.col("_s").eqNullSafe(F.col("_p"))).withColumn("_base", F.lit(0).cast("long")), "_part").select("_s", "_need", F.col("_cut").alias("_part"), F.col("_before").alias("_base"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.substring("_bucket", 1, BUCKET_DIGITS // 2) == F.col("_part"))
    ends = _cut(buckets.join(coarse, same), "_bucket").select("_s", "_cut", "_before")
    plan = settle(
        plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select(F.col("source").alias("_source"), "source_size", "target", "_whole", "_need", "_cut", "_before"),
        "mix-plan",
    )
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    at_cut = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    outside = joined.filter(~at_cut).withColumn("_more", F.when(F.col("_cut").isNull(), F.lit(0)).otherwise((F.col("_bucket") < F.col("_cut")).cast("int")))
    order = Window.partitionBy("_source").orderBy("_ticket", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = joined.filter(at_cut).withColumn("_more", (so_far * 2 + F.col("size") < F.col("_need") * 2).cast("int"))
    out = outside.unionByName(inside)
    return out.withColumn("reps", (F.col("_whole") + F.col("_more")).cast("int")).select(*base.columns, *MADE)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it was drawn, with the columns of docs, whatever their
    names."""
    doc_id = options.get("doc_id", "doc_id")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), doc_id, "text", "source")
    drawn = _drawn(rows, **options).filter("reps > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("reps"))).alias("copy")).select("row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = _drawn(docs)
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("reps")).cast("long").alias("taken"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))) AS ticket
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget
  FROM sources
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap ELSE weight * (
           SELECT min_by(level, cap / weight) FROM levels WHERE level * weight < cap) END AS target
  FROM levels
), run AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ticket, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN so_far * 2 + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
