"""Preference formatting of conversation pairs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import table

TURN = "struct<turn:bigint,role:string,text:string>"


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _written(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column, trained_role: str) -> Column:
    """Runs of `characters:1` (the loss counts them) and `characters:0`, one a turn."""
    run = lambda t: F.concat(F.length(_render(t)), F.when(t["role"] == trained_role, ":1").otherwise(":0"))
    return F.array_join(F.transform(turns, run), ",")


def format_pairs(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """turns(pair_id, chosen boolean, turn, role, text) -> one row a pair that has both sides.

    n_common: turns of the longest common prefix of both sides (role and text alike). prompt: that
    prefix, rendered once. chosen, rejected: what follows on each side. *_mask: runs that say which
    characters are trained. Null role or text counts as empty; turns of one side go by (turn, role,
    text), so ties are ordered and repeated rows stay. Equal sides: both completions are empty.
    Pairs with a null id or one side only give no row, nor does an empty table; turns whose `chosen` is null
    belong to neither side; texts of any length are taken whole; extra columns are not read.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda flag: F.array_sort(F.collect_list(F.when(F.col("chosen") == F.lit(flag), turn)))
    both = turns.filter("pair_id IS NOT NULL").groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    both = both.filter((F.size("c") > 0) & (F.size("r") > 0))
    alike = F.zip_with("c", "r", lambda c, r: F.coalesce((c["role"] == r["role"]) & (c["text"] == r["text"]), F.lit(False)))
    first_other = F.array_position(alike, False)
    both = both.withColumn("n_common", F.when(first_other == 0, F.size("c")).otherwise(first_other - 1).cast("int"))
    rest = lambda x: F.slice(x, F.col("n_common") + 1, F.size(x))
    return both.select(
        "pair_id", "n_common", _written(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
        _written(rest(F.col("c"))).alias("chosen"), _mask(rest(F.col("c")), trained_role).alias("chosen_mask"),
        _written(rest(F.col("r"))).alias("rejected"), _mask(rest(F.col("r")), trained_role).alias("rejected_mask"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2i is chosen over conversation 2i + 1."""
    turns = table(spark, sf_dir, "conversations")
    return format_pairs(turns.select(F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text"))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, {'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), both_sides AS (
  SELECT pair_id, list_sort(list(t) FILTER (is_chosen)) AS c, list_sort(list(t) FILTER (NOT is_chosen)) AS r FROM turns GROUP BY pair_id
), prefix AS (
  SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1),
              lambda i: i <= len(c) AND i <= len(r) AND c[i].role = r[i].role AND c[i].text = r[i].text), false) - 1, len(c))::INTEGER AS n_common
  FROM both_sides WHERE len(c) > 0 AND len(r) > 0
), parts AS (
  SELECT pair_id, n_common, c[1:n_common] AS p, c[n_common + 1:] AS c, r[n_common + 1:] AS r FROM prefix
)
SELECT pair_id, n_common,
  coalesce(list_aggregate(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '') AS chosen,
  coalesce(list_aggregate(list_transform(c, lambda t: (length(t.role) + length(t.text) + 13) || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END), 'string_agg', ','), '') AS chosen_mask,
  coalesce(list_aggregate(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '') AS rejected,
  coalesce(list_aggregate(list_transform(r, lambda t: (length(t.role) + length(t.text) + 13) || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END), 'string_agg', ','), '') AS rejected_mask
FROM parts
"""
