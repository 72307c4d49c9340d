"""A manifest of a dataset as a hash tree: a root, and for each row a proof that it belongs to it.

Leaves are digested where their rows are, so only digests are shuffled. They are sorted by range and
numbered; from the number of leaves of a group follows how many nodes each level has, and so how many
children each node waits for. Building is driven by arrivals: a node that arrives is put into its parent's
partial list by its place, and a parent whose list is full becomes a node that arrives. What waits in vain
in a task, because siblings are in others, is its frontier: it is dealt anew by an ancestor some levels
up, so each round climbs at least so many levels, and tasks hold a bounded part of the tree. Links from
children to full parents, read backwards, give each node the siblings on its way up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.llm.common import partitions, release, settle, small_batches, table

#: Children of a node.
ARITY = 3
#: Levels that a round climbs at least: a part has at most ARITY**LEVELS nodes of its lowest level.
LEVELS = 8
#: Nodes that a task holds before it begins another lot (at the end of a part), and rows that it hands on at a time.
HELD, HANDED = 1 << 15, 4096
PATH = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of UTF-8 text."""
    return F.sha2(text.cast("binary"), 256)


def packed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def width(n: int, level: int) -> int:
    """Nodes of a level, over n leaves."""
    return -(-n // ARITY**level)


class Climb:
    """The nodes that a task has seen. A key is (group, leaves of the group, level, place)."""

    def __init__(self) -> None:
        self.nodes: dict[tuple, str] = {}
        self.waiting: dict[tuple, dict[int, str]] = {}
        self.runs: dict[tuple, list[str]] = {}
        self.paths: dict[tuple, tuple[list, tuple]] = {}

    def arrive(self, key: tuple, value: str) -> None:
        """A node; what it fills arrives in turn."""
        while True:
            self.nodes[key] = value
            g, n, level, i = key
            if width(n, level) == 1:
                return
            up = (g, n, level + 1, i // ARITY)
            part = self.waiting.setdefault(up, {})
            part[i % ARITY] = value
            if len(part) < min(ARITY, width(n, level) - ARITY * (i // ARITY)):
                return
            del self.waiting[up]
            run = self.runs[up] = [part[k] for k in range(len(part))]
            key, value = up, hashlib.sha256("".join(run).encode()).hexdigest()

    def path(self, key: tuple) -> tuple[list, tuple]:
        """The siblings (to the left, to the right) of each level up to the last full parent, and that parent."""
        found = self.paths.get(key)
        if found is None:
            g, n, level, i = key
            up = (g, n, level + 1, i // ARITY)
            if up in self.runs:
                run, k, (rest, top) = self.runs[up], i % ARITY, self.path(up)
                found = [("".join(run[:k]), "".join(run[k + 1 :])), *rest], top
            else:
                found = [], key
            self.paths[key] = found
        return found


def climb(nodes: DataFrame) -> DataFrame:
    """nodes(g, n, level, i, digest, part, ...) -> all but part, with near (the path as far as the task's nodes go) and t_level,
    t_i, t_digest (the node it ends at). Rows of a part follow one another."""
    own = ["g", "n", "level", "i", "digest", "part"]
    more = [c for c in nodes.columns if c not in own]
    types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    names = [*own[:-1], *more, "near", "t_level", "t_i", "t_digest"]
    schema = ", ".join(f"{c} {types[c]}" for c in [*own[:-1], *more]) + f", near {PATH}, t_level int, t_i long, t_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple] = []
        kinds: list[pa.DataType] = []

        def done() -> Iterator[pa.RecordBatch]:
            task = Climb()
            for r in lot:
                task.arrive(r[:4], r[4])
            for first in range(0, len(lot), HANDED):
                rows = lot[first : first + HANDED]
                found = [task.path(r[:4]) for r in rows]
                ends = [0]
                for steps, _ in found:
                    ends.append(ends[-1] + len(steps))
                sides = [pa.array([x[j] for steps, _ in found for x in steps], pa.string()) for j in (0, 1)]
                near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["l", "r"]))
                keep = [pa.array([r[j] for r in rows], kinds[j]) for j in range(len(kinds)) if j != 5]
                tops = [pa.array([top[2] for _, top in found], pa.int32()), pa.array([top[3] for _, top in found], pa.int64()), pa.array([task.nodes[top] for _, top in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*keep, near, *tops], names=names)
            lot.clear()

        for batch in batches:
            kinds = kinds or [f.type for f in batch.schema]
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(lot) >= HELD and (r[0], r[5]) != (lot[-1][0], lot[-1][5]):
                    yield from done()
                lot.append(r)
        yield from done()

    return nodes.select(*own, *more).mapInArrow(run, schema)


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """rows(g, at, digest, ...) -> rows with n (rows of the group) and i (place in it, from 0, by `at`, nulls first,
    then the digest). Ranges are numbered apart and then moved by what lies before them, so a group of any size is
    spread; equal rows each have their place."""
    order = ["g", "at", "digest"]
    laid = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    laid = settle(laid.withColumn("p", F.shiftright("id", 33)), f"{name}-sorted")
    runs = laid.groupBy("g", "p").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m"))  # a row a range and group
    before = F.sum("m").over(Window.partitionBy("g").orderBy("p")) - F.col("m")
    moved = runs.select("g", "p", (F.col("first") - before).alias("less"))
    sizes = runs.groupBy("g").agg(F.sum("m").alias("n"))
    moved = settle(moved.join(sizes, "g"), f"{name}-runs")
    out = settle(laid.join(moved, ["g", "p"]).withColumn("i", F.col("id") - F.col("less")).drop("id", "p", "less", "at"), f"{name}-ranked")
    release(laid, moved)
    return out


def forest(leaves: DataFrame, name: str) -> DataFrame:
    """leaves(g, n, i, digest, ...): a tree for each g -> leaves with near (the siblings of each leaf, level by level)
    and root."""
    spark = leaves.sparkSession
    small_batches(spark)

    def dealt(nodes: DataFrame, target: int) -> DataFrame:
        under = F.pow(F.lit(float(ARITY)), F.greatest(F.lit(target) - F.col("level"), F.lit(0)))
        placed = nodes.withColumn("part", F.floor(F.col("i") / under).cast("long"))
        return placed.repartition(partitions(spark), "g", "part").sortWithinPartitions("g", "part", "level", "i")

    rounds = [settle(climb(dealt(leaves.withColumn("level", F.lit(0)), LEVELS)), f"{name}-round-0")]
    while True:
        waits = rounds[-1].filter(F.pow(F.lit(float(ARITY)), F.col("t_level")) < F.col("n"))
        if waits.isEmpty():
            break
        front = waits.select("g", "n", F.col("t_level").alias("level"), F.col("t_i").alias("i"), F.col("t_digest").alias("digest")).distinct()
        rounds.append(settle(climb(dealt(front, LEVELS * (len(rounds) + 1))), f"{name}-round-{len(rounds)}"))
    # links read backwards, from the last round's nodes down to the leaves
    none = F.array().cast(PATH)
    found = rounds[-1].withColumn("root", F.col("t_digest"))
    for made in reversed(rounds[:-1]):
        above = found.select("g", F.col("level").alias("t_level"), F.col("i").alias("t_i"), F.col("near").alias("far"), F.col("root").alias("higher"))
        found = made.join(above, ["g", "t_level", "t_i"], "left").withColumn("near", F.concat("near", F.coalesce("far", none))).withColumn("root", F.coalesce("higher", "t_digest")).drop("far", "higher")
    out = settle(found.drop("n", "level", "t_level", "t_i", "t_digest"), f"{name}-paths")
    release(*rounds)
    return out


def fold(leaf: Column, path: Column) -> Column:
    """The root to which a leaf and the siblings on its way lead."""
    return F.aggregate(path, leaf, lambda acc, x: digest(F.concat(x["l"], acc, x["r"])))


def proof_text(path: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "")


def manifest(docs: DataFrame, group: str, order: str, fields: list[str], altered: dict[str, Column] | None = None) -> DataFrame:
    """docs -> `order`, leaf, subroot (of the row's group), root, path (siblings, level by level, through the subroot),
    other (the leaf of the row with the columns `altered`; leaf where they leave it as it is).

    A leaf is the digest of the row's `fields`. Leaves of a group stand by `order`, nulls first; of equal `order` by digest, and
    repeated rows side by side, each a leaf. Groups stand by their bytes, null first. A group of one row has its leaf as
    subroot, and one group alone its subroot as root. Texts of any length are digested in one go; null and empty
    ones differ. An empty table has no rows and no root. Other columns of docs play no part, whatever their names.
    """
    here = lambda c: docs[f"`{c}`"]
    leaf = digest(F.concat(*[packed(here(c)) for c in fields]))
    other = digest(F.concat(*[packed((altered or {}).get(c, here(c))) for c in fields]))
    g = F.coalesce(F.concat(F.lit("="), here(group).cast("string")), F.lit(""))
    leaves = forest(ranked(docs.select(g.alias("g"), here(order).alias("at"), leaf.alias("digest"), other.alias("other"), here(order).alias("key")), "merkle-rows"), "merkle-rows")
    tops = leaves.filter("i = 0").select(F.lit("").alias("g"), F.col("g").alias("at"), F.col("root").alias("digest"), F.col("g").alias("of"))
    upper = forest(ranked(tops, "merkle-groups"), "merkle-groups").select(F.col("of").alias("g"), F.col("near").alias("far"), F.col("root").alias("whole"))
    out = leaves.join(upper, "g")
    return out.select(F.col("key").alias(order), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("near", "far").alias("path"), "other")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0
    text = F.when(tampered, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    found = manifest(docs, "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": text})
    found = found.withColumn("folded_root", fold(F.col("other"), F.col("path"))).withColumn("proof_sha256", digest(proof_text(F.col("path"))))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_PACKED = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_PACKED.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
#: One tree over rows (g, i, n, d): its levels, and for each node what stands beside it in its run.
_LEVELS = """
{0} AS (
  SELECT g, 0 AS level, i, n AS m, d FROM {1}
  UNION ALL
  SELECT g, level + 1, i // 3, any_value((m + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM {0} WHERE m > 1 GROUP BY g, level, i // 3),
{0}_beside AS (
  SELECT g, level, i, coalesce(string_agg(d, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {0} WHERE m > 1 WINDOW run AS (PARTITION BY g, level, i // 3 ORDER BY i)),
{0}_walk AS (
  SELECT doc_id, g, 0 AS level, i, f, proof FROM {2}
  UNION ALL
  SELECT doc_id, w.g, w.level + 1, w.i // 3, sha256(l || f || r), proof || l || r
  FROM {0}_walk w JOIN {0}_beside b ON w.g = b.g AND w.level = b.level AND w.i = b.i),
{0}_end AS (SELECT doc_id, arg_max(f, level) AS f, arg_max(proof, level) AS proof FROM {0}_walk GROUP BY doc_id)"""
OP13_SQL = f"""
WITH RECURSIVE marked AS (
  SELECT doc_id, source, {_LEAF.format(_PACKED.format("text"))} AS d,
    {_LEAF.format(_PACKED.format("replace(text, chr(10), '')"))} AS other,
    list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), 256, 256, 256, 256, 256, 256, 256, 256]))),
      lambda crc, x: CASE WHEN x < 256 THEN xor(crc::BIGINT, x::BIGINT) ELSE xor((crc // 2)::BIGINT, (crc % 2 * 3988292384)::BIGINT) END) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, row_number() OVER (run ORDER BY doc_id) - 1 AS i, count(*) OVER run AS n, d,
    CASE WHEN xor(crc::BIGINT, 4294967295) % 2 = 0 THEN other ELSE d END AS f, '' AS proof
  FROM marked WINDOW run AS (PARTITION BY source)),
{_LEVELS.format("low", "leaves", "leaves")},
tops AS (SELECT '' AS g, g AS of, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, d FROM low WHERE m = 1),
climbed AS (SELECT e.doc_id, t.g, t.i, e.f, e.proof FROM low_end e JOIN leaves v ON e.doc_id = v.doc_id JOIN tops t ON t.of = v.g),
{_LEVELS.format("high", "tops", "climbed")}
SELECT v.doc_id, v.d AS leaf, t.d AS subroot, root, sha256(e.proof) AS proof_sha256, e.f AS folded_root, e.f = root AS verified
FROM leaves v JOIN tops t ON t.of = v.g JOIN high_end e ON e.doc_id = v.doc_id CROSS JOIN (SELECT d AS root FROM high WHERE m = 1)
"""
