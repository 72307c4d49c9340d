"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import release, settle

#: Edges that a task holds at a time when it contracts its own.
HELD = 1 << 16


def contract(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> edges that connect the same nodes, those that a task holds as stars: each node with the
    smallest one that the task's edges lead to. Nothing is shuffled; rows of one `a` in a row stay together."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            root = x
            while up.get(root, root) != root:
                root = up[root]
            while up.get(x, x) != root:
                up[x], x = root, up[x]
            return root

        def stars() -> pa.RecordBatch:
            rows = [(x, top(x)) for x in list(up)]
            rows = [r for r in rows if r[0] != r[1]]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in (0, 1)], names=["a", "b"])

        types = last = None
        for batch in batches:
            types = types or [batch.schema.field(i).type for i in (0, 1)]
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(up) > HELD and a != last:
                    yield stars()
                    up.clear()
                last = a
                x, y = top(a), top(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if up:
            yield stars()

    return edges.mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """edges(a, b) -> node, root: the smallest node that can be reached, for each node that has an edge.

    Tasks first contract the edges they hold, so `edges` is best a written table, which few tasks read. Each
    node's smallest neighbour is then found: where no node has both smaller and larger neighbours, or two
    smaller ones, that's the result. Else a round links the larger neighbours of a node to its smallest one,
    deals the edges by their larger node and contracts again, which links a node's smaller neighbours likewise;
    the number of rounds grows with the logarithm of the longest chain. A star with very many leaves stays a list
    of edges throughout, aggregated by partial minima; nothing is gathered by node. Tables go to the shared folder.
    """
    now = settle(contract(edges.filter("a <> b").select("a", "b")), f"{name}-0")
    for i in range(1, rounds + 1):
        both = now.select(F.col("a").alias("node"), F.col("b").alias("to")).union(now.select(F.col("b").alias("node"), F.col("a").alias("to")))
        most = both.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.when(F.col("to") < F.col("node"), F.col("to"))).alias("up"))
        loose = F.expr("lo < node AND (hi > node OR lo <> up)")
        least = settle(most.select("node", F.least("node", "lo").alias("root"), loose.alias("loose")), f"{name}-{i}-least")
        if least.filter("loose").isEmpty():
            release(now)
            return least.select("node", "root")
        large = now.join(least, F.col("b") == F.col("node")).select("a", F.col("root").alias("b"))
        new = settle(contract(large.repartition("a").sortWithinPartitions("a")), f"{name}-{i}")
        release(now, least)
        now = new
    raise RuntimeError("the components didn't settle")
