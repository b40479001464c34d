"""Connected components of a graph that is a table, by alternating star contractions.

Each round is joins and aggregations over (a, b) rows, written to the shared folder; the driver sees a row count
and a checksum, never nodes.  A node with very many neighbours is dealt over salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import discard, least_per_key, materialise, salt_of


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours v."""
    rows = edges.select("u", "v", salt_of("v"))
    return rows.join(least_per_key(rows, "u", "v", "w").drop("copies"), ["u", "salt"]).select("u", "v", F.least("u", "w").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rows = _with_least(down)
    linked = rows.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(rows.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _finish(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph that fits one task, by union-find."""
    kind = dict(edges.dtypes)["u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        form = None
        for b in batches:
            form = b.schema.field(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = find(u), find(v)
                parent[max(a, c)] = min(a, c)
        nodes = list(parent)
        for a in range(0, len(nodes), 1 << 16):
            some = nodes[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, form), pa.array([find(x) for x in some], form)], ["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b", *, fits: int = 500_000, rounds: int = 40) -> DataFrame:
    """(node, root) of every node that has an edge to another: root is the least node of its component.

    The graph is contracted over the cluster, in a number of rounds logarithmic in its longest path, until nothing
    changes or no more than ``fits`` edges are left (some 100 MB), which one task then finishes.  Loops and repeated edges don't matter.
    A graph that still changes after ``rounds`` rounds is an error.
    """
    at = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "edges")
    seen = (at.count(), None)
    for _ in range(rounds):
        if seen[0] <= fits:
            out = materialise(_finish(at), "components")
            discard(at)
            return out
        before, at = at, materialise(_small_star(_large_star(at)), "edges")
        discard(before)
        now = tuple(at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
