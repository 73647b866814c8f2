"""Connected components of an edge table: union-find inside tasks, star contraction between them.

Every task first replaces its edges by a union-find forest (each node points at the least node
it is joined to), so that dense groups shrink before anything is shuffled.  Large-star and
small-star rounds (Kiveris et al., 2014) then contract the forests until nothing changes.  Hub
nodes meet their edges in joins, which adaptive execution splits, never in one group.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_path, materialize


def _forest(batches):
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One contraction: neighbours of a node (all of them, or only the smaller) move to the least of them."""
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    around = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else ends
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = around.join(least, "u")
    if both:
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (two long columns a, b); root is the component's least node.

    Self-loops and repeated edges change nothing; rows with a null are ignored; no edges, no rows.
    """
    spark, folders = edges.sparkSession, list[str]()
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    now, mark = materialize(pairs.mapInArrow(_forest, "a long, b long").distinct(), "forest", folders), None
    for _ in range(most_rounds):
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark or sums[0] == 0:
            break
        mark = tuple(sums)
        now = materialize(_star(_star(now, True), False), "stars", folders)
        clear_path(spark, folders.pop(0))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
