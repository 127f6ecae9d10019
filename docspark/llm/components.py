"""Connected components as DataFrame joins and aggregates.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", SoCC 2014): each step replaces the edges of a node by edges to the least node of its
neighbourhood. Neighbourhoods are never gathered: a step is one ``min`` aggregate, which Spark
combines before the shuffle, and one equi-join back to the edges, which deals the edges of a hub (the root of
a giant component) over salts. The edge list stays distributed and is written to the shared folder after
every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.skew import spread_join
from docspark.storage import Workspace


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hub = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("__n")).select("a", F.least("a", "least").alias("m"), "__n")
    return (
        spread_join(both.where("b > a"), hub, "a", ["b"], "__n", 2 * n)
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b").distinct()
    )


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n"))
    moved = spread_join(down, least, "a", ["b"], "__n", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, work: Workspace, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the least node of its component.

    Nulls and self-loops are ignored, repeated edges count once, no edges give no rows.
    """
    start = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    path = work.write(start, "edges")
    current, mark = work.read(path, start), None
    for _ in range(max_rounds):
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or (state["n"], state["h"]) == mark:
            break
        mark = (state["n"], state["h"])
        following = _small_star(_large_star(current, state["n"]), state["n"])
        new_path = work.write(following, "edges")
        current = work.read(new_path, start)
        work.drop(path)
        path = new_path
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
