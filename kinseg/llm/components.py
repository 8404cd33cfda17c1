"""Connected components of a link table by repeated contraction, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinseg.llm.shared import forget, written

#: Steps along the pointers in a round.
JUMPS = 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node in edges(a, b); root is the smallest node reachable.

    Each round gives every node the smallest node among its neighbours, follows
    those pointers a few steps, and renames the ends of the edges to what they
    point at. Edges inside one name vanish, so the table shrinks until it is
    empty. Groups are aggregates or equi-joins only: no group is collected, and
    each round is written to the shared folder. No edges: no rows.
    """
    live = written(edges.select("a", "b").filter("a <> b").distinct(), "links")
    names: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        point = written(point, "pointers")
        hops = [point]
        for _ in range(JUMPS):
            onward = point.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            point = point.join(onward, "to").select("node", F.col("beyond").alias("to"))
            point = written(point, "pointers")
            hops.append(point)
        to_a, to_b = (point.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        renamed = live.join(to_a, "a").join(to_b, "b").filter("a2 <> b2")
        after = written(renamed.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        if names is None:
            names = point.select("node", F.col("to").alias("root"))
        else:
            last = point.select(F.col("node").alias("root"), F.col("to").alias("next"))
            merged = names.join(last, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            fresh = written(merged, "names")
            forget(names)
            names = fresh
        for old in (*hops[:-1], live):
            forget(old)
        live = after
    if names is None:
        names = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
