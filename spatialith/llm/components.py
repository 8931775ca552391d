"""Connected components of an edge table by repeated local contraction.

In each round every node takes, of itself and its neighbours, the one that comes first in a fixed pseudo-random order;
edges between the names taken go into the next round.  Stars and small groups end in two or three rounds, chains in a
logarithmic number.  Each round pre-aggregates before it shuffles, so a node with any number of neighbours is safe, and
is written to the shared folder, so that plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) for each end of ``edges`` (columns a, b): component is the smallest id that edges reach.

    Self-loops, repeated and reversed edges are harmless; rows with a null end are ignored.
    """
    straight = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = scratch.keep(straight.distinct(), f"{name}-edges-0")
    steps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = scratch.keep(
            first.select(F.col("a").alias("id"), F.least("m", order("a"))["v"].alias("to")), f"{name}-step-{len(steps)}"
        )
        steps.append(step)
        left = step.select(F.col("id").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("id").alias("b"), F.col("to").alias("y"))
        named = current.join(left, "a").join(right, "b").filter("x <> y")
        named = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        current = scratch.keep(named, f"{name}-edges-{len(steps)}")
        scratch.drop(f"{name}-edges-{len(steps) - 1}")
    if not steps:
        return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
        found = found.join(later, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    found = scratch.keep(found, f"{name}-roots")
    least = found.groupBy("to").agg(F.least(F.min("id"), F.first("to")).alias("component"))
    return found.join(least, "to").select("id", "component")
