"""Attachment graphs: best parents, chains, and forests without cycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed order of attachment types, the strongest last.
TYPE_PRIORITY = {"supported_by": 1, "resting_on_soft_surface": 2, "affixed_to": 3, "contained_in": 4}


def type_priority(column: str = "type"):
    out = F.lit(0)
    for name, rank in TYPE_PRIORITY.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Rank of each candidate parent within its child: confidence, type, containment, coverage, then least gap.

    Of equal candidates the smaller parent comes first.
    """
    order = [F.desc("confidence"), F.desc(type_priority()), F.desc("containment"), F.desc("coverage"), F.asc("gap"), F.asc("parent_id")]
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy("scene_id", "child_id").orderBy(*order)))


def best_parent(candidates: DataFrame) -> DataFrame:
    """One row per child: its best candidate.  An aggregate, so candidates shrink before they are shuffled."""
    key = F.struct("confidence", type_priority().alias("p"), "containment", "coverage", (-F.col("gap")).alias("g"), (-F.col("parent_id")).alias("o"))
    return candidates.groupBy("scene_id", "child_id").agg(F.max_by(F.struct("parent_id", "type", "confidence"), key).alias("e")).select("scene_id", "child_id", "e.*")


def best_support(candidates: DataFrame) -> DataFrame:
    """One row per child: the parent that carries it, by type, contact height, gap, confidence and coverage."""
    key = F.struct(type_priority().alias("p"), "contact_z", (-F.col("gap")).alias("g"), "confidence", "coverage", (-F.col("parent_id")).alias("o"))
    return candidates.groupBy("scene_id", "child_id").agg(F.max_by(F.struct("parent_id", "type"), key).alias("e")).select("scene_id", "child_id", "e.*")


def forest(candidates: DataFrame) -> DataFrame:
    """Best parents with cycles broken: a scene's edges enter in descending order unless they close a cycle."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["confidence", "parent_id", "child_id"], ascending=[False, True, True])
        parent: dict[int, int] = {}
        keep = []
        for row in order.itertuples():
            at = row.parent_id
            while at is not None and at != row.child_id:
                at = parent.get(at)
            if at is None:
                parent[row.child_id] = row.parent_id
                keep.append(row.Index)
        return pdf.loc[keep, ["scene_id", "parent_id", "child_id", "type"]]

    schema = "scene_id long, parent_id long, child_id long, type string"
    return best_parent(candidates).groupBy("scene_id").applyInPandas(build, schema)


def chains(edges: DataFrame) -> DataFrame:
    """(scene_id, root, id, hops): all dependents of each object at any depth, with the fewest hops.

    A scene's edges are one small group, so one shuffle replaces a join per level; cycles end.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict[int, list[int]] = {}
        for parent, child in zip(pdf.parent_id.tolist(), pdf.child_id.tolist(), strict=True):
            below.setdefault(parent, []).append(child)
        rows = []
        for root in below:
            seen, level, hops = {root}, [root], 0
            while level:
                hops += 1
                level = list(dict.fromkeys(c for p in level for c in below.get(p, ()) if c not in seen))
                seen.update(level)
                rows += [(root, c, hops) for c in level]
        out = pd.DataFrame(rows, columns=["root", "id", "hops"])
        return out.assign(scene_id=pdf.scene_id.iloc[0])[["scene_id", "root", "id", "hops"]]

    slim = edges.select("scene_id", "parent_id", "child_id")
    return slim.groupBy("scene_id").applyInPandas(walk, "scene_id long, root long, id long, hops int")


def moved_sets(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, target, id): what moves when the target moves, itself included."""
    own = objects.select("scene_id", F.col("id").alias("target"), "id")
    return own.unionByName(chains(edges).select("scene_id", F.col("root").alias("target"), "id"))


def grandparents(edges: DataFrame) -> DataFrame:
    """(scene_id, grandparent_id, parent_id, grandchild_id): two hops down."""
    up = edges.select("scene_id", F.col("parent_id").alias("grandparent_id"), F.col("child_id").alias("parent_id"))
    down = edges.select("scene_id", "parent_id", F.col("child_id").alias("grandchild_id"))
    return up.join(down, ["scene_id", "parent_id"])


def chain_questions(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Two-hop chains with the nearest object outside the chain as distractor; three different labels."""
    two = grandparents(edges)
    tops = two.select("scene_id", F.col("grandparent_id").alias("target")).distinct()
    inside = moved_sets(objects, edges).withColumnRenamed("id", "o_id")
    at = objects.select("scene_id", *[F.col(c).alias(f"o_{c}") for c in ("id", "label", "cx", "cy", "cz")])
    top = objects.select("scene_id", F.col("id").alias("target"), *[F.col(c).alias(f"g_{c}") for c in ("cx", "cy", "cz")])
    outside = tops.join(at, "scene_id").join(inside, ["scene_id", "target", "o_id"], "left_anti").join(top, ["scene_id", "target"])
    square = sum(((F.col(f"o_c{k}") - F.col(f"g_c{k}")) * (F.col(f"o_c{k}") - F.col(f"g_c{k}")) for k in "xyz"), F.lit(0.0))
    near = outside.groupBy("scene_id", "target").agg(F.min_by(F.struct("o_id", "o_label"), F.struct(square, "o_id")).alias("n"))
    label = lambda k: objects.select("scene_id", F.col("id").alias(f"{k}_id"), F.col("label").alias(f"{k}_label"))
    out = two.join(near.withColumnRenamed("target", "grandparent_id"), ["scene_id", "grandparent_id"])
    for k in ("grandparent", "parent", "grandchild"):
        out = out.join(label(k), ["scene_id", f"{k}_id"])
    out = out.filter("size(array_distinct(array(parent_label, grandchild_label, n.o_label))) = 3")
    return out.select(
        "scene_id",
        "grandparent_id",
        "parent_id",
        "grandchild_id",
        F.col("n.o_id").alias("neighbor_id"),
        F.concat(F.lit("Both the "), "parent_label", F.lit(" and the "), "grandchild_label").alias("correct_value"),
    )
