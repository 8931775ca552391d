"""Pairs and triplets of a scene's objects: relations, their changes, and the first-level questions on them.

Every join keeps the scene as an equality key, so pairs are hash joins within scenes and grow with the sum of squared
scene sizes, never with the square of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

COORDS = ["cx", "cy", "cz", "x0", "y0", "z0", "x1", "y1", "z1"]


def side(objects: DataFrame, prefix: str, key: str = "scene_id") -> DataFrame:
    """An object table as one side of a join: all columns but the scene with a prefix."""
    return objects.select(key, *[F.col(c).alias(prefix + c) for c in objects.columns if c != key])


def pairs(objects: DataFrame, ordered: bool = False) -> DataFrame:
    """All pairs of a scene's objects (a before b, or both orders)."""
    a, b = side(objects, "a_"), side(objects, "b_")
    rest = F.col("a_id") != F.col("b_id") if ordered else F.col("a_id") < F.col("b_id")
    return a.join(b, "scene_id").filter(rest)


def rounded(d: Column) -> Column:
    return F.floor(d * 100 + 0.5) / 100


def measure(pair: DataFrame) -> DataFrame:
    """Adds distance, its bin and doubt, and the map direction of a seen from b."""
    dx, dy = F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy")
    out = pair.withColumn("distance_raw", G.box_distance())
    return out.withColumns(
        {
            "distance_bin": G.distance_bin(F.col("distance_raw")),
            "near_boundary": G.near_boundary(F.col("distance_raw")),
            "direction": G.ring_direction(dy, dx, G.CARDINAL),
            "ambiguity": G.ring_ambiguity(dy, dx),
        }
    )


def camera_relations(objects: DataFrame, cameras: DataFrame) -> DataFrame:
    """Per frame and pair: where b is from a as the camera sees it, above and below first."""
    pair = pairs(objects).join(cameras, "scene_id")
    # direction of b from a
    dx, dy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    forward, right = dx * F.col("fx") + dy * F.col("fy"), dx * F.col("fy") - dy * F.col("fx")
    flat = G.ring_direction(forward, right, G.HORIZONTAL)
    vertical = G.vertical_direction()
    return measure(pair).withColumns(
        {
            "horizontal": flat,
            "direction": F.coalesce(vertical, flat),
            "ambiguity": F.when(vertical.isNotNull(), G.vertical_ambiguity()).otherwise(G.ring_ambiguity(forward, right)),
        }
    )


def with_edge(pair: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the type of the pair's attachment edge, in whichever direction, or null."""
    known = edges.select(
        "scene_id",
        F.least("parent_id", "child_id").alias("_lo"),
        F.greatest("parent_id", "child_id").alias("_hi"),
        F.col("type").alias("edge_type"),
    )
    keyed = pair.withColumns({"_lo": F.least("a_id", "b_id"), "_hi": F.greatest("a_id", "b_id")})
    return keyed.join(known, ["scene_id", "_lo", "_hi"], "left").drop("_lo", "_hi")


def suppression(direction: Column) -> Column:
    """Why a horizontal answer is not asked for: attached, touching, or overlapping footprints; null if it is."""
    x, y, z = G.box_gaps()
    contact = ~((x > G.EPS) | (y > G.EPS) | (z > G.EPS))
    return (
        F.when(direction.isin("above", "below"), None)
        .when(F.col("edge_type").isNotNull(), "attached_pair_non_vertical_direction")
        .when(contact, "horizontal_3d_bbox_contact")
        .when(G.overlap_area() > G.EPS, "horizontal_projection_overlap")
    )


def changed(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of both tables, by key, in which some field differs; null equals null."""
    n = new.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields])
    both = old.select(*keys, *[F.col(f).alias(f"old_{f}") for f in fields]).join(n, keys)
    names = [F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]
    return both.withColumn("changes", F.concat_ws(",", *names)).filter("changes <> ''")


def merged_changes(primary: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Changed relations of two searches by key: ``changes`` (a map) of both, where ``extra`` wins."""
    both = primary.select(*keys, F.lit(0).alias("_o"), "changes").unionByName(extra.select(*keys, F.lit(1).alias("_o"), "changes"))
    one = both.select(*keys, "_o", F.explode("changes").alias("field", "value")).groupBy(*keys, "field").agg(F.max_by("value", "_o").alias("value"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("changes"))


def triplets(objects: DataFrame, least_distance: float = 0.5) -> DataFrame:
    """Ordered (reference, facing, target) with different labels, a stable heading, and distances of some size.

    Pairs are filtered before the third join.
    """
    pair = side(objects, "a_").join(side(objects, "b_"), "scene_id").filter("a_id <> b_id and a_label <> b_label")
    dx, dy, dz = (F.col(f"b_c{k}") - F.col(f"a_c{k}") for k in "xyz")
    pair = pair.filter(G.stable_facing(dx, dy, dz) & (G.box_distance() >= least_distance))
    pair = pair.select("scene_id", *[F.col(p + c) for p in ("a_", "b_") for c in ("id", "label", *COORDS)])
    trip = pair.join(side(objects, "c_"), "scene_id")
    trip = trip.filter("c_id <> a_id and c_id <> b_id and c_label <> a_label and c_label <> b_label")
    trip = trip.filter(G.box_distance("a_", "c_") >= least_distance)
    fx, fy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    tx, ty = F.col("c_cx") - F.col("a_cx"), F.col("c_cy") - F.col("a_cy")
    along, right = tx * fx + ty * fy, tx * fy - ty * fx
    norm = F.hypot(fx, fy)
    return trip.withColumns(
        {
            "direction": G.ring_direction(along / norm, right / norm, G.HORIZONTAL),
            "ambiguity": G.ring_ambiguity(along / norm, right / norm),
        }
    )


def hash_order(*keys: str, seed: int = 42) -> Column:
    """A reproducible random order: md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def cap_per(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
