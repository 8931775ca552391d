"""Frames: which objects a frame shows, and which frames to keep."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Fixed thresholds of the selector.
AREA_MIN, MASK_MIN, RATIO_MIN = 800.0, 400.0, 0.35


def visibility(meta: DataFrame, width: int = 320, height: int = 240, margin: int = 80) -> DataFrame:
    """Selector decision for each object of a frame, with all reasons against it.

    ``meta``: u, v, depth_m, bbox_ratio, area_px, mask_px, has_mask.
    """
    deep = (F.col("depth_m") > 0.3) & (F.col("depth_m") <= 8.0)
    centre = G.in_image(F.col("u"), F.col("v"), width, height, margin)
    large, masked, framed = F.col("area_px") >= AREA_MIN, F.col("mask_px") >= MASK_MIN, F.col("bbox_ratio") >= RATIO_MIN
    fallback = F.when(F.col("has_mask"), large & masked).otherwise(large & framed)
    decision = F.when(~deep, "rejected").when(centre, "selected_center").when(fallback, "selected_roi_fallback").otherwise("rejected")
    lost = deep & ~centre & ~fallback
    reasons = F.array_compact(
        F.array(
            F.when(~deep, "depth_out_of_range"),
            F.when(lost, "center_not_in_margin"),
            F.when(lost & ~F.col("has_mask") & ~framed, "bbox_in_frame_ratio_below_threshold"),
            F.when(lost & ~large, "projected_area_below_threshold"),
            F.when(lost & F.col("has_mask") & ~masked, "zbuffer_mask_area_below_threshold"),
        )
    )
    return meta.withColumns({"decision": decision, "reasons": F.concat_ws(",", reasons), "passed": decision != "rejected"})


def frame_scores(visible: DataFrame, edges: DataFrame) -> DataFrame:
    """Per frame: visible objects, well-cropped ones, attached pairs among them, and a score.

    Objects are known by scene and ``scene_object_id``, as in ``edges``.
    """
    end = lambda k: visible.select("scene_id", "frame_id", F.col("scene_object_id").alias(f"{k}_id"), F.col("bbox_ratio").alias(f"{k}_ratio"))
    pair = edges.select("scene_id", "parent_id", "child_id").join(end("parent"), ["scene_id", "parent_id"])
    pair = pair.join(end("child"), ["scene_id", "frame_id", "child_id"])
    n_pairs = pair.groupBy("frame_id").agg(F.count_if((F.col("parent_ratio") >= 0.5) & (F.col("child_ratio") >= 0.5)).alias("n_pairs"))
    base = visible.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_visible"), F.count_if(F.col("bbox_ratio") >= 0.7).alias("n_cropped"))
    out = base.join(n_pairs, "frame_id", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return out.withColumn("score", F.col("n_visible") + 2 * F.col("n_pairs"))


def select_frames(scores: DataFrame, group: str, most: int = 5, attached_slots: int = 3) -> DataFrame:
    """Per group the best frames with attached pairs first, then the best of the rest, ``most`` together."""
    order = [F.desc("score"), F.desc("n_cropped"), F.asc("frame_id")]
    has = (F.col("n_pairs") > 0).cast("int")
    ranked = scores.withColumn("_a", F.row_number().over(W.partitionBy(group, has).orderBy(*order)))
    first = (F.col("n_pairs") > 0) & (F.col("_a") <= attached_slots)
    ranked = ranked.withColumn("_slot", F.when(first, 0).otherwise(1))
    w = W.partitionBy(group).orderBy("_slot", *order)
    return ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("_a", "_slot")


def stride(frames: DataFrame, group: str, order: str) -> DataFrame:
    """Every frame of groups up to 10, every second up to 30, every third of larger ones."""
    w = W.partitionBy(group)
    rows = frames.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)) - 1)
    step = F.when(F.col("_n") <= 10, 1).when(F.col("_n") <= 30, 2).otherwise(3)
    return rows.filter(F.col("_i") % step == 0).drop("_n", "_i")


def every_nth(frames: DataFrame, group: str, order: str, n: int = 3) -> DataFrame:
    """The first, then every ``n``-th frame of each group."""
    w = W.partitionBy(group).orderBy(order)
    return frames.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") % n == 0).drop("_i")


def rerank(accepted: DataFrame, group: str, most: int) -> DataFrame:
    """The clearest accepted frames of each group, ``most`` at a time; ties go to the first name."""
    w = W.partitionBy(group).orderBy(F.coalesce("clarity", F.lit(0)).desc(), F.coalesce("image_name", F.lit("")))
    return accepted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def covering_frames(coverage: DataFrame, group: str = "scene_id") -> DataFrame:
    """Greedy set cover: per group, frames by how many items they newly cover; ties to clarity, then the later name.

    ``coverage``: group, frame_id, clarity, item.  One group is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {f: set(g.item) for f, g in pdf.groupby("frame_id")}
        clarity = pdf.groupby("frame_id").clarity.first().to_dict()
        covered: set = set()
        out = []
        while left:
            best = max(left, key=lambda f: (len(left[f] - covered), clarity[f], f))
            gain = len(left.pop(best) - covered)
            if not gain:
                break
            covered |= set(pdf.item[pdf.frame_id == best])
            out.append((pdf[group].iloc[0], best, len(out) + 1, gain))
        return pd.DataFrame(out, columns=[group, "frame_id", "place", "gain"])

    return coverage.groupBy(group).applyInPandas(run, f"{group} long, frame_id long, place int, gain int")


def occlusion_decision(m: DataFrame) -> DataFrame:
    """Static occlusion from ray counts: skip, not visible, not occluded, occluded or grayzone, the first that holds.

    ``m``: area_px, in_frame_ratio, n_in_frame, n_valid, n_visible, n_occluded, probe_n, probe_valid, probe_visible.
    """
    enough = (F.col("n_valid") >= 64) & (F.col("n_valid") >= 0.25 * F.col("n_in_frame"))
    ratio = F.col("n_occluded") / F.col("n_valid")
    skip = (F.col("area_px") < 400) | (F.col("in_frame_ratio") < 0.05) | (F.col("n_in_frame") <= 0)
    probed = (F.col("probe_n") >= 512) & (F.col("probe_valid") >= F.col("probe_n")) & (F.col("probe_visible") == 0)
    decision = (
        F.when(skip, "skip")
        .when(probed & (F.col("n_valid") > 0) & enough & (F.col("n_visible") == 0), "not visible")
        .when(~enough, "skip")
        .when(ratio < 0.005, "not occluded")
        .when((ratio > 0.10) & (F.col("n_occluded") >= 16), "occluded")
        .otherwise("grayzone")
    )
    return m.withColumn("decision", decision)
