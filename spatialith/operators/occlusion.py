"""Decisions on visibility from ray counts, and which questions they allow; all of it column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states a question may ask for, those with something to see, and the limits of evidence.
STATES = ["not occluded", "occluded", "not visible"]
SEEN = ["not occluded", "occluded"]
LEAST_AREA, LEAST_IN_FRAME = 400.0, 0.05
LEAST_VALID, LEAST_EFFECTIVE = 64, 0.25
VETO_LEAST = 0.35


def evidence(rays: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the counts of its rays: sampled, in frame, valid, visible, occluded, and whether they suffice.

    ``rays``: keys, in_frame, valid, visible (booleans).  A ray out of frame or without a valid hit is no evidence.
    """
    seen = F.col("in_frame") & F.col("valid")
    counts = rays.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sampled"),
        F.count_if(F.col("in_frame")).alias("n_in_frame"),
        F.count_if(seen).alias("n_valid"),
        F.count_if(seen & F.col("visible")).alias("n_visible"),
    )
    ratio = F.coalesce(F.try_divide(F.col("n_valid"), F.col("n_in_frame")), F.lit(0.0))
    return counts.withColumns(
        {
            "n_occluded": F.col("n_valid") - F.col("n_visible"),
            "in_frame_ratio": F.col("n_in_frame") / F.col("n_sampled"),
            "effective_ratio": ratio,
            "sufficient": (F.col("n_valid") >= LEAST_VALID) & (ratio >= LEAST_EFFECTIVE),
        }
    )


def _out_of_frame() -> Column:
    return (F.col("area_px") <= 0) | (F.col("n_in_frame") <= 0) | (F.col("in_frame_ratio") <= 0)


def static_status(m: DataFrame) -> DataFrame:
    """Adds ``status`` (null: not asked) and ``source``: what a static question may state, from ``decision``."""
    status = F.when(_out_of_frame(), "not visible").when(F.col("decision").isin("skip", "grayzone"), None).otherwise(F.col("decision"))
    source = F.when(~_out_of_frame() & (F.col("decision") == "grayzone"), "grayzone_fallback").otherwise("rays")
    return m.withColumns({"status": status, "source": source})


def counterfactual_status(m: DataFrame) -> DataFrame:
    """Adds ``status`` (null: not trusted) and ``reason``, the first that holds, after something was moved or removed.

    ``m``: area_px, in_frame_ratio, n_in_frame, n_valid, sufficient, decision.
    """
    sure = F.col("decision").isin(STATES)
    reason = (
        F.when(_out_of_frame(), "not_visible_out_of_frame")
        .when(F.col("area_px") < LEAST_AREA, "projected_area_too_small")
        .when(F.col("in_frame_ratio") < LEAST_IN_FRAME, "in_frame_ratio_too_small")
        .when(F.col("n_valid") <= 0, "no_valid_visibility_samples")
        .when(~F.col("sufficient"), "insufficient_visibility_evidence")
        .when(F.col("decision") == "grayzone", "grayzone_visibility")
        .when(sure, "resolved_visibility")
        .otherwise("unresolved_visibility_decision")
    )
    out = m.withColumn("reason", reason)
    status = F.when(F.col("reason") == "not_visible_out_of_frame", "not visible")
    return out.withColumn("status", status.when(F.col("reason") == "resolved_visibility", F.col("decision")))


def transition(old: Column, new: Column) -> Column:
    """Whether something seen changes its state; false if either state is unknown."""
    return F.coalesce(old.isin(SEEN) & new.isin(STATES) & (old != new), F.lit(False))


def absent_target(mentions: DataFrame) -> DataFrame:
    """Adds ``exempt``: a mention that needs no object, because the question says that its target is not visible.

    ``mentions``: type, correct_value, role, obj_id, label_status, n_label_ids, decision_source.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    says = (low("type") == "occlusion") & (low("correct_value") == "not visible") & (low("role") == "target") & F.col("obj_id").isNull()
    absent = (low("label_status") == "absent") & (F.coalesce("n_label_ids", F.lit(0)) == 0)
    return mentions.withColumn("exempt", says & (absent | (low("decision_source") == "vlm_out_of_frame_label_review")))


def veto(objects: DataFrame, least: float = VETO_LEAST) -> DataFrame:
    """Adds ``veto``: not_visible, low_visible, skipped (no valid ray, stays) or kept, by the share of valid rays that see."""
    share = F.try_divide(F.col("n_visible"), F.col("n_valid"))
    named = F.when(share.isNull(), "skipped").when(share <= 0, "not_visible").when(share < least, "low_visible").otherwise("kept")
    return objects.withColumn("veto", named)
