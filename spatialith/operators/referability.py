"""Which objects a question may mention: label reviews, their merging, and audits of mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G


def crop_label_statuses(reviews: DataFrame) -> DataFrame:
    """(frame_id, label, status, n_clear, referable_id) from each object's verdict: clear, unsure, absent or null."""
    clear = F.col("status") == "clear"
    counts = reviews.groupBy("frame_id", "label").agg(
        F.count_if(clear).alias("n_clear"),
        F.bool_or(F.coalesce(F.col("status") == "unsure", F.lit(True))).alias("unsure"),
        F.min(F.when(clear, F.col("object_id"))).alias("first_clear"),
    )
    status = (
        F.when((F.col("n_clear") == 1) & ~F.col("unsure"), "unique")
        .when(F.col("n_clear") >= 2, "multiple")
        .when((F.col("n_clear") == 0) & ~F.col("unsure"), "absent")
        .otherwise("unsure")
    )
    return counts.select("frame_id", "label", status.alias("status"), "n_clear", F.when(status == "unique", F.col("first_clear")).alias("referable_id"))


def merge_statuses(crop: DataFrame, full_frame: DataFrame, selector: DataFrame) -> DataFrame:
    """Full-frame verdicts override crops; two instances seen earlier make a label multiple unless it is absent."""
    valid = full_frame.filter(F.col("status").isin("unique", "multiple", "absent", "unsure"))
    a = crop.select("frame_id", "label", F.col("status").alias("crop"))
    b = valid.select("frame_id", "label", F.col("status").alias("full"))
    c = selector.select("frame_id", "label", F.col("n").alias("seen"))
    both = a.join(b, ["frame_id", "label"], "full").join(c, ["frame_id", "label"], "full")
    merged = F.coalesce("full", "crop")
    veto = (F.coalesce("seen", F.lit(0)) >= 2) & (F.coalesce(merged, F.lit("")) != "absent")
    return both.select("frame_id", "label", F.when(veto, "multiple").otherwise(merged).alias("status")).filter("status is not null")


def audit_mentions(mentions: DataFrame, statuses: DataFrame, referable: DataFrame, role_rule: bool = True) -> DataFrame:
    """(question_id, decision, reason_codes): whether every mention of a question is unique and referable.

    ``mentions``: question_id, frame_id, role, label, obj_id; ``referable``: frame_id, label, obj_id.
    """
    by_role = W.partitionBy("question_id", "role")
    by_object = W.partitionBy("question_id", "obj_id")
    signature = F.concat_ws("|", F.coalesce(F.col("obj_id").cast("string"), F.lit("")), F.lower("label"))
    rows = mentions.withColumn("conflict", F.size(F.collect_set(signature).over(by_role)) > 1)
    rows = rows.withColumn("multi", F.col("obj_id").isNotNull() & (F.size(F.collect_set("role").over(by_object)) > 1))
    known = referable.select(F.col("frame_id").alias("_frame"), F.col("obj_id").alias("_ref")).distinct()
    of_label = referable.groupBy("frame_id", "label").agg(F.collect_set("obj_id").alias("label_ids"))
    rows = rows.join(statuses.select("frame_id", "label", "status"), ["frame_id", "label"], "left")
    rows = rows.join(known, (F.col("frame_id") == F.col("_frame")) & (F.col("obj_id") == F.col("_ref")), "left")
    rows = rows.join(of_label, ["frame_id", "label"], "left")
    n = F.when(F.col("label_ids").isNull(), 0).otherwise(F.size("label_ids"))
    other = (n == 1) & F.col("obj_id").isNotNull() & ~F.coalesce(F.array_contains("label_ids", F.col("obj_id")), F.lit(False))
    stated = F.coalesce(F.col("status"), F.lit("unsure"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("conflict"), "mentioned_role_conflict"),
            F.when(F.col("multi") & F.lit(role_rule), "mentioned_object_multi_role"),
            F.when((F.col("obj_id").isNotNull() & F.col("_ref").isNull()) | other, "mentioned_nonreferable_object"),
            F.when(stated == "multiple", "mentioned_label_not_unique"),
            F.when(~stated.isin("multiple", "unique") | (n != 1), "mentioned_label_not_resolved"),
        )
    )
    out = rows.groupBy("question_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(reasons)))).alias("r"))
    return out.select("question_id", F.when(F.size("r") > 0, "drop").otherwise("pass").alias("decision"), F.concat_ws(",", "r").alias("reason_codes"))


def enforce(audits: DataFrame) -> DataFrame:
    """The audits unchanged; the query fails if any was dropped (a backstop after filtering)."""
    return audits.filter(F.assert_true(F.col("decision") == "pass", F.lit("a question that must not be asked got through")).isNull())


def pair_gate(reviews: DataFrame, least_ratio: float = 0.2, least_area: float = 400.0) -> DataFrame:
    """Decision and reason for one object of an attachment pair, the first rule that applies."""
    reason = (
        F.when(F.col("status").isNull(), "missing_object_review")
        .when(F.col("status") == "absent", "vlm_status_absent")
        .when(F.col("bbox_ratio") < least_ratio, "bbox_in_frame_ratio_too_small")
        .when(F.col("area_px") < least_area, "projected_area_too_small")
    )
    decision = F.when(reason.isNull(), "pass").when(F.col("status").isNull(), "uncertain").otherwise("auto_drop_hard_fail")
    return reviews.select("object_id", decision.alias("decision"), reason.alias("reason"))


def alias_inventory(reviews: DataFrame) -> DataFrame:
    """Per label: frames, objects, and how often each status was given."""
    status = F.coalesce("status", F.lit("missing"))
    return reviews.groupBy("label").agg(
        F.count_distinct("frame_id").alias("n_frames"),
        F.count(F.lit(1)).alias("n_objects"),
        *[F.count_if(status == s).alias(f"n_{s}") for s in ("clear", "unsure", "absent", "missing")],
    )


def restricted(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges whose two ends are both among ``objects`` (scene_id, id)."""
    ends = objects.select("scene_id", "id").distinct()
    for end in ("parent_id", "child_id"):
        edges = edges.join(ends.withColumnRenamed("id", end), ["scene_id", end], "left_semi")
    return edges


def gates(questions: DataFrame, mentions: DataFrame, visible: DataFrame, audits: DataFrame) -> DataFrame:
    """Adds ``removed_by``, the first gate that a question fails, in the order in-frame, referable, facing; null if kept.

    ``mentions``: question_id, frame_id, obj_id; ``visible``: frame_id, obj_id; ``audits``: question_id, decision;
    ``questions``: question_id, type, correct_value, and dx, dy, dz from anchor to facing object or null.
    """
    lost = mentions.filter("obj_id is not null").join(visible, ["frame_id", "obj_id"], "left_anti")
    lost = lost.select("question_id").distinct().withColumn("_lost", F.lit(True))
    rows = questions.join(lost, "question_id", "left").join(audits.select("question_id", "decision"), "question_id", "left")
    absent = (F.lower("type") == "occlusion") & (F.lower("correct_value") == "not visible")
    faced = F.coalesce(G.stable_facing(F.col("dx"), F.col("dy"), F.col("dz")), F.lit(True))
    gate = F.when(F.coalesce("_lost", F.lit(False)) & ~F.coalesce(absent, F.lit(False)), "in_frame_mentions")
    gate = gate.when(F.coalesce("decision", F.lit("drop")) != "pass", "referable_mentions").when(~faced, "stable_facing")
    return rows.withColumn("removed_by", gate).drop("_lost", "decision")
