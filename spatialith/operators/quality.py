"""Quality control and scoring of questions: dedup, caps, balancing, sampling, statistics and accuracy.

Random choices of other engines become hash orders, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relations import hash_order


def first_per(df: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key in input order."""
    w = W.partitionBy(*key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def quality_filter(questions: DataFrame, ambiguous_type: str = "direction_agent", limit: float = 0.7) -> DataFrame:
    """Without ambiguous directions, near duplicates within a frame, and equal texts across a scene's frames."""
    clear = questions.filter(~((F.col("type") == ambiguous_type) & (F.col("ambiguity") > limit)))
    near = first_per(clear, ["scene_id", "image_name", "type", "a_id", "b_id"])
    return first_per(near, ["scene_id", "question"])


def quality_report(questions: DataFrame, ambiguous_type: str = "direction_agent", limit: float = 0.7) -> DataFrame:
    """How many questions each filter removes."""
    bad = (F.col("type") == ambiguous_type) & (F.col("ambiguity") > limit)
    near = W.partitionBy("bad", "scene_id", "image_name", "type", "a_id", "b_id").orderBy("ord")
    rows = questions.withColumn("bad", bad).withColumn("_near", F.row_number().over(near))
    text = W.partitionBy("bad", F.col("_near") > 1, "scene_id", "question").orderBy("ord")
    rows = rows.withColumn("_text", F.row_number().over(text))
    reason = (
        F.when(F.col("bad"), "ambiguous_direction").when(F.col("_near") > 1, "near_duplicate").when(F.col("_text") > 1, "cross_frame_duplicate").otherwise("kept")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def cap_share(rows: DataFrame, among: Column, capped: Column, ratio: float = 1 / 3) -> DataFrame:
    """Drop rows of ``capped`` by hash order until they are at most ``ratio`` of the rows of ``among``."""
    count = rows.agg(
        F.coalesce(F.sum((among & capped).cast("long")), F.lit(0)).alias("_k"),
        F.coalesce(F.sum((among & ~capped).cast("long")), F.lit(0)).alias("_other"),
    )
    # the largest k with k / (other + k) <= ratio, its boundary checked by the same division
    k = F.floor(F.col("_other") * ratio / (1 - ratio)) + 1
    fits = lambda k: F.coalesce(F.try_divide(k, F.col("_other") + k) <= F.lit(ratio), F.lit(False))
    most = F.when(fits(k), k).when(fits(k - 1), k - 1).otherwise(F.greatest(k - 2, F.lit(0)))
    count = count.select(F.least(most, F.col("_k")).cast("long").alias("_most"))  # one row
    hit = rows.filter(among & capped).select("question_id", hash_order("question_id").alias("_h"))
    # rank by hash without one sorted partition: count per leading hex digits, then rank within
    hit = hit.withColumn("_b", F.substring("_h", 1, 3))
    sizes = hit.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows at most
    below = sizes.withColumn("_base", F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    ranked = hit.join(F.broadcast(below.select("_b", F.coalesce("_base", F.lit(0)).alias("_base"))), "_b")
    ranked = ranked.withColumn("_r", F.col("_base") + F.row_number().over(W.partitionBy("_b").orderBy("_h", "question_id")))
    gone = ranked.crossJoin(F.broadcast(count)).filter("_r > _most").select("question_id")
    return rows.join(gone, "question_id", "left_anti")


def balance_values(questions: DataFrame, types: list[str]) -> DataFrame:
    """Within each of ``types``, every answer value down to the size of the rarest."""
    target = F.col("type").isin(types)
    sizes = questions.filter(target).groupBy("type", "correct_value").agg(F.count(F.lit(1)).alias("_n"))
    least = sizes.groupBy("type").agg(F.min("_n").alias("_least"))
    w = W.partitionBy("type", "correct_value").orderBy(hash_order("question_id"), "question_id")
    rows = questions.filter(target).withColumn("_rank", F.row_number().over(w)).join(F.broadcast(least), "type")
    kept = rows.filter("_rank <= _least").select(questions.columns)
    return questions.filter(~target).unionByName(kept)


def attachment_dominance(questions: DataFrame, level: str = "L2", spare: int = 3) -> DataFrame:
    """Of each move or rotation type at most twice as many unattached questions as attached ones."""
    subject = (F.col("level") == level) & (F.col("type").startswith("object_move_") | (F.col("type") == "object_rotate_object_centric"))
    counts = questions.filter(subject).groupBy("type").agg(F.sum(F.col("attached").cast("long")).alias("_a"))
    w = W.partitionBy("type").orderBy(hash_order("question_id"), "question_id")
    loose = questions.filter(subject & ~F.col("attached")).withColumn("_rank", F.row_number().over(w))
    most = F.when(F.col("_a") > 0, 2 * F.col("_a")).otherwise(spare)
    gone = loose.join(F.broadcast(counts), "type").filter(F.col("_rank") > most).select("question_id")
    return questions.join(gone, "question_id", "left_anti")


def cap_tiers(questions: DataFrame, group: list[str], most: int) -> DataFrame:
    """At most ``most`` rows a group: attached and changed first, then attached, then the rest."""
    tier = F.when(F.col("attached") & ~F.col("unchanged"), 0).when(F.col("attached"), 1).otherwise(2)
    w = W.partitionBy(*group).orderBy(tier, hash_order("question_id"), "question_id")
    return questions.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def viewer_filter(questions: DataFrame, group: list[str], floor: int = 1) -> DataFrame:
    """All attached rows, and the first unattached ones up to twice their number (``floor`` if there are none)."""
    w = W.partitionBy(*group)
    rows = questions.withColumn("_a", F.sum(F.col("attached").cast("long")).over(w))
    rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*group, "attached").orderBy("ord")))
    most = F.when(F.col("_a") > 0, 2 * F.col("_a")).otherwise(floor)
    return rows.filter(F.col("attached") | (F.col("_rank") <= most)).drop("_a", "_rank")


def validation_sample(questions: DataFrame, per_level: int = 50) -> DataFrame:
    """Up to ``per_level`` questions of each level by hash order, numbered through."""
    w = W.partitionBy("level").orderBy(hash_order("question_id"), "question_id")
    rows = questions.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_level)
    return rows.withColumn("validation_id", F.row_number().over(W.orderBy("level", "_rank"))).drop("_rank")


def statistics(questions: DataFrame) -> DataFrame:
    """Counts in all, by level and by type, and the share of each answer letter within its level."""
    sets = questions.groupingSets([[], ["level"], ["type"], ["level", "answer"]], "level", "type", "answer").agg(
        F.grouping_id().cast("long").alias("set_id"), F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(W.partitionBy("set_id", "level"))
    share = F.when(F.col("answer").isNotNull(), F.bround(F.col("n") / total, 3))
    return sets.select("level", "type", "answer", "n", share.alias("share"))


def last_prediction(predictions: DataFrame) -> DataFrame:
    """One row per question: the prediction given last, null included."""
    return predictions.groupBy("question_id").agg(F.max_by(F.struct("prediction"), "ord").alias("p")).select("question_id", "p.prediction")


def matched(questions: DataFrame, predictions: DataFrame, all_questions: bool = False) -> DataFrame:
    """Questions with whether the last prediction is right; those without one drop out, or count as wrong."""
    how = "left" if all_questions else "inner"
    rows = questions.join(last_prediction(predictions), "question_id", how)
    return rows.withColumn("correct", F.coalesce(F.col("prediction") == F.col("answer"), F.lit(False)))


def accuracy(rows: DataFrame, levels: tuple[str, ...] = ("L1", "L2", "L3")) -> DataFrame:
    """(scope, name, correct, total, accuracy): overall, by level (all of ``levels``, 0 where empty) and by type."""
    sets = rows.groupingSets([[], ["level"], ["type"]], "level", "type").agg(
        F.grouping_id().cast("long").alias("g"), F.sum(F.col("correct").cast("long")).alias("correct"), F.count(F.lit(1)).alias("total")
    )
    scope = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "level").otherwise("type")
    named = sets.select(scope.alias("scope"), F.coalesce("level", "type", F.lit("all")).alias("name"), "correct", "total")
    spine = rows.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('level', '{x}')" for x in levels) + ", ('overall', 'all') AS t(scope, name)")
    filled = named.join(F.broadcast(spine), ["scope", "name"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    share = F.coalesce(F.try_divide(F.col("correct"), F.col("total")), F.lit(0.0))
    return filled.select("scope", "name", zero("correct"), zero("total"), share.alias("accuracy"))


def gap_report(scores: DataFrame) -> DataFrame:
    """First-level less second-level accuracy, and its band."""
    level = lambda x: F.max(F.when((F.col("scope") == "level") & (F.col("name") == x), F.col("accuracy")))
    gap = scores.agg((level("L1") - level("L2")).alias("gap"))
    band = F.when(F.col("gap") > 0.20, "PASS").when(F.col("gap") > 0.10, "WARN").otherwise("FAIL")
    return gap.withColumn("band", band)


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns of labels: 0 without rows, 1 if chance alone agrees always."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("x"))
    cols = cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, "a").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("e"))
    one = total.join(F.broadcast(chance))  # one row each
    po = F.try_divide(F.col("same"), F.col("t"))
    pe = F.try_divide(F.col("e"), F.col("t").cast("double") * F.col("t"))
    return one.select(F.when(F.col("t") == 0, 0.0).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def calibrate_bins(distances: DataFrame, column: str = "distance_raw", least: float = 0.05, gap: float = 0.4) -> DataFrame:
    """Bin limits at the quartiles of distances over ``least``, to 0.1 and at least ``gap`` apart; one row."""
    q = distances.filter(F.col(column) > least).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    tenth = F.transform("q", lambda x: F.floor(x * 10 + 0.5) / 10)
    spread = F.aggregate(
        tenth,
        F.array().cast("array<double>"),
        lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(F.greatest(x, F.floor((F.element_at(acc, -1) + gap) * 10 + 0.5) / 10))),
    )
    return q.select(*[spread[i].alias(f"limit_{i + 1}") for i in range(3)])


def balance_letters(questions: DataFrame, share: float = 0.35, letters: str = "ABCD") -> DataFrame:
    """Per level and type, letters with more than ``share`` of the answers give the excess to letters with room.

    The first excess questions by ``ord`` change: the right option swaps places with the option at the new letter.  Counts
    are of the whole group, so a group in which nothing can get better stays as it is.
    """
    group = ["level", "type"]
    counts = questions.groupBy(*group, "answer").agg(F.count(F.lit(1)).alias("n"))
    spine = counts.select(*group).distinct().withColumn("answer", F.explode(F.array(*map(F.lit, letters))))
    counts = spine.join(counts, [*group, "answer"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.floor(F.sum("n").over(W.partitionBy(*group)) * share)
    counts = counts.withColumn("over", F.greatest(F.col("n") - most, F.lit(0))).withColumn("room", F.greatest(most - F.col("n"), F.lit(0)))
    before = W.partitionBy(*group).orderBy("answer").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("over_before", F.coalesce(F.sum("over").over(before), F.lit(0)))
    counts = counts.withColumn("room_before", F.coalesce(F.sum("room").over(before), F.lit(0)))
    rows = questions.join(counts.select(*group, "answer", "over", "over_before"), [*group, "answer"], "left")
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(*group, "answer").orderBy("ord")))
    rows = rows.withColumn("_place", F.when(F.col("_r") <= F.col("over"), F.col("over_before") + F.col("_r")))
    free = counts.filter("room > 0").select(*group, F.col("answer").alias("_to"), "room", "room_before").alias("f")
    inside = (F.col("_place") > F.col("f.room_before")) & (F.col("_place") <= F.col("f.room_before") + F.col("f.room"))
    rows = rows.alias("q").join(free, (F.col("q.level") == F.col("f.level")) & (F.col("q.type") == F.col("f.type")) & inside, "left")
    old, new = F.ascii("q.answer") - ord(letters[0]), F.ascii("_to") - ord(letters[0])
    swapped = F.transform("q.options", lambda x, i: F.when(i == old, F.get("q.options", new)).when(i == new, F.get("q.options", old)).otherwise(x))
    out = {"options": F.when(F.col("_to").isNull(), F.col("q.options")).otherwise(swapped), "answer": F.coalesce("_to", "q.answer")}
    return rows.select(*[out[c].alias(c) if c in out else F.col(f"q.{c}") for c in questions.columns])


def matched_by_text(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Questions with the last prediction for their scene and wording; for predictions that carry no question's number."""
    last = predictions.groupBy("scene_id", "question").agg(F.max_by(F.struct("prediction"), "ord").alias("p")).select("scene_id", "question", "p.prediction")
    rows = questions.join(last, ["scene_id", "question"])
    return rows.withColumn("correct", F.coalesce(F.col("prediction") == F.col("answer"), F.lit(False)))


#: Fixed order of types in the viewer.
VIEWER_ORDER = [
    "direction_agent", "occlusion", "distance", "direction_object_centric", "direction_allocentric", "object_move_agent",
    "object_move_distance", "object_move_occlusion", "object_rotate_object_centric", "object_move_allocentric",
    "viewpoint_move", "object_remove", "attachment_chain", "coordinate_rotation_agent",
    "coordinate_rotation_object_centric", "coordinate_rotation_allocentric",
]
MOVES = ["object_move_agent", "object_move_distance", "object_move_occlusion", "object_move_allocentric", "object_rotate_object_centric"]


def canonical_type(type_: Column) -> Column:
    """The type trimmed; an older name gives the present one, and an empty one "unknown"."""
    name = F.trim(F.coalesce(type_, F.lit("")))
    return F.when(name == "object_move_object_centric", "object_rotate_object_centric").when(name == "", "unknown").otherwise(name)


def viewer_order(questions: DataFrame) -> DataFrame:
    """Adds ``type_rank`` and ``shuffle``: sorted by them, types come in the viewer's order and each is shuffled."""
    name = canonical_type(F.col("type"))
    place = F.array_position(F.array(*map(F.lit, VIEWER_ORDER)), name)
    rank = F.when(place > 0, place - 1).otherwise(len(VIEWER_ORDER))
    return questions.withColumns({"type_rank": rank.cast("long"), "shuffle": hash_order("question_id")})


def viewer_summary(questions: DataFrame) -> DataFrame:
    """(type, n, attached, unattached): questions by canonical type; of moves, those with and without attachment."""
    rows = questions.withColumn("type", canonical_type(F.col("type")))
    move = F.col("type").isin(MOVES)
    return rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(move & F.col("attached")).alias("attached"), F.count_if(move & ~F.col("attached")).alias("unattached")
    )


def image_summary(records: DataFrame) -> DataFrame:
    """One row: images in all, passed and rejected by the first stage, scored by the second, selected and rejected."""
    return records.agg(
        F.count(F.lit(1)).alias("total_images"),
        F.count_if("stage1_pass").alias("stage1_pass"),
        F.count_if(~F.coalesce("stage1_pass", F.lit(False))).alias("stage1_reject"),
        F.count("score").alias("stage2_scored"),
        F.count_if("final_pass").alias("final_selected"),
        F.count_if(~F.coalesce("final_pass", F.lit(False))).alias("final_reject"),
    )


def slice_in_order(rows: DataFrame, order: list, start: int = 0, most: int | None = None) -> DataFrame:
    """Rows from ``start`` on, at most ``most`` of them, in order."""
    if start < 0 or most is not None and most <= 0:
        raise ValueError("start must be 0 or more, and most above 0")
    ordered = rows.orderBy(*order).offset(start)
    return ordered if most is None else ordered.limit(most)


def reason_counts(events: DataFrame) -> DataFrame:
    """(generator, reason, n): why candidates were skipped."""
    return events.groupBy("generator", F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def review_rollup(reviews: DataFrame) -> DataFrame:
    """(review_type, reviewed, passed, flagged, issues): verdicts and issue counts by type of review."""
    flagged = F.coalesce(F.col("verdict") != "pass", F.lit(True))
    return reviews.groupBy("review_type").agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(~flagged).alias("passed"),
        F.count_if(flagged).alias("flagged"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).cast("long").alias("issues"),
    )


def concat_scenes(*parts: DataFrame) -> DataFrame:
    """Question tables of several scenes as one; columns that one of them lacks are null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
