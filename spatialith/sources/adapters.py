"""Views of the driver's tables as scenes, edges, cameras, questions and predictions.

Each function reads one or two Parquet tables and projects only what it needs, so pruning and filters reach the scan.
``plans.oracle_views`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCD"
TYPES = ["direction_agent", "distance", "occlusion", "object_move_agent", "object_rotate_object_centric", "attachment_chain"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thousandth(x: Column) -> Column:
    """Rounded to 0.001, the same way in every engine."""
    return F.floor(x * 1000 + 0.5) / 1000


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, id, label, centre cx..cz, box x0..z1.  Ten objects a scene, numbered from 0 in every scene."""
    e = lambda i: F.col("embedding")[i].cast("double")
    half = [thousandth(0.1 + F.abs(e(3)) * 5), thousandth(0.1 + F.abs(e(4)) * 5), thousandth(0.05 + F.abs(e(5)) * 3)]
    centre = [thousandth(e(0) * 20), thousandth(e(1) * 20), thousandth(F.abs(e(2)) * 8)]
    base = read(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("scene_id"),
        F.expr("vec_id % 10").alias("id"),
        F.concat(F.lit("label_"), F.col("label")).alias("label"),
        *[c.alias(f"c{a}") for c, a in zip(centre, "xyz", strict=True)],
        *[h.alias(f"h{a}") for h, a in zip(half, "xyz", strict=True)],
    )
    low = [thousandth(F.col(f"c{a}") - F.col(f"h{a}")).alias(f"{a}0") for a in "xyz"]
    high = [thousandth(F.col(f"c{a}") + F.col(f"h{a}")).alias(f"{a}1") for a in "xyz"]
    return base.select("scene_id", "id", "label", "cx", "cy", "cz", *low, *high)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, parent_id, child_id, type, confidence, coverage, gap: one parent per object but each scene's first."""
    child = read(spark, sf_dir, "embeddings").filter("vec_id % 10 <> 0")
    return child.selectExpr(
        "vec_id div 10 as scene_id",
        "(vec_id % 10) div 2 as parent_id",
        "vec_id % 10 as child_id",
        "element_at(array('supported_by', 'resting_on_soft_surface', 'affixed_to', 'contained_in'), cast(vec_id % 4 as int) + 1) as type",
        "(vec_id * 37 % 100) / 100.0D as confidence",
        "(vec_id * 53 % 100) / 100.0D as coverage",
        "(vec_id * 71 % 50) / 1000.0D as gap",
    )


def candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``edges``, with three candidate parents (0 to 2 places before the child) for each object."""
    child = read(spark, sf_dir, "embeddings").select("vec_id").filter("vec_id % 10 <> 0")
    return child.selectExpr("vec_id", "explode(sequence(1, 3)) as k").selectExpr(
        "vec_id div 10 as scene_id",
        "(vec_id % 10 + 10 - k) % 10 as parent_id",
        "vec_id % 10 as child_id",
        "element_at(array('supported_by', 'resting_on_soft_surface', 'affixed_to', 'contained_in'), cast((vec_id + k) % 4 as int) + 1) as type",
        "((vec_id * 37 + k * 11) % 5) / 5.0D as confidence",
        "((vec_id * 53 + k * 7) % 4) / 4.0D as coverage",
        "((vec_id * 71 + k * 3) % 50) / 1000.0D as gap",
        "((vec_id + k) % 3) / 3.0D as containment",
        "((vec_id * 3 + k) % 7) / 10.0D as contact_z",
    )


#: Labels of the furnished scenes: what stands on the floor, and what is on, in or at it.
FURNITURE = ["bed", "desk", "cabinet", "drawer", "box", "tv stand", "table", "sofa"]
THINGS = ["pillow", "book", "handle", "book", "toy", "monitor", "cup", "towel"]


def furnished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``objects``; each odd object lies on, in, at the edge of, or close under the top of the one before it.

    With candidate surfaces: the footprint and a smaller one below, the footprint and half of it above.
    """
    plain = objects(spark, sf_dir)
    below = plain.filter("id % 2 = 0").select("scene_id", (F.col("id") + 1).alias("id"), *[F.col(c).alias(f"p_{c}") for c in ("cx", "cy", "x0", "x1", "y0", "y1", "z0", "z1")])
    both = plain.filter("id % 2 = 1").join(below, ["scene_id", "id"])
    both = both.withColumn("mode", F.expr("(scene_id + id div 2) % 4")).withColumn("tall", F.col("p_z1") - F.col("p_z0"))
    shift = F.when(F.col("mode") == 2, 0.9).otherwise(0.1)
    rise = F.when(F.col("mode") == 1, F.col("p_z0") + 0.3 * F.col("tall")).when(F.col("mode") == 3, F.col("p_z1") - 0.06)
    rise = rise.otherwise(F.col("p_z1") + (F.expr("scene_id % 7") - 3) * 0.01)
    both = both.select(
        "scene_id",
        "id",
        thousandth(F.col("p_cx") + shift * (F.col("p_x1") - F.col("p_x0")) / 2).alias("cx"),
        thousandth(F.col("p_cy") + 0.05 * (F.col("p_y1") - F.col("p_y0"))).alias("cy"),
        thousandth(0.15 * (F.col("p_x1") - F.col("p_x0"))).alias("hx"),
        thousandth(0.15 * (F.col("p_y1") - F.col("p_y0"))).alias("hy"),
        thousandth(rise).alias("z0"),
        thousandth(rise + 0.3 * F.col("tall")).alias("z1"),
    )
    both = both.select("scene_id", "id", "cx", "cy", ((F.col("z0") + F.col("z1")) / 2).alias("cz"), *[thousandth(F.col(f"c{k}") + s * F.col(f"h{k}")).alias(f"{k}{n}") for n, s in ((0, -1), (1, 1)) for k in "xy"], "z0", "z1")
    rows = plain.filter("id % 2 = 0").drop("label").unionByName(both)
    place = F.expr("cast((scene_id + id div 2 + if(id % 2 = 1 and scene_id % 3 = 0, 1, 0)) % 8 as int)")
    named = F.when(F.expr("id % 2 = 0"), F.get(F.array(*map(F.lit, FURNITURE)), place)).otherwise(F.get(F.array(*map(F.lit, THINGS)), place))
    low = "array(named_struct('z', z0, 'x0', x0, 'y0', y0, 'x1', x1, 'y1', y1, 'score', 1D), named_struct('z', z0 + 0.02D, 'x0', x0, 'y0', y0, 'x1', (x0 + x1) / 2, 'y1', y1, 'score', 0.5D))"
    high = "array(named_struct('z', z1, 'x0', x0, 'y0', y0, 'x1', x1, 'y1', y1, 'score', 1D), named_struct('z', (z0 + z1) / 2, 'x0', x0, 'y0', y0, 'x1', x1, 'y1', (y0 + y1) / 2, 'score', 0.5D))"
    return rows.withColumns({"label": named, "bottoms": F.expr(low), "tops": F.expr(high)})


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, frame_id, position px..pz and yaw; a level camera that looks along (sin yaw, cos yaw)."""
    scenes = read(spark, sf_dir, "embeddings").filter("vec_id % 10 = 0").selectExpr("vec_id div 10 as scene_id")
    frames = scenes.selectExpr("scene_id", "explode(sequence(0L, 2L)) as frame_id")
    yaw = "radians(cast((scene_id * 7 + frame_id * 5) % 12 * 30 as double))"
    return frames.selectExpr(
        "scene_id",
        "frame_id",
        f"floor(sin({yaw}) * 1e6 + 0.5) / 1e6 as fx",
        f"floor(cos({yaw}) * 1e6 + 0.5) / 1e6 as fy",
        "cast((scene_id + frame_id) % 5 - 2 as double) as px",
        "cast((scene_id * 3 + frame_id) % 5 - 2 as double) as py",
        "1.5D as pz",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice questions made from orders; ``ord`` is their order."""
    types = ", ".join(f"'{t}'" for t in TYPES)
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as question_id",
        "o_orderkey as ord",
        "o_custkey % 50 as scene_id",
        "concat('frame_', o_orderkey % 8) as image_name",
        "case when o_orderpriority < '3' then 'L1' when o_orderpriority < '4' then 'L2' else 'L3' end as level",
        f"element_at(array({types}), cast(o_orderkey % 6 as int) + 1) as type",
        "concat('question ', o_orderkey % 997) as question",
        "substring('ABCD', cast((o_orderkey * 7 + o_custkey) % 4 as int) + 1, 1) as answer",
        "element_at(array('not visible', 'occluded', 'not occluded', 'near', 'far'), cast((o_orderkey * 3 + o_custkey) % 5 as int) + 1) as correct_value",
        "(o_orderkey * 13 % 100) / 100.0D as ambiguity",
        "o_custkey % 10 as a_id",
        "o_orderkey % 7 as b_id",
        "o_custkey % 3 = 0 as attached",
        "o_orderkey % 4 = 0 as unchanged",
        "transform(sequence(0, 3), i -> concat('option ', (o_orderkey + i) % 997)) as options",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers made from all line items; a question may have several, the last counts.

    Every eleventh order's answers belong to no question of the table, so that some questions have none.
    """
    return (
        read(spark, sf_dir, "lineitem")
        .selectExpr(
            "case when l_orderkey % 11 = 0 then -l_orderkey else l_orderkey end as question_id",
            "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as ord",
            "case when l_suppkey % 17 = 0 then null else substring('ABCD', cast((l_orderkey * 7 + l_partkey % 3) % 4 as int) + 1, 1) end as prediction",
            "element_at(array('B', ' (c) ', 'Answer: B', 'I think A or B', 'The answer is D.', 'no idea', '', 'Because of C', 'a)', 'option D', 'I choose A, not B'), cast(l_partkey % 11 as int) + 1) as raw_response",
        )
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame and object a reviewer's verdict, made from documents and labels.

    ``object_id`` is the table's own, ``scene_object_id`` the one that edges use within the scene.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id div 10 as scene_id",
        "doc_id div 40 as frame_id",
        "doc_id as object_id",
        "doc_id % 10 as scene_object_id",
        "concat('label_', doc_id % 7) as label",
        "case when toxic = 1 then 'absent' when quality = 0 then 'unsure' when quality = 1 then 'clear' when doc_id % 5 = 0 then 'absent' when doc_id % 9 = 0 then null else 'clear' end as status",
        "(n_chars % 100) / 100.0D as bbox_ratio",
        "cast(n_chars % 2000 as double) as area_px",
        "cast(n_chars % 1000 as double) as mask_px",
        "(n_chars % 97) / 10.0D as depth_m",
        "doc_id % 3 = 0 as has_mask",
        "cast(n_chars % 330 - 5 as double) as u",
        "cast(n_chars % 250 - 5 as double) as v",
    )
