"""Hand-checked cases of labels, attachment, visibility decisions, gates and letters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spatialith.functions import geometry as G
from spatialith.functions import labels as L
from spatialith.operators import attachment as T
from spatialith.operators import graph as A
from spatialith.operators import occlusion as N
from spatialith.operators import quality as Q
from spatialith.operators import referability as M

OBJECT = "scene_id long, id long, label string, cx double, cy double, cz double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
SURFACE = "array<struct<z double, x0 double, y0 double, x1 double, y1 double, score double>>"


def thing(id_, label, x0, y0, z0, x1, y1, z1, scene=0):
    box = (float(x0), float(y0), float(z0), float(x1), float(y1), float(z1))
    flat = (box[0], box[1], box[3], box[4], 1.0)
    centre = tuple((a + b) / 2 for a, b in zip(box[:3], box[3:], strict=True))
    return (scene, id_, label, *centre, *box, [(box[2], *flat)], [(box[5], *flat)])


def scene(spark, *things):
    return spark.createDataFrame(list(things), f"{OBJECT}, bottoms {SURFACE}, tops {SURFACE}")


def edges(spark, *things):
    return {(r.scene_id, r.child_id, r.parent_id): r for r in T.candidates(scene(spark, *things)).collect()}


def test_labels(spark):
    rows = [(" Couch ",), ("Books",), ("bin",), ("bag of chips",), (None,), ("TV",), ("gadget",)]
    raw = spark.createDataFrame(rows, "label string")
    plain = [r.normal for r in L.normalized(raw).collect()]
    assert plain == ["sofa", "books", "bin", "bag of chips", "", "television", "gadget"]
    classes = spark.createDataFrame([("couch", "sofa"), ("books", "book"), ("bin", "otherprop"), ("gadget", "OtherProp"), ("", "void")], "raw string, class string")
    mapped = {r.label: r.normal for r in L.normalized(raw, classes).collect()}
    assert mapped["Books"] == "books" and mapped["bin"] == "bin" and mapped["gadget"] == "otherprop"
    assert L.normalized(raw.limit(0), classes).count() == 0


def test_excluded_labels():
    plain, closed = L.excluded_labels(), L.excluded_labels({"floor": "ground surface", "doors": "door panel", "ground surface": "base"})
    assert {"floor", "tv", "television", ""} <= set(plain) and "sofa" not in plain
    assert {"ground surface", "base"} <= set(closed) and "door panel" not in closed  # kept plurals are not mapped


def test_supported(spark):
    found = edges(spark, thing(0, "desk", 0, 0, 0, 2, 2, 1), thing(1, "book", 0.5, 0.5, 1.0, 1, 1, 1.2))
    (edge,) = found.values()
    assert (edge.child_id, edge.parent_id, edge.type) == (1, 0, "supported_by")
    assert edge.confidence == pytest.approx(1.0) and edge.coverage == 1 and edge.gap == 0


def test_supported_needs_contact(spark):
    far = thing(1, "book", 0.5, 0.5, 1.4, 1, 1, 1.6)
    aside = thing(2, "book", 5, 5, 1.0, 5.5, 5.5, 1.2)
    other = thing(3, "book", 0.5, 0.5, 1.0, 1, 1, 1.2, scene=1)
    assert not edges(spark, thing(0, "desk", 0, 0, 0, 2, 2, 1), far, aside, other)


def test_soft_contained_affixed(spark):
    soft = edges(spark, thing(0, "bed", 0, 0, 0, 2, 2, 0.5), thing(1, "pillow", 0.2, 0.2, 0.5, 0.8, 0.8, 0.7))
    assert soft[0, 1, 0].type == "resting_on_soft_surface" and soft[0, 1, 0].confidence == pytest.approx(1.0)
    inside = edges(spark, thing(0, "drawer", 0, 0, 0, 2, 2, 1), thing(1, "book", 0.5, 0.5, 0.3, 1, 1, 0.5))
    assert inside[0, 1, 0].type == "contained_in" and inside[0, 1, 0].containment > 0.9
    fixed = edges(spark, thing(0, "cabinet", 0, 0, 0, 1, 1, 1), thing(1, "handle", 1.02, 0.4, 0.4, 1.06, 0.6, 0.6))
    assert fixed[0, 1, 0].type == "affixed_to" and fixed[0, 1, 0].confidence == pytest.approx(0.55 + 0.30 * (1 - 0.02 / 0.12))


def test_enclosed_support(spark):
    """A child near the top of a box that encloses it, with no surface there, is supported with bounded confidence."""
    shelf = thing(0, "shelf", 0, 0, 0, 2, 2, 1)
    shelf = (*shelf[:-1], [(0.1, 0.0, 0.0, 2.0, 2.0, 1.0)])  # the only top surface lies far below
    (edge,) = edges(spark, shelf, thing(1, "vase", 0.5, 0.5, 0.98, 1, 1, 1.4)).values()
    assert edge.type == "supported_by" and 0.45 <= edge.confidence <= 0.74


def test_candidate_ranks_within_scenes(spark):
    rows = [(s, p, 5, "supported_by", c, 0.5, 0.0, 0.0, 0.0) for s, p, c in ((0, 1, 0.9), (0, 2, 0.5), (1, 1, 0.4), (1, 2, 0.8))]
    found = spark.createDataFrame(rows, "scene_id long, parent_id long, child_id long, type string, confidence double, coverage double, gap double, containment double, contact_z double")
    ranks = {(r.scene_id, r.parent_id): r["rank"] for r in A.ranked_candidates(found).collect()}
    assert ranks == {(0, 1): 1, (0, 2): 2, (1, 2): 1, (1, 1): 2}


def test_visibility_decisions(spark):
    rows = [(500.0, 1.0, 512, 512, True, "occluded"), (0.0, 1.0, 5, 5, False, "skip"), (500.0, 1.0, 512, 512, True, "grayzone"), (500.0, 0.01, 512, 512, True, "occluded")]
    m = spark.createDataFrame(rows, "area_px double, in_frame_ratio double, n_in_frame long, n_valid long, sufficient boolean, decision string")
    assert [r.status for r in N.counterfactual_status(m).collect()] == ["occluded", "not visible", None, None]
    assert [r.status for r in N.static_status(m).collect()] == ["occluded", "not visible", None, "occluded"]
    pairs = spark.createDataFrame([("occluded", "not visible"), ("occluded", "occluded"), ("not visible", "occluded"), (None, "occluded"), ("occluded", None)], "a string, b string")
    assert [r[0] for r in pairs.select(N.transition(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]


def test_evidence(spark):
    rays = [(1, True, True, True)] * 48 + [(1, True, True, False)] * 16 + [(1, True, False, True)] * 10 + [(1, False, True, True)] * 6 + [(2, False, True, True)]
    out = {r.k: r for r in N.evidence(spark.createDataFrame(rays, "k int, in_frame boolean, valid boolean, visible boolean"), ["k"]).collect()}
    assert (out[1].n_sampled, out[1].n_in_frame, out[1].n_valid, out[1].n_occluded, out[1].sufficient) == (80, 74, 64, 16, True)
    assert out[2].effective_ratio == 0 and not out[2].sufficient


def test_gates_in_order(spark):
    questions = spark.createDataFrame([(1, "distance", "far", 0.1, 0.0, 5.0), (2, "distance", "far", 0.1, 0.0, 5.0), (3, "distance", "far", 0.1, 0.0, 5.0), (4, "occlusion", "not visible", None, None, None)], "question_id long, type string, correct_value string, dx double, dy double, dz double")
    mentions = spark.createDataFrame([(1, 0, 9), (2, 0, 8), (3, 0, 8), (4, 0, 9)], "question_id long, frame_id long, obj_id long")
    visible = spark.createDataFrame([(0, 8)], "frame_id long, obj_id long")
    audits = spark.createDataFrame([(1, "drop"), (2, "drop"), (3, "pass"), (4, "pass")], "question_id long, decision string")
    out = {r.question_id: r.removed_by for r in M.gates(questions, mentions, visible, audits).collect()}
    assert out == {1: "in_frame_mentions", 2: "referable_mentions", 3: "stable_facing", 4: None}


def test_balanced_letters_move_options(spark):
    rows = [(i, "L1", "t", i, "A", ["right", "x", "y", "z"]) for i in range(10)]
    q = spark.createDataFrame(rows, "question_id long, level string, type string, ord long, answer string, options array<string>")
    out = Q.balance_letters(q).orderBy("ord").collect()
    assert all(r.options["ABCD".index(r.answer)] == "right" and sorted(r.options) == ["right", "x", "y", "z"] for r in out)
    assert [r.answer for r in out] == list("BBBCCCDAAA")
    alone = Q.balance_letters(q.limit(1)).collect()
    assert alone[0].answer == "A" and alone[0].options == ["right", "x", "y", "z"]


def test_sample_count(spark):
    row = spark.sql("SELECT 4D a, 1D b, CAST(NULL AS DOUBLE) n").select(G.sample_count(F.col("a"), F.col("b"), 512), G.sample_count(F.col("n"), F.col("b"), 512)).first()
    assert tuple(row) == (1024, 512)
