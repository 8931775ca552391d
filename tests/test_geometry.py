"""Hand-checked values of geometry and text expressions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spatialith.functions import geometry as G
from spatialith.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


@pytest.mark.parametrize(
    ("forward", "right", "name", "doubt"),
    [(1, 1, "front-right", 0), (1, 0, "front", 0), (-1, 0, "back", 0), (0, -1, "left", 0), (0, 0, "front", 1)],
)
def test_ring(spark, forward, right, name, doubt):
    p, s = lit(forward, right)
    assert value(spark, G.ring_direction(p, s, G.HORIZONTAL)) == name
    assert math.isclose(value(spark, G.ring_ambiguity(p, s)), doubt, abs_tol=1e-9)


def test_sector_edge(spark):
    edge = math.radians(22.5 + 1e-9)
    p, s = lit(math.cos(edge), math.sin(edge))
    assert value(spark, G.ring_direction(p, s, G.CARDINAL)) == "northeast"
    assert value(spark, G.ring_ambiguity(p, s)) > 0.999


@pytest.mark.parametrize(
    ("d", "name", "near"),
    [(0.95, "very_close", True), (1.0, "close", True), (2.0, "moderate", True), (3.3, "far", True), (3.5, "far", False)],
)
def test_distance_bins(spark, d, name, near):
    (x,) = lit(d)
    assert value(spark, G.distance_bin(x)) == name
    assert value(spark, G.near_boundary(x)) is near


def boxes(spark, a, b):
    names = [f"{p}{k}{i}" for p in ("a_", "b_") for i in (0, 1) for k in "xyz"]
    return spark.createDataFrame([tuple(map(float, (*a, *b)))], ", ".join(f"{n} double" for n in names))


def test_boxes(spark):
    touching = boxes(spark, (0, 0, 0, 1, 1, 1), (1, 0, 0, 2, 1, 1))
    row = touching.select(G.boxes_intersect().alias("hit"), G.box_distance().alias("d"), G.overlap_area().alias("o")).first()
    assert (row.hit, row.d, row.o) == (False, 0.0, 0.0)
    above = boxes(spark, (0, 0, 0, 1, 1, 1), (0.5, 0.5, 2, 1.5, 1.5, 3))
    row = above.select(G.vertical_direction().alias("v"), G.overlap_area().alias("o"), G.box_distance().alias("d")).first()
    assert (row.v, row.o, row.d) == ("above", 0.25, 1.0)
    inside = boxes(spark, (0, 0, 0, 4, 4, 1), (1, 1, 0, 2, 2, 1))
    assert inside.select(G.overlap_area().alias("o")).first().o == 1.0


def test_moves_and_compass(spark):
    assert value(spark, G.cardinal_move(*lit(1, 0, 0))) == "east"
    assert value(spark, G.cardinal_move(*lit(0, 0, 2))) == "up"
    assert value(spark, G.camera_move(*lit(0.1, 0.1, -2))) == "backward"
    assert [value(spark, G.compass(F.lit(float(a)))) for a in (0, 44, 91, 359)] == ["north", "northeast", "east", "north"]
    assert value(spark, G.vertical_tolerance(*lit(1, 1))) == pytest.approx(0.07)


def test_shoelace(spark):
    square = F.array(*[F.array(*lit(*p)) for p in ((0, 0), (2, 0), (2, 1), (0, 1))])
    assert value(spark, G.shoelace(square)) == 2.0


@pytest.mark.parametrize(
    ("raw", "letter", "strict"),
    [
        ("Answer: B", "B", "B"),
        ("I think A or B", "A", None),
        ("(c)", "C", "C"),
        ("D", "D", "D"),
        ("", None, None),
        (None, None, None),
        ("option d", "D", "D"),
        ("nothing", None, None),
    ],
)
def test_answers(spark, raw, letter, strict):
    assert value(spark, X.parse_answer(F.lit(raw).cast("string"))) == letter
    assert value(spark, X.parse_strict(F.lit(raw).cast("string"))) == strict


def test_options(spark):
    pool = F.array(*map(F.lit, [*G.HORIZONTAL, "above", "below"]))
    up = value(spark, X.options(F.lit("above"), pool, F.lit("k")))
    assert "above" in up and "below" in up and len(up) == 4  # horizontals fill the rest
    ring = value(spark, X.direction_options(F.lit("north"), G.CARDINAL, F.lit("k")))
    assert len(set(ring)) == 4 and "north" in ring and not {"northwest", "northeast"} & set(ring)
    few = value(spark, X.options(F.lit("a"), F.array(F.lit("a"), F.lit("b")), F.lit("k")))
    assert few[-1] == X.NONE and set(few) == {"a", "b", X.NONE}
    assert value(spark, X.letter(F.array(F.lit("x"), F.lit("y")), F.lit("y"))) == "B"


def test_small_text(spark):
    assert value(spark, X.opposite(F.lit("front-left"))) == "back-right"
    assert value(spark, X.slug(F.lit("  Coffee Table! "))) == "coffee_table"
    assert value(spark, X.preview(F.lit("a  b " * 100), 10)) == "a b a b..."
    assert value(spark, X.first_json(F.lit('so: {"a": 1} ok'))) == '{"a": 1}'
    assert value(spark, X.natural_number(F.lit("frame12.jpg"))) == 12
