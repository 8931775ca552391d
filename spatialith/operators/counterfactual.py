"""What-if operators: candidate moves and rotations as small literal tables joined to scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import relations as R

#: Fixed search order: longest moves first, axes before diagonals.
MAGNITUDES = [3.0, 2.5, 2.0, 1.5, 1.0, 0.5]
UNITS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1)]
#: Fixed orbit candidates in search order: degrees, counter-clockwise positive.
ORBITS = [-180, -135, 135, -90, 90, -45, 45]
ROTATIONS = [90, 180, 270]
BINS = ["very_close", "close", "moderate", "far"]
ROOM_TOLERANCE = 1e-6


def moves(spark: SparkSession) -> DataFrame:
    """The 48 displacements, in search order."""
    rows, n = [], 0
    for m in MAGNITUDES:
        for x, y in UNITS:
            n += 1
            k = m if x == 0 or y == 0 else m * 2**-0.5
            rows.append(f"({n}, {round(x * k, 6)}D, {round(y * k, 6)}D)")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(move, dx, dy)")


def room_bounds(objects: DataFrame) -> DataFrame:
    """Per scene the box of all boxes."""
    low = [F.min(f"{k}0").alias(f"room_{k}0") for k in "xyz"]
    return objects.groupBy("scene_id").agg(*low, *[F.max(f"{k}1").alias(f"room_{k}1") for k in "xyz"])


def translated(objects: DataFrame) -> DataFrame:
    """Objects moved by their row's dx, dy."""
    out = objects
    for k in "xy":
        for c in (f"c{k}", f"{k}0", f"{k}1"):
            out = out.withColumn(c, F.col(c) + F.col(f"d{k}"))
    return out


def legal_moves(objects: DataFrame, moved: DataFrame) -> DataFrame:
    """(scene_id, target, move, dx, dy): moves that stay within the room and run into nothing that stays.

    ``moved``: (scene_id, target, id), what moves along with each target.
    """
    steps = F.broadcast(moves(objects.sparkSession))  # 48 rows
    going = translated(moved.join(objects, ["scene_id", "id"]).crossJoin(steps))
    return _unhindered(going, objects, moved, ["move"], ["dx", "dy"])


def _unhindered(going: DataFrame, objects: DataFrame, moved: DataFrame, way: list[str], more: list[str]) -> DataFrame:
    """The ways of each target's chain (``going``: its boxes, each way) that stay in the room and hit nothing that stays.

    Ways that leave the room drop out before the others look for obstacles.
    """
    t = ROOM_TOLERANCE
    within = F.lit(True)
    for k in "xyz":
        within = within & (F.col(f"{k}0") >= F.col(f"room_{k}0") - t) & (F.col(f"{k}1") <= F.col(f"room_{k}1") + t)
    keys = ["scene_id", "target", *way]
    inside = going.join(room_bounds(objects), "scene_id").groupBy(*keys, *more).agg(F.every(within).alias("ok")).filter("ok").drop("ok")
    hit = going.select(*keys, "id", "x0", "x1", "y0", "y1", "z0", "z1").join(inside.select(*keys), keys, "left_semi")
    hit = R.side(hit, "m_")
    still = R.side(objects.select("scene_id", "id", "x0", "x1", "y0", "y1", "z0", "z1"), "s_")
    touch = hit.join(still, "scene_id").filter(G.boxes_intersect("m_", "s_"))
    chain = moved.select("scene_id", F.col("target").alias("m_target"), F.col("id").alias("s_id"))
    touch = touch.join(chain, ["scene_id", "m_target", "s_id"], "left_anti")  # its own chain is no obstacle
    touch = touch.select("scene_id", *[F.col(f"m_{k}").alias(k) for k in ["target", *way]]).distinct()
    return inside.join(touch, keys, "left_anti")


def meaningful_moves(objects: DataFrame, moved: DataFrame, legal: DataFrame) -> DataFrame:
    """Per target the first legal move that turns some pair's direction by 90 degrees or more, else by 45.

    Only pairs with exactly one moved end can change.
    """
    ends = moved.select("scene_id", "target", F.col("id").alias("m_id"))
    pair = ends.join(R.side(objects, "m_", "scene_id"), ["scene_id", "m_id"]).join(R.side(objects, "s_"), "scene_id")
    pair = pair.join(ends.select("scene_id", "target", F.col("m_id").alias("s_id")), ["scene_id", "target", "s_id"], "left_anti")
    dx, dy = F.col("s_cx") - F.col("m_cx"), F.col("s_cy") - F.col("m_cy")
    pair = pair.select("scene_id", "target", dx.alias("ox"), dy.alias("oy"))
    after = pair.join(legal, ["scene_id", "target"])
    old = G.ring_index(F.col("oy"), F.col("ox"))
    new = G.ring_index(F.col("oy") - F.col("dy"), F.col("ox") - F.col("dx"))
    apart = F.abs(old - new)
    after = after.withColumn("steps", F.least(apart, 8 - apart))
    per_move = after.groupBy("scene_id", "target", "move", "dx", "dy").agg(F.max("steps").alias("steps")).filter("steps >= 1")
    first = F.struct(F.when(F.col("steps") >= 2, 0).otherwise(1), "move")
    return per_move.groupBy("scene_id", "target").agg(F.min_by(F.struct("move", "dx", "dy", "steps"), first).alias("m")).select("scene_id", "target", "m.*")


def stable_distance_moves(objects: DataFrame, moved: DataFrame, legal: DataFrame, least: float = 0.2) -> DataFrame:
    """Per target and pair with one moved end, the first legal move that takes its distance clearly into the next bin.

    (scene_id, target, m_id, s_id, move, old_bin, new_bin, unchanged).  A pair that moves by attachment, and that no move
    takes there, keeps the first legal move that leaves its bin, marked unchanged.
    """
    ends = moved.select("scene_id", "target", F.col("id").alias("m_id"))
    pair = ends.join(R.side(objects, "m_", "scene_id"), ["scene_id", "m_id"]).join(R.side(objects, "s_"), "scene_id")
    pair = pair.join(ends.withColumnRenamed("m_id", "s_id"), ["scene_id", "target", "s_id"], "left_anti")
    pair = pair.withColumn("old", G.box_distance("m_", "s_")).filter(F.col("old") >= least)
    after = pair.join(legal, ["scene_id", "target"])
    for k in "xy":
        after = after.withColumns({f"m_{k}{n}": F.col(f"m_{k}{n}") + F.col(f"d{k}") for n in "01"})
    after = after.withColumn("new", G.box_distance("m_", "s_")).filter(F.col("new") >= least)
    place = lambda c: F.array_position(F.array(*map(F.lit, BINS)), G.distance_bin(F.col(c)))
    apart = F.abs(place("new") - place("old"))
    state = F.struct("move", G.distance_bin(F.col("new")).alias("bin"))
    rows = after.groupBy("scene_id", "target", "m_id", "s_id", G.distance_bin(F.col("old")).alias("old_bin")).agg(
        F.min(F.when((apart == 1) & ~G.near_boundary(F.col("new")), state)).alias("hit"), F.min(F.when(apart == 0, state)).alias("same")
    )
    found = F.coalesce("hit", F.when(F.col("m_id") != F.col("target"), F.col("same")))
    rows = rows.withColumn("found", found).filter("found is not null")
    return rows.select("scene_id", "target", "m_id", "s_id", "found.move", "old_bin", F.col("found.bin").alias("new_bin"), F.col("hit").isNull().alias("unchanged"))


def moved_directions(objects: DataFrame, moved: DataFrame, chosen: DataFrame) -> DataFrame:
    """Map directions that each target's chosen move changes: (scene_id, target, move, m_id, s_id, old_, new_direction)."""
    ends = moved.select("scene_id", "target", F.col("id").alias("m_id"))
    pair = ends.join(R.side(objects, "m_", "scene_id"), ["scene_id", "m_id"]).join(R.side(objects, "s_"), "scene_id").filter("m_label <> s_label")
    pair = pair.join(ends.withColumnRenamed("m_id", "s_id"), ["scene_id", "target", "s_id"], "left_anti")
    both = pair.join(chosen.select("scene_id", "target", "move", "dx", "dy"), ["scene_id", "target"])
    dx, dy = F.col("m_cx") - F.col("s_cx"), F.col("m_cy") - F.col("s_cy")
    old = G.ring_direction(dy, dx, G.CARDINAL)
    new = G.ring_direction(dy + F.col("dy"), dx + F.col("dx"), G.CARDINAL)
    clear = G.ring_ambiguity(dy + F.col("dy"), dx + F.col("dx")) <= 0.7
    rows = both.filter(clear).select("scene_id", "target", "move", "m_id", "s_id", old.alias("old_direction"), new.alias("new_direction"))
    return rows.filter("old_direction <> new_direction")


def legal_orbits(objects: DataFrame, moved: DataFrame) -> DataFrame:
    """(scene_id, target, pivot, ord, angle): orbits that stay within the room and run into nothing that stays."""
    turned = orbits(objects, moved)
    return _unhindered(turned, objects, moved, ["pivot", "ord"], ["angle"])


def orbit_questions(objects: DataFrame, moved: DataFrame) -> DataFrame:
    """Per target, member of its chain, pivot that the member faces, and reference: the first legal orbit that turns it.

    (scene_id, target, m_id, pivot, r_id, angle, old_direction, new_direction, unchanged): where the reference is for one
    who stands at the member and faces the pivot, before and after.  Facings must be stable and the new direction clear;
    where no orbit turns it, the first that qualifies stands, marked unchanged.
    """
    turned, legal = orbits(objects, moved), legal_orbits(objects, moved)
    keys = ["scene_id", "target", "pivot", "ord"]
    new = turned.join(legal.select(*keys), keys, "left_semi")
    new = new.select(*keys, "angle", F.col("id").alias("m_id"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    at = lambda p: objects.select("scene_id", F.col("id").alias("pivot" if p == "q_" else f"{p}id"), *[F.col(c).alias(p + c) for c in ("label", "cx", "cy", "cz")])
    rows = new.join(at("m_"), ["scene_id", "m_id"]).join(at("q_"), ["scene_id", "pivot"])
    rise = F.col("q_cz") - F.col("m_cz")
    before = F.col("q_cx") - F.col("m_cx"), F.col("q_cy") - F.col("m_cy")
    after = F.col("q_cx") - F.col("nx"), F.col("q_cy") - F.col("ny")
    rows = rows.filter("m_label <> q_label").filter(G.stable_facing(*before, rise) & G.stable_facing(*after, rise))
    rows = rows.join(at("r_"), "scene_id").filter("r_id <> m_id and r_id <> pivot and r_label <> m_label and r_label <> q_label")
    along = new.select(*keys, F.col("m_id").alias("r_id"), F.col("nx").alias("r_nx"), F.col("ny").alias("r_ny"))
    rows = rows.join(along, [*keys, "r_id"], "left")  # a reference in the chain turns too

    def seen(facing, x, y):
        norm = F.hypot(*facing)
        forward, right = (x * facing[0] + y * facing[1]) / norm, (x * facing[1] - y * facing[0]) / norm
        return G.ring_direction(forward, right, G.HORIZONTAL), G.ring_ambiguity(forward, right)

    old, _ = seen(before, F.col("r_cx") - F.col("m_cx"), F.col("r_cy") - F.col("m_cy"))
    now, doubt = seen(after, F.coalesce("r_nx", "r_cx") - F.col("nx"), F.coalesce("r_ny", "r_cy") - F.col("ny"))
    rows = rows.withColumns({"old": old, "now": now, "doubt": doubt}).filter("doubt <= 0.7")
    state = F.struct((F.col("old") == F.col("now")).alias("unchanged"), "ord", "angle", "now")  # changed ones first
    first = rows.groupBy("scene_id", "target", "m_id", "pivot", "r_id", "old").agg(F.min(state).alias("s"))
    names = F.col("old").alias("old_direction"), F.col("s.now").alias("new_direction"), "s.unchanged"
    return first.select("scene_id", "target", "m_id", "pivot", "r_id", "s.angle", *names)


def orbits(objects: DataFrame, moved: DataFrame) -> DataFrame:
    """(scene_id, target, pivot, ord, angle, id, cx, cy and the box around the turned box): chains turned around an object
    outside them; all candidates."""
    spark = objects.sparkSession
    rows = ", ".join(f"({i}, {a}, {G.rotation(a)[0]!r}D, {G.rotation(a)[1]!r}D)" for i, a in enumerate(ORBITS))
    turns = F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(ord, angle, cos, sin)"))  # 7 rows
    ends = moved.join(objects.select("scene_id", "id", "cx", "cy", "x0", "x1", "y0", "y1", "z0", "z1"), ["scene_id", "id"])
    pivot = objects.select("scene_id", F.col("id").alias("pivot"), F.col("cx").alias("qx"), F.col("cy").alias("qy"))
    both = ends.join(pivot, "scene_id").join(moved.withColumnRenamed("id", "pivot"), ["scene_id", "target", "pivot"], "left_anti")
    both = both.crossJoin(turns)

    def turn(x, y):
        dx, dy = F.col(x) - F.col("qx"), F.col(y) - F.col("qy")
        return F.col("qx") + dx * F.col("cos") - dy * F.col("sin"), F.col("qy") + dx * F.col("sin") + dy * F.col("cos")

    corners = [turn(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
    cx, cy = turn("cx", "cy")
    return both.select(
        "scene_id",
        "target",
        "pivot",
        "ord",
        "angle",
        "id",
        cx.alias("cx"),
        cy.alias("cy"),
        F.least(*[c[0] for c in corners]).alias("x0"),
        F.greatest(*[c[0] for c in corners]).alias("x1"),
        F.least(*[c[1] for c in corners]).alias("y0"),
        F.greatest(*[c[1] for c in corners]).alias("y1"),
        "z0",
        "z1",
    )


def coordinate_rotation(objects: DataFrame) -> DataFrame:
    """Every scene turned by each of the fixed rotations around its mean centre, boxes fitted anew."""
    spark = objects.sparkSession
    rows = ", ".join(f"({a}, {G.rotation(a)[0]}D, {G.rotation(a)[1]}D)" for a in ROTATIONS)
    turns = F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(angle, cos, sin)"))  # 3 rows
    mean = objects.groupBy("scene_id").agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"))
    all_ = objects.join(mean, "scene_id").crossJoin(turns)

    def turn(x, y):
        dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
        return F.col("mx") + dx * F.col("cos") - dy * F.col("sin"), F.col("my") + dx * F.col("sin") + dy * F.col("cos")

    corners = [turn(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
    cx, cy = turn("cx", "cy")
    return all_.select(
        "scene_id",
        "angle",
        "id",
        "label",
        cx.alias("cx"),
        cy.alias("cy"),
        "cz",
        F.least(*[c[0] for c in corners]).alias("x0"),
        F.greatest(*[c[0] for c in corners]).alias("x1"),
        F.least(*[c[1] for c in corners]).alias("y0"),
        F.greatest(*[c[1] for c in corners]).alias("y1"),
        "z0",
        "z1",
    )


def rotation_questions(objects: DataFrame, per_angle: int = 5) -> DataFrame:
    """Pairs whose map direction changes under a rotation, a few per scene and angle."""
    turned = coordinate_rotation(objects).withColumn("scene_angle", F.struct("scene_id", "angle"))
    new = R.pairs(turned.drop("scene_id", "angle").withColumnRenamed("scene_angle", "scene_id"))
    new = new.select("scene_id.*", "a_id", "b_id", G.ring_direction(F.col("a_cy") - F.col("b_cy"), F.col("a_cx") - F.col("b_cx"), G.CARDINAL).alias("new_direction"))
    old = R.measure(R.pairs(objects)).filter("a_label <> b_label and distance_raw >= 0.5 and ambiguity <= 0.7")
    old = old.select("scene_id", "a_id", "b_id", F.col("direction").alias("old_direction"))
    both = new.join(old, ["scene_id", "a_id", "b_id"]).filter("new_direction <> old_direction")
    return R.cap_per(both, ["scene_id", "angle"], [R.hash_order("angle", "a_id", "b_id"), "a_id", "b_id"], per_angle)


def removed(objects: DataFrame, target: DataFrame) -> DataFrame:
    """(scene_id, target, id, label): the scene without each target."""
    rest = objects.join(target.select("scene_id", F.col("id").alias("target")), "scene_id")
    return rest.filter("id <> target").select("scene_id", "target", "id", "label")


def viewpoint_moves(cameras: DataFrame) -> DataFrame:
    """Each camera moved 1, 2 or 3 metres forward, backward, right or left."""
    spark = cameras.sparkSession
    ways = [("forward", 1, 0), ("backward", -1, 0), ("right", 0, 1), ("left", 0, -1)]
    rows = ", ".join(f"('{n}', {m}, {f * m}D, {r * m}D)" for n, f, r in ways for m in (1, 2, 3))
    steps = F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(way, metres, ahead, aside)"))  # 12 rows
    out = cameras.crossJoin(steps)
    out = out.withColumn("px", F.col("px") + F.col("ahead") * F.col("fx") + F.col("aside") * F.col("fy"))
    return out.withColumn("py", F.col("py") + F.col("ahead") * F.col("fy") - F.col("aside") * F.col("fx")).drop("ahead", "aside")


def removal_policy(rows: DataFrame, group: list[str], order: str, floor: int = 2) -> DataFrame:
    """All changed rows of a group; one unchanged row more where fewer than ``floor`` changed."""
    w = W.partitionBy(*group)
    ranked = rows.withColumn("_changed", F.sum((~F.col("unchanged")).cast("int")).over(w))
    ranked = ranked.withColumn("_rank", F.row_number().over(W.partitionBy(*group, "unchanged").orderBy(order)))
    keep = ~F.col("unchanged") | ((F.col("_changed") < floor) & (F.col("_rank") == 1))
    return ranked.filter(keep).drop("_changed", "_rank")
