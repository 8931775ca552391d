"""One query per operator, over the adapter views, and the SQL that another engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import counterfactual as C
from ..operators import frames as V
from ..operators import graph as A
from ..operators import kernels as K
from ..operators import quality as Q
from ..operators import referability as M
from ..operators import relations as R
from ..sources import adapters as S
from ..sources import files
from . import oracle_views as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its oracle."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# SQL twins of the geometry expressions
_WRAP = "({x}) - floor(({x}) / 360) * 360"
RING = _sql_list(G.CARDINAL)
EGO = _sql_list(G.HORIZONTAL)


def _shift(p: str, s: str) -> str:
    return "(" + _WRAP.format(x=f"degrees(atan2({s}, {p})) + 22.5") + ")"


def _index(p: str, s: str) -> str:
    return f"(CASE WHEN sqrt(({p}) * ({p}) + ({s}) * ({s})) >= 1e-6 THEN least(floor({_shift(p, s)} / 45), 7) END)"


def _direction(p: str, s: str, ring: str) -> str:
    return f"{ring}[coalesce({_index(p, s)}, 0)::INT + 1]"


def _ambiguity(p: str, s: str) -> str:
    x = _shift(p, s)
    return f"(CASE WHEN sqrt(({p}) * ({p}) + ({s}) * ({s})) < 1e-6 THEN 1.0 ELSE abs({x} - floor({x} / 45) * 45 - 22.5) / 22.5 END)"


def _gap(k: str, a: str = "a", b: str = "b") -> str:
    return f"greatest({a}.{k}0 - {b}.{k}1, {b}.{k}0 - {a}.{k}1)"


#: Common area of two footprints.
_OVERLAP = " * ".join(f"greatest(least(a.{k}1, b.{k}1) - greatest(a.{k}0, b.{k}0), 0)" for k in "xy")


def _distance(a: str = "a", b: str = "b") -> str:
    g = [f"greatest({_gap(k, a, b)}, 0.0)" for k in "xyz"]
    return f"sqrt({g[0]} * {g[0]} + {g[1]} * {g[1]} + {g[2]} * {g[2]})"


def _bin(d: str) -> str:
    return f"CASE WHEN {d} < 1.0 THEN 'very_close' WHEN {d} < 2.0 THEN 'close' WHEN {d} < 3.3 THEN 'moderate' ELSE 'far' END"


def _near(d: str) -> str:
    return f"(abs({d} - 1.0) < 0.1 OR abs({d} - 2.0) < 0.1 OR abs({d} - 3.3) < 0.1)"


def _cut(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def cut(x):
    return F.floor(x * 100 + 0.5) / 100


PAIR = "FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.id < b.id"
P, S_ = "(a.cy - b.cy)", "(a.cx - b.cx)"
RELATIONS = f"""relations AS (SELECT a.scene_id, a.id AS a_id, b.id AS b_id, a.label AS a_label, b.label AS b_label,
  {_distance()} AS d, {_direction(P, S_, RING)} AS direction, {_ambiguity(P, S_)} AS ambiguity,
  {_OVERLAP} AS overlap,
  greatest({_gap('x')}, {_gap('y')}, {_gap('z')}) AS gap {PAIR})"""


@query(
    "relations",
    O.views(O.OBJECTS, RELATIONS)
    + f" SELECT scene_id, a_id, b_id, direction, {_cut('ambiguity')} AS ambiguity, {_cut('d')} AS distance, {_bin('d')} AS distance_bin, {_near('d')} AS near_boundary FROM relations",
)
def relations(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: all pairs of each scene with map direction, box distance, bin and doubt."""
    out = R.measure(R.pairs(S.objects(spark, sf)))
    return out.select("scene_id", "a_id", "b_id", "direction", cut(F.col("ambiguity")).alias("ambiguity"), cut(F.col("distance_raw")).alias("distance"), "distance_bin", "near_boundary")


_FWD = "((b.cx - a.cx) * c.fx + (b.cy - a.cy) * c.fy)"
_RGT = "((b.cx - a.cx) * c.fy - (b.cy - a.cy) * c.fx)"
_VERT = f"""CASE WHEN {_OVERLAP} > 1e-8 AND b.z0 - a.z1 > 0.02 THEN 'above'
  WHEN {_OVERLAP} > 1e-8 AND a.z0 - b.z1 > 0.02 THEN 'below' END"""


@query(
    "camera_relations",
    O.views(O.OBJECTS, O.CAMERAS)
    + f" SELECT a.scene_id, c.frame_id, a.id AS a_id, b.id AS b_id, {_direction(_FWD, _RGT, EGO)} AS horizontal, coalesce({_VERT}, {_direction(_FWD, _RGT, EGO)}) AS direction {PAIR} JOIN cameras c ON c.scene_id = a.scene_id",
)
def camera_relations(spark: SparkSession, sf: str) -> DataFrame:
    return R.camera_relations(S.objects(spark, sf), S.cameras(spark, sf)).select("scene_id", "frame_id", "a_id", "b_id", "horizontal", "direction")


@query(
    "relation_changes",
    O.views(O.OBJECTS, RELATIONS)
    + f""", moved AS (SELECT a.scene_id, a.id AS a_id, b.id AS b_id, {_direction(P, '(a.cx - b.cx + 1.5)', RING)} AS nd {PAIR} WHERE a.id % 2 = 0 AND b.id % 2 = 1)
  SELECT r.scene_id, r.a_id, r.b_id, r.direction AS old_direction, m.nd AS new_direction, 'direction' AS changes
  FROM relations r JOIN moved m ON r.scene_id = m.scene_id AND r.a_id = m.a_id AND r.b_id = m.b_id WHERE r.direction <> m.nd""",
)
def relation_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Even objects move 1.5 m east; which pairs' directions change."""
    old = R.measure(R.pairs(S.objects(spark, sf))).select("scene_id", "a_id", "b_id", "direction")
    pair = R.pairs(S.objects(spark, sf)).filter("a_id % 2 = 0 and b_id % 2 = 1").withColumn("a_cx", F.col("a_cx") + 1.5)
    new = R.measure(pair).select("scene_id", "a_id", "b_id", "direction")
    return R.changed(old, new, ["scene_id", "a_id", "b_id"], ["direction"])


_FX, _FY = "(b.cx - a.cx)", "(b.cy - a.cy)"
_TX, _TY = "(c.cx - a.cx)", "(c.cy - a.cy)"
_N = f"sqrt({_FX} * {_FX} + {_FY} * {_FY})"
_AL, _RI = f"(({_TX} * {_FX} + {_TY} * {_FY}) / {_N})", f"(({_TX} * {_FY} - {_TY} * {_FX}) / {_N})"
_TOT = f"sqrt({_FX} * {_FX} + {_FY} * {_FY} + (b.cz - a.cz) * (b.cz - a.cz))"
TRIPLETS = f"""triplets AS (SELECT a.scene_id, a.id AS a_id, b.id AS b_id, c.id AS c_id, {_direction(_AL, _RI, EGO)} AS direction, {_ambiguity(_AL, _RI)} AS ambiguity
  FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.id <> b.id JOIN objects c ON c.scene_id = a.scene_id AND c.id <> a.id AND c.id <> b.id
  WHERE a.label <> b.label AND c.label <> a.label AND c.label <> b.label AND {_N} >= 0.3 AND {_TOT} >= 1e-6 AND {_N} >= 0.5 * {_TOT}
  AND {_distance()} >= 0.5 AND {_distance('a', 'c')} >= 0.5)"""


@query("object_centric_triplets", O.views(O.OBJECTS, TRIPLETS) + f" SELECT scene_id, a_id, b_id, c_id, direction, {_cut('ambiguity')} AS ambiguity FROM triplets")
def object_centric_triplets(spark: SparkSession, sf: str) -> DataFrame:
    return R.triplets(S.objects(spark, sf)).select("scene_id", "a_id", "b_id", "c_id", "direction", cut(F.col("ambiguity")).alias("ambiguity"))


@query(
    "l1_direction_object_centric",
    O.views(O.OBJECTS, TRIPLETS)
    + " SELECT scene_id, a_id, b_id, c_id, direction FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY md5(concat_ws('|', '42', a_id, b_id, c_id)), a_id, b_id, c_id) AS r FROM triplets WHERE ambiguity <= 0.7) WHERE r <= 15",
)
def l1_direction_object_centric(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.triplets(S.objects(spark, sf)).filter("ambiguity <= 0.7")
    keys = ["a_id", "b_id", "c_id"]
    return R.cap_per(rows, ["scene_id"], [R.hash_order(*keys), *keys], 15).select("scene_id", *keys, "direction")


_EDGE = "LEFT JOIN edges e ON e.scene_id = r.scene_id AND ((e.parent_id = r.a_id AND e.child_id = r.b_id) OR (e.parent_id = r.b_id AND e.child_id = r.a_id))"
_WHY = """CASE WHEN e.type IS NOT NULL THEN 'attached_pair_non_vertical_direction' WHEN NOT (r.gap > 1e-8) THEN 'horizontal_3d_bbox_contact'
  WHEN r.overlap > 1e-8 THEN 'horizontal_projection_overlap' END"""


@query("direction_suppression", O.views(O.OBJECTS, O.EDGES, RELATIONS) + f" SELECT r.scene_id, r.a_id, r.b_id, {_WHY} AS reason FROM relations r {_EDGE}")
def direction_suppression(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.with_edge(R.measure(R.pairs(S.objects(spark, sf))), S.edges(spark, sf))
    return rows.select("scene_id", "a_id", "b_id", R.suppression(F.col("direction")).alias("reason"))


def _md5_options(correct: str, pool: str, keys: str, ring: str) -> str:
    """Options without the answer's neighbours on the ring, in hash order; SQL."""
    at = f"list_position({ring}, {correct})"
    near = f"[{ring}[({at} + 6) % 8 + 1], {ring}[{at} % 8 + 1], {correct}]"
    shuffled = "list_transform(list_sort(list_transform({x}, lambda o: {{'h': md5(concat_ws('|', '42', {k}, o)), 'v': o}})), lambda s: s.v)"
    picked = shuffled.format(x=f"list_filter({ring}, lambda o: NOT list_contains({near}, o))", k=keys)
    return shuffled.format(x=f"list_concat([{correct}], {picked}[1:3])", k=f"'order', {keys}")


@query(
    "l1_direction_allocentric",
    O.views(O.OBJECTS, O.EDGES, RELATIONS)
    + f""", ok AS (SELECT r.*, row_number() OVER (PARTITION BY r.scene_id ORDER BY md5(concat_ws('|', '42', r.a_id, r.b_id)), r.a_id, r.b_id) AS k FROM relations r {_EDGE}
      WHERE r.d >= 0.5 AND r.ambiguity <= 0.7 AND r.a_label <> r.b_label AND ({_WHY}) IS NULL),
    o AS (SELECT *, {_md5_options('direction', RING, 'a_id, b_id', RING)} AS opts FROM ok WHERE k <= 15)
    SELECT scene_id, a_id, b_id, direction AS correct_value, array_to_string(opts, ',') AS options, substr('ABCD', list_position(opts, direction)::INT, 1) AS answer FROM o""",
)
def l1_direction_allocentric(spark: SparkSession, sf: str) -> DataFrame:
    """First-level map-direction questions: clear, apart, unattached pairs with four options."""
    rows = R.with_edge(R.measure(R.pairs(S.objects(spark, sf))), S.edges(spark, sf))
    rows = rows.filter("distance_raw >= 0.5 and ambiguity <= 0.7 and a_label <> b_label").filter(R.suppression(F.col("direction")).isNull())
    rows = R.cap_per(rows, ["scene_id"], [R.hash_order("a_id", "b_id"), "a_id", "b_id"], 15)
    a, b = F.col("a_id").cast("string"), F.col("b_id").cast("string")
    rows = rows.withColumn("opts", X.direction_options(F.col("direction"), G.CARDINAL, a, b))
    return rows.select("scene_id", "a_id", "b_id", F.col("direction").alias("correct_value"), F.array_join("opts", ",").alias("options"), X.letter(F.col("opts"), F.col("direction")).alias("answer"))


@query(
    "l1_distance",
    O.views(O.OBJECTS, RELATIONS)
    + f""" SELECT scene_id, a_id, b_id, {_bin('d')} AS correct_value, 'What is the approximate distance between ' || a_label || ' and ' || b_label || '?' AS question FROM
      (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY md5(concat_ws('|', '42', a_id, b_id)), a_id, b_id) AS k FROM relations WHERE d >= 0.2 AND NOT {_near('d')} AND a_label <> b_label) WHERE k <= 20""",
)
def l1_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.measure(R.pairs(S.objects(spark, sf))).filter("distance_raw >= 0.2 and not near_boundary and a_label <> b_label")
    rows = R.cap_per(rows, ["scene_id"], [R.hash_order("a_id", "b_id"), "a_id", "b_id"], 20)
    text = X.fill("What is the approximate distance between {obj_a} and {obj_b}?", obj_a=F.col("a_label"), obj_b=F.col("b_label"))
    return rows.select("scene_id", "a_id", "b_id", F.col("distance_bin").alias("correct_value"), text.alias("question"))


@query(
    "l1_direction_agent",
    O.views(O.OBJECTS, O.CAMERAS, O.EDGES)
    + f""", r AS (SELECT a.scene_id, c.frame_id, a.id AS a_id, b.id AS b_id, coalesce({_VERT}, {_direction(_FWD, _RGT, EGO)}) AS direction,
      CASE WHEN ({_VERT}) IS NOT NULL THEN 1.0 - least(greatest(b.z0 - a.z1, a.z0 - b.z1) / greatest(a.z1 - a.z0, b.z1 - b.z0, 0.02), 1.0) ELSE {_ambiguity(_FWD, _RGT)} END AS ambiguity,
      {_OVERLAP} AS overlap, greatest({_gap('x')}, {_gap('y')}, {_gap('z')}) AS gap, {_distance()} AS d
      {PAIR} JOIN cameras c ON c.scene_id = a.scene_id WHERE a.label <> b.label)
    SELECT scene_id, frame_id, a_id, b_id, direction AS correct_value FROM (SELECT r.*, row_number() OVER (PARTITION BY r.scene_id, r.frame_id ORDER BY md5(concat_ws('|', '42', r.a_id, r.b_id)), r.a_id, r.b_id) AS k
      FROM r {_EDGE} WHERE r.ambiguity <= 0.7 AND r.d >= 0.5 AND (CASE WHEN r.direction IN ('above', 'below') THEN NULL ELSE {_WHY} END) IS NULL) WHERE k <= 20""",
)
def l1_direction_agent(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.with_edge(R.camera_relations(S.objects(spark, sf), S.cameras(spark, sf)), S.edges(spark, sf))
    rows = rows.filter("ambiguity <= 0.7 and distance_raw >= 0.5 and a_label <> b_label").filter(R.suppression(F.col("direction")).isNull())
    rows = R.cap_per(rows, ["scene_id", "frame_id"], [R.hash_order("a_id", "b_id"), "a_id", "b_id"], 20)
    return rows.select("scene_id", "frame_id", "a_id", "b_id", F.col("direction").alias("correct_value"))


@query(
    "projection",
    O.views(O.OBJECTS, O.CAMERAS)
    + f""" SELECT scene_id, frame_id, id, {_cut('fwd')} AS depth, CASE WHEN fwd > 0 THEN {_cut('rgt / fwd * 200 + 160')} END AS u, CASE WHEN fwd > 0 THEN {_cut('(pz - cz) / fwd * 200 + 120')} END AS v,
      coalesce(fwd > 0 AND rgt / fwd * 200 + 160 >= 0 AND rgt / fwd * 200 + 160 < 320 AND (pz - cz) / fwd * 200 + 120 >= 0 AND (pz - cz) / fwd * 200 + 120 < 240, false) AS inside
    FROM (SELECT o.scene_id, c.frame_id, o.id, o.cz, c.pz, (o.cx - c.px) * c.fy - (o.cy - c.py) * c.fx AS rgt, (o.cx - c.px) * c.fx + (o.cy - c.py) * c.fy AS fwd FROM objects o JOIN cameras c ON o.scene_id = c.scene_id)""",
)
def projection(spark: SparkSession, sf: str) -> DataFrame:
    both = S.objects(spark, sf).join(S.cameras(spark, sf), "scene_id")
    right, down, forward = G.to_camera(F.col("cx"), F.col("cy"), F.col("cz"))
    u, v = G.project(right, down, forward, 200.0, 160.0, 120.0)
    return both.select("scene_id", "frame_id", "id", cut(forward).alias("depth"), cut(u).alias("u"), cut(v).alias("v"), G.in_image(u, v, 320, 240).alias("inside"))


# attachment graph

_PRIO = "CASE type WHEN 'supported_by' THEN 1 WHEN 'resting_on_soft_surface' THEN 2 WHEN 'affixed_to' THEN 3 WHEN 'contained_in' THEN 4 ELSE 0 END"
_ORDER = f"confidence DESC, {_PRIO} DESC, containment DESC, coverage DESC, gap, parent_id"


@query("attachment_candidate_ranks", O.views(O.CANDIDATES) + f" SELECT scene_id, child_id, parent_id, row_number() OVER (PARTITION BY scene_id, child_id ORDER BY {_ORDER}) AS rank FROM candidate_edges")
def attachment_candidate_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return A.ranked_candidates(S.candidate_edges(spark, sf)).select("scene_id", "child_id", "parent_id", F.col("rank").cast("long").alias("rank"))


@query(
    "attachment_best_parent",
    O.views(O.CANDIDATES) + f" SELECT scene_id, child_id, parent_id, type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, child_id ORDER BY {_ORDER}) AS r FROM candidate_edges) WHERE r = 1",
)
def attachment_best_parent(spark: SparkSession, sf: str) -> DataFrame:
    return A.best_parent(S.candidate_edges(spark, sf))


@query(
    "support_best_parent",
    O.views(O.CANDIDATES)
    + f" SELECT scene_id, child_id, parent_id, type FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, child_id ORDER BY {_PRIO} DESC, contact_z DESC, gap, confidence DESC, coverage DESC, parent_id) AS r FROM candidate_edges) WHERE r = 1",
)
def support_best_parent(spark: SparkSession, sf: str) -> DataFrame:
    return A.best_support(S.candidate_edges(spark, sf))


@query("attachment_forest")
def attachment_forest(spark: SparkSession, sf: str) -> DataFrame:
    return A.forest(S.candidate_edges(spark, sf))


_WALK = """walk(scene_id, root, id, hops) AS (SELECT scene_id, parent_id, child_id, 1 FROM edges UNION ALL
  SELECT w.scene_id, w.root, e.child_id, w.hops + 1 FROM walk w JOIN edges e ON e.scene_id = w.scene_id AND e.parent_id = w.id WHERE w.hops < 10)"""
_MOVED = "moved AS (SELECT scene_id, id AS target, id FROM objects UNION ALL SELECT scene_id, root, id FROM walk)"


def _recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


@query("attachment_chains", _recursive(O.EDGES, _WALK) + " SELECT scene_id, root, id, min(hops)::INT AS hops FROM walk GROUP BY ALL")
def attachment_chains(spark: SparkSession, sf: str) -> DataFrame:
    return A.chains(S.edges(spark, sf))


@query(
    "l3_attachment_chain",
    _recursive(O.OBJECTS, O.EDGES, _WALK, _MOVED)
    + """, two AS (SELECT u.scene_id, u.parent_id AS g, u.child_id AS p, d.child_id AS k FROM edges u JOIN edges d ON d.scene_id = u.scene_id AND d.parent_id = u.child_id),
    near AS (SELECT x.scene_id, g, arg_min(o.id, row((o.cx - t.cx) * (o.cx - t.cx) + (o.cy - t.cy) * (o.cy - t.cy) + (o.cz - t.cz) * (o.cz - t.cz), o.id)) AS n
      FROM (SELECT DISTINCT scene_id, g FROM two) x JOIN objects t ON t.scene_id = x.scene_id AND t.id = g JOIN objects o ON o.scene_id = x.scene_id
      WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.scene_id = x.scene_id AND m.target = g AND m.id = o.id) GROUP BY x.scene_id, g)
    SELECT two.scene_id, two.g AS grandparent_id, two.p AS parent_id, two.k AS grandchild_id, near.n AS neighbor_id, 'Both the ' || op.label || ' and the ' || ok.label AS correct_value
    FROM two JOIN near USING (scene_id, g) JOIN objects op ON op.scene_id = two.scene_id AND op.id = two.p JOIN objects ok ON ok.scene_id = two.scene_id AND ok.id = two.k JOIN objects nn ON nn.scene_id = two.scene_id AND nn.id = near.n
    WHERE op.label <> ok.label AND ok.label <> nn.label AND op.label <> nn.label""",
)
def l3_attachment_chain(spark: SparkSession, sf: str) -> DataFrame:
    return A.chain_questions(S.objects(spark, sf), S.edges(spark, sf))


# what-if

_STEPS = ", ".join(
    f"({i * 8 + j + 1}, {round(x * (m if x == 0 or y == 0 else m * 2**-0.5), 6)}::DOUBLE, {round(y * (m if x == 0 or y == 0 else m * 2**-0.5), 6)}::DOUBLE)"
    for i, m in enumerate(C.MAGNITUDES)
    for j, (x, y) in enumerate(C.UNITS)
)
_LEGAL = f"""steps(move, dx, dy) AS (VALUES {_STEPS}),
room AS (SELECT scene_id, min(x0) rx0, min(y0) ry0, min(z0) rz0, max(x1) rx1, max(y1) ry1, max(z1) rz1 FROM objects GROUP BY scene_id),
going AS (SELECT m.scene_id, m.target, s.move, s.dx, s.dy, o.id, o.x0 + s.dx AS x0, o.x1 + s.dx AS x1, o.y0 + s.dy AS y0, o.y1 + s.dy AS y1, o.z0, o.z1 FROM moved m JOIN objects o ON o.scene_id = m.scene_id AND o.id = m.id CROSS JOIN steps s),
inside AS (SELECT g.scene_id, target, move, dx, dy FROM going g JOIN room r ON r.scene_id = g.scene_id GROUP BY ALL
  HAVING bool_and(x0 >= rx0 - 1e-6 AND y0 >= ry0 - 1e-6 AND z0 >= rz0 - 1e-6 AND x1 <= rx1 + 1e-6 AND y1 <= ry1 + 1e-6 AND z1 <= rz1 + 1e-6)),
hits AS (SELECT DISTINCT a.scene_id, a.target, a.move FROM going a JOIN objects b ON a.scene_id = b.scene_id AND {_gap('x')} < 0 AND {_gap('y')} < 0 AND {_gap('z')} < 0
  WHERE NOT EXISTS (SELECT 1 FROM moved c WHERE c.scene_id = a.scene_id AND c.target = a.target AND c.id = b.id)),
legal AS (SELECT * FROM inside i WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.scene_id = i.scene_id AND h.target = i.target AND h.move = i.move))"""


@query("legal_moves", _recursive(O.OBJECTS, O.EDGES, _WALK, _MOVED, _LEGAL) + " SELECT scene_id, target, move, dx, dy FROM legal")
def legal_moves(spark: SparkSession, sf: str) -> DataFrame:
    objects = S.objects(spark, sf)
    return C.legal_moves(objects, A.moved_sets(objects, S.edges(spark, sf))).select("scene_id", "target", "move", "dx", "dy")


_OX, _OY = "(s.cx - m.cx)", "(s.cy - m.cy)"
_NEWI = _index(f"({_OY} - l.dy)", f"({_OX} - l.dx)")


@query(
    "l2_object_move",
    _recursive(O.OBJECTS, O.EDGES, _WALK, _MOVED, _LEGAL)
    + f""", turned AS (SELECT l.scene_id, l.target, l.move, l.dx, l.dy, max(least(abs({_index(_OY, _OX)} - {_NEWI}), 8 - abs({_index(_OY, _OX)} - {_NEWI}))) AS steps
      FROM legal l JOIN moved v ON v.scene_id = l.scene_id AND v.target = l.target JOIN objects m ON m.scene_id = l.scene_id AND m.id = v.id JOIN objects s ON s.scene_id = l.scene_id
      WHERE NOT EXISTS (SELECT 1 FROM moved c WHERE c.scene_id = l.scene_id AND c.target = l.target AND c.id = s.id) GROUP BY ALL)
    SELECT scene_id, target, move, dx, dy, steps::BIGINT AS steps FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, target ORDER BY CASE WHEN steps >= 2 THEN 0 ELSE 1 END, move) AS r FROM turned WHERE steps >= 1) WHERE r = 1""",
)
def l2_object_move(spark: SparkSession, sf: str) -> DataFrame:
    """Per object the first legal move that turns some pair by 90 degrees, else by 45."""
    objects = S.objects(spark, sf)
    moved = A.moved_sets(objects, S.edges(spark, sf))
    return C.meaningful_moves(objects, moved, C.legal_moves(objects, moved)).withColumn("steps", F.col("steps").cast("long"))


@query("l2_orbit_rotation")
def l2_orbit_rotation(spark: SparkSession, sf: str) -> DataFrame:
    objects = S.objects(spark, sf)
    out = C.orbits(objects, A.moved_sets(objects, S.edges(spark, sf)))
    return out.select("scene_id", "target", "pivot", "angle", "id", cut(F.col("cx")).alias("cx"), cut(F.col("cy")).alias("cy"))


ORACLES["l2_orbit_rotation"] = _recursive(
    O.OBJECTS,
    O.EDGES,
    _WALK,
    _MOVED,
    "turns(angle, co, si) AS (VALUES " + ", ".join(f"({a}, {G.rotation(a)[0]!r}::DOUBLE, {G.rotation(a)[1]!r}::DOUBLE)" for a in C.ORBITS) + ")",
) + f""" SELECT m.scene_id, m.target, q.id AS pivot, t.angle, m.id, {_cut('q.cx + (o.cx - q.cx) * co - (o.cy - q.cy) * si')} AS cx, {_cut('q.cy + (o.cx - q.cx) * si + (o.cy - q.cy) * co')} AS cy
  FROM moved m JOIN objects o ON o.scene_id = m.scene_id AND o.id = m.id JOIN objects q ON q.scene_id = m.scene_id CROSS JOIN turns t WHERE NOT EXISTS (SELECT 1 FROM moved c WHERE c.scene_id = m.scene_id AND c.target = m.target AND c.id = q.id)"""

_TURN3 = "turns(angle, co, si) AS (VALUES " + ", ".join(f"({a}, {G.rotation(a)[0]}::DOUBLE, {G.rotation(a)[1]}::DOUBLE)" for a in C.ROTATIONS) + ")"
_MEAN = "mean AS (SELECT scene_id, avg(cx) mx, avg(cy) my FROM objects GROUP BY scene_id)"


@query(
    "l3_coordinate_rotation",
    O.views(O.OBJECTS, RELATIONS, _TURN3)
    + f""" SELECT scene_id, angle, a_id, b_id, old_direction, new_direction FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, angle ORDER BY md5(concat_ws('|', '42', angle, a_id, b_id)), a_id, b_id) AS k FROM (
      SELECT r.scene_id, t.angle, r.a_id, r.b_id, r.direction AS old_direction, {_direction('((a.cx - b.cx) * si + (a.cy - b.cy) * co)', '((a.cx - b.cx) * co - (a.cy - b.cy) * si)', RING)} AS new_direction
      FROM relations r JOIN objects a ON a.scene_id = r.scene_id AND a.id = r.a_id JOIN objects b ON b.scene_id = r.scene_id AND b.id = r.b_id CROSS JOIN turns t WHERE r.a_label <> r.b_label AND r.d >= 0.5 AND r.ambiguity <= 0.7) WHERE old_direction <> new_direction) WHERE k <= 5""",
)
def l3_coordinate_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return C.rotation_questions(S.objects(spark, sf)).select("scene_id", "angle", "a_id", "b_id", "old_direction", "new_direction")


@query(
    "coordinate_rotation_boxes",
    O.views(O.OBJECTS, _MEAN, _TURN3)
    + f""" SELECT o.scene_id, t.angle, o.id, {_cut('mx + (cx - mx) * co - (cy - my) * si')} AS cx, {_cut('my + (cx - mx) * si + (cy - my) * co')} AS cy,
      {_cut('least(mx + (x0 - mx) * co - (y0 - my) * si, mx + (x1 - mx) * co - (y0 - my) * si, mx + (x0 - mx) * co - (y1 - my) * si, mx + (x1 - mx) * co - (y1 - my) * si)')} AS x0
    FROM objects o JOIN mean m ON o.scene_id = m.scene_id CROSS JOIN turns t""",
)
def coordinate_rotation_boxes(spark: SparkSession, sf: str) -> DataFrame:
    out = C.coordinate_rotation(S.objects(spark, sf))
    return out.select("scene_id", "angle", "id", *[cut(F.col(c)).alias(c) for c in ("cx", "cy", "x0")])


@query("object_removal", O.views(O.OBJECTS) + " SELECT o.scene_id, t.id AS target, o.id, o.label FROM objects o JOIN objects t ON o.scene_id = t.scene_id AND o.id <> t.id")
def object_removal(spark: SparkSession, sf: str) -> DataFrame:
    objects = S.objects(spark, sf)
    return C.removed(objects, objects)


_WAYS = ", ".join(f"('{n}', {m}, {f * m}::DOUBLE, {r * m}::DOUBLE)" for n, f, r in (("forward", 1, 0), ("backward", -1, 0), ("right", 0, 1), ("left", 0, -1)) for m in (1, 2, 3))


@query(
    "l2_viewpoint_move",
    O.views(O.CAMERAS) + f", w(way, metres, ahead, aside) AS (VALUES {_WAYS}) SELECT scene_id, frame_id, way, metres, {_cut('px + ahead * fx + aside * fy')} AS px, {_cut('py + ahead * fy - aside * fx')} AS py FROM cameras, w",
)
def l2_viewpoint_move(spark: SparkSession, sf: str) -> DataFrame:
    out = C.viewpoint_moves(S.cameras(spark, sf))
    return out.select("scene_id", "frame_id", "way", "metres", cut(F.col("px")).alias("px"), cut(F.col("py")).alias("py"))


@query("room_bounds", O.views(O.OBJECTS) + " SELECT scene_id, min(x0) AS room_x0, min(y0) AS room_y0, min(z0) AS room_z0, max(x1) AS room_x1, max(y1) AS room_y1, max(z1) AS room_z1 FROM objects GROUP BY scene_id")
def room_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return C.room_bounds(S.objects(spark, sf))


@query(
    "move_descriptions",
    "WITH s(move, dx, dy) AS (VALUES " + _STEPS + """) SELECT move, CASE WHEN a < 45 OR a >= 315 THEN 'north' WHEN a < 135 THEN 'east' WHEN a < 225 THEN 'south' ELSE 'west' END AS cardinal
    FROM (SELECT move, degrees(atan2(dx, dy)) - floor(degrees(atan2(dx, dy)) / 360) * 360 AS a FROM s)""",
)
def move_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return C.moves(spark).select("move", G.cardinal_move(F.col("dx"), F.col("dy"), F.lit(0.0)).alias("cardinal"))


# quality control and scoring

QC = """clear AS (SELECT * FROM questions WHERE NOT (type = 'direction_agent' AND ambiguity > 0.7)),
near AS (SELECT * FROM clear QUALIFY row_number() OVER (PARTITION BY scene_id, image_name, type, a_id, b_id ORDER BY ord) = 1),
final AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY scene_id, question ORDER BY ord) = 1)"""


@query("quality_filter", O.views(O.QUESTIONS, QC) + " SELECT question_id, scene_id, type FROM final")
def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quality_filter(S.questions(spark, sf)).select("question_id", "scene_id", "type")


@query(
    "quality_report",
    O.views(O.QUESTIONS, QC)
    + """ SELECT reason, n FROM (SELECT 'ambiguous_direction' AS reason, (SELECT count(*) FROM questions) - (SELECT count(*) FROM clear) AS n UNION ALL
      SELECT 'near_duplicate', (SELECT count(*) FROM clear) - (SELECT count(*) FROM near) UNION ALL SELECT 'cross_frame_duplicate', (SELECT count(*) FROM near) - (SELECT count(*) FROM final)
      UNION ALL SELECT 'kept', (SELECT count(*) FROM final)) WHERE n > 0""",
)
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quality_report(S.questions(spark, sf))


_H = "md5(concat_ws('|', '42', question_id)), question_id"


@query(
    "cap_not_visible",
    O.views(O.QUESTIONS)
    + f""", n AS (SELECT count(*) FILTER (correct_value = 'not visible') AS k, count(*) FILTER (correct_value <> 'not visible') AS o FROM questions WHERE level = 'L1' AND type = 'occlusion'),
    most AS (SELECT coalesce(max(x), 0) AS m FROM n, range(1, 1000000) r(x) WHERE x <= k AND x / (o + x)::DOUBLE <= 1.0::DOUBLE / 3)
    SELECT question_id FROM (SELECT question_id, CASE WHEN level = 'L1' AND type = 'occlusion' AND correct_value = 'not visible' THEN row_number() OVER (PARTITION BY level = 'L1' AND type = 'occlusion' AND correct_value = 'not visible' ORDER BY {_H}) ELSE 0 END AS r FROM questions), most WHERE r <= m""",
)
def cap_not_visible(spark: SparkSession, sf: str) -> DataFrame:
    among = (F.col("level") == "L1") & (F.col("type") == "occlusion")
    return Q.cap_share(S.questions(spark, sf), among, F.col("correct_value") == "not visible").select("question_id")


@query(
    "balance_answer_values",
    O.views(O.QUESTIONS)
    + f""", n AS (SELECT type, min(c) AS least FROM (SELECT type, correct_value, count(*) c FROM questions GROUP BY ALL) GROUP BY type)
    SELECT question_id FROM (SELECT q.*, n.least, row_number() OVER (PARTITION BY q.type, correct_value ORDER BY {_H}) AS r FROM questions q JOIN n ON n.type = q.type) WHERE r <= least OR type NOT IN ('distance', 'direction_agent')""",
)
def balance_answer_values(spark: SparkSession, sf: str) -> DataFrame:
    return Q.balance_values(S.questions(spark, sf), ["distance", "direction_agent"]).select("question_id")


@query(
    "attachment_dominance",
    O.views(O.QUESTIONS)
    + f""", s AS (SELECT *, level = 'L2' AND (type LIKE 'object\\_move\\_%' ESCAPE '\\' OR type = 'object_rotate_object_centric') AS subject FROM questions),
    n AS (SELECT type, count(*) FILTER (attached) AS a FROM s WHERE subject GROUP BY type)
    SELECT question_id FROM (SELECT s.*, n.a, row_number() OVER (PARTITION BY subject, s.type, attached ORDER BY {_H}) AS r FROM s LEFT JOIN n ON n.type = s.type) WHERE NOT subject OR attached OR r <= CASE WHEN a > 0 THEN 2 * a ELSE 3 END""",
)
def attachment_dominance(spark: SparkSession, sf: str) -> DataFrame:
    return Q.attachment_dominance(S.questions(spark, sf)).select("question_id")


@query(
    "cap_question_groups",
    O.views(O.QUESTIONS)
    + f" SELECT question_id FROM questions QUALIFY row_number() OVER (PARTITION BY scene_id, type ORDER BY CASE WHEN attached AND NOT unchanged THEN 0 WHEN attached THEN 1 ELSE 2 END, {_H}) <= 4",
)
def cap_question_groups(spark: SparkSession, sf: str) -> DataFrame:
    return Q.cap_tiers(S.questions(spark, sf), ["scene_id", "type"], 4).select("question_id")


@query(
    "viewer_filter",
    O.views(O.QUESTIONS)
    + """ SELECT question_id FROM (SELECT *, count(*) FILTER (attached) OVER (PARTITION BY scene_id, image_name, type) AS a, row_number() OVER (PARTITION BY scene_id, image_name, type, attached ORDER BY ord) AS r FROM questions)
    WHERE attached OR r <= CASE WHEN a > 0 THEN 2 * a ELSE 1 END""",
)
def viewer_filter(spark: SparkSession, sf: str) -> DataFrame:
    return Q.viewer_filter(S.questions(spark, sf), ["scene_id", "image_name", "type"]).select("question_id")


@query(
    "validation_sample",
    O.views(O.QUESTIONS)
    + f" SELECT question_id, level, row_number() OVER (ORDER BY level, r) AS validation_id FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY {_H}) AS r FROM questions) WHERE r <= 50",
)
def validation_sample(spark: SparkSession, sf: str) -> DataFrame:
    return Q.validation_sample(S.questions(spark, sf)).select("question_id", "level", F.col("validation_id").cast("long").alias("validation_id"))


@query(
    "question_statistics",
    O.views(O.QUESTIONS)
    + """ SELECT level, type, answer, n, CASE WHEN answer IS NOT NULL THEN round_even(n / sum(n) OVER (PARTITION BY g, level), 3) END AS share
    FROM (SELECT level, type, answer, grouping(level, type, answer) AS g, count(*) AS n FROM questions GROUP BY GROUPING SETS ((), (level), (type), (level, answer)))""",
)
def question_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return Q.statistics(S.questions(spark, sf))


_LAST = "last AS (SELECT question_id, arg_max(row(prediction), ord) AS p FROM predictions GROUP BY question_id)"


def _accuracy(join: str) -> str:
    return (
        O.views(O.QUESTIONS, O.PREDICTIONS, _LAST)
        + f""", m AS (SELECT q.level, q.type, coalesce(l.p[1] = q.answer, false) AS ok FROM questions q {join} last l ON l.question_id = q.question_id),
    s AS (SELECT CASE WHEN grouping(level, type) = 3 THEN 'overall' WHEN grouping(level, type) = 1 THEN 'level' ELSE 'type' END AS scope, coalesce(level, type, 'all') AS name, count(*) FILTER (ok) AS correct, count(*) AS total
      FROM m GROUP BY GROUPING SETS ((), (level), (type))),
    f AS (SELECT scope, name, coalesce(correct, 0) AS correct, coalesce(total, 0) AS total, coalesce(correct / nullif(total, 0), 0.0) AS accuracy FROM s FULL JOIN (VALUES ('level', 'L1'), ('level', 'L2'), ('level', 'L3'), ('overall', 'all')) v(scope, name) USING (scope, name))"""
    )


@query("accuracy", _accuracy("JOIN") + " SELECT * FROM f")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return Q.accuracy(Q.matched(S.questions(spark, sf), S.predictions(spark, sf)))


@query("pilot_accuracy", _accuracy("LEFT JOIN") + " SELECT * FROM f")
def pilot_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return Q.accuracy(Q.matched(S.questions(spark, sf), S.predictions(spark, sf), all_questions=True))


@query(
    "accuracy_gap",
    _accuracy("JOIN")
    + " SELECT gap, CASE WHEN gap > 0.20 THEN 'PASS' WHEN gap > 0.10 THEN 'WARN' ELSE 'FAIL' END AS band FROM (SELECT max(accuracy) FILTER (scope = 'level' AND name = 'L1') - max(accuracy) FILTER (scope = 'level' AND name = 'L2') AS gap FROM f)",
)
def accuracy_gap(spark: SparkSession, sf: str) -> DataFrame:
    return Q.gap_report(accuracy(spark, sf))


@query(
    "annotator_kappa",
    O.views(O.QUESTIONS, O.PREDICTIONS, _LAST)
    + """, c AS (SELECT q.answer AS a, l.p[1] AS b, count(*) AS n FROM questions q JOIN last l ON l.question_id = q.question_id WHERE l.p[1] IS NOT NULL GROUP BY ALL),
    t AS (SELECT sum(n)::DOUBLE AS t, coalesce(sum(n) FILTER (a = b), 0)::DOUBLE AS s FROM c),
    e AS (SELECT sum(x.n::DOUBLE * y.n::DOUBLE) AS e FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON x.a = y.b)
    SELECT CASE WHEN e / (t * t) >= 1 THEN 1.0 ELSE (s / t - e / (t * t)) / (1 - e / (t * t)) END AS kappa FROM t, e""",
)
def annotator_kappa(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.questions(spark, sf).join(Q.last_prediction(S.predictions(spark, sf)), "question_id").filter("prediction is not null")
    return Q.kappa(rows, "answer", "prediction")


_Q10 = "floor(x * 10 + 0.5) / 10"


@query(
    "calibrate_distance_bins",
    O.views(O.OBJECTS, RELATIONS)
    + """, q AS (SELECT list_transform(quantile_cont(d, [0.25, 0.5, 0.75]), lambda x: floor(x * 10 + 0.5) / 10) AS q FROM relations WHERE d > 0.05),
    a AS (SELECT q, q[1] AS l1, greatest(q[2], floor((q[1] + 0.4) * 10 + 0.5) / 10) AS l2 FROM q)
    SELECT l1 AS limit_1, l2 AS limit_2, greatest(q[3], floor((l2 + 0.4) * 10 + 0.5) / 10) AS limit_3 FROM a""",
)
def calibrate_distance_bins(spark: SparkSession, sf: str) -> DataFrame:
    return Q.calibrate_bins(R.measure(R.pairs(S.objects(spark, sf))))


@query(
    "balance_answer_letters",
    O.views(O.QUESTIONS)
    + """, s AS (SELECT level, type, answer, sum(n) AS n FROM (SELECT level, type, answer, 1 AS n FROM questions UNION ALL SELECT DISTINCT level, type, unnest(['A', 'B', 'C', 'D']), 0 FROM questions) GROUP BY ALL),
    m AS (SELECT *, floor(sum(n) OVER (PARTITION BY level, type) * 0.35) AS most FROM s),
    giving AS (SELECT *, row_number() OVER (PARTITION BY level, type ORDER BY answer, r) AS place FROM (SELECT q.*, m.n, m.most, row_number() OVER (PARTITION BY q.level, q.type, q.answer ORDER BY ord) AS r FROM questions q JOIN m USING (level, type, answer)) WHERE r <= n - most),
    taking AS (SELECT *, row_number() OVER (PARTITION BY level, type ORDER BY answer, i) AS place FROM (SELECT level, type, answer, unnest(range(0, greatest(most - n, 0)::BIGINT)) AS i FROM m)),
    moved AS (SELECT g.question_id, t.answer AS new FROM giving g JOIN taking t USING (level, type, place))
    SELECT question_id, level, type, coalesce(new, answer) AS answer, array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN new IS NULL THEN options[i + 1] WHEN i = ascii(answer) - 65 THEN options[ascii(new) - 64]
      WHEN i = ascii(new) - 65 THEN options[ascii(answer) - 64] ELSE options[i + 1] END), ',') AS options FROM questions LEFT JOIN moved USING (question_id)""",
)
def balance_answer_letters(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.balance_letters(S.questions(spark, sf))
    return rows.select("question_id", "level", "type", "answer", F.array_join("options", ",").alias("options"))


_U = "upper(trim(coalesce(raw_response, '')))"


def _pick(p: str) -> str:
    return f"nullif(regexp_extract({_U}, '{p}', 1), '')"


@query(
    "parse_answers",
    O.views(O.PREDICTIONS)
    + f""" SELECT raw_response, count(*) AS n, coalesce({_pick('^([ABCD])$')}, {_pick(r'^[(\[]?([ABCD])(?:[)\].:\s-]|$)')}, {_pick(r'\b([ABCD])\b')}) AS letter,
      coalesce({_pick('^([ABCD])$')}, {_pick(r'^[(\[]?([ABCD])(?:[)\].:\s-]*)?$')}, {', '.join(_pick(p) for p in X.EXPLICIT)},
      CASE WHEN len(list_distinct(regexp_extract_all({_U}, '\\b([ABCD])\\b', 1))) = 1 THEN regexp_extract_all({_U}, '\\b([ABCD])\\b', 1)[1] END) AS strict FROM predictions GROUP BY raw_response""",
)
def parse_answers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw_response")
    rows = S.predictions(spark, sf).groupBy("raw_response").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("raw_response", "n", X.parse_answer(raw).alias("letter"), X.parse_strict(raw).alias("strict"))


# referability and frames


@query(
    "crop_label_statuses",
    O.views(O.REVIEWS)
    + """, c AS (SELECT frame_id, label, count(*) FILTER (status = 'clear') AS n_clear, bool_or(coalesce(status = 'unsure', true)) AS unsure, min(object_id) FILTER (status = 'clear') AS f FROM reviews GROUP BY ALL),
    s AS (SELECT *, CASE WHEN n_clear = 1 AND NOT unsure THEN 'unique' WHEN n_clear >= 2 THEN 'multiple' WHEN n_clear = 0 AND NOT unsure THEN 'absent' ELSE 'unsure' END AS status FROM c)
    SELECT frame_id, label, status, n_clear, CASE WHEN status = 'unique' THEN f END AS referable_id FROM s""",
)
def crop_label_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return M.crop_label_statuses(S.reviews(spark, sf))


CROP = ORACLES["crop_label_statuses"].removeprefix("WITH ").replace("SELECT frame_id, label, status, n_clear, CASE WHEN status = 'unique' THEN f END AS referable_id FROM s", "")
_FULL = "full_frame AS (SELECT frame_id, label, CASE WHEN n_clear % 3 = 0 THEN 'multiple' ELSE 'bogus' END AS status FROM s WHERE frame_id % 2 = 0)"
_SEEN = "seen AS (SELECT frame_id, label, count(*) AS n FROM reviews WHERE area_px >= 1500 GROUP BY ALL)"
_MERGED = """merged AS (SELECT frame_id, label, CASE WHEN coalesce(n, 0) >= 2 AND coalesce(f.status, s.status, '') <> 'absent' THEN 'multiple' ELSE coalesce(f.status, s.status) END AS status
  FROM s FULL JOIN (SELECT * FROM full_frame WHERE status IN ('unique', 'multiple', 'absent', 'unsure')) f USING (frame_id, label) FULL JOIN seen USING (frame_id, label))"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    reviews = S.reviews(spark, sf)
    crop = M.crop_label_statuses(reviews)
    full = crop.filter("frame_id % 2 = 0").select("frame_id", "label", F.when(F.col("n_clear") % 3 == 0, "multiple").otherwise("bogus").alias("status"))
    seen = reviews.filter("area_px >= 1500").groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return M.merge_statuses(crop, full, seen)


@query("merge_label_statuses", "WITH " + CROP + f", {_FULL}, {_SEEN}, {_MERGED} SELECT * FROM merged WHERE status IS NOT NULL")
def merge_label_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


_MENTIONS = """mentions AS (SELECT object_id AS question_id, frame_id, 'obj_a' AS role, label, object_id AS obj_id FROM reviews UNION ALL
  SELECT object_id, frame_id, 'obj_b', 'label_' || ((object_id + 1) % 7), CASE WHEN object_id % 4 = 0 THEN object_id WHEN object_id % 4 = 1 THEN NULL ELSE object_id + 1 END FROM reviews)"""


@query(
    "mention_audit",
    "WITH " + CROP + f""", {_FULL}, {_SEEN}, {_MERGED}, {_MENTIONS}, ref AS (SELECT frame_id, label, object_id AS obj_id FROM reviews WHERE status = 'clear' AND bbox_ratio >= 0.3),
    m AS (SELECT m.*, count(DISTINCT concat_ws('|', coalesce(obj_id::VARCHAR, ''), lower(m.label))) OVER (PARTITION BY question_id, role) > 1 AS conflict,
      obj_id IS NOT NULL AND count(DISTINCT role) OVER (PARTITION BY question_id, obj_id) > 1 AS multi, coalesce(s.status, 'unsure') AS st,
      coalesce(k.n, 0) AS n,
      EXISTS (SELECT 1 FROM ref r WHERE r.frame_id = m.frame_id AND r.label = m.label AND r.obj_id = m.obj_id) AS own,
      EXISTS (SELECT 1 FROM ref r WHERE r.frame_id = m.frame_id AND r.obj_id = m.obj_id) AS known
      FROM mentions m LEFT JOIN (SELECT * FROM merged WHERE status IS NOT NULL) s ON s.frame_id = m.frame_id AND s.label = m.label
      LEFT JOIN (SELECT frame_id, label, count(DISTINCT obj_id) AS n FROM ref GROUP BY ALL) k ON k.frame_id = m.frame_id AND k.label = m.label),
    x AS (SELECT question_id, unnest([CASE WHEN conflict THEN 'mentioned_role_conflict' END, CASE WHEN multi THEN 'mentioned_object_multi_role' END,
      CASE WHEN obj_id IS NOT NULL AND (NOT known OR (n = 1 AND NOT own)) THEN 'mentioned_nonreferable_object' END, CASE WHEN st = 'multiple' THEN 'mentioned_label_not_unique' END,
      CASE WHEN st NOT IN ('multiple', 'unique') OR n <> 1 THEN 'mentioned_label_not_resolved' END]) AS why FROM m)
    SELECT question_id, CASE WHEN count(why) > 0 THEN 'drop' ELSE 'pass' END AS decision, coalesce(string_agg(DISTINCT why, ',' ORDER BY why), '') AS reason_codes FROM x GROUP BY question_id""",
)
def mention_audit(spark: SparkSession, sf: str) -> DataFrame:
    reviews = S.reviews(spark, sf)
    a = reviews.select(F.col("object_id").alias("question_id"), "frame_id", F.lit("obj_a").alias("role"), "label", F.col("object_id").alias("obj_id"))
    other = F.expr("case when object_id % 4 = 0 then object_id when object_id % 4 = 1 then null else object_id + 1 end")
    b = reviews.select(F.col("object_id").alias("question_id"), "frame_id", F.lit("obj_b").alias("role"), F.expr("concat('label_', (object_id + 1) % 7)").alias("label"), other.alias("obj_id"))
    ref = reviews.filter("status = 'clear' and bbox_ratio >= 0.3").select("frame_id", "label", F.col("object_id").alias("obj_id"))
    return M.audit_mentions(a.unionByName(b), _merged(spark, sf), ref)


@query(
    "attachment_pair_gate",
    O.views(O.REVIEWS)
    + """ SELECT object_id, CASE WHEN reason IS NULL THEN 'pass' WHEN status IS NULL THEN 'uncertain' ELSE 'auto_drop_hard_fail' END AS decision, reason FROM (SELECT *, CASE WHEN status IS NULL THEN 'missing_object_review'
      WHEN status = 'absent' THEN 'vlm_status_absent' WHEN bbox_ratio < 0.2 THEN 'bbox_in_frame_ratio_too_small' WHEN area_px < 400 THEN 'projected_area_too_small' END AS reason FROM reviews)""",
)
def attachment_pair_gate(spark: SparkSession, sf: str) -> DataFrame:
    return M.pair_gate(S.reviews(spark, sf))


@query(
    "alias_inventory",
    O.views(O.REVIEWS)
    + """ SELECT label, count(DISTINCT frame_id) AS n_frames, count(*) AS n_objects, count(*) FILTER (status = 'clear') AS n_clear, count(*) FILTER (status = 'unsure') AS n_unsure,
      count(*) FILTER (status = 'absent') AS n_absent, count(*) FILTER (status IS NULL) AS n_missing FROM reviews GROUP BY label""",
)
def alias_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return M.alias_inventory(S.reviews(spark, sf))


_CENTRE = "(u >= 80 AND u < 240 AND v >= 80 AND v < 160)"
_VIS = f"""vis AS (SELECT *, CASE WHEN NOT (depth_m > 0.3 AND depth_m <= 8.0) THEN 'rejected' WHEN {_CENTRE} THEN 'selected_center'
  WHEN CASE WHEN has_mask THEN area_px >= 800 AND mask_px >= 400 ELSE area_px >= 800 AND bbox_ratio >= 0.35 END THEN 'selected_roi_fallback' ELSE 'rejected' END AS decision FROM reviews)"""


@query(
    "selector_visibility",
    O.views(O.REVIEWS, _VIS)
    + """ SELECT object_id, decision, array_to_string(list_filter([CASE WHEN NOT deep THEN 'depth_out_of_range' END, CASE WHEN lost THEN 'center_not_in_margin' END, CASE WHEN lost AND NOT has_mask AND bbox_ratio < 0.35 THEN 'bbox_in_frame_ratio_below_threshold' END,
      CASE WHEN lost AND area_px < 800 THEN 'projected_area_below_threshold' END, CASE WHEN lost AND has_mask AND mask_px < 400 THEN 'zbuffer_mask_area_below_threshold' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT *, depth_m > 0.3 AND depth_m <= 8.0 AS deep, decision = 'rejected' AND depth_m > 0.3 AND depth_m <= 8.0 AS lost FROM vis)""",
)
def selector_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return V.visibility(S.reviews(spark, sf)).select("object_id", "decision", "reasons")


_SCORES = """sc AS (SELECT frame_id, n_visible, n_cropped, coalesce(n_pairs, 0) AS n_pairs, n_visible + 2 * coalesce(n_pairs, 0) AS score FROM
  (SELECT frame_id, count(*) AS n_visible, count(*) FILTER (bbox_ratio >= 0.7) AS n_cropped FROM vis WHERE decision <> 'rejected' GROUP BY frame_id) LEFT JOIN
  (SELECT p.frame_id, count(*) FILTER (p.bbox_ratio >= 0.5 AND c.bbox_ratio >= 0.5) AS n_pairs FROM vis p JOIN edges e ON e.scene_id = p.scene_id AND e.parent_id = p.scene_object_id JOIN vis c ON c.scene_id = e.scene_id AND c.scene_object_id = e.child_id AND c.frame_id = p.frame_id
   WHERE p.decision <> 'rejected' AND c.decision <> 'rejected' GROUP BY p.frame_id) USING (frame_id))"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    visible = V.visibility(S.reviews(spark, sf)).filter("passed")
    return V.frame_scores(visible, S.edges(spark, sf))


@query("frame_scores", O.views(O.REVIEWS, _VIS, O.EDGES, _SCORES) + " SELECT frame_id, n_visible, n_cropped, n_pairs, score FROM sc")
def frame_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("frame_id", "n_visible", "n_cropped", "n_pairs", "score")


@query(
    "frame_selection",
    O.views(O.REVIEWS, _VIS, O.EDGES, _SCORES)
    + """ SELECT g, frame_id, place FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN n_pairs > 0 AND a <= 3 THEN 0 ELSE 1 END, score DESC, n_cropped DESC, frame_id) AS place FROM
      (SELECT *, frame_id // 10 AS g, row_number() OVER (PARTITION BY frame_id // 10, n_pairs > 0 ORDER BY score DESC, n_cropped DESC, frame_id) AS a FROM sc)) WHERE place <= 5""",
)
def frame_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.select_frames(_scores(spark, sf).withColumn("g", F.expr("frame_id div 10")), "g")
    return rows.select("g", "frame_id", F.col("place").cast("long").alias("place"))


@query(
    "frame_stride",
    "SELECT g, page_id FROM (SELECT page_id // 25 AS g, page_id, count(*) OVER (PARTITION BY page_id // 25) AS n, row_number() OVER (PARTITION BY page_id // 25 ORDER BY page_id) - 1 AS i FROM pages) WHERE i % CASE WHEN n <= 10 THEN 1 WHEN n <= 30 THEN 2 ELSE 3 END = 0",
)
def frame_stride(spark: SparkSession, sf: str) -> DataFrame:
    return V.stride(S.read(spark, sf, "pages").selectExpr("page_id div 25 as g", "page_id"), "g", "page_id")


@query("frame_cover")
def frame_cover(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.visibility(S.reviews(spark, sf)).filter("passed")
    return V.covering_frames(rows.selectExpr("frame_id div 10 as scene_id", "frame_id", "bbox_ratio as clarity", "label as item"))


_METRICS = """rays AS (SELECT object_id, area_px, bbox_ratio AS in_frame_ratio, mask_px::BIGINT AS n_in_frame, (mask_px * 0.8)::BIGINT AS n_valid, object_id % 50 AS n_occluded,
  CASE WHEN object_id % 6 = 0 THEN 0 ELSE 40 END AS n_visible, 512 AS probe_n, 512 AS probe_valid, CASE WHEN object_id % 6 = 0 THEN 0 ELSE 3 END AS probe_visible FROM reviews)"""


@query(
    "occlusion_decision",
    O.views(O.REVIEWS, _METRICS.replace("(mask_px * 0.8)::BIGINT", "floor(mask_px * 0.8)::BIGINT"))
    + """ SELECT object_id, CASE WHEN area_px < 400 OR in_frame_ratio < 0.05 OR n_in_frame <= 0 THEN 'skip' WHEN probe_n >= 512 AND probe_valid >= probe_n AND probe_visible = 0 AND n_valid > 0 AND n_valid >= 64 AND n_valid >= 0.25 * n_in_frame AND n_visible = 0 THEN 'not visible'
      WHEN NOT (n_valid >= 64 AND n_valid >= 0.25 * n_in_frame) THEN 'skip' WHEN n_occluded / n_valid < 0.005 THEN 'not occluded' WHEN n_occluded / n_valid > 0.10 AND n_occluded >= 16 THEN 'occluded' ELSE 'grayzone' END AS decision FROM rays""",
)
def occlusion_decision(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.reviews(spark, sf).selectExpr(
        "object_id",
        "area_px",
        "bbox_ratio as in_frame_ratio",
        "cast(mask_px as long) as n_in_frame",
        "floor(mask_px * 0.8) as n_valid",
        "object_id % 50 as n_occluded",
        "case when object_id % 6 = 0 then 0 else 40 end as n_visible",
        "512 as probe_n",
        "512 as probe_valid",
        "case when object_id % 6 = 0 then 0 else 3 end as probe_visible",
    )
    return V.occlusion_decision(rows).select("object_id", "decision")


# kernels: no SQL form; tests compare them with hand-checked values


@query("surface_distances")
def surface_distances(spark: SparkSession, sf: str) -> DataFrame:
    return K.surface_distances(S.objects(spark, sf))


@query("ray_visibility")
def ray_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return K.visible_shares(S.objects(spark, sf), S.cameras(spark, sf))


@query(
    "footprint_overlaps",
    O.views(O.OBJECTS) + f" SELECT a.scene_id, a.id AS a_id, b.id AS b_id, round({_OVERLAP} * 1e6)::BIGINT AS overlap_mm2 {PAIR}",
)
def footprint_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Polygon clipping of rectangular footprints, so that SQL can check it."""
    corners = lambda p: F.array(*[F.array(F.col(f"{p}x{i}"), F.col(f"{p}y{j}")) for i in (0, 1) for j in (0, 1)])
    pair = R.pairs(S.objects(spark, sf)).select("scene_id", "a_id", "b_id", corners("a_").alias("a_hull"), corners("b_").alias("b_hull"))
    out = K.footprint_overlaps(pair)
    return out.select("scene_id", "a_id", "b_id", F.round(F.col("overlap_area") * 1e6).cast("long").alias("overlap_mm2"))


@query("box_suppression")
def box_suppression(spark: SparkSession, sf: str) -> DataFrame:
    boxes = S.objects(spark, sf).selectExpr("scene_id as frame_id", "substring(label, 1, 6) as label", "id", "(id * 37 % 100) / 100.0D as score", "x0", "y0", "x1", "y1")
    return K.suppress(boxes, 0.1).select("frame_id", "id")


@query(
    "label_duplicates",
    O.views(O.REVIEWS) + " SELECT frame_id, label, count(*) AS n FROM reviews GROUP BY ALL HAVING count(*) > 1",
)
def label_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return S.reviews(spark, sf).groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "opposite_directions",
    "SELECT d AS direction, o AS opposite FROM (VALUES "
    + ", ".join(f"('{r[i]}', '{r[(i + 4) % 8]}')" for r in (G.HORIZONTAL, G.CARDINAL) for i in range(8))
    + ", ('above', 'below'), ('below', 'above')) t(d, o)",
)
def opposite_directions(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.sql("SELECT explode(array(" + ", ".join(f"'{d}'" for d in [*G.HORIZONTAL, *G.CARDINAL, "above", "below"]) + ")) AS direction")
    return names.select("direction", X.opposite(F.col("direction")).alias("opposite"))


@query(
    "label_slugs",
    "SELECT p_name, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, count(*) AS n FROM part GROUP BY ALL",
)
def label_slugs(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.read(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("p_name", X.slug(F.col("p_name")).alias("slug"), "n")


@query(
    "resume_remaining",
    O.views(O.QUESTIONS, O.PREDICTIONS) + " SELECT question_id FROM questions q WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.question_id = q.question_id)",
)
def resume_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return files.remaining(S.questions(spark, sf), S.predictions(spark, sf), ["question_id"]).select("question_id")


@query(
    "scene_parsing",
    """WITH v AS (SELECT l_orderkey // 100 AS scene_id, l_orderkey AS segment, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem),
    s AS (SELECT o_orderkey // 100 AS scene_id, o_orderkey AS segment, o_orderkey % 5 AS id, 'label_' || (o_orderkey % 5) AS label FROM orders),
    o AS (SELECT v.scene_id, id, label, count(*) AS n_vertices, min(x) AS x0, max(x) AS x1 FROM v JOIN s ON v.segment = s.segment WHERE label NOT IN ('label_0') GROUP BY ALL)
    SELECT scene_id, id, label, n_vertices, x0, x1, (x0 + x1) / 2 AS cx FROM o WHERE scene_id IN (SELECT scene_id FROM o GROUP BY scene_id HAVING count(*) >= 3)""",
)
def scene_parsing(spark: SparkSession, sf: str) -> DataFrame:
    vertices = S.read(spark, sf, "lineitem").selectExpr("l_orderkey div 100 as scene_id", "l_orderkey as segment", "l_quantity as x", "l_discount as y", "l_tax as z")
    segments = S.read(spark, sf, "orders").selectExpr("o_orderkey div 100 as scene_id", "o_orderkey as segment", "o_orderkey % 5 as id", "concat('label_', o_orderkey % 5) as label")
    return files.parse_scene(vertices, segments, ["label_0"]).select("scene_id", "id", "label", "n_vertices", "x0", "x1", "cx")


from . import scene_queries  # noqa: E402, F401  registers its queries
