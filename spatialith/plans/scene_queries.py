"""Queries on labels, attachment measures, visibility decisions and the gates after generation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as L
from ..operators import attachment as T
from ..operators import counterfactual as C
from ..operators import frames as V
from ..operators import graph as A
from ..operators import occlusion as N
from ..operators import quality as Q
from ..operators import referability as M
from ..operators import relations as R
from ..sources import adapters as S
from . import oracle_views as O
from .queries import _LEGAL, _MOVED, _WALK, EGO, RING, _ambiguity, _bin, _cut, _direction, _distance, _gap, _near, _OVERLAP, _recursive, _sql_list, cut, query

# labels

_RAW = ["Couch", " nightstand", "TV", "office chair", "books", "File Cabinets", "backpack", "potted plant", "bin", "radiator", "drawer", "door", "widget", "", "kitchen cabinet", "hamper"]
#: A class map as its file would give it: some names, their classes, spelled with other case and space.
_CLASSES = [("couch", "sofa"), ("Books ", "book"), ("backpack", "otherprop"), ("bin", "OtherProp"), ("radiator", "otherfurniture"), ("widget", "otherprop"), ("door", "door"), ("nightstand", "night stand"), ("potted plant", "otherprop"), ("office chair", "chair"), ("file cabinets", "cabinet"), ("drawer", "otherstructure")]
_PAIRS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in (L.SINGULAR | L.PLURAL).items()) + ")"
_MAP = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _CLASSES) + ")"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, _RAW)), F.expr(f"cast(o_orderkey % {len(_RAW)} as int)"))
    return S.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("label"))


@query(
    "normalized_labels",
    f"""WITH o AS (SELECT o_orderkey AS id, {_sql_list(_RAW)}[o_orderkey % {len(_RAW)} + 1] AS label FROM orders), names(a, b) AS (SELECT * FROM {_PAIRS} t(a, b)),
    map(raw, class) AS (SELECT lower(trim(r)), lower(trim(c)) FROM {_MAP} t(r, c)),
    x AS (SELECT o.id, lower(trim(o.label)) AS low, coalesce(n.b, lower(trim(o.label))) AS own, m.class FROM o LEFT JOIN names n ON n.a = lower(trim(o.label)) LEFT JOIN map m ON m.raw = lower(trim(o.label))),
    k AS (SELECT id, CASE WHEN class IS NULL OR list_contains(list_concat({_sql_list(L.KEPT_PLURALS)}, CASE class WHEN 'otherprop' THEN {_sql_list(L.KEPT_PROPS)} WHEN 'otherfurniture' THEN {_sql_list(L.KEPT_FURNITURE)} ELSE [] END), low)
      OR list_contains(list_concat({_sql_list(L.KEPT_PLURALS)}, CASE class WHEN 'otherprop' THEN {_sql_list(L.KEPT_PROPS)} WHEN 'otherfurniture' THEN {_sql_list(L.KEPT_FURNITURE)} ELSE [] END), own) THEN own ELSE class END AS name FROM x)
    SELECT id, coalesce(n.b, name) AS normal FROM k LEFT JOIN names n ON n.a = name""",
)
def normalized_labels(spark: SparkSession, sf: str) -> DataFrame:
    classes = spark.createDataFrame(_CLASSES, "raw string, class string")
    return L.normalized(_labels(spark, sf), classes).select("id", "normal")


@query(
    "kept_labels",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey AS id, lower(trim({_sql_list(_RAW)}[o_orderkey % {len(_RAW)} + 1])) AS low FROM orders),
    map(raw, class) AS (SELECT lower(trim(r)), lower(trim(c)) FROM {_MAP} t(r, c)), names(a, b) AS (SELECT * FROM {_PAIRS} t(a, b)),
    gone(label) AS (SELECT unnest({_sql_list(L.EXCLUDED)}) UNION (
      SELECT unnest([coalesce(n.b, g.label), CASE WHEN NOT list_contains({_sql_list(L.KEPT_PLURALS)}, g.label) AND NOT list_contains({_sql_list(L.KEPT_PLURALS)}, coalesce(n.b, g.label)) THEN coalesce(m.class, g.label) ELSE g.label END])
      FROM gone g LEFT JOIN names n ON n.a = g.label LEFT JOIN map m ON m.raw = g.label))
    SELECT id, low FROM o WHERE low NOT IN (SELECT label FROM gone)""",
)
def kept_labels(spark: SparkSession, sf: str) -> DataFrame:
    classes = {a.strip().lower(): b.strip().lower() for a, b in _CLASSES}
    rows = _labels(spark, sf).select("id", F.lower(F.trim("label")).alias("low"))
    return rows.filter(~F.col("low").isin(L.excluded_labels(classes)))


@query("floor_objects", O.views(O.OBJECTS, O.FURNISHED) + " SELECT scene_id, id FROM furnished WHERE z0 < 0.10")
def floor_objects(spark: SparkSession, sf: str) -> DataFrame:
    return S.furnished(spark, sf).filter(L.on_floor(F.col("z0"))).select("scene_id", "id")


# attachment

_AREA = "((a.x1 - a.x0) * (a.y1 - a.y0))"
_TOL = "least(least(greatest(0.02 + 0.05 * (b.z1 - b.z0), 0.03), 0.10), greatest(0.30 * (a.z1 - a.z0), 0.03))"
_ORDERED = "FROM furnished a JOIN furnished b ON a.scene_id = b.scene_id AND a.id <> b.id"
_COMMON = " * ".join(f"greatest(least(c.{k}1, t.{k}1) - greatest(c.{k}0, t.{k}0), 0)" for k in "xy")


def _contact(name: str, scale: float, hull: float, fallback: float) -> str:
    cover = "CASE WHEN ca > 1e-8 AND ta > 1e-8 THEN common / ca ELSE aabb END"
    strong = f"(aabb >= {max(0.60, fallback)} AND (CASE WHEN ca > 1e-8 AND ta > 1e-8 THEN common / ca >= {max(0.50, hull)} ELSE true END))"
    return f"""{name} AS (SELECT * FROM (SELECT *, {cover} AS coverage, CASE WHEN ca > 1e-8 AND ta > 1e-8 THEN common ELSE overlap END AS shared FROM (
      SELECT a.scene_id, a.id AS a_id, b.id AS b_id, c.z - t.z AS signed, t.z AS contact_z, {_COMMON} AS common, (c.x1 - c.x0) * (c.y1 - c.y0) AS ca, (t.x1 - t.x0) * (t.y1 - t.y0) AS ta, c.score AS cs, t.score AS ts,
        {_OVERLAP} AS overlap, {_OVERLAP} / {_AREA} AS aabb, {_TOL} * {scale} AS tol
      {_ORDERED} JOIN bottoms c ON c.scene_id = a.scene_id AND c.id = a.id JOIN tops t ON t.scene_id = b.scene_id AND t.id = b.id WHERE {_AREA} > 1e-8 AND {_OVERLAP} > 1e-8 AND {_OVERLAP} / {_AREA} >= 0.12))
    WHERE signed <= tol AND -signed <= least(0.05, least(0.02, 0.5 * tol) + 0.03) AND coverage >= CASE WHEN ca > 1e-8 AND ta > 1e-8 THEN {hull} ELSE {fallback} END AND (signed >= -least(0.02, 0.5 * tol) OR {strong})
    QUALIFY row_number() OVER (PARTITION BY scene_id, a_id, b_id ORDER BY coverage DESC, abs(signed), shared DESC, cs DESC, ts DESC, ca DESC, ta DESC, signed DESC) = 1)"""


_TOUCH = _contact("touch", 1.0, T.HULL_LEAST, T.FALLBACK_LEAST)
_SOFT = _contact("soft", T.SOFT_SCALE, T.SOFT_HULL_LEAST, T.SOFT_FALLBACK_LEAST)


@query("surface_contacts", O.views(O.OBJECTS, O.FURNISHED, _TOUCH) + f" SELECT scene_id, a_id, b_id, {_cut('coverage')} AS coverage, {_cut('signed * 10')} AS signed_cm, contact_z FROM touch")
def surface_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """The best pair of surfaces of every ordered pair of objects that touch."""
    rows = T.measured(S.furnished(spark, sf)).filter("_contact is not null").select("scene_id", "a_id", "b_id", "_contact.*")
    return rows.select("scene_id", "a_id", "b_id", cut(F.col("coverage")).alias("coverage"), cut(F.col("signed_gap") * 10).alias("signed_cm"), "contact_z")


def _prior(pairs: list[str], other: str) -> str:
    return f"CASE WHEN a.label || '|' || b.label IN ({', '.join(repr(p) for p in pairs)}) THEN 1.0 {other} ELSE 0.0 END"


def _in(x: str, names: list[str]) -> str:
    return f"{x} IN ({', '.join(repr(n) for n in names)})"


_CONTAINER = _in("b.label", T.CONTAINERS)
_EDGES = f"""priors AS (SELECT a.scene_id, a.id AS a_id, b.id AS b_id, {_prior(T.CONTAINED_PAIRS, f"WHEN {_CONTAINER} THEN 0.7")} AS kept_in, {_prior(T.AFFIXED_PAIRS, f"WHEN {_in('a.label', T.SCREENS)} AND {_in('b.label', T.SCREEN_STANDS)} THEN 0.8")} AS fixed,
    {_prior(T.SOFT_PAIRS, f"WHEN {_in('b.label', T.SOFT_PARENTS)} AND {_in('a.label', T.SOFT_CHILDREN)} THEN 0.75")} AS soft, {_prior(T.RIGID_PAIRS, "")} AS rigid,
    {_OVERLAP} / greatest({_AREA}, 1e-8) AS cover, {_OVERLAP} / {_AREA} AS aabb, {_TOL} AS tol, sqrt({' + '.join(f"greatest({_gap(k)}, 0.0) * greatest({_gap(k)}, 0.0)" for k in 'xyz')}) AS far, least({', '.join(f"greatest({_gap(k)}, 0.0)" for k in 'xyz')}) AS near,
    a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AND a.cx BETWEEN b.x0 AND b.x1 AND a.cy BETWEEN b.y0 AND b.y1 AS whole, a.cx BETWEEN b.x0 AND b.x1 AND a.cy BETWEEN b.y0 AND b.y1 AS centred,
    {_AREA} AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba, 0.05 + 0.05 * (b.z1 - b.z0) AS slack, a.z0 AS az0, a.z1 AS az1, b.z0 AS bz0, b.z1 AS bz1, {_CONTAINER} OR {_in('b.label', T.SOFT_PARENTS)} AS closed {_ORDERED}),
  inside AS (SELECT *, greatest(least(az1, bz1 + slack) - greatest(az0, bz0 - slack), 0.0) / greatest(az1 - az0, 1e-8) AS ratio, least(greatest((ba - aa) / greatest(ba, 1e-8), 0.0), 1.0) AS size FROM priors),
  scored AS (SELECT p.*, least(greatest(0.55 * cover + 0.15 + 0.15 * least(ratio, 1.0) + 0.15 * size, 0.0), 1.0) AS score, aa > 1e-8 AND ba > aa * 1.05 AND cover >= 1 - 1e-6 AND whole AND az0 >= bz0 - slack AND ratio >= 0.60 AS held,
    fixed > 0 AND far <= 0.12 AND (near <= 0.06 OR cover >= 0.20) AS stuck, s.coverage AS scov, s.signed AS sgap, s.contact_z AS sz, t.coverage AS tcov, t.signed AS tgap, t.contact_z AS tz,
    NOT closed AND kept_in <= 0 AND aa > 1e-8 AND cover >= 0.85 AND centred AND az0 - bz0 >= 0.50 AND az0 - bz1 <= 0.05 AND greatest(bz1 - az0, 0.0) <= least(0.20, p.tol) AS enclosed, least(0.20, p.tol) AS upper
    FROM inside p LEFT JOIN soft s USING (scene_id, a_id, b_id) LEFT JOIN touch t USING (scene_id, a_id, b_id)),
  confident AS (SELECT *, CASE WHEN held THEN least(0.80 * score + 0.20 * kept_in, 1.0) END AS c1, CASE WHEN stuck THEN least(0.55 * fixed + 0.30 * least(greatest(1.0 - far / 0.12, 0.0), 1.0) + 0.15 * cover, 1.0) END AS c2,
    CASE WHEN soft > 0 AND scov IS NOT NULL THEN least(0.45 * scov + 0.25 * least(greatest(1.0 - abs(sgap) / greatest(tol * 1.75, 1e-8), 0.0), 1.0) + 0.30 * soft, 1.0) END AS c3,
    CASE WHEN tcov IS NOT NULL THEN least(0.55 * tcov + 0.20 * least(greatest(1.0 - abs(tgap) / greatest(tol, 1e-8), 0.0), 1.0) + 0.15 * aabb + 0.10 * rigid, 1.0)
      WHEN enclosed THEN least(0.50 * cover + 0.30 * least(greatest(1.0 - abs(az0 - bz1) / greatest(CASE WHEN az0 - bz1 < 0 THEN upper ELSE 0.05 END, 1e-8), 0.0), 1.0) + 0.10 + 0.10 * rigid, 0.74) END AS c4 FROM scored),
  found AS (SELECT scene_id, b_id AS parent_id, a_id AS child_id, CASE WHEN c1 >= 0.55 THEN 'contained_in' WHEN c2 >= 0 THEN 'affixed_to' WHEN c3 >= 0.60 THEN 'resting_on_soft_surface' WHEN c4 >= 0.45 THEN 'supported_by' END AS type,
    CASE WHEN c1 >= 0.55 THEN c1 WHEN c2 >= 0 THEN c2 WHEN c3 >= 0.60 THEN c3 ELSE c4 END AS confidence, CASE WHEN c1 >= 0.55 OR c2 >= 0 THEN cover WHEN c3 >= 0.60 THEN scov ELSE coalesce(tcov, cover) END AS coverage,
    CASE WHEN c1 >= 0.55 OR c2 >= 0 THEN far WHEN c3 >= 0.60 THEN abs(sgap) ELSE coalesce(abs(tgap), abs(az0 - bz1)) END AS gap, CASE WHEN c1 >= 0.55 THEN score ELSE 0.0 END AS containment,
    CASE WHEN c1 >= 0.55 THEN bz0 WHEN c2 >= 0 THEN bz1 WHEN c3 >= 0.60 THEN sz ELSE coalesce(tz, bz1) END AS contact_z FROM confident)"""


@query(
    "attachment_candidates",
    O.views(O.OBJECTS, O.FURNISHED, _TOUCH, _SOFT, _EDGES)
    + f" SELECT scene_id, parent_id, child_id, type, {_cut('confidence')} AS confidence, {_cut('coverage')} AS coverage, {_cut('gap')} AS gap, {_cut('containment')} AS containment, {_cut('contact_z')} AS contact_z FROM found WHERE type IS NOT NULL",
)
def attachment_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate edges of all four types, measured on the furnished scenes."""
    rows = T.candidates(S.furnished(spark, sf))
    return rows.select("scene_id", "parent_id", "child_id", "type", *[cut(F.col(c)).alias(c) for c in ("confidence", "coverage", "gap", "containment", "contact_z")])


@query(
    "attachment_edges",
    O.views(O.OBJECTS, O.FURNISHED, _TOUCH, _SOFT, _EDGES)
    + """ SELECT scene_id, child_id, parent_id, type FROM found WHERE type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scene_id, child_id ORDER BY confidence DESC,
      CASE type WHEN 'supported_by' THEN 1 WHEN 'resting_on_soft_surface' THEN 2 WHEN 'affixed_to' THEN 3 ELSE 4 END DESC, containment DESC, coverage DESC, gap, parent_id) = 1""",
)
def attachment_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every object's best parent, from measured candidates."""
    return A.best_parent(T.candidates(S.furnished(spark, sf))).select("scene_id", "child_id", "parent_id", "type")


# visibility

_COUNTS = """counts AS (SELECT object_id, label, frame_id, CASE WHEN object_id % 11 = 0 THEN 0 ELSE area_px END AS area_px, mask_px::BIGINT AS n_in_frame, bbox_ratio AS in_frame_ratio, floor(mask_px * 0.8)::BIGINT AS n_valid,
  floor(mask_px * 0.8) >= 64 AS sufficient, ['skip', 'not visible', 'not occluded', 'occluded', 'grayzone', 'other'][object_id % 6 + 1] AS decision FROM reviews)"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.reviews(spark, sf).selectExpr(
        "object_id",
        "label",
        "frame_id",
        "if(object_id % 11 = 0, 0D, area_px) as area_px",
        "cast(mask_px as long) as n_in_frame",
        "bbox_ratio as in_frame_ratio",
        "cast(floor(mask_px * 0.8) as long) as n_valid",
        "floor(mask_px * 0.8) >= 64 as sufficient",
        "element_at(array('skip', 'not visible', 'not occluded', 'occluded', 'grayzone', 'other'), cast(object_id % 6 as int) + 1) as decision",
    )


_REASONED = """reasoned AS (SELECT *, CASE WHEN area_px <= 0 OR n_in_frame <= 0 OR in_frame_ratio <= 0 THEN 'not_visible_out_of_frame' WHEN area_px < 400 THEN 'projected_area_too_small' WHEN in_frame_ratio < 0.05 THEN 'in_frame_ratio_too_small'
  WHEN n_valid <= 0 THEN 'no_valid_visibility_samples' WHEN NOT sufficient THEN 'insufficient_visibility_evidence' WHEN decision = 'grayzone' THEN 'grayzone_visibility'
  WHEN decision IN ('not visible', 'not occluded', 'occluded') THEN 'resolved_visibility' ELSE 'unresolved_visibility_decision' END AS reason FROM counts)"""


@query(
    "counterfactual_visibility",
    O.views(O.REVIEWS, _COUNTS, _REASONED) + " SELECT object_id, reason, CASE reason WHEN 'not_visible_out_of_frame' THEN 'not visible' WHEN 'resolved_visibility' THEN decision END AS status FROM reasoned",
)
def counterfactual_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return N.counterfactual_status(_counts(spark, sf)).select("object_id", "reason", "status")


@query(
    "static_visibility",
    O.views(O.REVIEWS, _COUNTS)
    + """ SELECT object_id, CASE WHEN gone THEN 'not visible' WHEN decision NOT IN ('skip', 'grayzone') THEN decision END AS status, CASE WHEN NOT gone AND decision = 'grayzone' THEN 'grayzone_fallback' ELSE 'rays' END AS source
    FROM (SELECT *, area_px <= 0 OR n_in_frame <= 0 OR in_frame_ratio <= 0 AS gone FROM counts)""",
)
def static_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return N.static_status(_counts(spark, sf)).select("object_id", "status", "source")


@query(
    "l1_occlusion",
    O.views(O.REVIEWS, _COUNTS)
    + """, asked AS (SELECT *, CASE WHEN area_px <= 0 OR n_in_frame <= 0 OR in_frame_ratio <= 0 THEN 'not visible' WHEN decision NOT IN ('skip', 'grayzone') THEN decision END AS status, count(*) OVER (PARTITION BY frame_id, label) AS n FROM counts)
    SELECT frame_id, label, object_id, status AS correct_value, 'What is the visibility of the ' || label || ' from the current viewpoint?' AS question FROM asked WHERE n = 1 AND status IN ('not visible', 'not occluded', 'occluded')""",
)
def l1_occlusion(spark: SparkSession, sf: str) -> DataFrame:
    """First-level questions on visibility: labels with one object in the frame and a trusted state."""
    rows = N.static_status(_counts(spark, sf))
    alone = rows.groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("frame_id", "label")
    rows = rows.join(alone, ["frame_id", "label"], "left_semi").filter(F.col("status").isin(N.STATES))
    text = F.concat(F.lit("What is the visibility of the "), "label", F.lit(" from the current viewpoint?"))
    return rows.select("frame_id", "label", "object_id", F.col("status").alias("correct_value"), text.alias("question"))


@query(
    "occlusion_transitions",
    O.views(O.REVIEWS, _COUNTS, _REASONED)
    + """ SELECT object_id, old, new, old IN ('not occluded', 'occluded') AND new IS NOT NULL AND old <> new AS changed FROM (SELECT object_id, ['not occluded', 'occluded', 'not visible', 'none'][object_id % 4 + 1] AS old,
      CASE reason WHEN 'not_visible_out_of_frame' THEN 'not visible' WHEN 'resolved_visibility' THEN decision END AS new FROM reasoned)""",
)
def occlusion_transitions(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.counterfactual_status(_counts(spark, sf))
    old = F.expr("element_at(array('not occluded', 'occluded', 'not visible', 'none'), cast(object_id % 4 as int) + 1)")
    return rows.select("object_id", old.alias("old"), F.col("status").alias("new")).withColumn("changed", N.transition(F.col("old"), F.col("new")))


@query(
    "ray_evidence",
    """WITH r AS (SELECT l_orderkey AS object_id, l_linenumber <> 7 AS in_frame, l_suppkey % 5 <> 0 AS valid, l_partkey % 3 = 0 AS visible FROM lineitem),
    c AS (SELECT object_id, count(*) AS n_sampled, count(*) FILTER (in_frame) AS n_in_frame, count(*) FILTER (in_frame AND valid) AS n_valid, count(*) FILTER (in_frame AND valid AND visible) AS n_visible FROM r GROUP BY object_id)
    SELECT *, n_valid - n_visible AS n_occluded, n_in_frame / n_sampled AS in_frame_ratio, coalesce(n_valid / nullif(n_in_frame, 0), 0.0) AS effective_ratio, n_valid >= 64 AND coalesce(n_valid / nullif(n_in_frame, 0), 0.0) >= 0.25 AS sufficient FROM c""",
)
def ray_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rays = S.read(spark, sf, "lineitem").selectExpr("l_orderkey as object_id", "l_linenumber <> 7 as in_frame", "l_suppkey % 5 <> 0 as valid", "l_partkey % 3 = 0 as visible")
    return N.evidence(rays, ["object_id"])


@query(
    "occlusion_veto",
    O.views(O.REVIEWS) + """ SELECT object_id, CASE WHEN v = 0 THEN 'skipped' WHEN s <= 0 THEN 'not_visible' WHEN s / v < 0.35 THEN 'low_visible' ELSE 'kept' END AS veto FROM (SELECT object_id, object_id % 23 AS v, least(object_id % 7, object_id % 23) AS s FROM reviews)""",
)
def occlusion_veto(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.reviews(spark, sf).selectExpr("object_id", "object_id % 23 as n_valid", "least(object_id % 7, object_id % 23) as n_visible")
    return N.veto(rows).select("object_id", "veto")


@query(
    "absent_targets",
    O.views(O.QUESTIONS)
    + """ SELECT question_id, type = 'occlusion' AND correct_value = 'not visible' AND question_id % 2 = 0 AND question_id % 5 <> 0 AND ((scene_id % 3 = 0 AND question_id % 7 <> 0) OR question_id % 11 = 0) AS exempt FROM questions""",
)
def absent_targets(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.questions(spark, sf).selectExpr(
        "question_id",
        "upper(type) as type",
        "concat(' ', correct_value) as correct_value",
        "if(question_id % 2 = 0, 'target', 'obj_a') as role",
        "if(question_id % 5 = 0, question_id, null) as obj_id",
        "if(scene_id % 3 = 0, 'Absent', 'unique') as label_status",
        "if(question_id % 7 = 0, 1, 0) as n_label_ids",
        "if(question_id % 11 = 0, 'vlm_out_of_frame_label_review', null) as decision_source",
    )
    return N.absent_target(rows).select("question_id", "exempt")


# gates, orders, summaries


@query(
    "question_gates",
    O.views(O.QUESTIONS)
    + """ SELECT question_id, CASE WHEN (a_id % 4 = 3 OR b_id % 4 = 3) AND NOT (type = 'occlusion' AND correct_value = 'not visible') THEN 'in_frame_mentions' WHEN question_id % 9 = 0 THEN 'referable_mentions'
      WHEN question_id % 3 = 0 AND NOT (h >= 0.3 AND h >= 0.5 * t) THEN 'stable_facing' END AS removed_by FROM (SELECT *, sqrt((a_id / 10) * (a_id / 10) + (b_id / 10) * (b_id / 10)) AS h, sqrt((a_id / 10) * (a_id / 10) + (b_id / 10) * (b_id / 10) + (scene_id / 20) * (scene_id / 20)) AS t FROM questions)""",
)
def question_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Objects 3 and 7 are out of every frame; every ninth question fails its audit; every third has a facing."""
    rows = S.questions(spark, sf)
    faced = rows.selectExpr("question_id", "type", "correct_value", *[f"if(question_id % 3 = 0, {x}, null) as {k}" for k, x in (("dx", "a_id / 10"), ("dy", "b_id / 10"), ("dz", "scene_id / 20"))])
    mentions = rows.selectExpr("question_id", "image_name as frame_id", "explode(array(a_id, b_id)) as obj_id")
    visible = mentions.filter("obj_id % 4 <> 3").select("frame_id", "obj_id").distinct()
    audits = rows.selectExpr("question_id", "if(question_id % 9 = 0, 'drop', 'pass') as decision")
    return M.gates(faced, mentions, visible, audits).select("question_id", "removed_by")


@query("restricted_edges", O.views(O.OBJECTS, O.EDGES) + " SELECT scene_id, parent_id, child_id FROM edges e WHERE (e.scene_id, e.parent_id) IN (SELECT (scene_id, id) FROM objects WHERE cz < 1) AND (e.scene_id, e.child_id) IN (SELECT (scene_id, id) FROM objects WHERE cz < 1)")
def restricted_edges(spark: SparkSession, sf: str) -> DataFrame:
    return M.restricted(S.edges(spark, sf), S.objects(spark, sf).filter("cz < 1")).select("scene_id", "parent_id", "child_id")


@query(
    "text_matched_accuracy",
    O.views(O.QUESTIONS)
    + """, p AS (SELECT o_custkey % 50 AS scene_id, 'question ' || (o_orderkey % 997) AS question, arg_max(row(substr('ABCD', (o_orderkey % 4 + 1)::INT, 1)), o_orderkey) AS p FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
    SELECT q.question_id, coalesce(p.p[1] = q.answer, false) AS correct FROM questions q JOIN p USING (scene_id, question)""",
)
def text_matched_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions without question numbers, made from every third order, meet questions by scene and wording."""
    answers = S.read(spark, sf, "orders").filter("o_orderkey % 3 = 0")
    answers = answers.selectExpr("o_custkey % 50 as scene_id", "concat('question ', o_orderkey % 997) as question", "o_orderkey as ord", "substring('ABCD', cast(o_orderkey % 4 as int) + 1, 1) as prediction")
    return Q.matched_by_text(S.questions(spark, sf), answers).select("question_id", "correct")


@query(
    "viewer_order",
    O.views(O.QUESTIONS) + f" SELECT question_id, (coalesce(list_position({_sql_list(Q.VIEWER_ORDER)}, type), {len(Q.VIEWER_ORDER) + 1}) - 1)::BIGINT AS type_rank, md5('42|' || question_id) AS shuffle FROM questions",
)
def viewer_order(spark: SparkSession, sf: str) -> DataFrame:
    return Q.viewer_order(S.questions(spark, sf)).select("question_id", "type_rank", "shuffle")


@query(
    "viewer_summary",
    O.views(O.QUESTIONS) + f" SELECT type, count(*) AS n, count(*) FILTER ({_in('type', Q.MOVES)} AND attached) AS attached, count(*) FILTER ({_in('type', Q.MOVES)} AND NOT attached) AS unattached FROM questions GROUP BY type",
)
def viewer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.viewer_summary(S.questions(spark, sf))


_IMAGES = "page_id, page_id % 3 <> 0 AS stage1_pass, CASE WHEN page_id % 3 <> 0 THEN page_id % 50 / 1.0 END AS score, page_id % 3 <> 0 AND page_id % 50 < 30 AS final_pass"


@query(
    "image_summary",
    f"""WITH r AS (SELECT {_IMAGES} FROM pages) SELECT count(*) AS total_images, count(*) FILTER (stage1_pass) AS stage1_pass, count(*) FILTER (NOT stage1_pass) AS stage1_reject, count(score) AS stage2_scored,
    count(*) FILTER (final_pass) AS final_selected, count(*) FILTER (NOT final_pass) AS final_reject FROM r""",
)
def image_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.read(spark, sf, "pages").selectExpr(*[x.strip() for x in _IMAGES.split(", ")])
    return Q.image_summary(rows)


@query("image_slice", "SELECT page_id FROM pages ORDER BY page_id LIMIT 20 OFFSET 7")
def image_slice(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the listing: the limit is the feature."""
    return Q.slice_in_order(S.read(spark, sf, "pages").select("page_id"), ["page_id"], 7, 20)


@query("frames_every_third", "SELECT g, page_id FROM (SELECT page_id // 25 AS g, page_id, row_number() OVER (PARTITION BY page_id // 25 ORDER BY page_id) - 1 AS i FROM pages) WHERE i % 3 = 0")
def frames_every_third(spark: SparkSession, sf: str) -> DataFrame:
    return V.every_nth(S.read(spark, sf, "pages").selectExpr("page_id div 25 as g", "page_id"), "g", "page_id")


@query(
    "reranked_frames",
    "SELECT g, image_name, place FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY clarity DESC, image_name) AS place FROM (SELECT page_id // 25 AS g, 'frame_' || page_id AS image_name, coalesce(CASE WHEN page_id % 6 <> 0 THEN page_id * 7 % 5 END, 0) AS clarity FROM pages)) WHERE place <= 4",
)
def reranked_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.read(spark, sf, "pages").selectExpr("page_id div 25 as g", "concat('frame_', page_id) as image_name", "if(page_id % 6 <> 0, page_id * 7 % 5, null) as clarity")
    return V.rerank(rows, "g", 4).select("g", "image_name", F.col("place").cast("long").alias("place"))


@query(
    "skip_reasons",
    O.views(O.QUESTIONS) + " SELECT type AS generator, coalesce(CASE WHEN ambiguity > 0.7 THEN 'ambiguous' WHEN unchanged THEN 'unchanged' END, 'unknown') AS reason, count(*) AS n FROM questions GROUP BY ALL",
)
def skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return Q.reason_counts(S.questions(spark, sf).selectExpr("type as generator", "case when ambiguity > 0.7 then 'ambiguous' when unchanged then 'unchanged' end as reason"))


@query(
    "review_rollup",
    O.views(O.REVIEWS) + " SELECT label AS review_type, count(*) AS reviewed, count(*) FILTER (status = 'clear') AS passed, count(*) - count(*) FILTER (status = 'clear') AS flagged, (count(*) FILTER (area_px < 400) + count(*) FILTER (bbox_ratio < 0.2))::BIGINT AS issues FROM reviews GROUP BY label",
)
def review_rollup(spark: SparkSession, sf: str) -> DataFrame:
    issues = F.array_compact(F.array(F.when(F.col("area_px") < 400, "small"), F.when(F.col("bbox_ratio") < 0.2, "cut")))
    verdict = F.when(F.col("status") == "clear", "pass").when(F.col("status").isNotNull(), "fail")
    return Q.review_rollup(S.reviews(spark, sf).select(F.col("label").alias("review_type"), verdict.alias("verdict"), issues.alias("issues")))


@query("concat_scenes", O.views(O.QUESTIONS) + " SELECT question_id, answer, CASE WHEN scene_id % 2 = 0 THEN ambiguity END AS ambiguity FROM questions")
def concat_scenes(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.questions(spark, sf)
    even, odd = rows.filter("scene_id % 2 = 0"), rows.filter("scene_id % 2 = 1")
    return Q.concat_scenes(even.select("question_id", "answer", "ambiguity"), odd.select("answer", "question_id"))


@query(
    "merged_changes",
    O.views(O.OBJECTS)
    + """, p AS (SELECT a.scene_id, a.id AS a_id, b.id AS b_id FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.id < b.id), one AS (SELECT *, 'distance' AS f, 'near' AS v FROM p WHERE a_id % 2 = 0 UNION ALL SELECT *, 'direction', 'north' FROM p WHERE a_id % 2 = 0),
    two AS (SELECT *, 'direction' AS f, 'south' AS v FROM p WHERE b_id % 3 = 0), every AS (SELECT * FROM two UNION ALL SELECT * FROM one ANTI JOIN two USING (scene_id, a_id, b_id, f))
    SELECT scene_id, a_id, b_id, string_agg(f || '=' || v, ',' ORDER BY f) AS changes FROM every GROUP BY ALL""",
)
def merged_changes(spark: SparkSession, sf: str) -> DataFrame:
    pair = R.pairs(S.objects(spark, sf)).select("scene_id", "a_id", "b_id")
    one = pair.filter("a_id % 2 = 0").withColumn("changes", F.expr("map('distance', 'near', 'direction', 'north')"))
    two = pair.filter("b_id % 3 = 0").withColumn("changes", F.expr("map('direction', 'south')"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("changes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return R.merged_changes(one, two, ["scene_id", "a_id", "b_id"]).select("scene_id", "a_id", "b_id", text.alias("changes"))


@query(
    "chains_meet",
    O.views(O.EDGES) + " SELECT DISTINCT a.scene_id, a.parent_id AS a, b.parent_id AS b FROM edges a JOIN edges b ON a.scene_id = b.scene_id AND a.child_id = b.parent_id AND a.parent_id <> b.parent_id",
)
def chains_meet(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of parents where one's children include the other: id sets that meet."""
    sets = S.edges(spark, sf).groupBy("scene_id").agg(F.collect_list(F.struct("parent_id", "child_id")).alias("e"))
    kids = S.edges(spark, sf).select("scene_id", F.col("parent_id").alias("b")).distinct()
    rows = sets.select("scene_id", F.explode("e").alias("e")).groupBy("scene_id", F.col("e.parent_id").alias("a")).agg(F.collect_set("e.child_id").alias("ids"))
    return rows.join(kids, "scene_id").filter((F.col("a") != F.col("b")) & F.arrays_overlap("ids", F.array("b"))).select("scene_id", "a", "b")


@query("camera_headings", O.views(O.CAMERAS) + f" SELECT scene_id, frame_id, {_direction('fy', 'fx', RING)} AS heading FROM cameras")
def camera_headings(spark: SparkSession, sf: str) -> DataFrame:
    return S.cameras(spark, sf).select("scene_id", "frame_id", G.camera_heading(F.col("fx"), F.col("fy")).alias("heading"))


@query(
    "surface_sample_counts",
    O.views(O.OBJECTS)
    + """, s AS (SELECT scene_id, id, 2 * ((x1 - x0) * (y1 - y0) + (x1 - x0) * (z1 - z0) + (y1 - y0) * (z1 - z0)) AS area FROM objects)
    SELECT scene_id, id, greatest(512, ceil(512 * sqrt(greatest(area / min(area) OVER (PARTITION BY scene_id), 1.0))))::BIGINT AS n FROM s""",
)
def surface_sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    area = F.expr("2 * ((x1 - x0) * (y1 - y0) + (x1 - x0) * (z1 - z0) + (y1 - y0) * (z1 - z0))")
    rows = S.objects(spark, sf).select("scene_id", "id", area.alias("area"))
    least = rows.groupBy("scene_id").agg(F.min(F.when(F.col("area") > 1e-10, F.col("area"))).alias("least"))
    return rows.join(least, "scene_id").select("scene_id", "id", G.sample_count(F.when(F.col("area") > 1e-10, F.col("area")), F.col("least"), 512).alias("n"))


# generators after a move

_STILL = "NOT EXISTS (SELECT 1 FROM moved c WHERE c.scene_id = {t}.scene_id AND c.target = {t}.target AND c.id = {s}.id)"
_PLACE = "list_position(['very_close', 'close', 'moderate', 'far'], {})"


@query(
    "l2_stable_distance_move",
    _recursive(O.OBJECTS, O.EDGES, _WALK, _MOVED, _LEGAL)
    + f""", pair AS (SELECT v.scene_id, v.target, a.id AS m_id, b.id AS s_id, {_distance()} AS old, a.x0, a.x1, a.y0, a.y1, a.z0, a.z1, b.x0 AS bx0, b.x1 AS bx1, b.y0 AS by0, b.y1 AS by1, b.z0 AS bz0, b.z1 AS bz1
      FROM moved v JOIN objects a ON a.scene_id = v.scene_id AND a.id = v.id JOIN objects b ON b.scene_id = v.scene_id WHERE {_STILL.format(t='v', s='b')}),
    shifted AS (SELECT p.scene_id, p.target, p.m_id, p.s_id, l.move, {_bin('old')} AS old_bin, p.x0 + l.dx AS x0, p.x1 + l.dx AS x1, p.y0 + l.dy AS y0, p.y1 + l.dy AS y1, p.z0, p.z1, bx0, bx1, by0, by1, bz0, bz1 FROM pair p JOIN legal l USING (scene_id, target) WHERE old >= 0.2),
    gone AS (SELECT a.scene_id, a.target, a.m_id, a.s_id, a.move, a.old_bin, sqrt({' + '.join(f"greatest(greatest(a.{k}0 - a.b{k}1, a.b{k}0 - a.{k}1), 0.0) * greatest(greatest(a.{k}0 - a.b{k}1, a.b{k}0 - a.{k}1), 0.0)" for k in 'xyz')}) AS d FROM shifted a),
    rated AS (SELECT *, {_bin('d')} AS bin, abs({_PLACE.format(_bin('d'))} - {_PLACE.format('old_bin')}) AS apart, {_near('d')} AS near FROM gone WHERE d >= 0.2),
    first AS (SELECT scene_id, target, m_id, s_id, old_bin, min(move) FILTER (apart = 1 AND NOT near) AS hit, min(move) FILTER (apart = 0) AS same FROM rated GROUP BY ALL)
    SELECT f.scene_id, f.target, f.m_id, f.s_id, r.move, f.old_bin, r.bin AS new_bin, hit IS NULL AS unchanged FROM first f JOIN rated r ON r.scene_id = f.scene_id AND r.target = f.target AND r.m_id = f.m_id AND r.s_id = f.s_id
      AND r.move = coalesce(f.hit, CASE WHEN f.m_id <> f.target THEN f.same END)""",
)
def l2_stable_distance_move(spark: SparkSession, sf: str) -> DataFrame:
    objects = S.objects(spark, sf)
    moved = A.moved_sets(objects, S.edges(spark, sf))
    return C.stable_distance_moves(objects, moved, C.legal_moves(objects, moved))


_NX, _NY = "(m.cx + l.dx - s.cx)", "(m.cy + l.dy - s.cy)"


@query(
    "l2_object_move_allocentric",
    _recursive(O.OBJECTS, O.EDGES, _WALK, _MOVED, _LEGAL)
    + f""", turned AS (SELECT l.scene_id, l.target, l.move, l.dx, l.dy, max(least(abs(o - n), 8 - abs(o - n))) AS steps FROM (SELECT l.*, list_position({RING}, {_direction('(s.cy - m.cy)', '(s.cx - m.cx)', RING)}) AS o, list_position({RING}, {_direction('(s.cy - m.cy - l.dy)', '(s.cx - m.cx - l.dx)', RING)}) AS n
      FROM legal l JOIN moved v ON v.scene_id = l.scene_id AND v.target = l.target JOIN objects m ON m.scene_id = l.scene_id AND m.id = v.id JOIN objects s ON s.scene_id = l.scene_id WHERE {_STILL.format(t='l', s='s')}
        AND (abs(s.cx - m.cx) + abs(s.cy - m.cy) > 2e-6) AND (abs(s.cx - m.cx - l.dx) + abs(s.cy - m.cy - l.dy) > 2e-6)) l GROUP BY ALL),
    chosen AS (SELECT * FROM turned WHERE steps >= 1 QUALIFY row_number() OVER (PARTITION BY scene_id, target ORDER BY CASE WHEN steps >= 2 THEN 0 ELSE 1 END, move) = 1)
    SELECT l.scene_id, l.target, l.move, m.id AS m_id, s.id AS s_id, {_direction('(m.cy - s.cy)', '(m.cx - s.cx)', RING)} AS old_direction, {_direction(_NY, _NX, RING)} AS new_direction
    FROM chosen l JOIN moved v ON v.scene_id = l.scene_id AND v.target = l.target JOIN objects m ON m.scene_id = l.scene_id AND m.id = v.id JOIN objects s ON s.scene_id = l.scene_id
    WHERE {_STILL.format(t='l', s='s')} AND m.label <> s.label AND {_ambiguity(_NY, _NX)} <= 0.7 AND {_direction('(m.cy - s.cy)', '(m.cx - s.cx)', RING)} <> {_direction(_NY, _NX, RING)}""",
)
def l2_object_move_allocentric(spark: SparkSession, sf: str) -> DataFrame:
    """Map directions that change by each object's chosen move."""
    objects = S.objects(spark, sf)
    moved = A.moved_sets(objects, S.edges(spark, sf))
    return C.moved_directions(objects, moved, C.meaningful_moves(objects, moved, C.legal_moves(objects, moved)))


def _turned(x: str, y: str) -> tuple[str, str]:
    return f"(q.cx + ({x} - q.cx) * co - ({y} - q.cy) * si)", f"(q.cy + ({x} - q.cx) * si + ({y} - q.cy) * co)"


_CORNERS = [_turned(f"o.{x}", f"o.{y}") for x in ("x0", "x1") for y in ("y0", "y1")]
_TURNS = "turns(ord, angle, co, si) AS (VALUES " + ", ".join(f"({i}, {a}, {G.rotation(a)[0]!r}::DOUBLE, {G.rotation(a)[1]!r}::DOUBLE)" for i, a in enumerate(C.ORBITS)) + ")"
_ORBITS = f"""{_TURNS}, orbit AS (SELECT m.scene_id, m.target, q.id AS "pivot", t.ord, t.angle, m.id, {_turned('o.cx', 'o.cy')[0]} AS cx, {_turned('o.cx', 'o.cy')[1]} AS cy, least({', '.join(c[0] for c in _CORNERS)}) AS x0, greatest({', '.join(c[0] for c in _CORNERS)}) AS x1,
  least({', '.join(c[1] for c in _CORNERS)}) AS y0, greatest({', '.join(c[1] for c in _CORNERS)}) AS y1, o.z0, o.z1
  FROM moved m JOIN objects o ON o.scene_id = m.scene_id AND o.id = m.id JOIN objects q ON q.scene_id = m.scene_id CROSS JOIN turns t WHERE {_STILL.format(t='m', s='q')}),
room AS (SELECT scene_id, min(x0) rx0, min(y0) ry0, min(z0) rz0, max(x1) rx1, max(y1) ry1, max(z1) rz1 FROM objects GROUP BY scene_id),
allowed AS (SELECT scene_id, target, "pivot", ord, angle FROM orbit g JOIN room r USING (scene_id) GROUP BY ALL
  HAVING bool_and(x0 >= rx0 - 1e-6 AND y0 >= ry0 - 1e-6 AND z0 >= rz0 - 1e-6 AND x1 <= rx1 + 1e-6 AND y1 <= ry1 + 1e-6 AND z1 <= rz1 + 1e-6)),
struck AS (SELECT DISTINCT a.scene_id, a.target, a."pivot", a.ord FROM orbit a JOIN objects b ON a.scene_id = b.scene_id AND {_gap('x')} < 0 AND {_gap('y')} < 0 AND {_gap('z')} < 0 WHERE {_STILL.format(t='a', s='b')}),
free AS (SELECT * FROM allowed ANTI JOIN struck USING (scene_id, target, "pivot", ord))"""


@query("legal_orbits", _recursive(O.OBJECTS, O.EDGES, _WALK, _MOVED, _ORBITS) + ' SELECT scene_id, target, "pivot", angle FROM free')
def legal_orbits(spark: SparkSession, sf: str) -> DataFrame:
    objects = S.objects(spark, sf)
    return C.legal_orbits(objects, A.moved_sets(objects, S.edges(spark, sf))).select("scene_id", "target", "pivot", "angle")


def _faced(fx: str, fy: str, x: str, y: str) -> tuple[str, str]:
    norm = f"sqrt({fx} * {fx} + {fy} * {fy})"
    return f"(({x} * {fx} + {y} * {fy}) / {norm})", f"(({x} * {fy} - {y} * {fx}) / {norm})"


def _firm(fx: str, fy: str, fz: str) -> str:
    flat, total = f"sqrt({fx} * {fx} + {fy} * {fy})", f"sqrt({fx} * {fx} + {fy} * {fy} + {fz} * {fz})"
    return f"({flat} >= 0.3 AND {total} >= 1e-6 AND {flat} >= 0.5 * {total})"


_OLD = _faced("(q.cx - m.cx)", "(q.cy - m.cy)", "(r.cx - m.cx)", "(r.cy - m.cy)")
_NOW = _faced("(q.cx - n.cx)", "(q.cy - n.cy)", "(coalesce(k.cx, r.cx) - n.cx)", "(coalesce(k.cy, r.cy) - n.cy)")


@query(
    "l2_orbit_object_centric",
    _recursive(O.OBJECTS, O.EDGES, _WALK, _MOVED, _ORBITS)
    + f""", seen AS (SELECT n.scene_id, n.target, m.id AS m_id, q.id AS "pivot", r.id AS r_id, n.ord, n.angle, {_direction(*_OLD, EGO)} AS old_direction, {_direction(*_NOW, EGO)} AS new_direction
      FROM orbit n JOIN free f ON f.scene_id = n.scene_id AND f.target = n.target AND f."pivot" = n."pivot" AND f.ord = n.ord JOIN objects m ON m.scene_id = n.scene_id AND m.id = n.id JOIN objects q ON q.scene_id = n.scene_id AND q.id = n."pivot" JOIN objects r ON r.scene_id = n.scene_id
      LEFT JOIN orbit k ON k.scene_id = n.scene_id AND k.target = n.target AND k."pivot" = n."pivot" AND k.ord = n.ord AND k.id = r.id
      WHERE m.label <> q.label AND r.id <> m.id AND r.id <> q.id AND r.label <> m.label AND r.label <> q.label AND {_firm('(q.cx - m.cx)', '(q.cy - m.cy)', '(q.cz - m.cz)')} AND {_firm('(q.cx - n.cx)', '(q.cy - n.cy)', '(q.cz - m.cz)')} AND {_ambiguity(*_NOW)} <= 0.7)
    SELECT scene_id, target, m_id, "pivot", r_id, angle, old_direction, new_direction, old_direction = new_direction AS unchanged FROM seen
    QUALIFY row_number() OVER (PARTITION BY scene_id, target, m_id, "pivot", r_id ORDER BY old_direction = new_direction, ord) = 1""",
)
def l2_orbit_object_centric(spark: SparkSession, sf: str) -> DataFrame:
    """Rotation questions: the first legal orbit that turns a reference for one who faces the pivot, else unchanged."""
    objects = S.objects(spark, sf)
    return C.orbit_questions(objects, A.moved_sets(objects, S.edges(spark, sf)))
