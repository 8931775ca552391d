"""The adapter views in SQL, for comparison with another engine."""

from __future__ import annotations

_R = "floor(({x}) * 1000 + 0.5) / 1000"


def _r(x: str) -> str:
    return _R.format(x=x)


def _objects() -> str:
    e = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(6)]
    half = [_r(f"0.1 + abs({e[3]}) * 5"), _r(f"0.1 + abs({e[4]}) * 5"), _r(f"0.05 + abs({e[5]}) * 3")]
    centre = [_r(f"{e[0]} * 20"), _r(f"{e[1]} * 20"), _r(f"abs({e[2]}) * 8")]
    parts = ", ".join(f"{c} AS c{a}, {h} AS h{a}" for c, h, a in zip(centre, half, "xyz", strict=True))
    box = ", ".join(f"{_r(f'c{a} - h{a}')} AS {a}0, {_r(f'c{a} + h{a}')} AS {a}1" for a in "xyz")
    return f"""objects AS (SELECT scene_id, id, label, cx, cy, cz, {box} FROM (
      SELECT vec_id // 10 AS scene_id, vec_id % 10 AS id, 'label_' || label AS label, {parts} FROM embeddings))"""


_TYPE4 = "['supported_by', 'resting_on_soft_surface', 'affixed_to', 'contained_in']"
OBJECTS = _objects()
EDGES = f"""edges AS (SELECT vec_id // 10 AS scene_id, (vec_id % 10) // 2 AS parent_id, vec_id % 10 AS child_id,
  {_TYPE4}[vec_id % 4 + 1] AS type, (vec_id * 37 % 100) / 100.0::DOUBLE AS confidence,
  (vec_id * 53 % 100) / 100.0::DOUBLE AS coverage, (vec_id * 71 % 50) / 1000.0::DOUBLE AS gap
  FROM embeddings WHERE vec_id % 10 <> 0)"""
CANDIDATES = f"""candidate_edges AS (SELECT vec_id // 10 AS scene_id, (vec_id % 10 + 10 - k) % 10 AS parent_id,
  vec_id % 10 AS child_id, {_TYPE4}[(vec_id + k) % 4 + 1] AS type, ((vec_id * 37 + k * 11) % 5) / 5.0::DOUBLE AS confidence,
  ((vec_id * 53 + k * 7) % 4) / 4.0::DOUBLE AS coverage, ((vec_id * 71 + k * 3) % 50) / 1000.0::DOUBLE AS gap,
  ((vec_id + k) % 3) / 3.0::DOUBLE AS containment, ((vec_id * 3 + k) % 7) / 10.0::DOUBLE AS contact_z
  FROM (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0), range(1, 4) r(k))"""
_FURNITURE = "['bed', 'desk', 'cabinet', 'drawer', 'box', 'tv stand', 'table', 'sofa']"
_THINGS = "['pillow', 'book', 'handle', 'book', 'toy', 'monitor', 'cup', 'towel']"
_RISE = "CASE WHEN mode = 1 THEN p.z0 + 0.3 * (p.z1 - p.z0) WHEN mode = 3 THEN p.z1 - 0.06 ELSE p.z1 + (o.scene_id % 7 - 3) * 0.01 END::DOUBLE"
#: Needs OBJECTS.  With views of all bottoms and tops.
FURNISHED = f"""on_top AS (SELECT o.scene_id, o.id, {_r("p.cx + CASE WHEN mode = 2 THEN 0.9 ELSE 0.1 END::DOUBLE * (p.x1 - p.x0) / 2")} AS cx, {_r("p.cy + 0.05 * (p.y1 - p.y0)")} AS cy,
  {_r("0.15 * (p.x1 - p.x0)")} AS hx, {_r("0.15 * (p.y1 - p.y0)")} AS hy, {_r(_RISE)} AS z0, {_r(f"({_RISE}) + 0.3 * (p.z1 - p.z0)")} AS z1
  FROM (SELECT *, (scene_id + id // 2) % 4 AS mode FROM objects WHERE id % 2 = 1) o JOIN objects p ON p.scene_id = o.scene_id AND p.id = o.id - 1),
bare AS (SELECT scene_id, id, cx, cy, cz, x0, y0, z0, x1, y1, z1 FROM objects WHERE id % 2 = 0 UNION ALL
  SELECT scene_id, id, cx, cy, (z0 + z1) / 2, {_r("cx - hx")}, {_r("cy - hy")}, z0, {_r("cx + hx")}, {_r("cy + hy")}, z1 FROM on_top),
furnished AS (SELECT *, CASE WHEN id % 2 = 0 THEN {_FURNITURE}[(scene_id + id // 2) % 8 + 1] ELSE {_THINGS}[(scene_id + id // 2 + CASE WHEN scene_id % 3 = 0 THEN 1 ELSE 0 END) % 8 + 1] END AS label FROM bare),
bottoms AS (SELECT scene_id, id, z0 AS z, x0, y0, x1, y1, 1.0::DOUBLE AS score FROM furnished UNION ALL SELECT scene_id, id, z0 + 0.02, x0, y0, (x0 + x1) / 2, y1, 0.5 FROM furnished),
tops AS (SELECT scene_id, id, z1 AS z, x0, y0, x1, y1, 1.0::DOUBLE AS score FROM furnished UNION ALL SELECT scene_id, id, (z0 + z1) / 2, x0, y0, x1, (y0 + y1) / 2, 0.5 FROM furnished)"""
_YAW = "radians(((scene_id * 7 + frame_id * 5) % 12 * 30)::DOUBLE)"
CAMERAS = f"""cameras AS (SELECT scene_id, frame_id, floor(sin({_YAW}) * 1e6 + 0.5) / 1e6 AS fx, floor(cos({_YAW}) * 1e6 + 0.5) / 1e6 AS fy,
  ((scene_id + frame_id) % 5 - 2)::DOUBLE AS px, ((scene_id * 3 + frame_id) % 5 - 2)::DOUBLE AS py, 1.5::DOUBLE AS pz
  FROM (SELECT vec_id // 10 AS scene_id FROM embeddings WHERE vec_id % 10 = 0), range(0, 3) r(frame_id))"""
QUESTIONS = """questions AS (SELECT o_orderkey AS question_id, o_orderkey AS ord, o_custkey % 50 AS scene_id,
  'frame_' || (o_orderkey % 8) AS image_name,
  CASE WHEN o_orderpriority < '3' THEN 'L1' WHEN o_orderpriority < '4' THEN 'L2' ELSE 'L3' END AS level,
  ['direction_agent', 'distance', 'occlusion', 'object_move_agent', 'object_rotate_object_centric', 'attachment_chain'][o_orderkey % 6 + 1] AS type,
  'question ' || (o_orderkey % 997) AS question, substr('ABCD', ((o_orderkey * 7 + o_custkey) % 4 + 1)::INT, 1) AS answer,
  ['not visible', 'occluded', 'not occluded', 'near', 'far'][(o_orderkey * 3 + o_custkey) % 5 + 1] AS correct_value,
  (o_orderkey * 13 % 100) / 100.0::DOUBLE AS ambiguity, o_custkey % 10 AS a_id, o_orderkey % 7 AS b_id,
  o_custkey % 3 = 0 AS attached, o_orderkey % 4 = 0 AS unchanged,
  list_transform(range(0, 4), lambda i: 'option ' || ((o_orderkey + i) % 997)) AS options FROM orders)"""
PREDICTIONS = """predictions AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END AS question_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord,
  CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE substr('ABCD', ((l_orderkey * 7 + l_partkey % 3) % 4 + 1)::INT, 1) END AS prediction,
  ['B', ' (c) ', 'Answer: B', 'I think A or B', 'The answer is D.', 'no idea', '', 'Because of C', 'a)', 'option D', 'I choose A, not B'][l_partkey % 11 + 1] AS raw_response
  FROM lineitem)"""
REVIEWS = """reviews AS (SELECT d.doc_id // 10 AS scene_id, d.doc_id // 40 AS frame_id, d.doc_id AS object_id, d.doc_id % 10 AS scene_object_id, 'label_' || (d.doc_id % 7) AS label,
  CASE WHEN toxic = 1 THEN 'absent' WHEN quality = 0 THEN 'unsure' WHEN quality = 1 THEN 'clear' WHEN d.doc_id % 5 = 0 THEN 'absent' WHEN d.doc_id % 9 = 0 THEN NULL ELSE 'clear' END AS status,
  (n_chars % 100) / 100.0::DOUBLE AS bbox_ratio, (n_chars % 2000)::DOUBLE AS area_px, (n_chars % 1000)::DOUBLE AS mask_px,
  (n_chars % 97) / 10.0::DOUBLE AS depth_m, d.doc_id % 3 = 0 AS has_mask, (n_chars % 330 - 5)::DOUBLE AS u, (n_chars % 250 - 5)::DOUBLE AS v
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def views(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)
