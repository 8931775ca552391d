"""Operators on small hand-made tables."""

from __future__ import annotations

import json

import numpy as np
import pytest

from spatialith.operators import counterfactual as C
from spatialith.operators import frames as V
from spatialith.operators import graph as A
from spatialith.operators import kernels as K
from spatialith.operators import quality as Q
from spatialith.operators import referability as M
from spatialith.sources import files
from spatialith.streaming import scoring


def test_cap_share(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, i < 60) for i in range(100)], "question_id long, hit boolean")
    out = Q.cap_share(rows, F.lit(True), F.col("hit"))
    assert out.filter("hit").count() == 20 and out.filter("not hit").count() == 40
    assert Q.cap_share(rows.filter("hit"), F.lit(True), F.col("hit")).count() == 0


def test_accuracy_without_rows(spark):
    q = spark.createDataFrame([(1, "L1", "t", "A"), (2, "L2", "t", "B")], "question_id long, level string, type string, answer string")
    p = spark.createDataFrame([(1, 1, "B"), (1, 2, "A"), (2, 1, None)], "question_id long, ord long, prediction string")
    out = {(r.scope, r.name): (r.correct, r.total) for r in Q.accuracy(Q.matched(q, p)).collect()}
    assert out["level", "L1"] == (1, 1) and out["level", "L2"] == (0, 1) and out["level", "L3"] == (0, 0)
    assert Q.accuracy(Q.matched(q, p.limit(0))).filter("accuracy = 0").count() == 4
    assert Q.matched(q, p.filter("question_id = 1"), all_questions=True).count() == 2


def test_kappa(spark):
    pairs = spark.createDataFrame([("A", "A")] * 3, "a string, b string")
    assert Q.kappa(pairs, "a", "b").first().kappa == 1.0
    assert Q.kappa(pairs.limit(0), "a", "b").first().kappa == 0.0


def test_balance_letters(spark):
    rows = spark.createDataFrame([(i, i, "L1", "t", "A") for i in range(100)], "question_id long, ord long, level string, type string, answer string")
    counts = Q.balance_letters(rows).groupBy("answer").count().collect()
    assert max(r["count"] for r in counts) <= 36


def test_forest_has_no_cycle(spark):
    rows = [(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 3, 4)]
    edges = spark.createDataFrame([(*r, "affixed_to", 0.5, 0.5, 0.01, 0.1, 0.1) for r in rows], "scene_id long, parent_id long, child_id long, type string, confidence double, coverage double, gap double, containment double, contact_z double")
    out = A.forest(edges)
    assert out.count() == 3
    assert A.chains(out).filter("root = id").count() == 0


def test_chains_depth(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(12)], "scene_id long, parent_id long, child_id long")
    out = A.chains(edges)
    assert out.count() == 12 * 13 // 2 and out.agg({"hops": "max"}).first()[0] == 12


def test_moves(spark):
    rows = C.moves(spark).collect()
    assert len(rows) == 48 and (rows[0].dx, rows[0].dy) == (3.0, 0.0)
    assert abs(rows[4].dx - 2.12132) < 1e-6


def test_removal_policy(spark):
    rows = spark.createDataFrame([(1, i, i > 0) for i in range(4)] + [(2, i, i > 1) for i in range(4)], "g long, ord long, unchanged boolean")
    out = C.removal_policy(rows, ["g"], "ord")
    assert out.filter("g = 1").count() == 2 and out.filter("g = 2").count() == 2


def test_audit_roles(spark):
    mentions = spark.createDataFrame([(1, 1, "x", "cup", 7), (1, 1, "y", "cup", 7)], "question_id long, frame_id long, role string, label string, obj_id long")
    status = spark.createDataFrame([(1, "cup", "unique")], "frame_id long, label string, status string")
    ref = spark.createDataFrame([(1, "cup", 7)], "frame_id long, label string, obj_id long")
    assert M.audit_mentions(mentions, status, ref).first().reason_codes == "mentioned_object_multi_role"
    assert M.audit_mentions(mentions, status, ref, role_rule=False).first().decision == "pass"
    with pytest.raises(Exception, match="must not be asked"):
        M.enforce(M.audit_mentions(mentions, status, ref)).collect()


def test_cover(spark):
    rows = [(0, 1, 0.5, "a"), (0, 1, 0.5, "b"), (0, 2, 0.9, "b"), (0, 3, 0.1, "c")]
    out = V.covering_frames(spark.createDataFrame(rows, "scene_id long, frame_id long, clarity double, item string"))
    assert [(r.frame_id, r.gain) for r in out.orderBy("place").collect()] == [(1, 2), (3, 1)]


def test_polygons():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    assert abs(K.overlap(square, square + 0.5) - 0.25) < 1e-12
    assert K.overlap(square, square + 1) < 1e-12
    assert K.area(K.hull(np.concatenate([square, [[0.5, 0.5]]]))) == 1.0
    turned = square @ np.array([[np.cos(0.5), np.sin(0.5)], [-np.sin(0.5), np.cos(0.5)]]) * [1, 1]
    assert abs(np.prod(K.smallest_rectangle(turned)[:2]) - 1) < 1e-9


def test_rays():
    box = K.box_triangles(np.array([1.0, -1, -1]), np.array([2.0, 1, 1]))
    d = np.array([[1.0, 0.1, 0.05], [0, 1, 0]])
    hit = K.hit_distances(np.zeros(3), d / np.linalg.norm(d, axis=1, keepdims=True), box).min(1)
    assert abs(hit[0] - np.linalg.norm([1, 0.1, 0.05])) < 1e-9 and np.isinf(hit[1])
    path = K.compress_path(np.array([2.0, 1.0, 1.0005]), np.array([5, 4, 4]))
    assert path == [(1.0, 4), (2.0, 5)]


def test_masks_and_images():
    mask = K.decode_rle([1, 2, 1], 2, 2)
    assert mask.tolist() == [[False, True], [True, False]]
    assert K.mask_iou(mask, mask) == 1.0 and K.mask_iou(mask, ~mask) == 0.0
    flat, edge = np.zeros((8, 8)), np.zeros((8, 8))
    edge[:, 4:] = 255
    assert K.laplacian_variance(flat) == 0 and K.laplacian_variance(edge) > 0 and K.tenengrad(edge) > 0


def test_surface_samples():
    box = K.box_triangles(np.zeros(3), np.ones(3))
    points = K.sample_surface(box, 32, 1)
    assert points.shape == (32, 3) and ((points >= -1e-9) & (points <= 1 + 1e-9)).all()
    assert np.isclose(np.abs(points - 0.5).max(1), 0.5).all()
    assert (K.sample_surface(box, 32, 1) == points).all()
    assert K.nearest_pairs(np.zeros((3, 3)), np.ones((2, 3)), 1)[0][0] == pytest.approx(3**0.5)


def test_files(spark, tmp_path):
    q = {"question_id": 1, "scene_id": "s", "type": "t", "options": ["a"], "answer": "A"}
    (tmp_path / "list.json").write_text(json.dumps([q, q]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"questions": [q]}))
    assert files.read_questions(spark, str(tmp_path / "list.json")).count() == 2
    assert files.read_questions(spark, str(tmp_path / "wrapped.json")).first().answer == "A"
    cache = {"version": "2", "frames": {"s": {"f1": {"n": 3}, "f2": {"n": 4}}}}
    (tmp_path / "cache.json").write_text(json.dumps(cache))
    assert files.read_cache(spark, str(tmp_path / "cache.json"), "2", "n: int").count() == 2
    assert files.read_cache(spark, str(tmp_path / "cache.json"), "1", "n: int").count() == 0
    (tmp_path / "pose.txt").write_text("1 0 0\n0 inf 0\n0 0 1\n")
    assert files.read_matrix(spark, str(tmp_path / "pose.txt")).count() == 2
    (tmp_path / "meta.txt").write_text("a = 1\nb=x = y\n")
    assert {(r.key, r.value) for r in files.read_settings(spark, str(tmp_path / "meta.txt")).collect()} == {("a", "1"), ("b", "x = y")}
    for name in ("i10.jpg", "i9.jpg", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in files.list_images(spark, str(tmp_path)).collect()] == ["i9.jpg", "i10.jpg"]


def test_stream(spark, tmp_path):
    stream = scoring.prediction_stream(spark, "/root/testdata/sf0.001/events.parquet")
    out = scoring.run_to_end(scoring.windowed_accuracy(stream), "scored", str(tmp_path / "checkpoint"))
    assert out.count() > 0 and out.filter("n_right > n").count() == 0


def test_ray_visibility_covers_every_frame(spark):
    from spatialith.plans import queries
    from spatialith.sources import adapters

    sf = "/root/testdata/sf0.001"
    out = queries.ray_visibility(spark, sf).toPandas()
    wanted = adapters.cameras(spark, sf).join(adapters.objects(spark, sf), "scene_id").select("scene_id", "frame_id", "id").toPandas()
    assert sorted(map(tuple, out[["scene_id", "frame_id", "id"]].to_numpy().tolist())) == sorted(map(tuple, wanted.to_numpy().tolist()))
    assert (out.n_rays >= 512).all() and (out.n_rays > 512).any()
    assert ((out.n_visible >= 0) & (out.n_visible <= out.n_rays)).all()


def test_nearest_pairs_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    for shift in (0, 0.5, 3, 40):
        # few distinct coordinates, so that distances tie
        a, b = rng.integers(0, 4, (700, 3)).astype(float), rng.integers(0, 4, (300, 3)) + float(shift)
        all_pairs = np.sqrt(((a[:, None] - b) ** 2).sum(2))
        want = sorted((float(d), i, j) for (i, j), d in np.ndenumerate(all_pairs))[:8]
        assert K.nearest_pairs(a, b, 8, block=64) == want
    assert len(K.nearest_pairs(np.zeros((1, 3)), np.ones((2, 3)))) == 2


def test_surface_distances(spark):
    """Large boxes beside each other, apart along three axes, and one within another."""
    boxes = [(0, 0, 0, 0, 0, 4, 4, 4), (0, 1, 4.5, 0, 0, 8, 4, 4), (0, 2, 5, 6, 7, 6, 7, 8), (0, 3, 1, 1, 1, 2, 2, 2)]
    objects = spark.createDataFrame([(s, i, *map(float, b)) for s, i, *b in boxes], "scene_id long, id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    found = {(r.a_id, r.b_id): r.distance for r in K.surface_distances(objects).collect()}
    gaps = {(0, 1): 0.5, (0, 2): 14**0.5, (0, 3): 1.0, (1, 2): 13**0.5, (1, 3): 2.5, (2, 3): 50**0.5}
    assert found.keys() == gaps.keys()
    for pair, gap in gaps.items():
        assert gap - 1e-9 <= found[pair] <= gap + 0.12, (pair, found[pair], gap)
    things = [(t, *K.surface_samples(t, 600, 1)) for t in (K.box_triangles(np.array(b[2:5], float), np.array(b[5:], float)) for b in boxes[:2])]
    coarse = K.nearest_pairs(things[0][1], things[1][1], 1)[0][0]
    assert 0.5 <= K.surface_distance(*things) < coarse
    local = K.around(things[0][0][0], things[0][0][0].mean(0), 64, 1)
    assert np.abs(local - things[0][0][0].mean(0)).max() <= K.BLEND * 4


def test_pair_distances_side_by_side():
    """All pairs together, of apart, crossing and nested boxes with different numbers of points, give what each pair gives by itself."""
    boxes = [(0, 0, 0, 4, 4, 4), (4.5, 0, 0, 8, 4, 4), (3, 3, 3, 5, 5, 5), (1, 1, 1, 2, 2, 2), (0, 0, 0, 4, 4, 4)]
    meshes = [K.box_triangles(np.array(b[:3], float), np.array(b[3:], float)) for b in boxes]
    things = [(t, *K.surface_samples(t, 100 * (i + 1), i)) for i, t in enumerate(meshes)]
    left, right = np.triu_indices(len(things), 1)
    together = K.pair_distances(things, left, right)
    for i, j, found in zip(left, right, together, strict=True):
        near = sorted((float(d), *at) for at, d in np.ndenumerate(np.sqrt(((things[i][1][:, None] - things[j][1]) ** 2).sum(2))))[:8]
        wide = []
        for (triangles, points, owner), places in ((things[i], [p[1] for p in near]), (things[j], [p[2] for p in near])):
            distinct = list(dict.fromkeys(places))
            wide.append(np.concatenate([points[distinct], *(K.around(triangles[owner[p]], points[p], 64, p) for p in distinct[:4])]))
        assert abs(found - np.sqrt(((wide[0][:, None] - wide[1]) ** 2).sum(2)).min()) < 1e-12
    assert K.pair_distances(things, left[:0], right[:0]) == []


def test_farthest_points_are_those_of_all_points():
    """Sets of many sizes side by side, one of them with few distinct coordinates, give what a plain search gives."""
    rng = np.random.default_rng(7)
    clouds = [rng.random((m, 3)) * rng.random(3) * 9 for m in (2000, 700, 64, 33, 5)] + [rng.permutation(np.argwhere(np.ones((2, 1, 2))))]
    counts = [500, 300, 64, 8, 1, 4]
    order = sorted(range(len(clouds)), key=lambda i: -counts[i])
    found = K.farthest_first([clouds[i] for i in order], [counts[i] for i in order])
    for i, places in zip(order, found, strict=True):
        chosen, gap = [0], ((clouds[i] - clouds[i][0]) ** 2 @ np.ones(3))
        for place in places[1:]:
            assert gap[place] >= gap.max() * (1 - 1e-12)
            chosen.append(int(place))
            gap = np.minimum(gap, (clouds[i] - clouds[i][place]) ** 2 @ np.ones(3))
        assert places.tolist() == chosen and len(set(chosen)) == counts[i]


def test_first_hits_are_those_of_triangles():
    rng = np.random.default_rng(3)
    low, high = np.array([1.0, -1, -0.5]), np.array([2.0, 1, 1.5])
    rays = rng.normal(size=(4000, 3))
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    for eye in ([0.0, 0, 0], [1.5, 0.2, 0.3], [4.0, 3, 2], [1.5, 0, 9]):  # before, inside, behind, above
        want = K.hit_distances(np.array(eye), rays, K.box_triangles(low, high)).min(1)
        assert np.allclose(K.first_hits(np.array(eye), rays, low, high), want, atol=1e-9)
        assert np.isfinite(want).any()
    straight = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, -1]])
    assert K.first_hits(np.array([0.0, 0.5, 0.25]), straight, low, high).tolist() == [1, np.inf, np.inf]


def test_scenes_cross_batches(spark):
    """Scenes that several Arrow batches share are not torn apart."""
    boxes = [(s, i, i * 3.0, 0.0, 0.0, i * 3.0 + 1, 1.0, 1.0) for s in range(5) for i in range(4)]
    objects = spark.createDataFrame(boxes, "scene_id long, id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    frames = spark.createDataFrame([(s, f, -5.0 + f, 0.5, 0.5) for s in range(5) for f in range(2)], "scene_id long, frame_id long, px double, py double, pz double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    runs = []
    try:
        for rows in ("3", "10000"):
            spark.conf.set(key, rows)
            distances = sorted(map(tuple, K.surface_distances(objects, 64).collect()))
            shares = sorted(map(tuple, K.visible_shares(objects, frames, 64).collect()))
            runs.append((distances, shares))
    finally:
        spark.conf.set(key, before)
    assert runs[0] == runs[1] and len(runs[0][0]) == 5 * 6 and len(runs[0][1]) == 5 * 2 * 4
    assert all(2 * (b - a) - 1e-9 <= d - (b - a - 1) <= 2 * (b - a) + 0.2 for _, a, b, d in runs[0][0])
    assert all(v == r if i == 0 else v < r for _, _, i, r, v in runs[0][1])  # boxes in a row hide those behind
