"""Kernels that columns can't express: polygons, meshes, rays, masks and images.  NumPy inside Arrow or grouped maps.

Each kernel is a plain function over arrays with a thin Spark operator around it; groups are one object, one frame or
one scene, never an unbounded key.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-9


# polygons


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of 2D points, counter-clockwise, without collinear points."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(p - out[-1], 0))[2] <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def area(polygon: np.ndarray) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon.T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a convex polygon inside another (both counter-clockwise)."""
    out = [np.asarray(p, float) for p in subject]
    for a, b in zip(window, np.roll(window, -1, 0), strict=True):
        edge, before, out = b - a, out, []
        side = [edge[0] * (p[1] - a[1]) - edge[1] * (p[0] - a[0]) for p in before]
        for i, p in enumerate(before):
            q, s, t = before[i - 1], side[i], side[i - 1]
            if (s >= 0) != (t >= 0):
                out.append(q + (p - q) * (t / (t - s)))
            if s >= 0:
                out.append(p)
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Common area of two convex hulls."""
    a, b = hull(a), hull(b)
    return area(clip(a, b)) if len(a) > 2 and len(b) > 2 else 0.0


def smallest_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """(long side, short side, angle) of the smallest rectangle around points: one side lies on a hull edge."""
    h = hull(points)
    best = (0.0, 0.0, 0.0)
    least = np.inf
    for a, b in zip(h, np.roll(h, -1, 0), strict=True):
        d = b - a
        n = np.hypot(*d)
        if n < EPS:
            continue
        c, s = d / n
        turned = h @ np.array([[c, -s], [s, c]])
        w, v = np.ptp(turned, axis=0)
        if w * v < least - EPS:
            least, best = w * v, (max(w, v), min(w, v), float(np.degrees(np.arctan2(s, c)) % 180))
    return best


def footprint_overlaps(pairs: DataFrame) -> DataFrame:
    """Adds ``overlap_area`` of two footprints, arrays of (x, y), to pairs with columns a_hull and b_hull."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs_ = zip(pdf.a_hull, pdf.b_hull, strict=True)
            yield pdf.assign(overlap_area=[overlap(np.stack(list(a)), np.stack(list(b))) for a, b in pairs_])

    return pairs.mapInPandas(run, pairs.select("*", F.lit(0.0).alias("overlap_area")).schema)


# surfaces


#: Fixed values of surface distances: samples of the smallest object, pairs that are refined, how many samples of each
#: object are refined, points around each, and their share of the way to a random point of its triangle.
SAMPLES, TOP_PAIRS, REFINED, RESAMPLES, BLEND = 512, 8, 4, 64, 0.2


#: Point sets that are thinned side by side, and points of a patch.
TOGETHER, PATCH = 64, 32

#: Points of each set that give a first limit to its nearest pairs; pairs of sets, and points of a side, that are searched together.
NEAREST, SIDE_BY_SIDE, AT_ONCE = 32, 64, 1 << 15


def sample_surface(triangles: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` well-spread points: area-weighted samples, four times too many, then farthest points first."""
    return surface_samples(triangles, n, seed)[0]


def surface_samples(triangles: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The points of ``sample_surface``, and the triangle of each."""
    return all_surface_samples([(triangles, n, seed)])[0]


def all_surface_samples(meshes: list[tuple[np.ndarray, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``surface_samples`` of each (triangles, n, seed)."""
    drawn = []
    for triangles, n, seed in meshes:
        rng = np.random.default_rng(seed)
        a, b, c = triangles[:, 0], triangles[:, 1], triangles[:, 2]
        weight = np.linalg.norm(np.cross(b - a, c - a), axis=1)
        pick = rng.choice(len(triangles), 4 * n, p=weight / weight.sum())
        r, s = np.sqrt(rng.random(4 * n)), rng.random(4 * n)
        drawn.append((a[pick] * (1 - r)[:, None] + b[pick] * (r * (1 - s))[:, None] + c[pick] * (r * s)[:, None], pick))
    out: list = [None] * len(meshes)
    by_size = sorted(range(len(meshes)), key=lambda i: -meshes[i][1])
    runs = max(1, round(len(by_size) / TOGETHER))  # of about equal length
    for run in range(runs):
        some = by_size[len(by_size) * run // runs : len(by_size) * (run + 1) // runs]
        if not some:
            continue
        chosen = farthest_first([drawn[i][0] for i in some], [meshes[i][1] for i in some])
        for i, places in zip(some, chosen, strict=True):
            out[i] = drawn[i][0][places], drawn[i][1][places]
    return out


@lru_cache(1)
def curve_steps(bits: int) -> np.ndarray:
    """Place of each cell of a cube on the Hilbert curve (Skilling's transposition)."""
    side = np.arange(1 << bits, dtype=np.int32)
    axes = [x.ravel() for x in np.meshgrid(side, side, side, indexing="ij")]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(3):
            on = -(axes[k] >> level & 1)  # all bits or none
            swap = (axes[0] ^ axes[k]) & low & ~on
            axes[0] ^= low & on
            axes[0] ^= swap
            if k:
                axes[k] ^= swap
    axes[1] ^= axes[0]
    axes[2] ^= axes[1]
    turn = np.zeros_like(axes[2])
    for level in range(bits - 1, 0, -1):
        turn ^= -(axes[2] >> level & 1) & ((1 << level) - 1)
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for x in axes:
            key = key << 1 | (x ^ turn) >> level & 1
    return key


def along_curve(points: np.ndarray, bits: int = 6) -> np.ndarray:
    """Places of the points in the order of a Hilbert curve."""
    scale = ((1 << bits) - 1) / max(np.ptp(points, axis=0).max(), EPS)
    x, y, z = ((points - points.min(0)) * scale).astype(np.int32).T
    return np.argsort(curve_steps(bits)[(x << bits | y) << bits | z], kind="stable")


def farthest_first(clouds: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
    """Places of ``count`` points of each set: the first, then always the one farthest from all before.

    The sets, by falling count, advance together.  Each is cut into patches of neighbours with a ball around them; a new
    point is compared with the points of those patches alone that hold one it can be the nearest to.
    """
    sets, wide = len(clouds), -(-max(map(len, clouds)) // PATCH)
    place = np.zeros((sets, wide * PATCH), np.int64)
    xyz = np.full((3, sets, wide * PATCH), np.nan)  # no point is there
    for i, points in enumerate(clouds):
        order = along_curve(points)
        place[i, : len(points)] = order
        xyz[:, i, : len(points)] = points[order].T
    first = np.array([points[0] for points in clouds]).T
    gap = sum((xyz[k] - first[k][:, None]) ** 2 for k in range(3))
    gap[np.isnan(gap)] = -1
    x, y, z = xyz.reshape(3, -1, PATCH)
    gap = gap.reshape(-1, PATCH)
    top = gap.max(1)
    filled = np.flatnonzero(top >= 0)
    centre, radius = np.zeros((3, len(top))), np.zeros(len(top))
    for k, values in enumerate((x, y, z)):
        centre[k, filled] = (np.nanmin(values[filled], 1) + np.nanmax(values[filled], 1)) / 2
    away = sum((v[filled] - c[filled, None]) ** 2 for v, c in zip((x, y, z), centre, strict=True))
    radius[filled] = np.sqrt(np.nanmax(away, 1)) * (1 + 1e-9) + 1e-9
    reach = np.full(len(top), -1.0)  # square of the distance from the centre within which a point changes a patch
    reach[filled] = (radius[filled] + np.sqrt(top[filled])) ** 2
    np.nan_to_num(xyz, copy=False)
    cx, cy, cz = centre.reshape(3, sets, wide)
    by_set, reaches = top.reshape(sets, wide), reach.reshape(sets, wide)
    chosen = np.zeros((sets, max(counts)), np.int64)
    chosen[:, 0] = -1
    base = np.arange(sets) * wide
    alive = np.searchsorted(-np.array(counts), -np.arange(max(counts)), side="left").tolist()
    for t in range(1, max(counts)):
        k = alive[t]
        row = base[:k] + by_set[:k].argmax(1)
        column = gap[row].argmax(1)
        chosen[:k, t] = row * PATCH + column
        qx, qy, qz = x[row, column], y[row, column], z[row, column]
        d = cx[:k] - qx[:, None]
        d *= d
        for c, q in ((cy, qy), (cz, qz)):
            e = c[:k] - q[:, None]
            e *= e
            d += e
        met = np.flatnonzero(d < reaches[:k])
        owner = met // wide
        d = x[met]
        d -= qx[owner][:, None]
        d *= d
        for c, q in ((y, qy), (z, qz)):
            e = c[met]
            e -= q[owner][:, None]
            e *= e
            d += e
        np.minimum(d, gap[met], out=d)
        gap[met] = d
        most = d.max(1)
        top[met] = most
        reach[met] = (radius[met] + np.sqrt(most)) ** 2
    places = place.ravel()[chosen]
    places[:, 0] = 0
    return [places[i, :n] for i, n in enumerate(counts)]


def nearest_of_each(a: np.ndarray, b: np.ndarray, k: int, limit: np.ndarray, block: int = 256) -> tuple[np.ndarray, ...]:
    """Of each row of two arrays of point sets (rows, 3, points), padded by nan: the k smallest distances up to the root of its ``limit``.

    Returns row, distance and both places, sorted; ties go to the first places.  Points farther from the other set's box
    than k pairs are apart can't be in any of them and are left out.
    """
    gaps = []
    with np.errstate(invalid="ignore"):
        for p, q in ((a, b), (b, a)):
            low, high = np.fmin.reduce(q, 2), np.fmax.reduce(q, 2)
            gap = 0.0
            for x in range(3):
                e = p[:, x] - p[:, x].clip(low[:, x, None], high[:, x, None])
                e *= e
                gap = gap + e
            gap[np.isnan(gap)] = np.inf
            gaps.append(gap)
    # the points nearest to the other box give a limit for all
    first = [np.argpartition(g, NEAREST, 1)[:, :NEAREST] if g.shape[1] > NEAREST else np.broadcast_to(np.arange(g.shape[1]), g.shape) for g in gaps]
    p, q = (np.take_along_axis(s, f[:, None], 2) for s, f in zip((a, b), first, strict=True))
    d = squares(p[..., None], q[:, :, None]).reshape(len(a), -1)
    d[np.isnan(d)] = np.inf
    if d.shape[1] >= k:
        limit = np.minimum(limit, np.partition(d, k - 1, 1)[:, k - 1])
    (ra, i), (rb, j) = (np.nonzero(g <= np.minimum(limit * (1 + 1e-9), np.finfo(float).max)[:, None]) for g in gaps)
    cuts_a, cuts_b = (np.searchsorted(r, np.arange(len(a) + 1)) for r in (ra, rb))
    wide = np.diff(cuts_b)
    few = np.diff(cuts_a) * wide <= block * block // 8
    found = []

    def add(r: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        at = np.flatnonzero(d <= limit[r] * (1 + 1e-12))
        found.append((r[at], np.sqrt(d[at]), i[at], j[at]))

    some = np.flatnonzero(few[ra])
    times = wide[ra[some]]
    left = np.repeat(some, times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + cuts_b[ra[left]]
    add(ra[left], i[left], j[right], squares(a[ra[left], :, i[left]], b[ra[left], :, j[right]]))
    for r in np.flatnonzero(~few):
        mine, others = i[cuts_a[r] : cuts_a[r + 1]], j[cuts_b[r] : cuts_b[r + 1]]
        for at in range(0, len(mine), block):
            d = squares(a[r][:, mine[at : at + block], None][None], b[r][:, others][None, :, None]).ravel()
            near = np.flatnonzero(d <= limit[r] * (1 + 1e-12))
            add(np.full(len(near), r), mine[at + near // len(others)], others[near % len(others)], d[near])
    r, d, i, j = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((j, i, d, r))
    start = np.searchsorted(r[order], np.arange(len(a)))
    order = order[np.arange(len(order)) - start[r[order]] < k]
    return r[order], d[order], i[order], j[order]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of points, whose coordinates are the second axis, one after the other."""
    d = 0.0
    for x in range(3):
        e = a[:, x] - b[:, x]
        e *= e
        d = d + e
    return d


def nearest_pairs(a: np.ndarray, b: np.ndarray, k: int = TOP_PAIRS, block: int = 256) -> list[tuple[float, int, int]]:
    """The k smallest distances between two point sets and their places."""
    _, d, i, j = nearest_of_each(a.T[None], b.T[None], k, np.array([np.inf]), block)
    return list(zip(d.tolist(), i.tolist(), j.tolist(), strict=True))


@lru_cache(4096)
def spreads(n: int, seed: int) -> np.ndarray:
    """Shares of a triangle's corners in ``n`` random points of it."""
    return np.random.default_rng(seed).dirichlet(np.ones(3), n)


def around(triangle: np.ndarray, point: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` points of a triangle near one of its points."""
    return drawn_to(spreads(n, seed) @ triangle, point)


def drawn_to(spread: np.ndarray, point: np.ndarray) -> np.ndarray:
    return point + BLEND * (spread - point)


def surface_distance(a: tuple, b: tuple) -> float:
    """Least distance of two sampled surfaces (triangles, points, triangle of each point), the nearest pairs refined."""
    return pair_distances([a, b], np.array([0]), np.array([1]))[0]


def pair_distances(things: list[tuple], left: np.ndarray, right: np.ndarray) -> list[float]:
    """``surface_distance`` of many pairs of things, given by their places."""
    out: list[float] = []
    at = 0
    while at < len(left):
        wide = max(len(things[i][1]) for i in (*left[at : at + SIDE_BY_SIDE], *right[at : at + SIDE_BY_SIDE]))
        pairs = slice(at, at + max(1, min(SIDE_BY_SIDE, AT_ONCE // wide)))
        out += _pair_distances(things, left[pairs], right[pairs])
        at = pairs.stop
    return out


def _pair_distances(things: list[tuple], left: np.ndarray, right: np.ndarray) -> list[float]:
    used, own = np.unique(np.concatenate([left, right]), return_inverse=True)
    some = [things[i] for i in used.tolist()]
    points = padded([t[1] for t in some])
    rows, d, i, j = nearest_of_each(points[own[: len(left)]], points[own[len(left) :]], TOP_PAIRS, np.full(len(left), np.inf))
    least = d[np.searchsorted(rows, np.arange(len(left)))]
    # each side's places as they come first, and the points around the first of them, drawn once
    sides, wanted = [], {}
    cuts = np.searchsorted(rows, np.arange(len(left) + 1)).tolist()
    for places, who in ((i.tolist(), own[: len(left)].tolist()), (j.tolist(), own[len(left) :].tolist())):
        distinct = [[(t, p) for p in dict.fromkeys(places[a:b])] for t, a, b in zip(who, cuts, cuts[1:], strict=False)]
        for keys in distinct:
            for key in keys[:REFINED]:
                wanted.setdefault(key, len(wanted))
        sides.append(distinct)
    centre = np.array([some[t][1][p] for t, p in wanted])
    corners = np.array([some[t][0][some[t][2][p]] for t, p in wanted])
    spread = np.array([spreads(RESAMPLES, p) for _, p in wanted])
    more = drawn_to(spread @ corners, centre[:, None])
    wide = []
    for distinct in sides:
        sets = np.full((len(left), 3, TOP_PAIRS + REFINED * RESAMPLES), np.nan)
        for row, keys in enumerate(distinct):
            sets[row, :, : len(keys)] = np.array([some[t][1][p] for t, p in keys]).T
            near = [wanted[key] for key in keys[:REFINED]]
            sets[row, :, TOP_PAIRS : TOP_PAIRS + len(near) * RESAMPLES] = more[near].reshape(-1, 3).T
        wide.append(sets)
    _, d, _, _ = nearest_of_each(*wide, 1, least * least * (1 + 1e-9))
    return np.minimum(least, d).tolist()


def padded(sets: list[np.ndarray]) -> np.ndarray:
    """Point sets as one array, the shorter ones filled up with nan."""
    out = np.full((len(sets), 3, max(map(len, sets))), np.nan)
    for row, points in zip(out, sets, strict=True):
        row[:, : len(points)] = points.T
    return out


def box_triangles(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The twelve triangles of a box."""
    corner = np.array([[(low, high)[i >> k & 1][k] for k in range(3)] for i in range(8)])
    faces = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    return np.array([[corner[f[0]], corner[f[i]], corner[f[i + 1]]] for f in faces for i in (1, 2)])


def sample_counts(boxes: list[np.ndarray], base: int) -> list[int]:
    """Samples of each mesh of a scene: ``base`` for the smallest area, more by the root of the ratio of areas."""
    areas = np.array([np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1).sum() / 2 for t in boxes])
    least = areas[areas > 1e-10].min(initial=np.inf)
    return [int(np.ceil(base * np.sqrt(max(a / least, 1.0)))) for a in areas]


def surface_distances(objects: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(scene_id, a_id, b_id, distance): least distance between sampled surfaces of a scene's boxes.

    ``n``: samples of the smallest object of a scene; larger ones get more.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_freed()
        for scenes in whole_scenes(batches):
            for scene, ids, _, things in sampled(scenes, n):
                i, j = np.triu_indices(len(ids), 1)
                names = np.array(ids, np.int64)
                yield pd.DataFrame({"scene_id": scene, "a_id": names[i], "b_id": names[j], "distance": np.array(pair_distances(things, i, j), float)})

    return by_scene(objects, "id").mapInPandas(run, "scene_id long, a_id long, b_id long, distance double")


def keep_freed() -> None:
    """Lets this process use up to 64 MB again that it freed: the system would clear the pages of each array anew."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option:
        option(-3, 1 << 25)  # M_MMAP_THRESHOLD
        option(-1, 1 << 26)  # M_TRIM_THRESHOLD


def by_scene(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of each scene together, in a fixed number of partitions: by bytes, Spark would put few rows into one slow task.

    A few for each core: scenes of one partition are sampled side by side.
    """
    spark = rows.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "scene_id").sortWithinPartitions("scene_id", *order)


def whole_scenes(batches: Iterator[pd.DataFrame], objects: int = 6 * TOGETHER) -> Iterator[list[pd.DataFrame]]:
    """Runs of scenes, of about ``objects`` different objects together, of rows that come sorted by scene."""
    held: list[pd.DataFrame] = []
    some: list[pd.DataFrame] = []
    size = 0

    def more(scene: list[pd.DataFrame]) -> None:
        nonlocal size
        some.append(pd.concat(scene, ignore_index=True))
        size += some[-1].id.nunique()

    for batch in batches:
        for scene_id, rows in batch.groupby("scene_id", dropna=False, sort=False):
            if held and held[0].scene_id.iloc[0] != scene_id:
                more(held)
                held = []
                if size >= objects:
                    yield some
                    some, size = [], 0
            held.append(rows)
    if held:
        more(held)
    if some:
        yield some


def sampled(scenes: list[pd.DataFrame], n: int) -> Iterator[tuple[int, list[int], tuple[np.ndarray, np.ndarray], list[tuple]]]:
    """Of each scene of sorted objects: its identifier, theirs, their boxes, and their (triangles, points, triangle of each)."""
    boxes = [(pdf[["x0", "y0", "z0"]].to_numpy(), pdf[["x1", "y1", "z1"]].to_numpy()) for pdf in scenes]
    meshes = []
    for pdf, (low, high) in zip(scenes, boxes, strict=True):
        triangles = [box_triangles(a, b) for a, b in zip(low, high, strict=True)]
        meshes += [(t, c, int(i)) for t, c, i in zip(triangles, sample_counts(triangles, n), pdf.id, strict=True)]
    samples = iter([(mesh[0], *found) for mesh, found in zip(meshes, all_surface_samples(meshes), strict=True)])
    for pdf, box in zip(scenes, boxes, strict=True):
        yield pdf.scene_id.iloc[0], pdf.id.tolist(), box, [next(samples) for _ in range(len(pdf))]


# rays


def hit_distances(origin: np.ndarray, directions: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """(rays, triangles): distance along each unit ray to each triangle, inf where it misses."""
    a, e1, e2 = triangles[:, 0], triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0]
    p = np.cross(directions[:, None], e2[None])
    det = (p * e1).sum(2)
    ok = np.abs(det) > EPS
    inv = 1 / np.where(ok, det, 1)
    t0 = origin - a
    u = (p * t0).sum(2) * inv
    q = np.cross(t0, e1)
    v = (directions[:, None] * q[None]).sum(2) * inv
    t = (q * e2).sum(1) * inv
    return np.where(ok & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > EPS), t, np.inf)


def first_hits(origin: np.ndarray, directions: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance along each unit ray to the surface of a box, inf where it misses: ``hit_distances`` of its triangles."""
    enter, leave = np.full(len(directions), -np.inf), np.full(len(directions), np.inf)
    for k in range(3):
        d = directions[:, k]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (low[k] - origin[k]) / d, (high[k] - origin[k]) / d
        along = d == 0  # such a ray stays between the two faces, or never comes between them
        if along.any():
            t[along], u[along] = (-np.inf, np.inf) if low[k] <= origin[k] <= high[k] else (np.inf, -np.inf)
        np.maximum(enter, np.where(along, t, np.minimum(t, u)), out=enter)
        np.minimum(leave, np.where(along, u, np.maximum(t, u)), out=leave)
    first = np.where(enter > EPS, enter, leave)
    return np.where((enter <= leave) & (first > EPS), first, np.inf)


def visible_shares(objects: DataFrame, cameras: DataFrame, n: int = 512) -> DataFrame:
    """(scene_id, frame_id, id, n_rays, n_visible): how many rays to an object's surface meet nothing before it.

    ``n``: rays to the smallest object of a scene; larger ones get more.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_freed()
        for scenes in whole_scenes(batches):
            things_of = sampled([pdf.drop_duplicates("id").sort_values("id") for pdf in scenes], n)
            for pdf, (scene, ids, boxes, things) in zip(scenes, things_of, strict=True):
                rows = []
                counts = [len(t[1]) for t in things]
                owner = np.repeat(np.arange(len(ids)), counts)
                points = np.concatenate([t[1] for t in things])
                for frame in pdf.drop_duplicates("frame_id").sort_values("frame_id").itertuples():
                    eye = np.array([frame.px, frame.py, frame.pz], float)
                    target = points - eye
                    far = np.linalg.norm(target, axis=1)
                    target /= far[:, None]
                    clear = np.ones(len(points), bool)
                    for i, (low, high) in enumerate(zip(*boxes, strict=True)):
                        left = np.flatnonzero(clear & (owner != i))  # the object itself hides nothing of its own
                        clear[left] = first_hits(eye, target[left], low, high) > far[left] - 1e-3
                    seen = np.bincount(owner[clear], minlength=len(ids))
                    rows += [(scene, frame.frame_id, i, c, int(s)) for i, c, s in zip(ids, counts, seen, strict=True)]
                yield pd.DataFrame(rows, columns=["scene_id", "frame_id", "id", "n_rays", "n_visible"])

    joined = by_scene(cameras.join(objects, "scene_id"), "frame_id", "id")
    return joined.mapInPandas(run, "scene_id long, frame_id long, id long, n_rays int, n_visible int")


def compress_path(hits: np.ndarray, owners: np.ndarray, merge: float = 1e-3) -> list[tuple[float, int]]:
    """Hits along a ray in order, those of one object within ``merge`` as one."""
    out: list[tuple[float, int]] = []
    for t, o in sorted(zip(hits.tolist(), owners.tolist(), strict=True)):
        if not out or out[-1][1] != o or t - out[-1][0] > merge:
            out.append((t, o))
    return out


# masks and images


def decode_rle(counts: list[int], height: int, width: int) -> np.ndarray:
    """A mask from run lengths in column order, the first run empty."""
    flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    return flat[: height * width].reshape(width, height).T


def mask_iou(a: np.ndarray, b: np.ndarray) -> float:
    union = np.count_nonzero(a | b)
    return np.count_nonzero(a & b) / union if union else 0.0


def suppress(boxes: DataFrame, limit: float = 0.7) -> DataFrame:
    """Per frame and label, boxes by score that overlap none kept before by ``limit`` or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        box = pdf[["x0", "y0", "x1", "y1"]].to_numpy()
        keep: list[int] = []
        for i, b in enumerate(box):
            w = np.minimum(box[keep, 2], b[2]) - np.maximum(box[keep, 0], b[0])
            h = np.minimum(box[keep, 3], b[3]) - np.maximum(box[keep, 1], b[1])
            both = np.maximum(w, 0) * np.maximum(h, 0)
            size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
            if not keep or (both / (size[keep] + size[i] - both) < limit).all():
                keep.append(i)
        return pdf.iloc[keep]

    return boxes.groupBy("frame_id", "label").applyInPandas(run, boxes.schema)


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of a grey image: sharpness."""
    x = image.astype(float)
    return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())


def tenengrad(image: np.ndarray) -> float:
    """Mean Sobel gradient of a grey image."""
    x = image.astype(float)
    s = x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]
    t = x[:-2] + 2 * x[1:-1] + x[2:]
    return float(np.sqrt((s[2:] - s[:-2]) ** 2 + (t[:, 2:] - t[:, :-2]) ** 2).mean())
