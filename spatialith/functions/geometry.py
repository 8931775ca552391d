"""Geometry as column expressions: everything stays inside generated code.

World axes: x east, y north, z up.  A camera looks along a level unit vector (fx, fy); its right is (fy, -fx).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed vocabularies, clockwise.
HORIZONTAL = ["front", "front-right", "right", "back-right", "back", "back-left", "left", "front-left"]
CARDINAL = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]
#: Fixed limits of the distance bins in metres, and how near to a limit is doubtful.
DISTANCE_BINS = [(1.0, "very_close"), (2.0, "close"), (3.3, "moderate")]
BOUNDARY_MARGIN = 0.1
EPS = 1e-8
CLEARANCE = 0.02


def wrap360(x: Column) -> Column:
    return x - F.floor(x / 360) * 360


def ring_index(primary: Column, secondary: Column) -> Column:
    """Eighth of the circle (0: along ``primary``), or null for a vector of no length."""
    shifted = wrap360(F.degrees(F.atan2(secondary, primary)) + 22.5)
    return F.when(F.hypot(primary, secondary) >= 1e-6, F.least(F.floor(shifted / 45), F.lit(7)))


def ring_direction(primary: Column, secondary: Column, ring: list[str]) -> Column:
    """Name of the direction; the first of the ring for a vector of no length."""
    index = F.coalesce(ring_index(primary, secondary), F.lit(0))
    return F.element_at(F.array(*map(F.lit, ring)), index.cast("int") + 1)


def ring_ambiguity(primary: Column, secondary: Column) -> Column:
    """0 in the middle of a direction's sector, 1 on its edge or for a vector of no length."""
    shifted = wrap360(F.degrees(F.atan2(secondary, primary)) + 22.5)
    offset = F.abs(shifted - F.floor(shifted / 45) * 45 - 22.5)
    return F.when(F.hypot(primary, secondary) < 1e-6, 1.0).otherwise(offset / 22.5)


def axis_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Gap between two intervals; negative where they overlap."""
    return F.greatest(a0 - b1, b0 - a1)


def box_gaps(a: str = "a_", b: str = "b_") -> list[Column]:
    c = F.col
    return [axis_gap(c(f"{a}{k}0"), c(f"{a}{k}1"), c(f"{b}{k}0"), c(f"{b}{k}1")) for k in "xyz"]


def box_distance(a: str = "a_", b: str = "b_") -> Column:
    """Distance between the closest points of two boxes."""
    gaps = [F.greatest(g, F.lit(0.0)) for g in box_gaps(a, b)]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def distance_bin(d: Column) -> Column:
    out = F.when(d < DISTANCE_BINS[0][0], DISTANCE_BINS[0][1])
    for limit, name in DISTANCE_BINS[1:]:
        out = out.when(d < limit, name)
    return out.otherwise("far")


def near_boundary(d: Column) -> Column:
    near = F.lit(False)
    for limit, _ in DISTANCE_BINS:
        near = near | (F.abs(d - limit) < BOUNDARY_MARGIN)
    return near


def overlap_area(a: str = "a_", b: str = "b_") -> Column:
    """Common area of two rectangular footprints."""
    c = F.col
    x, y = (F.least(c(f"{a}{k}1"), c(f"{b}{k}1")) - F.greatest(c(f"{a}{k}0"), c(f"{b}{k}0")) for k in "xy")
    return F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0))


def vertical_direction(a: str = "a_", b: str = "b_") -> Column:
    """Where b is from a if their footprints overlap and a clear gap separates them: above, below or null."""
    c = F.col
    clear = overlap_area(a, b) > EPS
    up, down = c(f"{b}z0") - c(f"{a}z1"), c(f"{a}z0") - c(f"{b}z1")
    return F.when(clear & (up > CLEARANCE), "above").when(clear & (down > CLEARANCE), "below")


def vertical_ambiguity(a: str = "a_", b: str = "b_") -> Column:
    c = F.col
    extent = F.greatest(c(f"{a}z1") - c(f"{a}z0"), c(f"{b}z1") - c(f"{b}z0"), F.lit(CLEARANCE))
    gap = F.greatest(c(f"{b}z0") - c(f"{a}z1"), c(f"{a}z0") - c(f"{b}z1"))
    return 1.0 - F.least(gap / extent, F.lit(1.0))


def boxes_intersect(a: str = "a_", b: str = "b_") -> Column:
    """Overlap of positive volume; boxes that only touch don't."""
    x, y, z = box_gaps(a, b)
    return (x < 0) & (y < 0) & (z < 0)


def stable_facing(dx: Column, dy: Column, dz: Column) -> Column:
    """Whether anchor to facing object gives a reliable horizontal heading."""
    flat, total = F.hypot(dx, dy), F.sqrt(dx * dx + dy * dy + dz * dz)
    return (flat >= 0.3) & (total >= 1e-6) & (flat >= 0.5 * total)


def to_camera(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Camera coordinates (right, down, forward) of a world point; needs px, py, pz, fx, fy."""
    dx, dy = x - F.col("px"), y - F.col("py")
    return dx * F.col("fy") - dy * F.col("fx"), F.col("pz") - z, dx * F.col("fx") + dy * F.col("fy")


def project(right: Column, down: Column, forward: Column, focal: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel coordinates; null behind the camera."""
    ok = forward > 0
    return F.when(ok, right / forward * focal + cx), F.when(ok, down / forward * focal + cy)


def in_image(u: Column, v: Column, width: int, height: int, margin: int = 0) -> Column:
    """Half-open pixel bounds less a margin."""
    inside = (u >= margin) & (u < width - margin) & (v >= margin) & (v < height - margin)
    return F.coalesce(inside, F.lit(False))


def vertical_tolerance(a_height: Column, b_height: Column) -> Column:
    """How far apart surfaces may be that still touch; a rests on b."""
    soft = F.least(F.greatest(0.02 + 0.05 * b_height, F.lit(0.03)), F.lit(0.10))
    return F.least(soft, F.greatest(0.30 * a_height, F.lit(0.03)))


def cardinal_move(dx: Column, dy: Column, dz: Column) -> Column:
    """One of four cardinal directions, up or down, for a displacement."""
    flat = F.hypot(dx, dy)
    angle = wrap360(F.degrees(F.atan2(dx, dy)))
    name = F.when((angle < 45) | (angle >= 315), "north").when(angle < 135, "east").when(angle < 225, "south").otherwise("west")
    up = F.when(dz > 0, "up").otherwise("down")
    return F.when(F.abs(dz) > flat, up).when(flat < 1e-6, "north").otherwise(name)


def camera_move(right: Column, down: Column, forward: Column) -> Column:
    """Dominant camera axis of a displacement."""
    h, v, d = F.abs(right), F.abs(down), F.abs(forward)
    top = F.greatest(h, v, d)
    vertical = F.when(down > 0, "down").otherwise("up")
    depth = F.when(forward > 0, "forward").otherwise("backward")
    return F.when(top == v, vertical).when(top == d, depth).otherwise(F.when(right > 0, "right").otherwise("left"))


def compass(angle: Column) -> Column:
    """Nearest of eight compass points; ties go to the first."""
    a = wrap360(angle)
    index = F.ceil((a - 22.5) / 45) % 8
    return F.element_at(F.array(*map(F.lit, CARDINAL)), index.cast("int") + 1)


def rotation(degrees: float) -> tuple[float, float]:
    """Cosine and sine, exact at right angles."""
    turn = degrees % 360
    exact = {0: (1.0, 0.0), 90: (0.0, 1.0), 180: (-1.0, 0.0), 270: (0.0, -1.0)}
    return exact.get(turn, (math.cos(math.radians(turn)), math.sin(math.radians(turn))))


def shoelace(polygon: Column) -> Column:
    """Area of a polygon given as an array of (x, y) arrays."""
    n = F.size(polygon)
    turned = F.concat(F.slice(polygon, 2, n), F.slice(polygon, 1, 1))
    cross = F.zip_with(polygon, turned, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def camera_heading(fx: Column, fy: Column) -> Column:
    """Compass point of a camera's view; north if it looks straight up or down."""
    return F.when(F.hypot(fx, fy) < 1e-6, "north").otherwise(ring_direction(fy, fx, CARDINAL))


def sample_count(area: Column, least_area: Column, base: int) -> Column:
    """Surface samples of an object: ``base`` for the smallest, more by the square root of the area."""
    scale = F.sqrt(F.greatest(area / least_area, F.lit(1.0)))
    return F.coalesce(F.greatest(F.lit(base), F.ceil(base * scale)), F.lit(base)).cast("long")
