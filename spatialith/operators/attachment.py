"""Which object an object is attached to: contained, affixed, resting on something soft, or supported.

All measures are column expressions over ordered pairs of a scene (a: child, b: parent); the join keeps the scene as
its key.  ``bottoms`` and ``tops`` are an object's candidate surfaces, arrays of (z, x0, y0, x1, y1, score): level
rectangles.  Hulls of other shapes need the polygon kernel for their common area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import relations as R

#: Labels of soft parents, their children, and of containers.
SOFT_PARENTS = ["bed", "sofa", "couch", "chair", "bench", "ottoman"]
SOFT_CHILDREN = ["pillow", "cushion", "towel", "sheet"]
CONTAINERS = [
    "drawer", "cabinet", "box", "storage container", "basket", "laundry basket", "bowl", "bin", "trash can", "refrigerator", "sink",
]
#: child|parent pairs that are likely.
SOFT_PAIRS = [
    "pillow|bed", "pillow|sofa", "pillow|chair", "pillow|ottoman", "cushion|sofa", "cushion|chair", "cushion|bench",
    "cushion|ottoman", "sheet|bed", "towel|bed",
]
CONTAINED_PAIRS = [
    "apple|bowl", "fruit|bowl", "book|drawer", "book|cabinet", "book|box", "apple|basket", "fruit|basket", "toy|box",
    "toy|basket", "toy|bin", "towel|laundry basket", "bottle|refrigerator",
]
AFFIXED_PAIRS = [
    "monitor|monitor stand", "monitor|desk", "television|tv stand", "tv|tv stand", "handle|cabinet", "handle|drawer",
    "knob|cabinet", "knob|drawer", "drawer|cabinet", "drawer|desk", "drawer|dresser", "drawer|night stand",
    "drawer|wardrobe", "handle|dresser", "knob|dresser", "sink|counter", "lamp|wall",
]
SCREENS, SCREEN_STANDS = ["monitor", "television", "tv"], ["monitor stand", "tv stand", "desk"]
RIGID_PAIRS = [
    "book|table", "book|desk", "book|night stand", "laptop|desk", "keyboard|desk", "mouse|desk", "cup|table", "cup|desk",
    "bottle|table", "bottle|desk", "plate|table", "plate|counter", "bowl|table", "bowl|counter", "printer|cabinet",
    "printer|desk", "microwave|counter",
]
#: Fixed limits.
AABB_LEAST = 0.12
HULL_LEAST, FALLBACK_LEAST = 0.20, 0.25
SOFT_SCALE, SOFT_HULL_LEAST, SOFT_FALLBACK_LEAST = 1.75, 0.12, 0.18
DEEPEST, DEEP_HULL, DEEP_AABB = 0.05, 0.50, 0.60
LEAST = {"contained_in": 0.55, "affixed_to": 0.0, "resting_on_soft_surface": 0.60, "supported_by": 0.45}
ENCLOSED_COVERAGE, ENCLOSED_LIFT, ENCLOSED_TOP_GAP, ENCLOSED_OVERSHOOT, ENCLOSED_MOST = 0.85, 0.50, 0.20, 0.05, 0.74


def _c(name: str) -> Column:
    return F.col(name)


def _pair() -> Column:
    return F.concat_ws("|", "a_label", "b_label")


def soft_prior() -> Column:
    soft = _c("b_label").isin(SOFT_PARENTS) & _c("a_label").isin(SOFT_CHILDREN)
    return F.when(_pair().isin(SOFT_PAIRS), 1.0).when(soft, 0.75).otherwise(0.0)


def containment_prior() -> Column:
    return F.when(_pair().isin(CONTAINED_PAIRS), 1.0).when(_c("b_label").isin(CONTAINERS), 0.7).otherwise(0.0)


def affixed_prior() -> Column:
    screen = _c("a_label").isin(SCREENS) & _c("b_label").isin(SCREEN_STANDS)
    return F.when(_pair().isin(AFFIXED_PAIRS), 1.0).when(screen, 0.8).otherwise(0.0)


def rigid_prior() -> Column:
    return F.when(_pair().isin(RIGID_PAIRS), 1.0).otherwise(0.0)


def _clip(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def _tolerance() -> Column:
    return G.vertical_tolerance(_c("a_z1") - _c("a_z0"), _c("b_z1") - _c("b_z0"))


def _area(s: Column) -> Column:
    return (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])


def _common(a: Column, b: Column) -> Column:
    x = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    y = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0))


def _box(p: str) -> Column:
    return F.struct(*[_c(f"{p}{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])


def surface_contact(scale: float = 1.0, hull_least: float = HULL_LEAST, fallback_least: float = FALLBACK_LEAST) -> Column:
    """The best of all pairs of a bottom of a and a top of b that touch, or null.

    Best: coverage, least gap, common area, scores of child and parent surface, their areas, in this order.
    """
    area, overlap = _area(_box("a_")), G.overlap_area()
    aabb = overlap / area
    tolerance = _tolerance() * scale
    under = F.least(F.lit(0.02), 0.5 * tolerance)
    deepest = F.least(F.lit(DEEPEST), under + 0.03)

    def touch(child: Column, parent: Column) -> Column:
        signed = child["z"] - parent["z"]
        common = _common(child, parent)
        shaped = (_area(child) > G.EPS) & (_area(parent) > G.EPS)
        cover = F.when(shaped, common / _area(child)).otherwise(aabb)
        strong = aabb >= max(DEEP_AABB, fallback_least)
        strong = F.when(shaped, strong & (cover >= max(DEEP_HULL, hull_least))).otherwise(strong)
        enough = cover >= F.when(shaped, hull_least).otherwise(fallback_least)
        ok = (signed <= tolerance) & (-signed <= deepest) & enough & ((signed >= -under) | strong)
        return F.when(
            ok,
            F.struct(
                cover.alias("coverage"),
                (-F.abs(signed)).alias("near"),
                F.when(shaped, common).otherwise(overlap).alias("overlap"),
                child["score"].alias("child_score"),
                parent["score"].alias("parent_score"),
                _area(child).alias("child_area"),
                _area(parent).alias("parent_area"),
                signed.alias("signed_gap"),
                parent["z"].alias("contact_z"),
            ),
        )

    every = F.flatten(F.transform("a_bottoms", lambda child: F.transform("b_tops", lambda parent: touch(child, parent))))
    gate = (area > G.EPS) & (overlap > G.EPS) & (aabb >= AABB_LEAST)
    return F.when(gate, F.array_max(F.array_compact(every)))


def enclosed_contact() -> Column:
    """Support by a parent whose box encloses the child's bottom near its top; (coverage, near, signed_gap, upper) or null."""
    largest = F.array_max(F.transform("a_bottoms", lambda s: F.struct(_area(s).alias("area"), s["score"], (-s["z"]).alias("low"), s.alias("s"))))["s"]
    parent = _box("b_")
    cover = _common(largest, parent) / F.greatest(_area(largest), F.lit(G.EPS))
    inside = _c("a_cx").between(_c("b_x0"), _c("b_x1")) & _c("a_cy").between(_c("b_y0"), _c("b_y1"))
    signed = largest["z"] - _c("b_z1")
    upper = F.least(F.lit(ENCLOSED_TOP_GAP), _tolerance())
    open_ = ~_c("b_label").isin(CONTAINERS) & ~_c("b_label").isin(SOFT_PARENTS) & (containment_prior() <= 0)
    ok = open_ & (_area(largest) > G.EPS) & (cover >= ENCLOSED_COVERAGE) & inside
    ok = ok & (largest["z"] - _c("b_z0") >= ENCLOSED_LIFT) & (signed <= ENCLOSED_OVERSHOOT) & (F.greatest(-signed, F.lit(0.0)) <= upper)
    return F.when(ok, F.struct(cover.alias("coverage"), (-F.abs(signed)).alias("near"), signed.alias("signed_gap"), upper.alias("upper")))


def _edge(type_: str, confidence: Column, coverage: Column, gap: Column, containment: Column, contact_z: Column) -> Column:
    """An edge, if its confidence reaches the type's least one."""
    fields = confidence.alias("confidence"), coverage.alias("coverage"), gap.alias("gap"), containment.alias("containment")
    return F.when(confidence >= LEAST[type_], F.struct(F.lit(type_).alias("type"), *fields, contact_z.alias("contact_z")))


def supported_by() -> Column:
    best, closed = _c("_contact"), _c("_enclosed")
    near = _clip(1.0 + best["near"] / F.greatest(_tolerance(), F.lit(G.EPS)))
    aabb = G.overlap_area() / _area(_box("a_"))
    plain = _clip(0.55 * best["coverage"] + 0.20 * near + 0.15 * aabb + 0.10 * rigid_prior())
    limit = F.when(closed["signed_gap"] < 0, closed["upper"]).otherwise(ENCLOSED_OVERSHOOT)
    near = _clip(1.0 + closed["near"] / F.greatest(limit, F.lit(G.EPS)))
    inner = F.least(_clip(0.50 * closed["coverage"] + 0.30 * near + 0.10 + 0.10 * rigid_prior()), F.lit(ENCLOSED_MOST))
    inner = F.when(closed.isNotNull(), inner)  # the least of null and a number is the number
    own = best.isNotNull()
    found = F.when(own, plain).otherwise(inner)
    cover, gap = F.coalesce(best["coverage"], closed["coverage"]), -F.coalesce(best["near"], closed["near"])
    return _edge("supported_by", found, cover, gap, F.lit(0.0), F.when(own, best["contact_z"]).otherwise(_c("b_z1")))


def resting_on_soft() -> Column:
    best, prior = _c("_soft"), soft_prior()
    near = _clip(1.0 + best["near"] / F.greatest(_tolerance() * SOFT_SCALE, F.lit(G.EPS)))
    found = F.when(prior > 0, _clip(0.45 * best["coverage"] + 0.25 * near + 0.30 * prior))
    return _edge("resting_on_soft_surface", found, best["coverage"], -best["near"], F.lit(0.0), best["contact_z"])


def affixed_to() -> Column:
    prior = affixed_prior()
    gaps = [F.greatest(g, F.lit(0.0)) for g in G.box_gaps()]
    total, least = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]), F.least(*gaps)
    cover = G.overlap_area() / F.greatest(_area(_box("a_")), F.lit(G.EPS))
    ok = (prior > 0) & (total <= 0.12) & ((least <= 0.06) | (cover >= 0.20))
    found = F.when(ok, _clip(0.55 * prior + 0.30 * _clip(1.0 - total / 0.12) + 0.15 * cover))
    return _edge("affixed_to", found, cover, total, F.lit(0.0), _c("b_z1"))


def contained_in() -> Column:
    largest = lambda c: F.array_max(F.transform(c, lambda s: F.struct(_area(s).alias("area"), s.alias("s"))))["s"]
    child, parent = largest("a_bottoms"), largest("b_tops")
    cover = _common(child, parent) / F.greatest(_area(child), F.lit(G.EPS))
    whole = (child["x0"] >= parent["x0"]) & (child["x1"] <= parent["x1"]) & (child["y0"] >= parent["y0"]) & (child["y1"] <= parent["y1"])
    centred = _c("a_cx").between(parent["x0"], parent["x1"]) & _c("a_cy").between(parent["y0"], parent["y1"])
    slack = 0.05 + 0.05 * (_c("b_z1") - _c("b_z0"))
    shared = F.greatest(F.least(_c("a_z1"), _c("b_z1") + slack) - F.greatest(_c("a_z0"), _c("b_z0") - slack), F.lit(0.0))
    ratio = shared / F.greatest(_c("a_z1") - _c("a_z0"), F.lit(G.EPS))
    size = _clip((_area(parent) - _area(child)) / F.greatest(_area(parent), F.lit(G.EPS)))
    ok = (_area(child) > G.EPS) & (_area(parent) > _area(child) * 1.05) & (cover >= 1 - 1e-6) & whole & centred
    ok = ok & (_c("a_z0") >= _c("b_z0") - slack) & (ratio >= 0.60)
    score = _clip(0.55 * cover + 0.15 + 0.15 * F.least(ratio, F.lit(1.0)) + 0.15 * size)
    found = F.when(ok, _clip(0.80 * score + 0.20 * containment_prior()))
    gaps = [F.greatest(g, F.lit(0.0)) for g in G.box_gaps()]
    return _edge("contained_in", found, cover, F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]), score, _c("b_z0"))


def measured(objects: DataFrame) -> DataFrame:
    """All ordered pairs of a scene with ``_contact``, ``_soft`` and ``_enclosed``."""
    soft = surface_contact(SOFT_SCALE, SOFT_HULL_LEAST, SOFT_FALLBACK_LEAST)
    return R.pairs(objects, ordered=True).withColumns({"_contact": surface_contact(), "_soft": soft, "_enclosed": enclosed_contact()})


def candidates(objects: DataFrame) -> DataFrame:
    """Candidate edges: per ordered pair the first type, in the order of the module's title, that is confident enough."""
    pair = measured(objects).withColumn("e", F.coalesce(contained_in(), affixed_to(), resting_on_soft(), supported_by()))
    return pair.filter("e is not null").select("scene_id", F.col("b_id").alias("parent_id"), F.col("a_id").alias("child_id"), "e.*")
