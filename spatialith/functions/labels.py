"""Labels of objects: canonical names, and which labels are left out of every scene."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Singular names and sub-categories, and their canonical names.
SINGULAR = {
    "couch": "sofa",
    "nightstand": "night stand",
    "bedside table": "night stand",
    "bedside cabinet": "night stand",
    "bedside stand": "night stand",
    "tv": "television",
    "mug": "cup",
    "coffee mug": "cup",
    "backpack": "bag",
    "fridge": "refrigerator",
    "refridgerator": "refrigerator",
    "footstool": "ottoman",
    "garbage bin": "trash can",
    "waste bin": "trash can",
    "wastebasket": "trash can",
    "compost bin": "trash can",
    "keyboard piano": "piano",
    "folded ladder": "ladder",
    "stepladder": "ladder",
    "washer": "washing machine",
    "laundry dryer": "clothes dryer",
    "paper towel": "towel",
    "paper towel roll": "towel",
    "washcloth": "towel",
    "wardrobe closet": "wardrobe",
    "wardrobe cabinet": "wardrobe",
    "closet wardrobe": "wardrobe",
    "kitchen cabinet": "cabinet",
    "bathroom cabinet": "cabinet",
    "file cabinet": "cabinet",
    "kitchen counter": "counter",
    "storage box": "storage container",
    "storage bin": "storage container",
    "trash bin": "trash can",
    "recycling bin": "trash can",
    "sofa chair": "chair",
    "armchair": "chair",
    "office chair": "chair",
    "dining chair": "chair",
    "folding chair": "chair",
    "coffee table": "table",
    "dining table": "table",
    "mini fridge": "refrigerator",
    "hamper": "laundry basket",
    "laundry hamper": "laundry basket",
    "laundry bag": "laundry basket",
    "container": "storage container",
    "plastic container": "storage container",
    "plastic storage bin": "storage container",
    "food container": "storage container",
    "tupperware": "storage container",
    "potted plant": "plant",
    "shower wall": "wall",
    "ceiling fan": "fan",
}
#: The same for plurals.
PLURAL = {
    "couches": "sofas",
    "washers": "washing machines",
    "laundry dryers": "clothes dryers",
    "book shelves": "bookshelves",
    "kitchen cabinets": "cabinets",
    "bathroom cabinets": "cabinets",
    "file cabinets": "cabinets",
    "plastic containers": "storage containers",
}
#: Plurals that a class map must not turn into singulars.
KEPT_PLURALS = [
    "books", "doors", "curtains", "shoes", "clothes", "cabinets", "papers", "pipes", "mailboxes", "suitcases", "bookshelves",
    "wardrobes", "washing machines", "clothes dryers", "sofas", "couches", "washers", "laundry dryers", "book shelves",
    "kitchen cabinets", "bathroom cabinets", "file cabinets", "plastic containers", "storage containers",
]
#: Names that keep themselves though a class map calls them "otherprop".
KEPT_PROPS = [
    "backpack", "plant", "potted plant", "stool", "computer tower", "keyboard", "microwave", "suitcase", "suitcases",
    "luggage", "laptop", "printer", "copier", "clock", "basket", "laundry basket", "laundry hamper", "towel", "cup",
    "bottle", "plate", "bowl", "bin", "storage container", "bicycle", "guitar", "speaker", "subwoofer", "vacuum cleaner",
    "fire extinguisher",
]
#: Names that keep themselves though a class map calls them "otherfurniture".
KEPT_FURNITURE = [
    "radiator", "trash can", "washing machine", "clothes dryer", "piano", "wardrobe", "ladder", "water cooler",
    "ironing board", "bench", "ottoman", "drawer", "tv stand",
]
#: Labels left out, before closure under the maps.
EXCLUDED = [
    "floor", "wall", "ceiling", "room", "ground", "door", "window", "stairs", "pillar", "column", "doorframe",
    "windowsill", "hand rail", "shower", "shower curtain rod", "bathroom stall", "bathroom stall door", "ledge",
    "structure", "closet", "breakfast bar", "shower curtain", "", "object", "otherfurniture", "otherprop",
    "otherstructure", "unknown", "misc", "stuff", "mirror", "glass", "monitor", "tv", "television", "case", "tube",
    "board", "sign", "frame", "paper", "lotion", "person", "people", "human", "man", "woman", "boy", "girl", "child",
    "children", "blanket", "cloth", "clothes", "clothing", "rug", "lamp", "power outlet", "light switch", "fire alarm",
    "controller", "power strip", "soda can", "starbucks cup", "battery disposal jar", "can", "water bottle",
    "paper cutter", "doors", "papers",
]
#: Fixed limit in metres: an object whose bottom is lower stands on the floor.
FLOOR = 0.10


def canonical(label: Column) -> Column:
    """The canonical name by the fixed tables, else the label itself."""
    names = F.create_map(*map(F.lit, chain(*(SINGULAR | PLURAL).items())))
    return F.coalesce(names[label], label)


def normalized(objects: DataFrame, classes: DataFrame | None = None, label_col: str = "label") -> DataFrame:
    """Adds ``normal``: the label trimmed, in lower case, by the fixed tables and, if given, a class map.

    ``classes``: (raw, class); of a raw name that repeats, the class that comes last in order counts.  The map is a
    lookup table; Catalyst broadcasts it while it is small.  A null label counts as empty.
    """
    low = F.lower(F.trim(F.coalesce(F.col(label_col), F.lit(""))))
    rows = objects.withColumn("_low", low)
    own = canonical(F.col("_low"))
    if classes is None:
        return rows.withColumn("normal", canonical(own)).drop("_low")
    known = classes.select(F.lower(F.trim("raw")).alias("_low"), F.lower(F.trim("class")).alias("_class"))
    known = known.filter("_low <> '' and _class <> ''").groupBy("_low").agg(F.max("_class").alias("_class"))
    rows = rows.join(known, "_low", "left")

    def either(names: list[str]) -> Column:
        return F.col("_low").isin(names) | own.isin(names)

    keep = either(KEPT_PLURALS) | ((F.col("_class") == "otherprop") & either(KEPT_PROPS))
    keep = keep | ((F.col("_class") == "otherfurniture") & either(KEPT_FURNITURE))
    name = F.when(F.col("_class").isNull() | keep, own).otherwise(F.col("_class"))
    return rows.withColumn("normal", canonical(name)).drop("_low", "_class")


def excluded_labels(classes: dict[str, str] | None = None) -> list[str]:
    """The excluded labels, closed under the fixed tables and a class map; a constant of the plan."""
    names, found, todo = SINGULAR | PLURAL, set(), set(EXCLUDED)
    while todo:
        found |= todo
        own = {x: names.get(x, x) for x in todo}
        mapped = {(classes or {}).get(x) for x in todo if x not in KEPT_PLURALS and own[x] not in KEPT_PLURALS}
        todo = {x for x in {*own.values(), *mapped} if x is not None} - found
    return sorted(found)


def on_floor(z0: Column) -> Column:
    return z0 < FLOOR
