"""Answers, options and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import CARDINAL, HORIZONTAL

NONE = "None of the above"
VERTICAL = ["above", "below"]


def parse_answer(raw: Column) -> Column:
    """The letter of a free-text reply: alone, leading, or the first that stands alone; null if there is none."""
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    found = F.coalesce(
        F.nullif(F.regexp_extract(text, r"^([ABCD])$", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"^[(\[]?([ABCD])(?:[)\].:\s-]|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"\b([ABCD])\b", 1), F.lit("")),
    )
    return found


#: Fixed patterns of explicit answers, in order.
EXPLICIT = [
    r"\bANSWER(?:\s+IS)?\s*[:\-]?\s*[(\[]?([ABCD])(?:[)\]]|\b)",
    r"\bOPTION\s+([ABCD])\b",
    r"\bI\s+CHOOSE\s+([ABCD])\b",
    r"\bMY\s+ANSWER\s+IS\s+([ABCD])\b",
]


def parse_strict(raw: Column) -> Column:
    """Like ``parse_answer``, but null when letters that stand alone disagree and none is marked as the answer."""
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    pick = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    alone = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([ABCD])\b"), F.lit(1)))
    only = F.when(F.size(alone) == 1, alone[0])
    return F.coalesce(pick(r"^([ABCD])$"), pick(r"^[(\[]?([ABCD])(?:[)\].:\s-]*)?$"), *map(pick, EXPLICIT), only)


def shuffled(values: Column, *key: Column) -> Column:
    """An array in a reproducible random order given by the key."""
    keyed = F.transform(values, lambda x: F.struct(F.md5(F.concat_ws("|", F.lit("42"), *key, x)).alias("h"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def _finish(chosen: Column, n: int, *key: Column) -> Column:
    padded = F.when(F.size(chosen) < n, F.array_append(chosen, F.lit(NONE))).otherwise(chosen)
    rest = shuffled(F.array_remove(padded, F.lit(NONE)), F.lit("order"), *key)
    return F.when(F.array_contains(padded, F.lit(NONE)), F.array_append(rest, F.lit(NONE))).otherwise(rest)


def options(correct: Column, pool: Column, *key: Column, n: int = 4) -> Column:
    """``n`` options with the correct one; verticals and horizontals keep apart while the pool allows it."""
    vertical, flat = F.array(*map(F.lit, VERTICAL)), F.array(*map(F.lit, HORIZONTAL + CARDINAL))
    avoid = F.when(F.array_contains(vertical, correct), flat).when(F.array_contains(flat, correct), vertical).otherwise(F.array().cast("array<string>"))
    others = F.array_remove(pool, correct)
    strict = F.slice(shuffled(F.array_except(others, avoid), *key), 1, n - 1)
    chosen = F.concat(F.array(correct), strict)
    spare = shuffled(F.array_except(F.array_intersect(others, avoid), chosen), *key)
    return _finish(F.slice(F.concat(chosen, spare), 1, n), n, *key)


def direction_options(correct: Column, ring: list[str], *key: Column, n: int = 4) -> Column:
    """Options from a ring of directions without the correct one's neighbours."""
    whole = F.array(*map(F.lit, ring))
    at = F.array_position(whole, correct).cast("int")
    near = F.array(F.element_at(whole, (at + 6) % 8 + 1), F.element_at(whole, at % 8 + 1))
    pool = F.when(at > 0, F.array_except(whole, near)).otherwise(whole)
    chosen = F.concat(F.array(correct), F.slice(shuffled(F.array_remove(pool, correct), *key), 1, n - 1))
    return _finish(chosen, n, *key)


def letter(options_: Column, correct: Column) -> Column:
    return F.substring(F.lit("ABCDEFGH"), F.array_position(options_, correct).cast("int"), F.lit(1))


def opposite(direction: Column) -> Column:
    """The direction seen from the other side."""
    pairs = {r[i]: r[(i + 4) % 8] for r in (HORIZONTAL, CARDINAL) for i in range(8)} | {"above": "below", "below": "above"}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(table[direction], direction)


def fill(template: str, **slots: Column) -> Column:
    """A template with named slots filled."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def preview(text: Column, limit: int = 160) -> Column:
    """White space collapsed, cut at ``limit`` with dots."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def slug(label: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def first_json(text: Column) -> Column:
    """The first object in free text, up to the last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def natural_number(name: Column) -> Column:
    """The first run of digits as a number, for natural order; -1 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("long"), F.lit(-1))
