"""Secret scans over a trigram inverted index (native).

Each rule's regex is turned, once and on the driver, into a Boolean query over trigrams: an OR of clauses, each the AND
of the trigrams that one literal spelling needs.  The index holds, for every trigram that some rule asks for, bitmaps of
the documents that contain it (case-folded), one per range of 32768 rows of a file: rows are numbered without gaps there,
whatever the identifiers.  Clauses intersect bitmaps, rules unite clauses, and the documents that are left are verified
with the regex itself.  Files are known by a hash; files that shared one would only add candidates.  A rule without mandatory trigrams (a bare
run of hexadecimal digits) has no query and scans every text.

Scale: the index is one pass that shuffles at most 4 KB per trigram and range after map-side union, and no task holds
the postings of a whole trigram.  Candidates join the documents by file and row; Catalyst broadcasts them only when their
stored size is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise.

Edge cases: null text counts as empty and has no secrets.  Identifiers play no part, so null and repeated ones are
harmless; rows that don't come straight from files are stored first, which gives them places.  An empty table gives an
empty result.  Extra columns are ignored, whatever their names.  Spans count code points, end exclusive.
"""

from __future__ import annotations

import re._parser as sre
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, located, table


def _either_case(words: str) -> str:
    """The alternation with each letter as a class of both cases."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: (kind, regex, group whose length counts, least length).  Fixed patterns; the first three are the base kinds.
RULES = [
    (
        "assign",
        f"({_either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,255}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,255}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
]
BASE = ("assign", "access", "hex")
#: A run of one class can't match shorter parts of itself, so its least length may stand in the regex.
RUNS = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}
#: Spellings that are kept apart before they are turned into clauses.
MOST_SPELLINGS = 64

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def _all(a: Clauses, b: Clauses) -> Clauses:
    return _absorb(x | y for x, y in product(a, b))


def _absorb(clauses) -> Clauses:
    """Drop clauses that a smaller clause implies."""
    found = set(clauses)
    return frozenset(x for x in found if not any(y < x for y in found))


def _spelled(strings: set[str]) -> Clauses:
    return _absorb(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _alternatives(op, arg) -> set[str] | None:
    """All case-folded strings that one parsed item matches, or None if there are many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        found = set()
        for o, a in arg:
            if o is sre.RANGE and a[1] - a[0] > 8:
                return None
            found |= {chr(a).lower()} if o is sre.LITERAL else {chr(c).lower() for c in range(a[0], a[1] + 1)}
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _strings(arg[-1])
    if op is sre.BRANCH:
        parts = [_strings(b) for b in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _strings(arg[2])
        return None if inner is None else inner | {""}
    return None


def _strings(items) -> set[str] | None:
    found = {""}
    for op, arg in items:
        own = _alternatives(op, arg)
        if own is None or len(found) * len(own) > MOST_SPELLINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def _needed(op, arg) -> Clauses:
    """What an item that can't be spelled out needs all the same."""
    if op is sre.SUBPATTERN:
        return _query(arg[-1])
    if op is sre.BRANCH:
        return _absorb(c for b in arg[1] for c in _query(b))
    if op is sre.MAX_REPEAT and arg[0] >= 1:
        return _query(arg[2])
    return ANY


def _query(items) -> Clauses:
    query, run = ANY, {""}
    for op, arg in items:
        own = _alternatives(op, arg)
        if own is not None and len(run) * len(own) <= MOST_SPELLINGS:
            run = {a + b for a in run for b in own}
            continue
        query, run = _all(query, _spelled(run)), {""}
        if own is not None and len(own) <= MOST_SPELLINGS:
            run = own
        else:
            query = _all(query, _needed(op, arg))
    return _all(query, _spelled(run))


def trigram_query(regex: str) -> Clauses | None:
    """The regex as an OR of ANDs of lower-case trigrams; None if it has no mandatory trigrams."""
    found = _query(sre.parse(regex))
    return None if frozenset() in found else found


def build_index(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, file, bucket, bitmap): postings of ``grams`` as bitmaps over ranges of a file's rows.

    ``rows``: file, row, text.
    """
    folded = rows.select("file", "row", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return (
        folded.select("file", "row", F.explode(held).alias("gram"))
        .groupBy("gram", "file", F.bitmap_bucket_number("row").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bitmap"))
    )


def candidates(index: DataFrame, queries: dict[int, Clauses]) -> DataFrame:
    """(file, row, mask): documents that a rule's query lets through; bit r of the mask is rule r."""
    clauses = [
        (rule, n, gram, len(clause))
        for rule, q in queries.items()
        for n, clause in enumerate(sorted(map(sorted, q)))
        for gram in clause
    ]
    rows = ", ".join(f"({r}, {n}, '{g.replace(chr(39), chr(39) * 2)}', {k})" for r, n, g, k in clauses)
    wanted = index.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(rule, clause, gram, n)")
    both = index.join(F.broadcast(wanted), "gram").groupBy("rule", "clause", "file", "bucket", "n")
    both = both.agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("found")).filter("found = n")
    either = both.groupBy("rule", "file", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    positions = F.expr(
        """flatten(transform(
            filter(
                transform(sequence(0, 4095), j -> struct(j, cast(conv(hex(substring(bitmap, j + 1, 1)), 16, 10) as int) as b)),
                x -> x.b != 0),
            x -> transform(filter(sequence(0, 7), k -> (shiftright(x.b, k) & 1) = 1), k -> x.j * 8 + k)))"""
    )
    at = either.select("rule", "file", "bucket", F.explode(positions).alias("p"))
    # the inverse of bitmap_bucket_number and bitmap_bit_position
    row = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + F.col("p") + 1).otherwise(
        F.col("bucket") * 32768 - F.col("p")
    )
    return (
        at.select("file", row.alias("row"), F.expr("shiftleft(1, rule)").alias("m"))
        .groupBy("file", "row")
        .agg(F.bit_or("m").alias("_mask"))
    )


def _spans(text: Column, order: int, kind: str, regex: str, group: int, least: int) -> Column:
    """array<struct<start,ord,kind,stop>> of one rule's leftmost matches that are long enough."""
    pattern = F.lit(regex)
    parts = F.arrays_zip(
        F.split(text, regex, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(group)).alias("value"),
    )
    kinds = "array<struct<start:int,ord:int,kind:string,stop:int>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), stop.alias("stop"))
        add = F.length(x["value"]) >= least
        return F.struct(stop.alias("at"), F.when(add, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, first, step, lambda acc: acc["found"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` id and text with ``spans``: array of (start, ord, kind, stop), sorted by start, then kind."""
    scratch = Scratch(docs.sparkSession, "secrets")
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r[1]))}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    text = F.coalesce(F.col(f"doc.{text_col}"), F.lit("")).alias("text")
    rows = located(docs, scratch)
    rows = rows.select(F.col(f"doc.{id_col}").alias("id"), text, F.xxhash64("_file").alias("file"), F.col("_row").alias("row"))
    index = scratch.keep(build_index(rows, grams), "index")
    found = scratch.keep(candidates(index, queries), "candidates")
    rows = rows.join(found, ["file", "row"], "left")
    spans = []
    for i, (kind, regex, group, least) in enumerate(rules):
        run = RUNS.get(kind, regex)
        look = F.col("text").rlike(run)
        if i in queries:
            look = (F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0) & look
        none = F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int>>")
        spans.append(F.when(look, _spans(F.col("text"), i, kind, run, group, least)).otherwise(none))
    return rows.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.array_sort(F.concat(*spans)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(F.encode(_written(base), "UTF-8"), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
    )


def _oracle() -> str:
    def one(i: int, kind: str, regex: str, group: int, least: int) -> str:
        p = regex.replace("'", "''")
        return f"""SELECT doc_id, {i} AS ord, '{kind}' AS kind, unnest(list_transform(list_filter(range(len(h)), lambda i: length(v[i + 1]) >= {least}),
            lambda i: {{'start': coalesce(list_sum(list_transform(g[1:i + 1], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(h[1:i], lambda x: length(x))), 0)::BIGINT, 'n': length(h[i + 1])}})) AS s
        FROM (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}'))"""

    every = " UNION ALL ".join(one(i, *r) for i, r in enumerate(RULES))
    counts = ", ".join(f"(count(*) FILTER (kind = '{k}'))::BIGINT AS n_{k}" for k in BASE)
    base = ", ".join(f"'{k}'" for k in BASE)
    line = "kind || ':' || s.start || ':' || (s.start + s.n)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({every}),
a AS (SELECT doc_id, {counts},
  coalesce(string_agg({line}, ',' ORDER BY s.start, ord) FILTER (kind IN ({base})), '') AS base,
  string_agg({line}, ',' ORDER BY s.start, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


ORACLE = _oracle()
