"""Near-duplicate documents: a chosen-path join on the Jaccard similarity of five-word shingles.

1. Every text becomes its set of distinct shingle hashes; texts with equal sets form a class, and one document stands
   for its class from here on.  A class carries a bottom-k sketch of its set (``SKETCH`` smallest hashes).
2. Chosen paths: in each of several runs a class samples tokens of its sketch by a hash that all classes share, about
   1 / threshold of them, and lies in one bucket per token.  Buckets of more than ``SMALL`` classes are split again by
   tokens sampled in the same way for that path, up to ``LEVELS`` times.  What is still large then, such as a big group
   of true near copies, is cut into blocks of about ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles, and pairs of blocks
   are compared, so that no task holds a large bucket.
3. In each bucket all pairs are compared by sketch.  A pair that shares several buckets counts in the first one alone.
4. Classes with a candidate get their text back and pairs are verified on the full sets, again bucket by bucket.  Each
   bucket returns one row per class (weight of verified partners, smallest partner reached), never a row per pair.
5. Links are summed per class, and classes that links connect are united by contraction rounds.

The number of runs follows from the target recall: a pair exactly at the threshold survives ``LEVELS`` splits in one run
with a known probability, and runs repeat until the chance that all of them miss it is below 1 - ``RECALL``.

Edge cases: null text counts as empty.  Words are lower-cased (A-Z) and split at ASCII white space.  A text of one to
four words is one shingle; a text without words has no shingles and links with nothing.  Documents with a null
identifier get no links and a null class.  Rows that repeat an identifier count as documents of their own: classes have
numbers of their own and rows are told apart by their place in a file (rows that come from elsewhere are stored first),
so of a group exactly one row is kept, the first by identifier, file and position.  An empty table gives an empty
result.  Extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as B
from .components import components
from .store import Scratch, located, table

THRESHOLD = 0.8
SKETCH = 64
#: Least sketch estimate of a candidate: four standard errors of the estimate below the threshold.
SKETCH_MARGIN = 4
SMALL = 256
LEVELS = 3
#: Bounds on a block of a large bucket: classes, and shingles of all of them.
BLOCK = 256
BLOCK_SHINGLES = 1 << 21
RECALL = 0.99
#: Buckets up to this size are compared pair by pair, larger ones by matrix products.
PAIRWISE = 24


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, though its buckets were all split.

    A node's shared children are Poisson distributed with mean 1: each class samples 1 / threshold tokens, and a pair
    shares at least the threshold of them.
    """
    lives = 1.0
    for _ in range(levels):
        lives = 1 - math.exp(-lives)
    return math.ceil(math.log(1 - recall) / math.log(1 - lives))


def set_digests(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set of hashes."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix64(values ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(B.mix64(sums[edges[1:]] - sums[edges[:-1]] + np.diff(edges).astype(np.uint64)).astype(np.int64))
    return out[0], out[1]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in B.text_chunks(batch.column(1)):
            values, edges = B.shingles(texts)
            d1, d2 = set_digests(values, edges)
            small = (values >> np.uint64(16)).astype(np.uint32)
            sketch = [small[x : min(y, x + SKETCH)].tobytes() for x, y in zip(edges, edges[1:], strict=False)]
            place = [batch.column(k).slice(a, b - a) for k in (0, 2, 3)]
            columns = [*place, pa.array(np.diff(edges)), pa.array(d1), pa.array(d2), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "file", "row", "n", "d1", "d2", "sketch"])


def _paths(threshold: float, runs: int) -> Callable:
    """Maps (path or null, id, n, sketch) to (path, id, n): the buckets one level down."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sketches = batch.column(3).to_pylist()
            size = np.array([len(s) // 4 for s in sketches])
            token = np.frombuffer(b"".join(sketches), np.uint32).astype(np.uint64)
            row = np.repeat(np.arange(len(size)), size)
            limit = np.minimum(2.0**64 / (threshold * np.maximum(size, 1)), 2.0**64 - 2048).astype(np.uint64)[row]
            root = batch.column(0).null_count == batch.num_rows
            start = np.zeros(len(ids), np.uint64) if root else batch.column(0).to_numpy().astype(np.uint64)
            for run in range(runs if root else 1):
                seed = B.mix64(start + np.uint64((run * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1)))[row]
                taken = np.flatnonzero(B.mix64(token * np.uint64(0xFF51AFD7ED558CCD) + seed) < limit)
                path = B.mix64(seed[taken] ^ B.mix64(token[taken])).astype(np.int64)
                who = row[taken]
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(ids[who]), pa.array(n[who])], ["path", "id", "n"])

    return choose


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by ``keys``: tables of complete groups, with the groups' offsets."""
    held: list[pa.RecordBatch] = []

    def edges(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        at = edges(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]).combine_chunks(), at
            held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.concatenate([edges(t), [t.num_rows]])


def _pairs(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each group."""
    size = np.diff(edges)
    row = np.arange(edges[0], edges[-1])
    later = np.repeat(edges[1:], size) - row - 1
    left = np.repeat(row, later)
    first = np.concatenate([[0], np.cumsum(later)])[:-1]
    return left, left + 1 + np.arange(len(left)) - np.repeat(first, later)


def _ragged(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of longs."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = a.offsets.to_numpy().astype(np.int64)
    return a.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _padded(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As a matrix, and where it is filled."""
    size = np.diff(edges)
    at = np.arange(max(int(size.max(initial=0)), 1))
    mask = at < size[:, None]
    out = np.zeros(mask.shape, values.dtype)
    out[mask] = values
    return out, mask


def _shared(values: np.ndarray, edges: np.ndarray, rows: range) -> np.ndarray:
    """Matrix of common elements of the rows' sets, by products of 0/1 matrices over the elements that several have."""
    own = values[edges[rows.start] : edges[rows.stop]]
    who = np.repeat(np.arange(len(rows)), np.diff(edges[rows.start : rows.stop + 1]))
    _, place, times = np.unique(own, return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    use = often[place]
    col, who = number[place[use]], who[use]
    total = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    for a in range(0, int(often.sum()), 4096):
        x, y = np.searchsorted(col, [a, a + 4096])
        part = np.zeros((len(rows), 4096), np.float32)
        part[who[x:y], col[x:y] - a] = 1
        total += part @ part.T
    return total


def _first_meeting(t: pa.Table) -> tuple[Callable, Callable]:
    """Whether a pair of rows meets for the first time in its bucket: by pairs, and as a matrix for one group."""
    values, edges = _ragged(t.column("paths"))
    path = t.column("path").to_numpy()
    earlier = values < np.repeat(path, np.diff(edges))
    owner = np.repeat(np.arange(len(path)), np.diff(edges))[earlier]
    values = values[earlier]
    edges = np.searchsorted(owner, np.arange(len(path) + 1))
    grid, mask = _padded(values, edges)
    # empty cells hold values that no other cell has; paths are even, these odd
    fill = (np.arange(grid.size, dtype=np.int64).reshape(grid.shape) << 1) | 1
    grid = np.where(mask, grid & ~1, fill)

    def by_pair(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both = np.sort(np.concatenate([grid[i], grid[j]], 1), axis=1)
        return ~(both[:, 1:] == both[:, :-1]).any(1)

    def by_group(rows: range) -> np.ndarray:
        return _shared(values & ~1, edges, rows) == 0

    return by_pair, by_group


def _compare(t: pa.Table, at: np.ndarray, similar_pairs: Callable, similar_group: Callable) -> tuple[np.ndarray, ...]:
    """Pairs of rows that are similar and meet first in this bucket, over all groups."""
    new_pairs, new_group = _first_meeting(t)
    block = t.column("block").to_numpy()
    across = t.column("bi").to_numpy() != t.column("bj").to_numpy()
    size = np.diff(at)
    lefts, rights = [], []
    for lo in range(0, len(size), 4096):  # small groups together
        hi = min(lo + 4096, len(size))
        keep = np.flatnonzero((size[lo:hi] > 1) & (size[lo:hi] <= PAIRWISE)) + lo
        if not len(keep):
            continue
        parts = [_pairs(at[g : g + 2]) for g in keep] if len(keep) < hi - lo else [_pairs(at[lo : hi + 1])]
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        ok = ~across[i] | (block[i] != block[j])
        i, j = i[ok], j[ok]
        for a in range(0, len(i), 50_000):
            x, y = i[a : a + 50_000], j[a : a + 50_000]
            ok = new_pairs(x, y)
            x, y = x[ok], y[ok]
            ok = similar_pairs(x, y)
            lefts.append(x[ok])
            rights.append(y[ok])
    for g in np.flatnonzero(size > PAIRWISE):
        rows = range(at[g], at[g + 1])
        good = similar_group(rows) & new_group(rows)
        if across[rows.start]:
            b = block[rows.start : rows.stop]
            good &= b[:, None] != b[None, :]
        x, y = np.nonzero(np.triu(good, 1))
        lefts.append(x + rows.start)
        rights.append(y + rows.start)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def _candidates(threshold: float) -> Callable:
    least = threshold - SKETCH_MARGIN * math.sqrt(threshold * (1 - threshold) / SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["path", "bi", "bj"]):
            n = t.column("n").to_numpy()
            raw = t.column("sketch").to_pylist()
            edges = np.concatenate([[0], np.cumsum([len(s) // 4 for s in raw])])
            values = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
            grid, mask = _padded(values, edges)
            last = np.where(mask, grid, 0).max(1)
            full = n > SKETCH  # a smaller set is its own sketch
            top = np.where(full, last, np.iinfo(np.int64).max)
            blank = (np.arange(grid.size, dtype=np.int64).reshape(grid.shape) + 1) * -1
            grid = np.where(mask, grid, blank)

            def by_pair(i, j, n=n, grid=grid, mask=mask, top=top):
                ok = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
                cut = np.minimum(top[i], top[j])[:, None]
                a, b = grid[i], grid[j]
                in_a, in_b = (mask[i] & (a <= cut)).sum(1), (mask[j] & (b <= cut)).sum(1)
                both = np.sort(np.concatenate([a, b], 1), axis=1)
                same = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] <= cut)).sum(1)
                return ok & (same >= least * np.maximum(in_a + in_b - same, 1))

            def by_group(rows, n=n, values=values, edges=edges):
                # of all sketch tokens; a pair above the threshold shares at least this many of the smaller sketch
                same = _shared(values, edges, rows)
                s = np.diff(edges[rows.start : rows.stop + 1])
                m = n[rows.start : rows.stop]
                sizes = np.minimum(m[:, None], m[None]) >= threshold * np.maximum(m[:, None], m[None])
                return sizes & (same >= least * np.minimum(s[:, None], s[None]))

            i, j = _compare(t, at, by_pair, by_group)
            rows = np.unique(np.concatenate([i, j]))
            if len(rows):
                yield t.select(["path", "bi", "bj", "block", "id"]).take(pa.array(rows)).combine_chunks().to_batches()[0]

    return run


def _local_roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest identifier that links reach from each row."""
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        if (root == before).all():
            return root


def _verify(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["path", "bi", "bj"]):
            for lo, hi in _parts(t, at):
                yield from one(t.slice(at[lo], at[hi] - at[lo]).combine_chunks(), at[lo : hi + 1] - at[lo])

    def one(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts = t.column("text").to_pylist()
        parts = [B.shingles(texts[a:b]) for a, b in B.chunks(texts)]
        values = np.concatenate([v for v, _ in parts])
        edges = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in parts]))])
        d1, _ = set_digests(values, edges)
        ids, weight, n = t.column("id").to_numpy(), t.column("weight").to_numpy(), np.diff(edges)
        if (d1 != t.column("d1").to_numpy()).any():
            raise ValueError("a text is not the one that its class was made from")

        def by_pair(i, j):
            good = np.zeros(len(i), bool)
            maybe = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
            for k in np.flatnonzero(maybe):
                both = np.concatenate([values[edges[i[k]] : edges[i[k] + 1]], values[edges[j[k]] : edges[j[k] + 1]]])
                both.sort(kind="stable")
                same = np.count_nonzero(both[1:] == both[:-1])
                good[k] = same >= threshold * (len(both) - same) - 1e-9
            return good

        def by_group(rows):
            same = _shared(values, edges, rows)
            m = n[rows.start : rows.stop]
            return same >= threshold * (m[:, None] + m[None] - same) - 1e-6

        i, j = _compare(t, at, by_pair, by_group)
        links = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
        rows = np.unique(np.concatenate([i, j]))
        if len(rows):
            root = _local_roots(i, j, ids)
            columns = [pa.array(ids[rows]), pa.array(links[rows].astype(np.int64)), pa.array(root[rows])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "links", "root"])

    return run


def _parts(t: pa.Table, at: np.ndarray, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of groups with about ``limit`` characters of text together."""
    size = np.array([len(x) if x else 0 for x in t.column("text").to_pylist()])
    total = np.concatenate([[0], np.cumsum(size)])[at]
    lo = 0
    for hi in range(1, len(at)):
        if hi == len(at) - 1 or total[hi + 1] - total[lo] > limit:
            yield lo, hi
            lo = hi


def _buckets(reps: DataFrame, scratch: Scratch, threshold: float, runs: int, small: int, levels: int) -> DataFrame:
    """(path, id, n, size, total): final buckets of at least two classes, with their classes and shingles counted."""
    schema = "path long, id long, n long"
    choose = _paths(threshold, runs)
    found: DataFrame | None = None
    rows = reps.select(F.lit(None).cast("long").alias("path"), "id", "n", "sketch").mapInArrow(B.tidy(choose), schema)
    for level in range(1, levels + 1):
        # the same bucket by two tokens of one path is one bucket
        rows = scratch.keep(rows.distinct() if level > 1 else rows, f"paths-{level}")
        # stored, so that both sides of the join are plain shuffles and a path that many share can be split
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).filter("size > 1")
        sizes = scratch.keep(sizes, f"sizes-{level}")
        rows = scratch.keep(rows.join(sizes, "path"), f"buckets-{level}")
        scratch.drop(f"paths-{level}")
        done = rows if level == levels else rows.filter(F.col("size") <= small)
        found = done if found is None else found.unionByName(done)
        large = rows.filter(F.col("size") > small)
        if level == levels or large.isEmpty():
            break
        rows = large.join(reps.select("id", "sketch"), "id").select("path", "id", "n", "sketch").mapInArrow(B.tidy(choose), schema)
    return found


def _grouped(
    rows: DataFrame, scratch: Scratch, threshold: float, runs: int | None, small: int, levels: int, block: int
) -> DataFrame:
    """From (doc, file, row, text): (doc, file, row, class_id, n_links, kept)."""
    runs = runs or runs_needed(threshold, RECALL, levels)
    signature = "doc long, file string, row long, n long, d1 long, d2 long, sketch binary"
    signed = rows.select("doc", "text", "file", "row").mapInArrow(B.tidy(_signatures), signature)
    signed = scratch.keep(signed, "signatures")
    classes = signed.filter("n > 0 and doc is not null").groupBy("d1", "d2", "n", "sketch")
    classes = classes.agg(F.min(F.struct("doc", "file", "row")).alias("rep"), F.count(F.lit(1)).alias("weight"))
    # a class is known by a number of its own: identifiers may repeat with other texts
    reps = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    found = _buckets(reps, scratch, threshold, runs, small, levels)
    paths = found.groupBy("id").agg(F.collect_set("path").alias("paths"))
    known = scratch.keep(reps.join(paths, "id"), "members")
    keys = ["path", "bi", "bj"]

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys)

    # sketches join the buckets before blocks repeat them
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = found.join(known.select("id", "sketch", "paths"), "id")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    bounds = F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")
    with_sketch = dealt.select("path", "id", "block", *bounds, "n", "sketch", "paths")
    active = by_bucket(with_sketch).mapInArrow(B.tidy(_candidates(threshold)), "path long, bi int, bj int, block int, id long")
    active = scratch.keep(active, "active")
    texts = active.join(known.select("id", "weight", "d1", "paths", "rep.file", "rep.row"), "id")
    texts = texts.join(rows.select("file", "row", "text"), ["file", "row"]).drop("file", "row")
    checked = by_bucket(texts).mapInArrow(B.tidy(_verify(threshold)), "id long, links long, root long")
    checked = scratch.keep(checked, "links")

    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    united = components(checked.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    linked = reps.select("id", "rep").join(links, "id").join(united, "id", "left")
    linked = scratch.keep(linked.withColumn("component", F.coalesce("component", "id")), "linked")
    first = linked.groupBy("component").agg(F.min("rep").alias("first"))
    per_class = reps.join(linked.join(first, "component").select("id", "links", "first"), "id", "left")
    per_class = per_class.select("d1", "d2", "n", "weight", "links", F.coalesce("first", "rep").alias("first"))
    out = signed.select("doc", "file", "row", "n", "d1", "d2")
    out = out.join(scratch.keep(per_class, "per-class"), ["d1", "d2", "n"], "left")
    in_class = F.col("doc").isNotNull() & F.col("first").isNotNull()
    return out.select(
        "doc",
        "file",
        "row",
        F.when(in_class, F.col("first.doc")).otherwise(F.col("doc")).alias("class_id"),
        F.when(in_class, F.coalesce("links", F.lit(0)) + F.col("weight") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(in_class, F.col("first") == F.struct("doc", "file", "row")).otherwise(F.lit(True)).alias("kept"),
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their places, and (doc, file, row, text) of them."""
    at = located(docs, scratch)
    names = F.col(f"doc.{id_col}").cast("long").alias("doc"), F.col("_file").alias("file"), F.col("_row").alias("row")
    return at, at.select(*names, F.col(f"doc.{text_col}").alias("text"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    runs: int | None = None,
    small: int = SMALL,
    levels: int = LEVELS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, class_id (smallest identifier that links reach), n_links, kept (the class's one row)."""
    scratch = Scratch(docs.sparkSession, "jaccard-join")
    _, rows = _placed(docs, id_col, text_col, scratch)
    found = _grouped(rows, scratch, threshold, runs, small, levels, block)
    return found.select(F.col("doc").alias(id_col), "class_id", "n_links", "kept")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    runs: int | None = None,
    small: int = SMALL,
    levels: int = LEVELS,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns."""
    scratch = Scratch(docs.sparkSession, "jaccard-join")
    at, rows = _placed(docs, id_col, text_col, scratch)
    gone = _grouped(rows, scratch, threshold, runs, small, levels, block).filter(~F.col("kept"))
    gone = gone.select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    return at.join(gone, ["_file", "_row"], "left_anti").select("doc.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, a.n + b.n AS t FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE c >= 0.8 * (t - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, c.c AS class_id, coalesce(n.n, 0)::BIGINT AS n_links, d.doc_id = c.c AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.a = d.doc_id
"""
