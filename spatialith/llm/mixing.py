"""Mixing sources to target weights by Pfair scheduling (native).

Each source's documents, in identifier order, are cut into blocks of ``block_chars`` characters.  Served fluidly, every
source gets its weight's share of each slot until it ends; then the others share in proportion to their weights.  Block k
of a source is released at the slot in which its fluid service passes k blocks, and due when that passes k + 1; while all
sources last these are floor(k / w) and ceil((k + 1) / w).  Each slot goes to the released block with the earliest
deadline.  That gives every source, at every slot, less than one block more or less than its fluid service, by the
weights as they are: they are never rounded, there may be any number of sources, and no slot stays empty.

The schedule is made in chunks of ``CHUNK`` slots, side by side.  A chunk needs to know which of the blocks whose windows
reach into it are placed before it.  The first guess, those with the earliest deadlines, is nearly always what the chunk
before it leaves; each chunk is checked against that, and chunks that started from another state are scheduled again
until none is left.  So the result is that of one pass over all slots.

All documents are kept.  A document longer than a block takes its first block's slot; its further blocks' slots hold no
document, so its source is ahead by the document's length until they have passed.

Scale: shuffles of a few bytes a document and of one row a block.  Sizes are summed per (source, range of rows), only
those sums are added up over a source, and positions within a range are windows over that range; no task holds a source.
A slot compares the blocks that reach into its chunk, ``CHUNK`` and two a source.  What is broadcast has three numbers a
source.

Edge cases: a null source is a source of its own.  Null or empty texts have size 0 and share their neighbour's block.
A null identifier sorts first; rows that repeat an identifier are ordered by size, then by their place in a file (rows
that come from elsewhere are stored first).  An empty table gives an empty result.  Weights of one source add up.
Sources that a weight table leaves out, or whose weight is not a positive finite number, get no slot and follow after all
others; weights of sources without documents are ignored.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import Scratch, located, table

CHUNK = 128
BLOCK_CHARS = 65_536
#: Exponent of a source's size in its default weight: below 1, small sources are raised.
ALPHA = 0.7
#: Slots by which fluid service may miss a whole slot and still counts as meeting it; far above rounding errors.
EPSILON = 1e-6
#: Blocks of a source that one task lists.
LISTED = 4096


def default_weights(sizes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(source, weight) from (source, size): size to the power alpha."""
    return sizes.select("source", F.pow(F.greatest("size", F.lit(1)), F.lit(alpha)).alias("weight"))


def windows(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(rank, source, k, release, deadline) of every block, from (source, weight, blocks)."""
    every = W.partitionBy()
    by_name = W.orderBy(F.asc_nulls_first("source"))
    whole = by_name.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = F.col("weight") / F.sum("weight").over(whole)
    ranked = sources.select((F.row_number().over(by_name) - 1).alias("rank"), "source", share.alias("share"), "blocks")
    ranked = scratch.keep(ranked.withColumn("ends", F.col("blocks") / F.col("share")), "sources")
    # after source j ends, at fluid time e, the slot reached at fluid time x is a + b * x
    by_end = W.orderBy("ends", "rank")
    phases = ranked.select(
        F.struct(
            F.col("ends").alias("e"),
            F.sum("blocks").over(by_end.rowsBetween(W.unboundedPreceding, 0)).cast("double").alias("a"),
            F.coalesce(F.sum("share").over(by_end.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0)).alias("b"),
        ).alias("p"),
        F.sum("share").over(every).alias("all"),
    )
    phases = phases.agg(F.array_sort(F.collect_list("p")).alias("later"), F.first("all").alias("all"))
    phases = phases.selectExpr("concat(array(named_struct('e', 0D, 'a', 0D, 'b', all)), later) as phases")
    blocks = ranked.select("rank", "source", "share", "blocks", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {LISTED})")).alias("part"))
    blocks = blocks.repartition("rank", "part").crossJoin(F.broadcast(phases))
    k = F.explode(F.expr(f"sequence(part * {LISTED}, least(blocks, (part + 1) * {LISTED}) - 1)")).alias("k")
    blocks = blocks.select("rank", "source", "share", "phases", k)

    def slot(x: str) -> str:
        return f"transform(array(element_at(filter(phases, p -> p.e <= ({x}) / share), -1)), p -> p.a + p.b * (({x}) / share))[0]"

    return blocks.selectExpr(
        "rank",
        "source",
        "k",
        f"cast(floor({slot('k')} + {EPSILON}) as long) as release",
        f"cast(ceil({slot('k + 1')} - {EPSILON}) as long) as deadline",
    )


def _schedule_chunks(starts: DataFrame, chunk: int) -> DataFrame:
    """(c, start, slots, after): from (c, jobs, start), jobs by deadline and ``start`` the ranks already placed of them.

    ``slots``: the jobs in slot order; ``after``: the ranks already placed of those that reach into the next chunk.
    """
    folded = starts.selectExpr(
        "c",
        "start",
        "jobs",
        f"""aggregate(
            sequence(c * {chunk}L, c * {chunk}L + least({chunk}L, total - c * {chunk}L) - 1),
            named_struct(
                'left', filter(jobs, x -> not (x.release < c * {chunk}L and array_contains(start, x.rank))),
                'slots', filter(jobs, x -> false)),
            (acc, t) -> transform(
                array(filter(acc.left, x -> x.release <= t)[0]),
                w -> named_struct('left', array_remove(acc.left, w), 'slots', concat(acc.slots, array(w))))[0]) as f""",
    )
    end = f"(c + 1) * {chunk}L"
    return folded.selectExpr(
        "c",
        "start",
        "f.slots as slots",
        f"""array_sort(transform(
            filter(array_except(jobs, f.left), x -> x.release < {end} and x.deadline > {end}), x -> x.rank)) as after""",
    )


def schedule(blocks: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(rank, k, slot, release, deadline) of every block of ``windows``, by earliest deadline first over all slots."""
    blocks = scratch.keep(blocks.select("rank", "k", "release", "deadline"), "windows")
    total = blocks.count()
    due = blocks.groupBy(F.expr(f"(deadline - 1) div {chunk}L").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    met = blocks.withColumn("c", F.explode(F.expr(f"sequence(release div {chunk}L, (deadline - 1) div {chunk}L)")))
    met = met.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("deadline", "rank", "k", "release"))).alias("jobs"))
    met = met.join(due, "c", "left")
    before = F.sum("n").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, -1))  # one row a chunk
    counts = scratch.keep(met.select("c", F.coalesce(before, F.lit(0)).alias("met")), "counts")
    guess = f"""array_sort(transform(slice(filter(jobs, x -> x.release < c * {chunk}L), 1, cast(c * {chunk}L - met as int)), x -> x.rank))"""
    jobs = met.select("c", "jobs").join(counts, "c").withColumn("total", F.lit(total).cast("long"))
    jobs = scratch.keep(jobs.selectExpr("c", "jobs", "total", f"{guess} as start"), "jobs")
    done = scratch.keep(_schedule_chunks(jobs, chunk), "chunks-0")
    n = 0
    while True:
        left = done.selectExpr("c + 1 as c", "after")
        wrong = done.select("c", "start").join(left, "c").filter("start <> after").select("c", F.col("after").alias("start"))
        wrong = scratch.keep(wrong, f"wrong-{n}")
        if wrong.isEmpty():
            break
        n += 1
        again = scratch.keep(_schedule_chunks(jobs.drop("start").join(wrong, "c"), chunk), f"again-{n}")
        done = scratch.keep(done.join(again.select("c"), "c", "left_anti").unionByName(again), f"chunks-{n}")
    slots = done.select("c", F.posexplode("slots").alias("at", "job"))
    return slots.select("job.rank", "job.k", (F.col("c") * chunk + F.col("at")).alias("slot"), "job.release", "job.deadline")


def _placed(
    rows: DataFrame, weights: DataFrame | None, block_chars: int, scratch: Scratch, chunk: int = CHUNK
) -> DataFrame:
    """From (_id, source, size, _file, _row): these, and block, slot, release, deadline, offset."""
    order = [F.asc_nulls_first("_id"), F.asc("size"), F.asc("_file"), F.asc("_row")]
    ranged = rows.repartitionByRange(F.asc_nulls_first("source"), *order)
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()), "sizes")
    sums = scratch.keep(ranged.groupBy("source", "part").agg(F.sum("size").alias("size")), "sums")
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    sizes = sums.groupBy("source").agg(F.sum("size").alias("size"))
    w = weights if weights is not None else default_weights(sizes)
    w = w.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    w = w.filter("weight > 0 and weight < double('Infinity')")
    counted = sizes.select("source", F.expr(f"size div {block_chars} + 1").alias("blocks"))
    counted = counted.join(w, F.col("source").eqNullSafe(F.col("_s"))).select("source", "weight", "blocks")
    names = windows(scratch.keep(counted, "weights"), scratch)
    plan = schedule(names, scratch, chunk)
    ranks = scratch.spark.read.parquet(scratch.path("sources")).select(F.col("source").alias("_s"), "rank")

    within = W.partitionBy("source", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.withColumn("_in", F.sum("size").over(within) - F.col("size"))
    placed = placed.join(
        starts.withColumnsRenamed({"source": "_t", "part": "_p"}),
        F.col("source").eqNullSafe(F.col("_t")) & (F.col("part") == F.col("_p")),
    ).withColumn("offset", F.col("start") + F.col("_in"))
    placed = placed.withColumn("block", F.floor(F.col("offset") / block_chars))
    placed = placed.join(ranks, F.col("source").eqNullSafe(F.col("_s")), "left")
    plan = scratch.keep(plan.select(F.col("rank").alias("_r"), F.col("k").alias("_k"), "slot", "release", "deadline"), "plan")
    placed = placed.join(plan, (F.col("rank") == F.col("_r")) & (F.col("block") == F.col("_k")), "left")
    return placed.select("_id", "source", "size", "_file", "_row", "block", "slot", "release", "deadline", "offset")


def _sized(at: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return at.select(
        F.col(f"doc.{id_col}").alias("_id"),
        F.col(f"doc.{source_col}").alias("source"),
        F.coalesce(F.length(f"doc.{text_col}"), F.lit(0)).cast("long").alias("size"),
        "_file",
        "_row",
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: DataFrame | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document: id, source, block, slot, release, deadline, offset (characters before it in its source).

    (slot, offset) is the training order.  ``weights``: (source, weight); else sizes to the power ``ALPHA``.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    placed = _placed(_sized(located(docs, scratch), id_col, source_col, text_col), weights, block_chars, scratch)
    names = F.col("_id").alias(id_col), F.col("source").alias(source_col)
    return placed.select(*names, "block", "slot", "release", "deadline", "offset")


def in_order(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: DataFrame | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """All rows of ``docs``, range-partitioned and sorted by training order."""
    scratch = Scratch(docs.sparkSession, "mixing")
    at = located(docs, scratch)
    order = _placed(_sized(at, id_col, source_col, text_col), weights, block_chars, scratch)
    order = order.select("_file", "_row", "slot", "offset", F.col("source").alias("_source"), F.col("size").alias("_size"))
    rows = at.join(order, ["_file", "_row"])
    last = [F.asc_nulls_first("_source"), F.asc("offset"), F.asc("_size"), F.asc("_file"), F.asc("_row")]
    keys = [F.asc_nulls_last("slot"), *last]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, length(coalesce(text, ''))::BIGINT AS size FROM documents),
z AS (SELECT source, pow(greatest(sum(size), 1)::DOUBLE, {ALPHA}) AS weight, (sum(size) // {BLOCK_CHARS} + 1)::BIGINT AS blocks FROM d GROUP BY source),
s AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, source, weight / sum(weight) OVER () AS share, blocks FROM z),
g AS (SELECT a.rank, p.k, sum(least(b.share * (p.k / a.share), b.blocks)) AS t
  FROM (SELECT rank, share, unnest(range(blocks + 1)) AS k FROM s) p JOIN s a ON a.rank = p.rank, s b GROUP BY a.rank, p.k),
j AS (SELECT x.rank, x.k, floor(x.t + {EPSILON})::BIGINT AS release, ceil(y.t - {EPSILON})::BIGINT AS deadline
  FROM g x JOIN g y ON x.rank = y.rank AND y.k = x.k + 1),
l AS (SELECT list(r ORDER BY rank) AS r, list(u ORDER BY rank) AS u, sum(len(r))::BIGINT AS total
  FROM (SELECT rank, list(release ORDER BY k) AS r, list(deadline ORDER BY k) AS u FROM j GROUP BY rank)),
edf(t, done, who, k) AS (
  SELECT 0::BIGINT, list_transform(r, lambda x: 0::BIGINT), NULL::BIGINT, NULL::BIGINT FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: x + CASE WHEN i - 1 = pick THEN 1 ELSE 0 END), pick, done[pick + 1] FROM (
    SELECT t, done, list_min(list_filter(list_transform(range(len(r)), lambda i: CASE WHEN done[i + 1] < len(r[i + 1]) AND r[i + 1][done[i + 1] + 1] <= t
      THEN {{'due': u[i + 1][done[i + 1] + 1], 'who': i}} END), lambda x: x IS NOT NULL)).who AS pick
    FROM edf, l WHERE t < total)
),
plan AS (SELECT s.source, e.k, e.t - 1 AS slot, j.release, j.deadline FROM edf e JOIN s ON s.rank = e.who JOIN j ON j.rank = e.who AND j.k = e.k),
o AS (SELECT doc_id, source, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
b AS (SELECT doc_id, source, start, start // {BLOCK_CHARS} AS block FROM o)
SELECT b.doc_id, b.source, b.block, p.slot, p.release, p.deadline, b.start AS "offset"
FROM b LEFT JOIN plan p ON b.source IS NOT DISTINCT FROM p.source AND b.block = p.k
"""
