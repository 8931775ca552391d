"""Exact deduplication by stateful streaming (native).

A structured stream folds one small row per document (digest, identifier, content locator) into RocksDB state keyed by
digest.  Texts never enter the state.  Digests that more than one row has (hits) are then checked on full bytes, read
again by their locators; texts that share a digest but not their bytes are grouped by the bytes themselves.

The state has no watermark and so never expires.  With ``state``, a folder that outlives the run, a later run starts from
the same checkpoint: it recognises every digest of all runs before it, and checks hits against the bytes of earlier
documents, whose files must still be there.  Each row of documents must be given to one run only; a run that fails may
be repeated with ``state`` as it was before it.  Without ``state`` a run starts from nothing.

Scale: the stream shuffles about 100 bytes a document, pre-aggregated per task, so a text with any number of copies
sends one row per task and digest.  Full texts are shuffled once, by document and not by digest, to find the hits'
texts.  Their minimum and maximum per digest are aggregated per task, then per digest and group of tasks, then per
digest, so of a hot text no task gets more than about the square root of the number of tasks.

Edge cases: null text counts as empty; empty texts are equal to each other.  A row with a null identifier takes part and
loses to any other identifier.  Rows that repeat an identifier and a text are one group; of them one row stays (the
locator, file and row number, breaks the tie; rows that don't come straight from files are stored first).  An empty
table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch, located, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; null gives the empty string.  ASCII texts take the fast path."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(
        F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)
    )


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _keyed(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Of rows with their places: identifier, normalised text, digest, and where the content lies."""
    norm = ascii_lower(F.col(f"doc.{text_col}")).alias("_norm")
    return rows.select(F.col(f"doc.{id_col}").alias("_id"), norm, "_file", "_row").withColumn("_digest", digest(F.col("_norm")))


def fold_stream(keys: DataFrame, root: str, files_per_trigger: int | None = None) -> DataFrame:
    """Run the stateful stream over the files below ``root``/keys that no run before has read.

    Returns one row per digest of all runs: ``_n`` rows, and ``_keep`` with the identifier and locator of the row that
    stays.
    """
    spark = keys.sparkSession
    reader = spark.readStream.schema(keys.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    state = (
        reader.parquet(f"{root}/keys")
        .groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_file", "_row")).alias("_keep"))
    )
    updates = f"{root}/updates"
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # a store per partition: preallocated log files would outweigh the state
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{root}/checkpoint")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{updates}/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = T.StructType([*state.schema, T.StructField("batch", T.IntegerType())])
    ran = any(p["numInputRows"] for p in query.recentProgress)
    latest = spark.read.schema(schema).parquet(updates) if ran else spark.createDataFrame([], schema)
    return (
        latest.groupBy("_digest")
        .agg(F.max(F.struct("batch", "_n", "_keep")).alias("s"))
        .select("_digest", "s._n", "s._keep")
    )


def _groups(
    rows: DataFrame,
    id_col: str,
    text_col: str,
    digest: Callable[[Column], Column],
    files_per_trigger: int | None,
    scratch: Scratch,
    state: str | None,
) -> DataFrame:
    """Per row of ``rows`` (doc, _file, _row): _id, _file, _row, _sha, _n, _keep."""
    spark = scratch.spark
    root = (state or scratch.path("state")).rstrip("/")
    full = _keyed(rows, id_col, text_col, digest)
    sha = F.col("_digest") if digest is sha256_hex else sha256_hex(F.col("_norm"))
    keys = scratch.keep(full.select("_id", "_file", "_row", "_digest", sha.alias("_sha")), "keys")
    keys.write.mode("append").parquet(f"{root}/keys")
    groups = scratch.keep(fold_stream(keys, root, files_per_trigger), "groups")
    member = keys.join(groups, "_digest")
    hits = member.filter("_n > 1").select("_id", F.col("_digest").alias("_d"))
    if state:  # earlier rows of this run's digests; their texts are read from where they lie
        hit = hits.select(F.col("_d").alias("_digest")).distinct()
        earlier = spark.read.schema(keys.schema).parquet(f"{root}/keys").join(hit, "_digest", "left_semi")
        earlier = scratch.keep(earlier.join(keys, ["_file", "_row"], "left_anti"), "earlier")
        files = [r[0] for r in earlier.select("_file").distinct().collect()]  # one a file, not a row
        if files:
            old = spark.read.parquet(*files)
            doc = F.col("doc") if old.columns == ["doc"] else F.struct(*old.columns).alias("doc")
            old = old.select(doc, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
            old = old.join(earlier.select("_file", "_row"), ["_file", "_row"], "left_semi")
            full = full.unionByName(_keyed(old, id_col, text_col, digest))
            hits = hits.unionByName(earlier.select("_id", F.col("_digest").alias("_d")))
    texts = full.alias("f").join(
        hits.alias("h"), F.col("f._id").eqNullSafe(F.col("h._id")) & (F.col("f._digest") == F.col("h._d")), "left_semi"
    )
    # a task's own pre-aggregate goes to its group of tasks first, so that no task gets a hot text from all others
    salts = math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    salted = texts.withColumn("_salt", F.spark_partition_id() % salts)
    least = salted.groupBy("_digest", "_salt").agg(F.min("_norm").alias("_a"), F.max("_norm").alias("_b"))
    same = least.groupBy("_digest").agg((F.min("_a") == F.max("_b")).alias("_same"))
    differ = scratch.keep(same.filter("not _same").select("_digest"), "differ")
    if not differ.isEmpty():
        member = _by_bytes(full, member, keys, differ, scratch)
    return member


def _marked(member: DataFrame) -> DataFrame:
    tie = F.col("_keep._id").eqNullSafe(F.col("_id"))
    kept = tie & F.col("_keep._file").eqNullSafe(F.col("_file")) & F.col("_keep._row").eqNullSafe(F.col("_row"))
    return member.withColumn("_kept", kept)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    files_per_trigger: int | None = None,
    state: str | None = None,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, and the row's locator.

    ``state``: a shared folder's URI; groups then span all runs that named it, as far as they have come.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    member = _groups(located(docs, scratch), id_col, text_col, digest, files_per_trigger, scratch, state)
    return _marked(member).select(
        F.col("_id").alias(id_col),
        F.col("_keep._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
        "_file",
        "_row",
    )


def _by_bytes(full: DataFrame, member: DataFrame, keys: DataFrame, differ: DataFrame, scratch: Scratch) -> DataFrame:
    """Group the rows of digests that several texts share by their bytes."""
    odd = full.join(differ, "_digest", "left_semi")
    exact = odd.groupBy("_digest", "_norm").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_file", "_row")).alias("_keep")
    )
    rows = odd.join(exact, ["_digest", "_norm"]).withColumn("_sha", sha256_hex(F.col("_norm")))
    again = scratch.keep(rows.select("_digest", "_id", "_file", "_row", "_sha", "_n", "_keep"), "exact")
    own = again.join(keys.select("_file", "_row"), ["_file", "_row"], "left_semi")  # not those of earlier runs
    return member.join(differ, "_digest", "left_anti").select(again.columns).unionByName(own.select(again.columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = located(docs, scratch)
    stay = _marked(_groups(rows, id_col, text_col, sha256_hex, None, scratch, state)).filter("_kept")
    return rows.join(stay.select("_file", "_row"), ["_file", "_row"], "left_semi").select("doc.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("_file", "_row")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
