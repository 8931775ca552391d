"""Tables shared by the driver and all executors.

Intermediate results that must survive a lost executor are written as Parquet below the folder named by
``spark.checkpoint.dir``.  Only a local session without that setting (tests) gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SCOPES: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI.  Raises on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spatialith-")
    return _LOCAL[app]


class Scratch:
    """A fresh folder below the shared one, for the tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for scope_ in _SCOPES[-1:]:
            scope_.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage, and fixes rows that later steps must agree on."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one table (or all of them) that no pending DataFrame reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope() -> Iterator[None]:
    """Drops every scratch folder made inside, at the end: for work whose result has been written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a file: a scan under projections and filters alone."""
    if "_metadata" in docs.columns:  # a column of that name hides the file's own
        return False
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty()


def located(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, _file, _row): each row, packed so that no column of it clashes, and its own place in a file.

    Rows that don't come straight from files are stored first, so that every row has a place.
    """
    place = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    if not _plain_scan(docs):
        names = {c.lower() for c in docs.columns}
        if "_metadata" in names or len(names) < len(docs.columns):
            return scratch.keep(docs.select(F.struct(*docs.columns).alias("doc")), "located").select("doc", *place)
        docs = scratch.keep(docs, "located")
    return docs.select(F.struct(*docs.columns).alias("doc"), *place)
