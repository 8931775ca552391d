"""A training corpus in five stages, each a call of one operator over all rows that the stage before it kept.

1. quality: documents whose classifier score is below the threshold go.
2. exact dedup: of equal texts one document stays.
3. near dedup: of each group of near duplicates one document stays.
4. mixing: all documents, written in the order that interleaves their sources by weight.
5. tokens: one row per document with its SentencePiece tokens.

Every stage's rows are written to the shared folder and read again by the next one; what the stage itself had stored there
is deleted then, and so are the rows of the stage before it.  A run that loses executors repeats tasks of one stage only.

Edge cases: null and empty texts are scored like others, are equal to each other, are no near copies of anything, and
have no tokens.  Rows with a null identifier stay apart from labels; of equal ones one stays.  Rows that repeat an
identifier are documents of their own: rows are told apart by their place in a file.  Without usable labels all scores
are 0.5, so all documents pass the first stage.  An empty table gives an empty result.  Extra columns, whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spatialith.llm import exact_dedup, jaccard_join, mixing, pieces, quality_crf
from spatialith.llm.store import Scratch, scope, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.keep_good(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, pieces.Vocabulary())


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("tokens", tokens)]

#: The classifier has no SQL form; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next one."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with scope():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{n}")
        if n:
            scratch.drop(f"stage-{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
