"""Readers and writers of scenes, questions, verdict caches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "question_id long, scene_id string, image_name string, level string, type string, question string, options array<string>, answer string, correct_value string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files: a list, or an object with a list under ``questions``."""
    raw = spark.read.schema(f"questions array<struct<{_fields()}>>, {QUESTION}").json(path, multiLine=True)
    wrapped = raw.filter("questions is not null").select(F.explode("questions").alias("q")).select("q.*")
    return raw.filter("questions is null").drop("questions").unionByName(wrapped)


def _fields() -> str:
    parts = (p.split(" ", 1) for p in QUESTION.split(", "))
    return ", ".join(f"{name}: {kind}" for name, kind in parts)


def write_questions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str, version: str, entry: str) -> DataFrame:
    """A nested cache {version, frames: {scene: {image: entry}}} of one version, one row a frame."""
    raw = spark.read.schema(f"version string, frames map<string, map<string, struct<{entry}>>>").json(path, multiLine=True)
    scenes = raw.filter(F.col("version") == version).select(F.explode("frames").alias("scene_id", "images"))
    return scenes.select("scene_id", F.explode("images").alias("image_name", "e")).select("scene_id", "image_name", "e.*")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Text matrices: (path, row, values), rows with values that aren't finite left out."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.trim("value"), r"\r?\n")).alias("row", "line"))
    floats = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    finite = F.forall(floats, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return lines.select("path", "row", floats.alias("values")).filter(finite)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``key = value`` text files: (path, key, value)."""
    parts = F.split("value", "=", 2)
    lines = spark.read.text(path).filter(F.col("value").contains("="))
    return lines.select(F.input_file_name().alias("path"), F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated map of raw labels to categories."""
    return spark.read.csv(path, sep="\t", header=True)


def list_images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Image files below a folder in natural order, without reading them."""
    from ..functions.text import natural_number

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), natural_number(name).alias("number")).distinct().orderBy("number", "name")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys were not processed yet."""
    return rows.join(done.select(keys).distinct(), keys, "left_anti")


def parse_scene(vertices: DataFrame, segments: DataFrame, blocked: list[str], least: int = 3) -> DataFrame:
    """Objects of scenes: boxes of their vertices; blocked labels and scenes with few objects left out.

    ``vertices``: scene_id, segment, x, y, z; ``segments``: scene_id, segment, id, label.
    """
    both = vertices.join(segments, ["scene_id", "segment"]).filter(~F.col("label").isin(blocked))
    box = [f(k).alias(f"{k}{n}") for k in "xyz" for n, f in ((0, F.min), (1, F.max))]
    objects = both.groupBy("scene_id", "id", "label").agg(F.count(F.lit(1)).alias("n_vertices"), *box)
    enough = objects.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    objects = objects.join(enough.select("scene_id"), "scene_id", "left_semi")
    return objects.select("*", *[((F.col(f"{k}0") + F.col(f"{k}1")) / 2).alias(f"c{k}") for k in "xyz"])
