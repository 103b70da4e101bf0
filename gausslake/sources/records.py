"""Text files of poses and of vertices, read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(spark: SparkSession, paths: str | list[str], lines: int) -> DataFrame:
    """(path, record, numbers): the numbers of each run of `lines` non-empty lines of whole small files."""
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    kept = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    numbered = whole.select("path", F.posexplode(kept).alias("at", "line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    groups = numbered.groupBy("path", F.floor(F.col("at") / lines).alias("record")).agg(F.array_join(ordered, " ").alias("text"), F.count("*").alias("n"))
    return groups.where(F.col("n") == lines).select("path", "record", F.transform(F.split(F.trim("text"), r"\s+"), lambda x: x.cast("double")).alias("v"))


def _header(lines: int) -> list[Column]:
    return [F.col("v")[i].cast("long").alias(n) for i, n in enumerate(("i", "j", "n"))] + [F.slice("v", 4, (lines - 1) ** 2).alias("m")]


def read_pose_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, record, i, j, n, m): records of a header line and a 4 x 4 pose, row by row."""
    return _records(spark, paths, 5).select("path", "record", *_header(5))


def read_information(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, record, i, j, n, m): records of a header line and a 6 x 6 information matrix, row by row."""
    return _records(spark, paths, 7).select("path", "record", *_header(7))


def read_vertices(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, x, y, z): the vertices of OBJ files; other lines are left out by the scan."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("w"))
    return lines.where(F.col("w")[0] == "v").select("path", *[F.col("w")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
