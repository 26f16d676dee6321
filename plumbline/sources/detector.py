"""Results of an external language detector: one JSON document with the files of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """languages array<struct<name: string, color: string, file_count: long, files: array<string>, percentage: double, total_bytes: long>>,
  summary struct<languages_detected: long, total_bytes: long, total_files: long>, unknown_files array<string>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """``name, path, position`` of every file that has a language, in the document's order."""
    told = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    languages = told.select(F.posexplode("languages").alias("k", "language"))
    files = languages.select("k", "language.name", F.posexplode("language.files").alias("j", "path"))
    return files.select("name", "path", (F.col("k").cast("long") * F.lit(1 << 40) + F.col("j")).alias("position"))
