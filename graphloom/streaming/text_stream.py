"""The text scan over a stream of files: stateless, so each table is an append-only stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.sources.gfa_text import parse


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> Graph:
    """The tables as streams; ``ord`` is null, since files come in no fixed order."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse(lines.select(F.lit(None).cast("bigint").alias("ord"), F.col("value").alias("line")))
