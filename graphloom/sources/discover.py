"""Marks in the leading comments of text files: which tests and benchmarks a file is for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKS = ("test", "benchmark")


def marks(spark: SparkSession, folder: str, pattern: str = "*.gfa*") -> DataFrame:
    """(path, kind, name) for each ``# test: NAME`` or ``# benchmark: NAME`` among a file's first comments; files
    in sub-folders too. Only the comments before the first other line count."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value")
    # The first line of a file that is neither blank nor a comment, by split and then by line.
    place = F.struct("at", "i")
    body = rows.filter(~F.col("value").rlike("^\\s*(#|$)")).groupBy("path").agg(F.min(place).alias("first"))
    marked = rows.withColumn("kind", F.regexp_extract("value", f"^\\s*#\\s*({'|'.join(MARKS)})\\s*:", 1)).filter("kind <> ''")
    found = marked.join(body, "path", "left").filter(F.col("first").isNull() | (place < F.col("first")))
    names = F.explode(F.split(F.regexp_extract("value", ":(.*)$", 1), ","))
    return found.select("path", "kind", names.alias("name")).select("path", "kind", F.trim("name").alias("name")).filter("name <> ''")


def dataset_names(paths: DataFrame) -> DataFrame:
    """(path, dataset): the file's name without its suffixes; names that several files share get a number."""
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.(gfal?|bgfa)?(\\.(gz|xz|zst|zstd))?$", "")
    rows = paths.select("path").distinct().withColumn("stem", stem)
    k = F.row_number().over(Window.partitionBy("stem").orderBy("path"))
    return rows.select("path", F.when(k == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", k.cast("string"))).alias("dataset"))
