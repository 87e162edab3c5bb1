"""Graphs over the relational tables: parts chained by orders, and line items chained within orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import TAGS, Graph, key_of_walk

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sequence(c):
    return F.translate(F.md5(c.cast("string").cast("binary")), HEX, BASES)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    rows = items.withColumn("rn", F.row_number().over(w)).withColumn("next_part", F.lead("l_partkey").over(w)).withColumn("next_status", F.lead("l_linestatus").over(w))
    return rows.withColumn("ord", F.col("l_orderkey") * 1000 + F.col("rn"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    tag = F.struct(F.lit("i").alias("type"), F.col("p_size").cast("string").alias("value"))
    seq = F.when(F.col("p_partkey") % 10 == 0, "*").otherwise(_sequence(F.col("p_partkey")))
    rows = part.select(F.col("p_partkey").cast("bigint").alias("ord"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), seq.alias("sequence"), F.create_map(F.lit("RC"), tag).cast(TAGS).alias("tags"))
    return rows.select("ord", "name", "sequence", F.when(F.col("sequence") != "*", F.length("sequence").cast("bigint")).alias("slen"), "tags")


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of every other segment whose own is unknown."""
    part = load(spark, sf_dir, "part").filter("p_partkey % 20 = 0")
    return part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), _sequence(F.col("p_partkey")).alias("sequence"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    orn = lambda c, minus: F.when(F.col(c) == minus, "-").otherwise("+")
    rows = _items(spark, sf_dir).filter("next_part is not null")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    none = lambda t: F.lit(None).cast(t)
    align = F.when(F.col("rn") % 7 == 0, "*").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M")))
    return rows.select("ord", F.concat(F.lit("e"), F.col("ord").cast("string")).alias("eid"), F.lit("L").alias("kind"), name("l_partkey").alias("from_node"), orn("l_returnflag", "R").alias("from_orn"), name("next_part").alias("to_node"), orn("l_linestatus", "F").alias("to_orn"), align.alias("alignment"), none("bigint").alias("pos"), none("bigint").alias("distance"), none("string").alias("variance"), none(TAGS).alias("tags"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.struct("rn", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("seg"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("orn"))
    rows = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("s"))
    steps = F.transform("s", lambda x: F.struct(x["seg"].alias("seg"), x["orn"].alias("orn")))
    return rows.select(F.col("l_orderkey").alias("ord"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path_name"), steps.alias("steps"), F.array().cast("array<string>").alias("overlaps"), F.lit(None).cast(TAGS).alias("tags"))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One walk a user and event type; a user's events of a type in blocks of 1,000 by event id."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("part", F.floor(F.col("event_id") / 1000).cast("bigint"))
    step = F.struct("event_id", F.concat(F.lit("p"), F.coalesce("k", F.lit("0"))).alias("seg"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("orn"))
    rows = e.groupBy("user_id", "event_type", "part").agg(F.min("event_id").alias("seq_start"), F.max("event_id").alias("seq_end"), F.array_sort(F.collect_list(step)).alias("s"))
    steps = F.transform("s", lambda x: F.struct(x["seg"].alias("seg"), x["orn"].alias("orn")))
    rows = rows.select(F.col("seq_start").alias("ord"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sample_id"), (F.col("user_id") % 2).cast("bigint").alias("hapindex"), F.col("event_type").alias("seq_id"), "seq_start", "seq_end", steps.alias("steps"), F.lit(None).cast(TAGS).alias("tags"))
    return rows.select("ord", key_of_walk().alias("walk_key"), "sample_id", "hapindex", "seq_id", "seq_start", "seq_end", "steps", "tags")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(spark, segments=segments(spark, sf_dir), links=links(spark, sf_dir), paths=paths(spark, sf_dir), walks=walks(spark, sf_dir))


def chain_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Line items as segments, linked to the next of their order while the line status stays."""
    items = _items(spark, sf_dir)
    name = lambda k: F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("."), (F.col("rn") + k).cast("string"))
    seq = F.left(_sequence(F.col("ord")), F.lit(12))
    segments_ = items.select("ord", name(0).alias("name"), seq.alias("sequence"), F.lit(12).cast("bigint").alias("slen"), F.lit(None).cast(TAGS).alias("tags"))
    none = lambda t: F.lit(None).cast(t)
    links_ = items.filter("next_status = l_linestatus").select("ord", F.concat(F.lit("e"), F.col("ord").cast("string")).alias("eid"), F.lit("L").alias("kind"), name(0).alias("from_node"), F.lit("+").alias("from_orn"), name(1).alias("to_node"), F.lit("+").alias("to_orn"), F.concat((F.col("l_quantity").cast("int") % 5).cast("string"), F.lit("M")).alias("alignment"), none("bigint").alias("pos"), none("bigint").alias("distance"), none("string").alias("variance"), none(TAGS).alias("tags"))
    return Graph.of(spark, segments=segments_, links=links_)


def codec_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows from line items: a dataset a ship mode of flags, an option a status, a value a quantity."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("compression_option"), F.concat(F.lit("c"), (F.col("l_quantity").cast("int") % 10).cast("string")).alias("compression_value"), F.col("l_extendedprice").cast("bigint").alias("uncompressed_length"), (F.col("l_partkey") + 100).alias("compressed_length"), (F.col("l_discount") * 10).alias("encode_time_ms"), (F.col("l_tax") * 10).alias("decode_time_ms"), F.col("l_returnflag").alias("original_gfa"))
