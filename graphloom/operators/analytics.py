"""Dataset characterisation, list transforms behind the codecs, and the ranking of codecs."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph, counts
from graphloom.plans.tables import cut


def _chars(c: str, *letters: str) -> Column:
    return sum((F.length(c) - F.length(F.replace(F.upper(c), F.lit(x), F.lit(""))) for x in letters), F.lit(0)).cast("bigint")


def sequence_stats(segments: DataFrame) -> DataFrame:
    """One row: avg_seq_len, max_seq_len, gc_content over known sequences; 0 where there is none."""
    known = segments.filter("sequence <> '*'")
    gc, acgt = F.sum(_chars("sequence", "G", "C")), F.sum(_chars("sequence", "A", "C", "G", "T"))
    return known.agg(F.coalesce(F.round(F.avg(F.length("sequence")), 2), F.lit(0.0)).alias("avg_seq_len"), F.coalesce(F.max(F.length("sequence")), F.lit(0)).cast("bigint").alias("max_seq_len"), F.coalesce(F.round(F.try_divide(gc.cast("double"), acgt), 4), F.lit(0.0)).alias("gc_content"))


def alphabet(g: Graph) -> DataFrame:
    """One row: unique_chars_seq (upper case, known sequences) and unique_chars_names (segments, links, paths)."""
    letters = lambda t, c: t.select(F.explode(F.array_distinct(F.split(c, ""))).alias("c")).filter("c <> ''").distinct()
    seq = letters(g.segments.filter("sequence <> '*'").withColumn("u", F.upper("sequence")), "u").agg(F.count("*").alias("unique_chars_seq"))
    names = [letters(g.segments, "name"), letters(g.links.filter("eid is not null"), "eid"), letters(g.paths, "path_name")]
    return seq.crossJoin(reduce(DataFrame.union, names).distinct().agg(F.count("*").alias("unique_chars_names")))


def cigar_stats(links: DataFrame) -> DataFrame:
    """One row: avg_cigar_len and cigar_present_ratio."""
    present = F.coalesce(F.col("alignment") != "*", F.lit(False))
    return links.agg(F.coalesce(F.round(F.avg(F.when(present, F.length("alignment"))), 2), F.lit(0.0)).alias("avg_cigar_len"), F.coalesce(F.round(F.avg(F.when(present, 1.0).otherwise(0.0)), 4), F.lit(0.0)).alias("cigar_present_ratio"))


def path_depth(paths: DataFrame) -> DataFrame:
    return paths.agg(F.coalesce(F.round(F.avg(F.size("steps")), 2), F.lit(0.0)).alias("avg_path_depth"), F.coalesce(F.max(F.size("steps")), F.lit(0)).cast("bigint").alias("max_path_depth"))


def characterise(g: Graph) -> DataFrame:
    """One row with every figure above and the counts. The columns that they read are written once, so a
    graph that is costly to derive is derived once."""
    segments, links = cut(g.segments.select("name", "sequence"), "segments"), cut(g.links.select("eid", "alignment"), "links")
    paths, walks = cut(g.paths.select("path_name", "steps"), "paths"), g.walks
    lean = replace(g, segments=segments, links=links, paths=paths, walks=walks)
    return reduce(DataFrame.crossJoin, [counts(lean), sequence_stats(segments), alphabet(lean), cigar_stats(links), path_depth(paths)])


def _lists(by: str, order: str) -> Window:
    return Window.partitionBy(by).orderBy(order)


def delta_encode(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Adds ``delta``: the value minus the one before it in its list, the first as it is."""
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(_lists(by, order)), F.lit(0)))


def delta_decode(df: DataFrame, by: str, order: str, delta: str = "delta") -> DataFrame:
    return df.withColumn("decoded", F.sum(delta).over(_lists(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def frame_split(df: DataFrame, by: str, value: str) -> DataFrame:
    """Adds offset (value minus the list's least), threshold (its sorted offsets at 0.95 n, at least 1) and outlier."""
    w = Window.partitionBy(by)
    rows = df.withColumn("offset", F.col(value) - F.min(value).over(w))
    rows = rows.withColumn("__i", F.row_number().over(w.orderBy("offset"))).withColumn("__n", F.count("*").over(w))
    cut_ = F.max(F.when(F.col("__i") == F.floor(F.col("__n") * 95 / 100).cast("bigint") + 1, F.col("offset"))).over(w)
    return rows.withColumn("threshold", F.greatest(F.lit(1), cut_)).withColumn("outlier", F.col("offset") > F.col("threshold")).drop("__i", "__n")


def runs(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, run, value, length, packed): runs of equal values; packed where three or more."""
    w = _lists(by, order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    rows = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "run").agg(F.first(value).alias("value"), F.count("*").alias("length")).withColumn("packed", F.col("length") >= 3)


def dictionary(df: DataFrame, by: str, order: str, value: str, bound: int = 65536) -> DataFrame:
    """(by, value, code): distinct values by first place; lists with more than ``bound`` values have no code."""
    first = df.groupBy(by, value).agg(F.min(order).alias("__first"))
    w = Window.partitionBy(by)
    code = F.row_number().over(w.orderBy("__first", value)) - 1
    return first.withColumn("__n", F.count("*").over(w)).withColumn("code", F.when(F.col("__n") <= bound, code)).select(by, value, "code")


def blocks(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Adds ``block``: the ordinal in its section, divided by the block size."""
    return df.withColumn("block", F.floor((F.row_number().over(_lists(by, order)) - 1) / size).cast("bigint"))


def ranking(stats: DataFrame) -> DataFrame:
    """Per option and value: ratio (uncompressed by compressed), times over 0 and throughput, datasets."""
    u, c = F.col("uncompressed_length").cast("double"), F.col("compressed_length").cast("double")
    ms = F.col("encode_time_ms") + F.col("decode_time_ms")
    rows = stats.withColumn("ratio", F.when(c == 0, 1.0).otherwise(F.try_divide(u, c))).withColumn("throughput", F.when(ms > 0, u / (ms / 1000.0)))
    over = lambda x: F.avg(F.when(F.col(x) > 0, F.col(x).cast("double")))
    return rows.groupBy("compression_option", "compression_value").agg(F.avg("ratio").alias("ratio_mean"), F.percentile("ratio", 0.5).alias("ratio_median"), F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"), F.coalesce(over("encode_time_ms"), F.lit(0.0)).alias("encode_ms"), F.coalesce(over("decode_time_ms"), F.lit(0.0)).alias("decode_ms"), F.avg("throughput").alias("throughput"), F.countDistinct("original_gfa").alias("datasets"))


def balanced(ranked: DataFrame) -> DataFrame:
    """Adds ``score``: mean ratio times 1 + ln(throughput / the option's best); the mean ratio without one."""
    best = F.max("throughput").over(Window.partitionBy("compression_option"))
    return ranked.withColumn("score", F.when(F.col("throughput") > 0, F.col("ratio_mean") * (1 + F.log(F.col("throughput") / best))).otherwise(F.col("ratio_mean")))


def top(ranked: DataFrame, mode: str, n: int) -> DataFrame:
    """The n best of each option: ``best-ratio``, ``best-speed`` or ``balanced``; ties by value."""
    order = {"best-ratio": F.desc("ratio_median"), "best-speed": F.asc("decode_ms"), "balanced": F.desc("score")}[mode]
    rows = balanced(ranked) if mode == "balanced" else ranked
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("compression_option").orderBy(order, "compression_value"))).filter(F.col("rank") <= n)


def pareto(ranked: DataFrame, more: str = "ratio_mean", less: str = "decode_ms", by: str = "compression_option") -> DataFrame:
    """Rows that no row of their group beats: one as good in both figures and better in one. A row without a
    figure or a group neither beats nor is beaten.

    Sorted by the one figure, a row stays if it beats all before it in the other: no pairs are made. All is read
    off one pass, since averages computed twice can differ in their last bits."""
    known = F.col(by).isNotNull() & F.col(more).isNotNull() & F.col(less).isNotNull()
    best = F.when(known, F.col(more))
    group = [F.col(by), known]
    order = Window.partitionBy(*group).orderBy(F.asc(less), F.desc(more))
    # The first row of a figure knows the best of all smaller ones.
    seen = F.struct(F.row_number().over(order).alias("i"), F.max(best).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    same = Window.partitionBy(*group, less)
    rows = ranked.withColumn("__seen", seen).withColumn("__best", F.max(best).over(same)).withColumn("__before", F.min("__seen").over(same)["before"])
    stays = ~known | (F.col(more) == F.col("__best")) & (F.col("__before").isNull() | (F.col("__best") > F.col("__before")))
    return rows.filter(stays).select(ranked.columns)


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """Adds ``bucket``: q1 to q4 by the sorted values at n/4, n/2 and 3n/4; values that are no numbers are q1.

    All rows are ``all`` where none is a number."""
    number = F.col(value).try_cast("double")
    rows = df.withColumn("__v", number)
    n = rows.agg(F.count("__v").alias("n"))
    # Exact order statistics by value counts: ranges of distinct values are summed side by side, and the
    # one window over all of them has a row for each range.
    tally = rows.filter("__v is not null").groupBy("__v").agg(F.count("*").alias("c"))
    ranged = cut(tally.repartitionByRange("__v").withColumn("__p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__p").agg(F.sum("c").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("c").over(Window.partitionBy("__p").orderBy("__v"))
    marks = ranged.withColumn("inside", inside).join(sums.select("__p", before.alias("before")), "__p")
    marks = marks.withColumn("upto", F.col("before") + F.col("inside")).crossJoin(F.broadcast(n))
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(F.col("n") * k / 4), F.col("__v")))
    cuts = marks.agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    v = F.col("__v")
    bucket = F.when(F.col("a").isNull(), "all").when(v.isNull() | (v <= F.col("a")), "q1").when(v <= F.col("b"), "q2").when(v <= F.col("c"), "q3").otherwise("q4")
    return rows.crossJoin(F.broadcast(cuts)).withColumn("bucket", bucket).select(*df.columns, "bucket")


def heuristic_features(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per list: mean, standard deviation, largest value, and the codec that they suggest."""
    f = df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("largest"))
    return f.withColumn("suggested", F.when((F.col("std") > 0) & (F.col("largest") > F.col("mean") + 10 * F.col("std")), "pfor_delta").when(F.col("largest") < 65536, "bit_packing").otherwise("varint"))
