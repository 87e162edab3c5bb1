"""The ranking tool around the codec statistics: CSV scans, characteristics, reports; readable listings of a graph."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.sequence import steps_text, tags_text
from graphloom.operators.analytics import balanced, pareto, quartiles, ranking, top
from graphloom.operators.graph import Graph, counts

STATS = "compression_option string, compression_value string, uncompressed_length bigint, compressed_length bigint, encode_time_ms double, decode_time_ms double, original_gfa string"
MODES = ("best-ratio", "best-speed", "pareto", "balanced")


def read_stats(spark: SparkSession, *paths: str) -> DataFrame:
    """Measurement rows of CSV files with a header, plain, .gz or .zst, side by side, with ratio and throughput.

    Columns beyond those of ``STATS`` stay as text; a missing one is null."""
    rows = None
    for path in paths:
        part = spark.read.csv(path, header=True)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    typed = [(c.split()[0], c.split()[1]) for c in STATS.split(", ")]
    known = [F.col(c).try_cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in typed]
    rows = rows.select(*known, *[c for c in rows.columns if c not in dict(typed)])
    return derived(rows)


def derived(rows: DataFrame) -> DataFrame:
    """Adds ratio (uncompressed by compressed; 1 where nothing is left) and throughput (bytes a second both
    ways; infinite where no time was taken)."""
    ms = F.coalesce("encode_time_ms", F.lit(0.0)) + F.coalesce("decode_time_ms", F.lit(0.0))
    u = F.col("uncompressed_length").cast("double")
    ratio = F.when(F.col("compressed_length") == 0, 1.0).otherwise(F.try_divide(u, F.col("compressed_length")))
    return rows.withColumn("ratio", ratio).withColumn("throughput", F.when(ms > 0, u / (ms / 1000.0)).otherwise(F.lit(float("inf"))))


def annotate(rows: DataFrame, **constants: str | int | float | None) -> DataFrame:
    """Constant columns in front of the others, such as the file and the options of a run; they replace
    columns of their names."""
    return rows.select(*[F.lit(v).alias(k) for k, v in constants.items()], *[c for c in rows.columns if c not in constants])


def with_characteristics(rows: DataFrame, characteristics: DataFrame, file: str = "file") -> DataFrame:
    """Rows with the columns of the characterisation whose ``file`` is their ``original_gfa``, as text; the
    empty text where there is none."""
    more = [c for c in characteristics.columns if c != file and c not in rows.columns]
    side = characteristics.dropDuplicates([file]).select(F.col(file).alias("__file"), *[F.col(c).cast("string").alias(c) for c in more])
    joined = rows.join(side, rows["original_gfa"] == side["__file"], "left")
    return joined.select(*rows.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in more])


def chosen(stats: DataFrame, mode: str = "balanced", n: int = 5) -> DataFrame:
    """The ranked rows of a mode: the n best of each option; for ``pareto`` those that no other beats."""
    ranked = ranking(stats)
    if mode not in MODES:
        raise ValueError(f"no mode named {mode!r}")
    if mode != "pareto":
        return top(ranked, mode, n)
    best = pareto(ranked)
    scored = balanced(ranked).select("compression_option", "compression_value", "score")
    return best.join(scored, ["compression_option", "compression_value"])


def by_characteristic(stats: DataFrame, column: str, mode: str = "balanced", n: int = 5) -> DataFrame:
    """The same within each quartile of a characteristic: bucket and the ranked rows."""
    rows = quartiles(stats, column)
    # An option within a bucket is ranked like an option by itself.
    keyed = rows.withColumn("compression_option", F.concat_ws("\t", "bucket", "compression_option"))
    out = chosen(keyed, mode, n)
    at = F.split("compression_option", "\t")
    return out.select(F.get(at, F.lit(0)).alias("bucket"), F.get(at, F.lit(1)).alias("compression_option"), *[c for c in out.columns if c != "compression_option"])


REPORT = ("compression_option", "compression_value", "ratio_median", "ratio_mean", "encode_ms", "decode_ms", "datasets")


def report(best: DataFrame, form: str = "text") -> str:
    """The ranked rows (a few for each option) as ``text``, ``markdown`` or ``json``."""
    rows = [r.asDict() for r in best.orderBy("compression_option", F.desc("ratio_median"), "compression_value").collect()]
    if form == "json":
        out: dict[str, list] = {}
        for r in rows:
            out.setdefault(r["compression_option"], []).append({c: r[c] for c in REPORT[1:]})
        return json.dumps(out, indent=2)
    cell = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    table = [list(REPORT), *[[cell(r[c]) for c in REPORT] for r in rows]]
    if form == "markdown":
        lines = ["| " + " | ".join(r) + " |" for r in table]
        return "\n".join([lines[0], "| " + " | ".join("---" for _ in REPORT) + " |", *lines[1:]])
    if form != "text":
        raise ValueError(f"no report named {form!r}")
    widths = [max(len(r[i]) for r in table) for i in range(len(REPORT))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in table)


def run_matrix(spark: SparkSession, datasets: list[str], options: list[str], values: list[str], block_sizes: list[int]) -> DataFrame:
    """A row for each benchmark run: every option with every codec pair and block size, for every data set."""
    table = lambda name, xs, t: spark.createDataFrame([(x,) for x in xs], f"{name} {t}")
    runs = table("original_gfa", datasets, "string").crossJoin(table("compression_option", options, "string"))
    return runs.crossJoin(table("compression_value", values, "string")).crossJoin(table("block_size", block_sizes, "int"))


def listing(g: Graph) -> DataFrame:
    """(section, key, text) of a graph for reading: each element on a line with its attributes, tags last."""
    tags = F.array_join(F.coalesce(tags_text(F.col("tags")), F.array().cast("array<string>")), " ")
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    line = lambda *parts: F.rtrim(F.concat_ws(" ", *parts, tags))
    node = g.segments.select(F.lit(1).alias("section"), F.col("name").alias("key"), line(F.lit("node"), "name", F.concat(F.lit("length="), show("slen")), F.concat(F.lit("sequence="), show("sequence"))).alias("text"))
    edge = g.links.select(F.lit(2), F.concat_ws("\t", "from_node", "to_node", show("eid")), line(F.lit("edge"), show("eid"), F.concat("from_node", "from_orn"), F.lit("->"), F.concat("to_node", "to_orn"), F.concat(F.lit("alignment="), show("alignment"))))
    path = g.paths.select(F.lit(3), "path_name", line(F.lit("path"), "path_name", steps_text(F.col("steps")), F.when(F.size("overlaps") > 0, F.concat(F.lit("overlaps="), F.array_join("overlaps", ",")))))
    walk = g.walks.select(F.lit(4), "walk_key", line(F.lit("walk"), "walk_key", steps_text(F.col("steps"))))
    out = node.union(edge).union(path).union(walk)
    if g.subgraphs is not None:
        body = F.array_join(F.transform("elements", lambda e: F.concat(e["id"], F.coalesce(e["orn"], F.lit("")))), ",")
        out = out.union(g.subgraphs.select(F.lit(5), "sub_id", line(F.lit("subgraph"), "sub_id", body)))
    return out


def pretty(g: Graph) -> Iterator[str]:
    """The counts, then every element, streamed in order."""
    r = counts(g).first()
    yield f"segments {r['n_segments']}, links {r['n_links']}, paths {r['n_paths']}, walks {r['n_walks']}"
    for row in listing(g).orderBy("section", "key", "text").toLocalIterator():
        yield row["text"]
