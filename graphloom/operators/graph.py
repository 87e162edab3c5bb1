"""The graph as immutable tables, with lookups, searches, set operations and functional updates.

Every update returns a new ``Graph``. Ids are compared as strings; a null id matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "map<string,struct<type:string,value:string>>"
STEPS = "array<struct<seg:string,orn:string>>"
SCHEMAS = {
    "segments": f"ord bigint, name string, sequence string, slen bigint, tags {TAGS}",
    "links": f"ord bigint, eid string, kind string, from_node string, from_orn string, to_node string, to_orn string, alignment string, pos bigint, distance bigint, variance string, tags {TAGS}",
    "paths": f"ord bigint, path_name string, steps {STEPS}, overlaps array<string>, tags {TAGS}",
    "walks": f"ord bigint, walk_key string, sample_id string, hapindex bigint, seq_id string, seq_start bigint, seq_end bigint, steps {STEPS}, tags {TAGS}",
    "headers": f"ord bigint, tags {TAGS}",
    "jumps": f"ord bigint, from_node string, from_orn string, to_node string, to_orn string, distance string, tags {TAGS}",
    "rejects": "ord bigint, line string, reason string",
    "subgraphs": f"ord bigint, sub_id string, elements array<struct<id:string,orn:string>>, tags {TAGS}",
}


def key_of_walk() -> Column:
    """Sample, haplotype and sequence, with the positions, so that parts of one sequence stay apart."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    return F.concat_ws("_", part("sample_id"), part("hapindex"), part("seq_id"), part("seq_start"), part("seq_end"))


@dataclass(frozen=True)
class Graph:
    segments: DataFrame
    links: DataFrame
    paths: DataFrame
    walks: DataFrame
    headers: DataFrame
    jumps: DataFrame
    rejects: DataFrame
    subgraphs: DataFrame | None = None

    @staticmethod
    def of(spark: SparkSession, **tables: DataFrame) -> Graph:
        """A graph of the given tables; the others are empty."""
        return Graph(**{k: tables.get(k, spark.createDataFrame([], s)) for k, s in SCHEMAS.items()})


def elements(g: Graph) -> DataFrame:
    """(kind, id) of everything that has an id: nodes, edges, subgraphs, paths, walks."""
    parts = [g.segments.select(F.lit("node").alias("kind"), F.col("name").alias("id")), named_links(g.links).select(F.lit("edge"), "eid"), g.paths.select(F.lit("path"), "path_name"), g.walks.select(F.lit("walk"), "walk_key")]
    if g.subgraphs is not None:
        parts.append(g.subgraphs.select(F.lit("subgraph"), "sub_id"))
    return reduce(DataFrame.union, parts)


def counts(g: Graph) -> DataFrame:
    """One row: n_segments, n_links, n_paths, n_walks; empty tables count 0."""
    return reduce(DataFrame.crossJoin, [getattr(g, t).agg(F.count("*").alias(f"n_{t}")) for t in ("segments", "links", "paths", "walks")])


def named_links(links: DataFrame) -> DataFrame:
    """Links with an id each: virtual_N for those without, in the order of ``ord``, above every N in use.

    A rank within ranges of ``ord`` and the ranges' offsets replace a window over all rows."""
    used = links.agg(F.coalesce(F.max(F.regexp_extract("eid", "^virtual_([0-9]{1,18})$", 1).try_cast("bigint")), F.lit(-1)).alias("used"))
    bare = (F.col("eid").isNull() | (F.col("eid") == "*")).alias("bare")
    from pyspark.sql import Window

    part = F.shiftright("ord", 16)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("ord", "from_node", "to_node", "from_orn", "to_orn", "alignment"))
    todo = links.filter(bare).withColumn("__part", part).withColumn("__in", inside)
    sums = todo.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row for each 65,536 lines: the only window over all of them.
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = todo.join(sums.select("__part", before.alias("__before")), "__part").crossJoin(used)
    done = placed.withColumn("eid", F.concat(F.lit("virtual_"), (F.col("used") + F.col("__before") + F.col("__in")).cast("string")))
    return links.filter(~bare).unionByName(done.select(links.columns))


def search(g: Graph, node: Column | str | None = None, edge: Column | str | None = None, path: Column | str | None = None, walk: Column | str | None = None) -> DataFrame:
    """(kind, id) of the elements whose predicate holds; a predicate that is null does not hold."""
    tables = (("node", g.segments, "name", node), ("edge", g.links, "eid", edge), ("path", g.paths, "path_name", path), ("walk", g.walks, "walk_key", walk))
    found = [t.filter(p).select(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, t, c, p in tables if p is not None]
    return reduce(DataFrame.union, found)


def get_by_id(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, kind) for each wanted id (column ``id``): the first kind in the order node, subgraph, path, walk, edge."""
    rank = F.when(F.col("kind") == "node", 0).when(F.col("kind") == "subgraph", 1).when(F.col("kind") == "path", 2).when(F.col("kind") == "walk", 3).otherwise(4)
    return elements(g).join(ids.select("id").distinct(), "id").groupBy("id").agg(F.min_by("kind", rank).alias("kind"))


def edges_between(links: DataFrame, u: str, v: str) -> DataFrame:
    """Links of a node pair, whatever their direction."""
    return links.filter((F.least("from_node", "to_node") == min(u, v)) & (F.greatest("from_node", "to_node") == max(u, v)))


def both_ways(links: DataFrame) -> DataFrame:
    """(node, other), each link in both directions."""
    a, b = F.col("from_node"), F.col("to_node")
    return links.select(F.explode(F.array(F.struct(a.alias("node"), b.alias("other")), F.struct(b.alias("node"), a.alias("other")))).alias("x")).select("x.*")


def neighbours(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (node, other); of the wanted nodes (column ``node``) only, where given."""
    rows = both_ways(links)
    return (rows if nodes is None else rows.join(nodes.select("node").distinct(), "node", "left_semi")).distinct()


def implicit_nodes(g: Graph) -> DataFrame:
    """Names that links use and no segment has."""
    return both_ways(g.links).select(F.col("node").alias("name")).distinct().join(g.segments.select("name"), "name", "left_anti")


def with_implicit_nodes(g: Graph) -> Graph:
    names = implicit_nodes(g)
    more = names.select(F.lit(None).cast("bigint").alias("ord"), "name", F.lit("*").alias("sequence"), F.lit(None).cast("bigint").alias("slen"), F.lit(None).cast(TAGS).alias("tags"))
    return replace(g, segments=g.segments.unionByName(more))


def dangling_links(g: Graph) -> DataFrame:
    names = implicit_nodes(g)
    a, b = names.withColumnRenamed("name", "from_node"), names.withColumnRenamed("name", "to_node")
    from_ = g.links.join(a, "from_node", "left_semi")
    return from_.unionByName(g.links.join(a, "from_node", "left_anti").join(b, "to_node", "left_semi").select(from_.columns))


def degrees(links: DataFrame) -> DataFrame:
    """(node, side, degree): a link leaves its first node at the right side if ``+`` and enters its
    second at the left side if ``+``."""
    ends = F.array(F.struct(F.col("from_node").alias("node"), F.when(F.col("from_orn") == "+", "R").otherwise("L").alias("side")), F.struct(F.col("to_node").alias("node"), F.when(F.col("to_orn") == "+", "L").otherwise("R").alias("side")))
    return links.select(F.explode(ends).alias("e")).groupBy("e.node", "e.side").agg(F.count("*").alias("degree"))


def induced(g: Graph, names: DataFrame) -> Graph:
    """Segments of the wanted names (column ``name``) and the links among them."""
    wanted = names.select("name").distinct()
    links = g.links.join(wanted.withColumnRenamed("name", "from_node"), "from_node", "left_semi").join(wanted.withColumnRenamed("name", "to_node"), "to_node", "left_semi")
    return replace(g, segments=g.segments.join(wanted, "name", "left_semi"), links=links)


def stored_subgraph(g: Graph, sub_id: str) -> Graph:
    """The nodes that a stored subgraph names, its edges by id, and the links among those nodes."""
    wanted = g.subgraphs.filter(F.col("sub_id") == sub_id).select(F.explode("elements").alias("e")).select(F.col("e.id").alias("name")).distinct()
    by_id = g.links.join(wanted.withColumnRenamed("name", "eid"), "eid", "left_semi")
    ends = both_ways(by_id).select(F.col("node").alias("name"))
    return induced(g, wanted.union(ends))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key: each column's last value that is not null, tags merged, later ones first.

    ``new`` counts as later than ``old``; among one side's rows ``ord`` decides. A null key never meets another."""
    columns = [c for c in old.columns if c not in (key, "tags")]
    both = old.withColumn("__late", F.lit(0)).unionByName(new.withColumn("__late", F.lit(1)))
    order = F.struct("__late", F.coalesce("ord", F.lit(-1)))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    tags = F.array_sort(F.collect_list(F.struct(F.col("__late").alias("late"), F.coalesce("ord", F.lit(-1)).alias("o"), F.map_entries("tags").alias("t")))) if "tags" in old.columns else None
    merged = both.filter(F.col(key).isNotNull()).groupBy(key).agg(*last, *([tags.alias("tags")] if tags is not None else []))
    if tags is not None:
        flat = F.flatten(F.transform("tags", lambda x: F.coalesce(x["t"], F.array())))
        latest = F.filter(flat, lambda e, i: ~F.exists(F.slice(flat, i + 2, F.size(flat)), lambda x: x["key"] == e["key"]))
        merged = merged.withColumn("tags", F.map_from_entries(latest))
    return merged.select(old.columns).unionByName(both.filter(F.col(key).isNull()).select(old.columns))


def remove_nodes(g: Graph, names: DataFrame) -> Graph:
    """Without the wanted segments (column ``name``) and every link that touches one."""
    gone = names.select("name").distinct()
    links = g.links.join(gone.withColumnRenamed("name", "from_node"), "from_node", "left_anti").join(gone.withColumnRenamed("name", "to_node"), "to_node", "left_anti")
    return replace(g, segments=g.segments.join(gone, "name", "left_anti"), links=links.select(g.links.columns))


def remove_links(g: Graph, ids: DataFrame) -> Graph:
    return replace(g, links=g.links.join(ids.select(F.col("id").alias("eid")).distinct(), "eid", "left_anti").select(g.links.columns))


def remove_rows(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(table.columns)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, whole rows: the last of ``new`` by ``ord``, or else the last of ``old``.

    Rows with equal ``ord`` are told apart by their other columns; null keys all stay."""
    both = old.withColumn("__late", F.lit(0)).unionByName(new.withColumn("__late", F.lit(1)))
    row = F.struct(*[F.col(c) for c in old.columns])
    order = F.struct("__late", F.coalesce("ord", F.lit(-1)), F.to_json(row))
    last = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, order).alias("__row")).select("__row.*")
    return last.unionByName(both.filter(F.col(key).isNull()).drop("__late"))


def append(a: Graph, b: Graph) -> Graph:
    """Both graphs: segments merged, paths, walks and subgraphs overwritten by key, the second's later; other tables side by side."""
    groups = [g.subgraphs for g in (a, b) if g.subgraphs is not None]
    both = {t: getattr(a, t).unionByName(getattr(b, t)) for t in ("links", "headers", "jumps", "rejects")}
    return replace(a, segments=upsert(a.segments, b.segments, "name"), paths=replaced(a.paths, b.paths, "path_name"), walks=replaced(a.walks, b.walks, "walk_key"), subgraphs=replaced(*groups, "sub_id") if len(groups) == 2 else (groups or [None])[0], **both)


LINK_KEY = ("kind", "from_node", "from_orn", "to_node", "to_orn", "alignment")


def link_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, link columns) of the links, counted, that only one table has."""
    x, y = a.select(*LINK_KEY), b.select(*LINK_KEY)
    return x.exceptAll(y).select(F.lit("left").alias("side"), "*").union(y.exceptAll(x).select(F.lit("right"), "*"))


def equal(a: Graph, b: Graph) -> bool:
    """Whether both have the same segments, links, paths and walks as multisets."""
    same = lambda x, y: x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
    text = lambda t, *cols: t.select(*[F.to_json(c) if dict(t.dtypes)[c].startswith("array") else F.col(c) for c in cols])
    parts = (("segments", ("name", "sequence", "slen")), ("links", LINK_KEY), ("paths", ("path_name", "steps", "overlaps")), ("walks", ("walk_key", "steps")))
    return all(same(text(getattr(a, t), *cols), text(getattr(b, t), *cols)) for t, cols in parts)


def invalid(g: Graph) -> DataFrame:
    """(kind, id, reason) of the rows that break a constraint."""
    s = g.segments.filter((F.col("name") == "*") | ~F.col("sequence").rlike("^(\\*|[A-Za-z=.]+)$") | (F.col("slen") < 0)).select(F.lit("node").alias("kind"), F.col("name").alias("id"), F.lit("name, sequence or length").alias("reason"))
    bad = F.lit(False)
    for c in ("from_orn", "to_orn"):
        bad = bad | ~F.coalesce(F.col(c).isin("+", "-"), F.lit(False))
    for c in ("from_node", "to_node"):
        bad = bad | (F.coalesce(F.length(c), F.lit(0)) == 0)
    e = g.links.filter(bad).select(F.lit("edge"), "eid", F.lit("ends or orientations"))
    p = g.paths.filter((F.size("steps") < 1) | ((F.size("overlaps") > 0) & (F.size("overlaps") != F.size("steps") - 1))).select(F.lit("path"), "path_name", F.lit("steps or overlaps"))
    w = g.walks.filter((F.size("steps") < 1) | (F.col("hapindex") < 0) | (F.col("seq_start") < 0) | (F.col("seq_end") < F.col("seq_start"))).select(F.lit("walk"), "walk_key", F.lit("steps or positions"))
    return s.union(e).union(p).union(w)
