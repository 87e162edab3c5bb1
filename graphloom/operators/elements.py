"""Single elements: guarded inserts and removals, lookup as objects, membership, equality, subgraph shape.

Bulk work belongs to ``operators.graph``; what is here answers for a handful of elements, with an error where
one is missing, already there or malformed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from graphloom.operators.graph import SCHEMAS, Graph, append, elements, get_by_id, implicit_nodes


class GraphError(ValueError):
    """An operation that the graph does not allow."""


class MissingElement(GraphError):
    """No element has the id."""


class ElementExists(GraphError):
    """Some element already has the id."""


class MalformedLine(GraphError):
    """A line that is no record of its type."""


class BadSearch(GraphError):
    """Search values that select nothing by themselves."""


#: Kinds with their tables and keys.
KINDS = {"node": ("segments", "name"), "edge": ("links", "eid"), "subgraph": ("subgraphs", "sub_id"), "path": ("paths", "path_name"), "walk": ("walks", "walk_key")}


@dataclass(frozen=True)
class Element:
    """One element as an object: its kind, id and row."""

    kind: str
    id: str
    row: Row


def _table(g: Graph, kind: str) -> DataFrame:
    name, _ = KINDS[kind]
    table = getattr(g, name)
    return g.segments.sparkSession.createDataFrame([], SCHEMAS[name]) if table is None else table


def contains(g: Graph, ids: DataFrame) -> DataFrame:
    """The wanted ids (column ``id``) that an element of any kind has."""
    return ids.select("id").distinct().join(elements(g).select("id"), "id", "left_semi")


def element(g: Graph, id: str) -> Element:  # noqa: A002
    """The element with the id: a node before a subgraph, path, walk and edge."""
    wanted = g.segments.sparkSession.createDataFrame([(id,)], "id string")
    found = get_by_id(g, wanted).first()
    if found is None:
        raise MissingElement(id)
    _, key = KINDS[found["kind"]]
    row = _table(g, found["kind"]).filter(F.col(key) == id).first()
    return Element(found["kind"], id, row)


def add(g: Graph, kind: str, rows: DataFrame, safe: bool = False) -> Graph:
    """``rows`` (columns of the kind's table) inserted: nodes merged by name, paths, walks and subgraphs
    overwritten by key, edges put beside the others.

    With ``safe`` no id may be there yet, of any kind, and both ends of an edge must be."""
    name, key = KINDS[kind]
    if safe:
        there = contains(g, rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"))).first()
        if there is not None:
            raise ElementExists(there["id"])
        if kind == "edge" and (lost := implicit_nodes(replace(g, links=rows)).first()) is not None:
            raise MissingElement(lost["name"])
    spark = g.segments.sparkSession
    more = Graph.of(spark, **{name: rows})
    return append(g, more if kind == "subgraph" else replace(more, subgraphs=None))


def remove(g: Graph, kind: str, ids: DataFrame) -> Graph:
    """Without the wanted elements (column ``id``), each of which must be there; nodes take their edges along."""
    from graphloom.operators.graph import remove_nodes, remove_rows

    name, key = KINDS[kind]
    table = _table(g, kind)
    lost = ids.select("id").distinct().join(table.select(F.col(key).alias("id")), "id", "left_anti").first()
    if lost is not None:
        raise MissingElement(lost["id"])
    if kind == "node":
        return remove_nodes(g, ids.select(F.col("id").alias("name")))
    return replace(g, **{name: remove_rows(table, key, ids)})


def _pair(*values: str | None) -> None:
    if sum(v is not None for v in values) < 2:
        raise BadSearch("an edge is named by its id or by both of its nodes")


def between(links: DataFrame, u: str, v: str, eid: str | None = None) -> DataFrame:
    """Links of a node pair, whatever their direction; only the one with the id, where given."""
    _pair(u, v)
    rows = links.filter((F.least("from_node", "to_node") == min(u, v)) & (F.greatest("from_node", "to_node") == max(u, v)))
    return rows if eid is None else rows.filter(F.col("eid") == eid)


def remove_between(g: Graph, u: str, v: str, eid: str | None = None) -> Graph:
    """Without the links of a node pair, or without the one with the id; there must be one."""
    gone = between(g.links, u, v, eid)
    if gone.isEmpty():
        raise MissingElement(f"{u}, {v}" + (f", {eid}" if eid else ""))
    pair = (F.least("from_node", "to_node") == min(u, v)) & (F.greatest("from_node", "to_node") == max(u, v))
    out = pair if eid is None else pair & F.col("eid").eqNullSafe(F.lit(eid))
    return replace(g, links=g.links.filter(~F.coalesce(out, F.lit(False))))


def remove_pairs(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links without those of the wanted node pairs (columns ``u`` and ``v``), whatever their direction."""
    wanted = pairs.select(F.least("u", "v").alias("__a"), F.greatest("u", "v").alias("__b")).distinct()
    keyed = links.withColumn("__a", F.least("from_node", "to_node")).withColumn("__b", F.greatest("from_node", "to_node"))
    return keyed.join(wanted, ["__a", "__b"], "left_anti").select(links.columns)


def cleared(g: Graph) -> Graph:
    """A graph with nothing in it."""
    return Graph.of(g.segments.sparkSession)


def is_node(row: dict | Row) -> bool:
    """Whether a row has what a segment needs."""
    return _has(row, "name", "sequence")


def is_edge(row: dict | Row) -> bool:
    return _has(row, "from_node", "from_orn", "to_node", "to_orn", "alignment")


def is_subgraph(row: dict | Row) -> bool:
    return _has(row, "sub_id", "elements")


def _has(row: dict | Row, *names: str) -> bool:
    fields = row.asDict() if isinstance(row, Row) else row
    return all(fields.get(n) is not None for n in names)


def is_path() -> Column:
    """Whether a stored subgraph is a path: all of its elements have an orientation."""
    return F.forall("elements", lambda e: e["orn"].isNotNull())


def subgraph_map(as_text: bool = False) -> Column:
    """The elements of a stored subgraph as a map from id to orientation, the last of an id."""
    entries = F.col("elements")
    latest = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["id"] == e["id"]))
    out = F.map_from_entries(F.transform(latest, lambda e: F.struct(e["id"].alias("key"), e["orn"].alias("value"))))
    return F.to_json(out) if as_text else out


def same_rows(a: DataFrame, b: DataFrame, kind: str, tags: bool = True) -> bool:
    """Whether two tables of one kind hold equal elements, as multisets; tags in any order count too."""
    from graphloom.functions.sequence import tags_text

    columns = [c for c in a.columns if c not in ("ord", "tags", "walk_key")]

    def plain(t: DataFrame) -> DataFrame:
        kinds = dict(t.dtypes)
        cols = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in columns]
        text = F.array_join(F.coalesce(tags_text(F.col("tags")), F.array().cast("array<string>")), "\t").alias("tags")
        return t.select(*cols, *([text] if tags else []))

    x, y = plain(a), plain(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
