"""Graph algorithms: consistency of overlaps, components, paths, compaction, comparison.

Iterations run on tables in the shared folder; no step gathers a graph, or a component, in one place,
but for ``dfs_edges``, whose result is an order that only one walker can make.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.sequence import cigar_overlap, flip, oriented, overlap_length
from graphloom.operators.graph import Graph, both_ways, degrees
from graphloom.plans.tables import cut

#: Edges that a task turns into stars at once, and rows of a batch that it gives back.
STRETCH, ROWS = 200_000, 10_000


def overlap_check(g: Graph, fasta: DataFrame | None = None) -> DataFrame:
    """eid, declared, real, status of each link with both segments; ``fasta`` (id, sequence) serves ``*``.

    status: consistent, inconsistent, or not computable where a sequence or the number is unknown."""
    s = g.segments.select("name", "sequence")
    if fasta is not None:
        s = s.join(fasta.select(F.col("id").alias("name"), F.col("sequence").alias("fasta")), "name", "left")
        s = s.select("name", F.coalesce(F.when(F.col("sequence") != "*", F.col("sequence")), "fasta").alias("sequence"))
    else:
        s = s.select("name", F.when(F.col("sequence") != "*", F.col("sequence")).alias("sequence"))
    a = s.select(F.col("name").alias("from_node"), F.col("sequence").alias("a"))
    b = s.select(F.col("name").alias("to_node"), F.col("sequence").alias("b"))
    rows = g.links.join(a, "from_node").join(b, "to_node").withColumn("declared", cigar_overlap(F.col("alignment")))
    rows = rows.withColumn("real", F.when(F.col("declared").isNotNull(), overlap_length(oriented(F.col("a"), F.col("from_orn")), oriented(F.col("b"), F.col("to_orn")))))
    status = F.when(F.col("real").isNull(), "not computable").when(F.col("real") == F.col("declared"), "consistent").otherwise("inconsistent")
    return rows.select("eid", "from_node", "to_node", "declared", "real", status.alias("status"))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y) for the names of (a, b) edges, y the least name of x's piece among the edges of a stretch; y itself
    has a row only where it is alone."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        while (y := above[x]) != x:
            above[x] = x = above[y]
        return x

    def stars() -> pa.RecordBatch:
        tops = {x: y for x in above if (y := top(x)) != x}
        tops |= {x: x for x in above.keys() - tops.keys() - set(tops.values())}
        return pa.RecordBatch.from_arrays([pa.array(list(tops), pa.string()), pa.array(list(tops.values()), pa.string())], names=["x", "y"])

    left = STRETCH
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = a if a is not None else b, b if b is not None else a
            if a is None:
                continue
            for x in (a, b):
                if x not in above:
                    above[x] = x
            a, b = top(a), top(b)
            if a < b:
                above[b] = a
            elif b < a:
                above[a] = b
        left -= batch.num_rows
        if left <= 0:
            yield stars()
            above.clear()
            left = STRETCH
    yield stars()


def component_edges(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) edges, root the least name: alternating stars.

    Tasks first turn stretches of their edges into stars. Rounds never join two components nor split one, and end
    when the edges are disjoint stars: when no node has two centres and no centre has one itself."""
    pairs = cut(edges.select("a", "b").mapInArrow(_contracted, "x string, y string"), "pairs")
    now = pairs.filter("x <> y")
    while True:
        both = now.select("x", "y", F.lit(1).alias("ray"), F.lit(0).alias("centre")).union(now.select("y", "x", F.lit(0), F.lit(1)))
        # Written first, so that both sides of the joins are plain exchanges, in which hubs can be split.
        ray = F.when(F.col("ray") == 1, F.col("y"))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"), ((F.min(ray) < F.max(ray)) | (F.max("ray") + F.max("centre") > 1)).alias("more"))
        least = cut(least, "least")
        if least.filter("more").isEmpty():
            found, alone = least.select(F.col("x").alias("node"), F.col("m").alias("root")), pairs.filter("x = y").select(F.col("x").alias("node"))
            if alone.isEmpty():
                return found
            return found.union(alone.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
        large = cut(both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "large")
        low = cut(large.groupBy("x").agg(F.min("y").alias("m")), "low")
        small = large.join(low, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
        now = cut(small.filter("x <> y").distinct(), "stars")


def components(g: Graph) -> DataFrame:
    """(node, component): the least name of each weak component; segments without links are their own."""
    edges = g.links.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))
    alone = g.segments.select(F.col("name").alias("a"), F.col("name").alias("b"))
    return component_edges(edges.union(alone)).select("node", F.col("root").alias("component"))


def component_of(g: Graph, node: str) -> DataFrame:
    """The nodes of one node's component; none where the node is unknown.

    Read off all components, which take as many rounds as the logarithm of a path, not a job a hop."""
    found = cut(components(g), "components")
    mine = found.filter(F.col("node") == node).select("component").distinct()
    return found.join(F.broadcast(mine), "component", "left_semi").select("node")


def simple_paths(links: DataFrame, source: str, target: str, cutoff: int, keep: Column | None = None, undirected: bool = False, edges: bool = False) -> DataFrame:
    """(nodes, eids): all simple paths of at most ``cutoff`` links, parallel links apart; ``keep`` selects links.

    With ``edges`` a row has the path's links instead: array<struct<from_node, to_node, eid>>."""
    links = links if keep is None else links.filter(keep)
    hop = links.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), "eid")
    if undirected:
        hop = hop.union(hop.select("v", "u", "eid"))
    front = hop.filter((F.col("u") == source) & (F.col("v") != source)).select(F.array("u", "v").alias("nodes"), F.array("eid").alias("eids"), F.col("v").alias("at"))
    found = front.filter(F.col("at") == target)
    for _ in range(cutoff - 1):
        front = cut(front.filter(F.col("at") != target), "paths")
        if front.isEmpty():
            break
        step = front.join(hop, F.col("at") == F.col("u")).filter(~F.array_contains("nodes", F.col("v")))
        front = step.select(F.concat("nodes", F.array("v")).alias("nodes"), F.concat("eids", F.array("eid")).alias("eids"), F.col("v").alias("at"))
        found = found.union(front.filter(F.col("at") == target))
    if edges:
        return found.select(F.transform("eids", lambda e, i: F.struct(F.get("nodes", i).alias("from_node"), F.get("nodes", i + 1).alias("to_node"), e.alias("eid"))).alias("links"))
    return found.select("nodes", "eids")


def dfs_edges(g: Graph, source: str | None = None, keep: Column | None = None) -> DataFrame:
    """(component, position, u, v, eid): tree edges in depth-first preorder, neighbours by name; ``keep``
    selects the links that there are.

    One walker a component, which holds that component's edges; a task walks its components one after the other."""
    links = g.links if keep is None else g.links.filter(keep)
    links = cut(links.select("eid", F.col("from_node").alias("u"), F.col("to_node").alias("v")), "edges")
    found = component_edges(links.select(F.col("u").alias("a"), F.col("v").alias("b")))
    if source is not None:
        at = found.filter(F.col("node") == source).select("root")
        found = found.join(F.broadcast(at), "root", "left_semi")
    rows = links.join(found.select(F.col("node").alias("u"), F.col("root").alias("component")), "u").select("component", "u", "v", "eid")

    def walk(component: str, edges: list[tuple]) -> list[tuple]:
        near: dict[str, list[tuple[str, str]]] = {}
        for _, u, v, e in edges:
            near.setdefault(u, []).append((v, e or ""))
            near.setdefault(v, []).append((u, e or ""))
        start = source if source in near else min(near)
        seen, out = {start}, []
        stack = [(start, iter(sorted(near[start])))]
        while stack:
            u, rest = stack[-1]
            for v, e in rest:
                if v not in seen:
                    seen.add(v)
                    out.append((component, len(out), u, v, e))
                    stack.append((v, iter(sorted(near[v]))))
                    break
            else:
                stack.pop()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["component", "position", "u", "v", "eid"])
        out: list[tuple] = []
        for component, edges in itertools.groupby(each, lambda r: r[0]):
            out += walk(component, list(edges))
            if len(out) >= ROWS:
                yield table(out)
                out = []
        yield table(out)

    return rows.repartition("component").sortWithinPartitions("component").mapInArrow(run, "component string, position bigint, u string, v string, eid string")


def unary_links(links: DataFrame) -> DataFrame:
    """Links between two segments where no other link touches either of the two joined ends."""
    lone = cut(degrees(links).filter("degree = 1").select("node", "side"), "lone")
    rows = links.filter("from_node <> to_node").withColumn("from_side", F.when(F.col("from_orn") == "+", "R").otherwise("L")).withColumn("to_side", F.when(F.col("to_orn") == "+", "L").otherwise("R"))
    a = lone.select(F.col("node").alias("from_node"), F.col("side").alias("from_side"))
    b = lone.select(F.col("node").alias("to_node"), F.col("side").alias("to_side"))
    return rows.join(a, ["from_node", "from_side"], "left_semi").join(b, ["to_node", "to_side"], "left_semi").select(*links.columns, "from_side", "to_side")


def chains(g: Graph, merge: DataFrame) -> DataFrame:
    """(name, kept, orn, position, overlap): each merged segment's chain, its orientation there (the kept
    one is ``+``), its place and the overlap with the segment before.

    A state is a segment with the side it is left by; pointer jumping finds the state's last one."""
    ab = merge.select(F.col("from_node").alias("u"), F.col("from_side").alias("us"), F.col("to_node").alias("v"), F.col("to_side").alias("vs"), cigar_overlap(F.col("alignment")).alias("k"))
    ba = ab.select(F.col("v").alias("u"), F.col("vs").alias("us"), F.col("u").alias("v"), F.col("us").alias("vs"), "k")
    state = lambda n, s: F.concat_ws("\t", s, n)
    other = F.when(F.col("vs") == "L", "R").otherwise("L")
    hop = ab.union(ba).select(state("u", "us").alias("s"), state("v", other).alias("t"), "k")
    hop = cut(hop, "hops")
    ends = hop.select(F.col("t").alias("s")).join(hop, "s", "left_anti").distinct()
    jump = cut(hop.select("s", "t", F.lit(1).cast("bigint").alias("d")).union(ends.select("s", F.col("s").alias("t"), F.lit(0).cast("bigint"))), "jumps")
    total = max(1, jump.count())
    for _ in range(total.bit_length() + 1):
        on = jump.select(F.col("s").alias("t"), F.col("t").alias("t2"), F.col("d").alias("d2"))
        new = cut(jump.join(on, "t").select("s", F.col("t2").alias("t"), (F.col("d") + F.col("d2")).alias("d")), "jumps")
        if new.join(ends.select(F.col("s").alias("t")), "t", "left_anti").isEmpty():
            jump = new
            break
        jump = new
    # States that reach no end go round a closed cycle, which stays as it is.
    done = jump.join(ends.select(F.col("s").alias("t")), "t", "left_semi")
    named = done.select(F.expr("substring(s, 3)").alias("name"), F.left(F.col("s"), F.lit(1)).alias("side"), "t", "d")
    right = named.filter("side = 'R'").select("name", F.col("t").alias("rt"), F.col("d").alias("rd"))
    left = named.filter("side = 'L'").select("name", F.col("t").alias("lt"), F.col("d").alias("ld"))
    both = right.join(left, "name").join(g.segments.select("name", "ord"), "name")
    both = both.withColumn("chain", F.least("rt", "lt"))
    first = both.groupBy("chain").agg(F.min_by(F.struct("name", "rt"), F.struct("ord", "name")).alias("k"))
    placed = both.join(first, "chain").withColumn("along", F.col("rt") == F.col("k.rt"))
    rows = placed.select("name", F.col("k.name").alias("kept"), F.when(F.col("along"), "+").otherwise("-").alias("orn"), F.when(F.col("along"), F.col("ld")).otherwise(F.col("rd")).alias("position"))
    # The link that a segment is reached by leaves it at the side behind it.
    behind = hop.select(F.expr("substring(s, 3)").alias("name"), F.left(F.col("s"), F.lit(1)).alias("side"), "k")
    rows = rows.withColumn("side", F.when(F.col("orn") == "+", "L").otherwise("R"))
    return rows.join(behind, ["name", "side"], "left").select("name", "kept", "orn", "position", F.col("k").alias("overlap"))


def compact(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(segments, links) with every chain of unary links merged into its segment of least ``ord``.

    A merged sequence is unknown (``*``) where a part of it or an overlap is; ``members`` lists the merged
    names in order. Other links keep id and tags and are re-pointed, flipped where the segment was."""
    pieces, rest, links = compact_pieces(g)
    merged = pieces.groupBy("kept").agg(F.array_sort(F.collect_list(F.struct("position", "name", "piece"))).alias("ps"), F.count("*").alias("n"), F.count("length").alias("known"), F.sum("length").alias("total"))
    whole = F.when(F.exists("ps", lambda p: p["piece"].isNull()), F.lit("*")).otherwise(F.array_join(F.transform("ps", lambda p: p["piece"]), ""))
    merged = merged.select(F.col("kept").alias("name"), whole.alias("sequence"), F.when(F.col("n") == F.col("known"), F.col("total")).alias("slen"), F.transform("ps", lambda p: p["name"]).alias("members"))
    return rest.select("name", "sequence", "slen", F.array("name").alias("members")).unionByName(merged), links


def compact_pieces(g: Graph, merge: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, other segments, links) of the compaction: a row for each merged segment, so that a chain of
    any length stays many rows: kept, position, name, orn, piece (its letters behind the overlap; null
    where they are unknown) and length. ``merge`` says which links to merge, all unary ones where not."""
    source = replace(g, segments=cut(g.segments.select("ord", "name", "sequence", "slen"), "segments"), links=cut(g.links, "links"))
    merge = cut(unary_links(source.links) if merge is None else merge, "merge")
    return _pieces(source, merge)


def compact_by_edges(g: Graph, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, links) with the wanted links (column ``eid``) merged, of those that are unary; segments have
    the tag ``fu``: the merged names with their orientations, in order."""
    links = cut(g.links, "links")
    merge = unary_links(links).join(wanted.select("eid").distinct(), "eid", "left_semi")
    pieces, rest, links = compact_pieces(replace(g, links=links), merge.select(*g.links.columns, "from_side", "to_side"))
    made = pieces.groupBy("kept").agg(F.array_sort(F.collect_list(F.struct("position", "name", "orn", "piece"))).alias("ps"), F.count("*").alias("n"), F.count("length").alias("known"), F.sum("length").alias("total"))
    whole = F.when(F.exists("ps", lambda p: p["piece"].isNull()), F.lit("*")).otherwise(F.array_join(F.transform("ps", lambda p: p["piece"]), ""))
    made = made.select(F.col("kept").alias("name"), whole.alias("sequence"), F.when(F.col("n") == F.col("known"), F.col("total")).alias("slen"), F.array_join(F.transform("ps", lambda p: F.concat(p["name"], p["orn"])), ",").alias("fu"))
    return rest.select("name", "sequence", "slen", F.lit(None).cast("string").alias("fu")).unionByName(made), links


def _pieces(g: Graph, merge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    chain = cut(chains(g, merge), "chains")
    part = chain.join(g.segments.select("name", "sequence", "slen"), "name")
    trimmed = F.when((F.col("sequence") == "*") | ((F.col("position") > 0) & F.col("overlap").isNull()), None).otherwise(F.substring(oriented(F.col("sequence"), F.col("orn")), F.coalesce(F.when(F.col("position") > 0, F.col("overlap")), F.lit(0)) + 1, F.length("sequence")))
    length = F.col("slen") - F.when(F.col("position") > 0, F.col("overlap")).otherwise(0)
    pieces = part.select("kept", "position", "name", "orn", trimmed.alias("piece"), length.alias("length"))
    rest = g.segments.join(chain.select("name"), "name", "left_anti")
    inside = chain.select("name", "kept", "orn")
    gone = merge.select("ord", "from_node", "to_node", "from_side", "to_side").join(inside.select(F.col("name").alias("from_node")), "from_node", "left_semi").select("ord", "from_node", "to_node")
    links = g.links.join(gone, ["ord", "from_node", "to_node"], "left_anti").select(g.links.columns)
    for end in ("from", "to"):
        at = inside.select(F.col("name").alias(f"{end}_node"), F.col("kept").alias("__kept"), F.col("orn").alias("__orn"))
        links = links.join(at, f"{end}_node", "left")
        links = links.withColumn(f"{end}_orn", F.when(F.col("__orn") == "-", flip(F.col(f"{end}_orn"))).otherwise(F.col(f"{end}_orn")))
        links = links.withColumn(f"{end}_node", F.coalesce("__kept", f"{end}_node")).drop("__kept", "__orn")
    return pieces, rest, links.select(g.links.columns)


def colours(g: Graph, rounds: int = 3) -> DataFrame:
    """(colour, n): how many nodes have each colour after Weisfeiler-Lehman rounds over sequence, length,
    orientations and alignments. Isomorphic graphs have equal tables; different tables prove a difference."""
    now = node_colours(g, rounds)
    return now.groupBy("colour").agg(F.count("*").alias("n"))


def may_be_isomorphic(a: Graph, b: Graph, rounds: int = 3) -> bool:
    x, y = colours(a, rounds), colours(b, rounds)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def node_colours(g: Graph, rounds: int) -> DataFrame:
    """(node, colour) after the rounds."""
    now = cut(g.segments.select(F.col("name").alias("node"), F.xxhash64("sequence", "slen").alias("colour")), "colours")
    links = cut(g.links.select("from_node", "to_node", "from_orn", "to_orn", "alignment"), "links")
    for _ in range(rounds):
        a = links.join(now.withColumnRenamed("node", "to_node"), "to_node").select(F.col("from_node").alias("node"), F.xxhash64(F.lit("out"), "from_orn", "to_orn", "alignment", "colour").alias("x"))
        b = links.join(now.withColumnRenamed("node", "from_node"), "from_node").select(F.col("to_node").alias("node"), F.xxhash64(F.lit("in"), "from_orn", "to_orn", "alignment", "colour").alias("x"))
        # A sum of hashes stands for the multiset: it aggregates partially, whatever the degree.
        around = a.union(b).groupBy("node").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("around"), F.count("*").alias("n"))
        now = cut(now.join(around, "node", "left").select("node", F.xxhash64("colour", F.coalesce("around", F.lit(0)).cast("string"), F.coalesce("n", F.lit(0))).alias("colour")), "colours")
    return now


#: Components of a size up to this are compared by search; names decide in larger ones only where colours do.
SEARCH_NODES = 10_000


def isomorphic(a: Graph, b: Graph, rounds: int = 3) -> bool:
    """Whether some renaming of segments makes the graphs equal (sequences, lengths, links with orientations and
    alignments).

    Components are grouped by the multiset of their nodes' colours; those of a group are compared
    exactly, by search within colours, a group a task, and each kind must be there as often in
    both graphs. Raises where a component has over
    ``SEARCH_NODES`` nodes and colours do not tell all of its nodes apart."""
    shapes = []
    for side, g in (("a", a), ("b", b)):
        where = cut(components(g).join(node_colours(g, rounds), "node"), "coloured")
        key = where.groupBy("component").agg(F.count("*").alias("n"), F.countDistinct("colour").alias("kinds"), F.sum(F.col("colour").cast("decimal(38,0)")).cast("string").alias("shape"))
        if not key.filter((F.col("n") > SEARCH_NODES) & (F.col("kinds") < F.col("n"))).isEmpty():
            raise ValueError("a component is too large and too regular for an exact comparison")
        nodes = where.join(key.select("component", "shape"), "component").select("shape", "component", F.lit("n").alias("t"), F.col("node").alias("u"), F.lit("").alias("v"), F.col("colour").cast("string").alias("x"))
        place = where.select(F.col("node").alias("from_node"), "component").join(key.select("component", "shape"), "component")
        edges = g.links.select("from_node", "to_node", "from_orn", "to_orn", F.coalesce("alignment", F.lit("*")).alias("alignment")).join(place, "from_node")
        edges = edges.select("shape", "component", F.lit("e").alias("t"), F.col("from_node").alias("u"), F.col("to_node").alias("v"), F.concat_ws("\t", "from_orn", "to_orn", "alignment").alias("x"))
        each = nodes.unionByName(edges).groupBy("shape", "component").agg(F.array_sort(F.collect_list(F.struct("t", "u", "v", "x"))).alias("rows"))
        shapes.append(cut(each.withColumn("side", F.lit(side)), "shapes"))

    def classes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """How many components of each side fall in each class of truly equal ones."""
        found: list[tuple[list, dict[str, int]]] = []
        for rows, side in zip(pdf["rows"], pdf["side"], strict=True):
            one = [(r["t"], r["u"], r["v"], r["x"]) for r in rows]
            same = next((c for r, c in found if _same_shape(r, one)), None)
            if same is None:
                same = {"a": 0, "b": 0}
                found.append((one, same))
            same[side] += 1
        return pd.DataFrame({"differ": [any(c["a"] != c["b"] for _, c in found)]})

    return shapes[0].unionByName(shapes[1]).groupBy("shape").applyInPandas(classes, "differ boolean").filter("differ").isEmpty()


def _same_shape(a: list[tuple], b: list[tuple]) -> bool:
    """Whether a renaming of nodes makes two small coloured graphs equal: search over nodes in the order in
    which links reach them, candidates of equal colour only."""
    if len(a) != len(b):
        return False
    colour = [{u: x for t, u, _, x in rows if t == "n"} for rows in (a, b)]
    links = [Counter((u, v, x) for t, u, v, x in rows if t == "e") for rows in (a, b)]
    if sorted(colour[0].values()) != sorted(colour[1].values()):
        return False
    near: list[dict[str, set[str]]] = [{u: set() for u in c} for c in colour]
    of: list[dict[str, list]] = [{u: [] for u in c} for c in colour]
    for k in (0, 1):
        for (u, v, x), n in links[k].items():
            near[k][u].add(v)
            near[k][v].add(u)
            of[k][u].append((u, v, x, n))
            if u != v:
                of[k][v].append((u, v, x, n))
    rare = Counter(colour[0].values())
    order, seen = [], set()
    for start in sorted(colour[0], key=lambda u: (rare[colour[0][u]], u)):
        queue = [] if start in seen else [start]
        seen.update(queue)
        for u in queue:
            order.append(u)
            new = sorted(near[0][u] - seen)
            seen.update(new)
            queue.extend(new)
    by_colour: dict[str, list[str]] = {}
    for w, c in colour[1].items():
        by_colour.setdefault(c, []).append(w)
    to: dict[str, str] = {}
    used: set[str] = set()

    def fits(u: str, w: str) -> bool:
        to[u] = w
        good = all(links[1][to[p], to[q], x] == n for p, q, x, n in of[0][u] if p in to and q in to)
        good = good and sum(n for p, q, _, n in of[0][u] if p in to and q in to) == sum(n for p, q, _, n in of[1][w] if (p in used or p == w) and (q in used or q == w))
        del to[u]
        return good

    tries = [iter(by_colour[colour[0][order[0]]])] if order else []
    while tries:
        u = order[len(tries) - 1]
        if u in to:  # back from a dead end
            used.discard(to.pop(u))
        w = next((w for w in tries[-1] if w not in used and fits(u, w)), None)
        if w is None:
            tries.pop()
            continue
        to[u] = w
        used.add(w)
        if len(to) == len(order):
            return True
        u = order[len(tries)]
        known = next((p for p in near[0][u] if p in to), None)
        choice = near[1][to[known]] if known is not None else by_colour[colour[0][u]]
        tries.append(iter([w for w in sorted(choice) if colour[1][w] == colour[0][u]]))
    return not order
