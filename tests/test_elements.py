"""Single elements, reports, marks, the scan's order, exact comparison, compaction by edges."""

import gzip
import lzma
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions import sequence as sq
from graphloom.operators import algorithms as al
from graphloom.operators import elements as el
from graphloom.operators import graph as gr
from graphloom.operators import reports as rp
from graphloom.sources import discover, gfa_text

TEXT = "S\ta\tACGT\tRC:i:1\nS\tb\tGGTT\nS\tc\t*\nL\ta\t+\tb\t-\t2M\tID:Z:one\nL\tb\t+\ta\t+\t*\tID:Z:two\nL\tb\t+\tc\t+\t1M\tID:Z:three\nP\tp\ta+,b-\t2M\nW\ts\t0\tq\t0\t4\t>a<b"


@pytest.fixture(scope="module")
def g(spark):
    return gfa_text.parse(gfa_text.lines_of(spark, TEXT))


def graph(spark, text):
    return gfa_text.parse(gfa_text.lines_of(spark, text))


def names(df, c):
    return sorted(r[0] for r in df.select(c).collect())


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def test_guarded_inserts(spark, g):
    more = graph(spark, "S\ta\tTTTT\nS\td\tC\nL\ta\t+\td\t+\t*\tID:Z:four\nL\ta\t+\tlost\t+\t*\tID:Z:five\nP\tone\ta+\t*")
    assert names(el.add(g, "node", more.segments).segments, "name") == ["a", "b", "c", "d"]
    with pytest.raises(el.ElementExists):
        el.add(g, "node", more.segments, safe=True)
    bigger = el.add(g, "node", more.segments.filter("name = 'd'"), safe=True)
    assert el.add(bigger, "edge", more.links.filter("eid = 'four'"), safe=True).links.count() == 4
    with pytest.raises(el.MissingElement):
        el.add(bigger, "edge", more.links.filter("eid = 'five'"), safe=True)
    with pytest.raises(el.ElementExists):  # an edge has the name
        el.add(g, "path", more.paths, safe=True)


def test_removals(spark, g):
    assert names(el.remove(g, "node", ids(spark, "a")).links, "eid") == ["three"]
    assert el.remove(g, "path", ids(spark, "p")).paths.count() == 0
    for kind in el.KINDS:
        with pytest.raises(el.MissingElement):
            el.remove(g, kind, ids(spark, "nothing"))
    assert names(el.remove_between(g, "b", "a").links, "eid") == ["three"]
    assert names(el.remove_between(g, "a", "b", "one").links, "eid") == ["three", "two"]
    with pytest.raises(el.MissingElement):
        el.remove_between(g, "a", "c")
    with pytest.raises(el.BadSearch):
        el.between(g.links, "a", None)
    assert names(el.remove_pairs(g.links, spark.createDataFrame([("c", "b")], "u string, v string")), "eid") == ["one", "two"]
    assert gr.counts(el.cleared(g)).first() == (0, 0, 0, 0)


def test_lookup(spark, g):
    assert el.element(g, "a").row["sequence"] == "ACGT" and el.element(g, "two").kind == "edge" and el.element(g, "p").kind == "path"
    with pytest.raises(el.MissingElement):
        el.element(g, "nothing")
    assert names(el.contains(g, ids(spark, "a", "one", "x", None)), "id") == ["a", "one"]
    assert el.is_node(el.element(g, "a").row) and not el.is_node({"name": "x"}) and el.is_edge(el.element(g, "one").row)
    sub = gfa_text.subgraphs_of(gfa_text.lines_of(spark, "O\tx\ta+ b-\nU\ty\ta one\nP\tz\ta+,b-\t*"))
    assert {r["sub_id"]: r["path"] for r in sub.select("sub_id", el.is_path().alias("path")).collect()} == {"x": True, "y": False, "z": True}
    assert sub.filter("sub_id = 'x'").select(el.subgraph_map(True)).first()[0] == '{"a":"+","b":"-"}'
    whole = gr.replace(g, subgraphs=sub)
    assert el.element(whole, "y").kind == "subgraph" and names(gr.stored_subgraph(whole, "y").links, "eid") == ["one", "two"]


def test_equality(spark, g):
    same = graph(spark, "\n".join(reversed(TEXT.split("\n"))))
    other = graph(spark, TEXT.replace("RC:i:1", "RC:i:2"))
    assert el.same_rows(g.segments, same.segments, "node") and not el.same_rows(g.segments, other.segments, "node")
    assert el.same_rows(g.segments, other.segments, "node", tags=False) and el.same_rows(g.links, same.links, "edge")


def test_line_parser(spark):
    assert gfa_text.parse_line(spark, "S\tx\tAC\tRC:i:3")["tags"]["RC"] == {"type": "i", "value": "3"}
    assert gfa_text.parse_line(spark, "x\tAC", "S")["name"] == "x"
    for bad in ("S\tx", "Q\tx", "", "L\ta\t?\tb\t+\t*"):
        with pytest.raises(el.MalformedLine):
            gfa_text.parse_line(spark, bad)


def test_order_over_files(spark, tmp_path):
    """Later files overwrite earlier ones by name, whatever their sizes; packed ones too."""
    lines = {"a": ["S\tx\tAAAA"] + [f"S\tn{i}\tC" for i in range(500)], "b": ["S\tx\tCC", "S\ty\tG"], "c": ["S\tx\tGGG"]}
    for suffix, pack in ((".gfa", bytes), (".gfa.gz", gzip.compress), (".gfa.xz", lzma.compress), (".gfa.zst", zstandard.compress)):
        folder = tmp_path / suffix[1:]
        folder.mkdir()
        for name, text in lines.items():
            (folder / (name + suffix)).write_bytes(pack("\n".join(text).encode()))
        rows = gfa_text.read_lines(spark, str(folder)).orderBy("ord").collect()
        assert [r["line"] for r in rows] == lines["a"] + lines["b"] + lines["c"], suffix
        assert len({r["ord"] for r in rows}) == len(rows)


def test_marks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.gfa").write_text("# test: one, two\n\n#benchmark: fast\nS\tx\tA\n# test: late\n")
    (tmp_path / "in" / "a.gfa").write_text("#other\n# benchmark: slow")
    got = {(r["path"].rsplit("/", 2)[-2] == "in", r["kind"], r["name"]) for r in discover.marks(spark, str(tmp_path)).collect()}
    assert got == {(False, "test", "one"), (False, "test", "two"), (False, "benchmark", "fast"), (True, "benchmark", "slow")}
    assert names(discover.dataset_names(discover.marks(spark, str(tmp_path))), "dataset") == ["a", "a_2"]


STATS = "compression_option,compression_value,uncompressed_length,compressed_length,encode_time_ms,decode_time_ms,original_gfa,size\n"


def test_reports(spark, tmp_path, capsys):
    rows = [("names", "x", 1000, 100, 5, 5, "d1", 10), ("names", "y", 1000, 500, 1, 1, "d1", 10), ("names", "x", 900, 90, 6, 6, "d2", 400), ("tags", "x", 10, 0, 0, 0, "d2", 400)]
    body = [",".join(map(str, r)) + "\n" for r in rows]
    (tmp_path / "a.csv").write_text(STATS + "".join(body[:2]))
    (tmp_path / "b.csv.zst").write_bytes(zstandard.compress((STATS + "".join(body[2:])).encode()))
    stats = rp.read_stats(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv.zst"))
    assert sorted(r["ratio"] for r in stats.collect()) == [1.0, 2.0, 10.0, 10.0]
    best = rp.chosen(stats, "best-ratio", 1)
    assert {(r["compression_option"], r["compression_value"]) for r in best.collect()} == {("names", "x"), ("tags", "x")}
    text, mark, js = (rp.report(best, f) for f in ("text", "markdown", "json"))
    assert text.splitlines()[1].split()[:3] == ["names", "x", "10.0000"] and mark.splitlines()[1].startswith("| --- |") and '"compression_value": "x"' in js
    assert {r["compression_value"] for r in rp.chosen(stats, "pareto").filter("compression_option = 'names'").collect()} == {"x", "y"}
    buckets = rp.by_characteristic(stats, "size", "best-speed", 1)
    assert {(r["bucket"], r["compression_option"], r["compression_value"]) for r in buckets.collect()} >= {("q1", "names", "y")}
    with pytest.raises(ValueError):
        rp.chosen(stats, "nonsense")
    assert cli.main(["rank", str(tmp_path / "a.csv"), "--mode", "best-speed", "--top", "1", "--format", "markdown"]) == 0
    assert "| names | y |" in capsys.readouterr().out
    chars = spark.createDataFrame([("d1", 7)], "file string, segments int")
    assert {(r["original_gfa"], r["segments"]) for r in rp.with_characteristics(rp.annotate(stats, run=1), chars).collect()} == {("d1", "7"), ("d2", "")}
    assert rp.run_matrix(spark, ["d"], ["o", "p"], ["v", "w", "x"], [64]).count() == 6


def test_listing(g):
    out = list(rp.pretty(g))
    assert out[0] == "segments 3, links 3, paths 1, walks 1" and out[1] == "node a length=4 sequence=ACGT RC:i:1"
    assert "path p a+,b- overlaps=2M" in out and "edge one a+ -> b- alignment=2M ID:Z:one" in out


def renamed(spark, text, rng):
    to = {}
    lines = []
    for line in text.split("\n"):
        f = line.split("\t")
        for i in (1,) if f[0] == "S" else (1, 3):
            f[i] = to.setdefault(f[i], f"r{rng.randrange(10**9)}")
        lines.append("\t".join(f))
    rng.shuffle(lines)
    return graph(spark, "\n".join(lines))


def test_isomorphic(spark):
    rng = random.Random(4)
    ring = lambda k, n: [f"S\t{k}{i}\tAC" for i in range(n)] + [f"L\t{k}{i}\t+\t{k}{(i + 1) % n}\t+\t*" for i in range(n)]
    six, two = "\n".join(ring("a", 6)), "\n".join(ring("a", 3) + ring("b", 3))
    assert al.may_be_isomorphic(graph(spark, six), graph(spark, two))  # colours cannot tell them apart
    assert not al.isomorphic(graph(spark, six), graph(spark, two))
    assert al.isomorphic(graph(spark, two), renamed(spark, two, rng)) and al.isomorphic(graph(spark, six), renamed(spark, six, rng))
    twice = six + "\nL\ta0\t+\ta1\t+\t*"
    assert not al.isomorphic(graph(spark, six), graph(spark, twice))


def test_same_shape_by_brute_force():
    """The search against all renamings of small graphs."""
    import itertools

    rng = random.Random(12)
    for _ in range(150):
        n = rng.randrange(1, 6)
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice("xy")) for _ in range(rng.randrange(7))]
        other = [(rng.randrange(n), rng.randrange(n), rng.choice("xy")) for _ in edges]
        if rng.random() < 0.6:
            p = rng.sample(range(n), n)
            other = [(p[u], p[v], x) for u, v, x in edges]
            if edges and rng.random() < 0.4:
                u, v, x = other[0]
                other[0] = (v, u, x)
        make = lambda es: [("n", str(u), "", "c") for u in range(n)] + [("e", str(u), str(v), x) for u, v, x in es]
        want = any(sorted((p[u], p[v], x) for u, v, x in edges) == sorted(other) for p in itertools.permutations(range(n)))
        assert al._same_shape(make(edges), make(other)) == want


def test_compaction_by_edges(spark):
    g = graph(spark, "S\t1\tACGT\nS\t2\tGTAA\nS\t3\tAACC\nL\t1\t+\t2\t+\t2M\tID:Z:x\nL\t2\t+\t3\t+\t2M\tID:Z:y")
    segments, links = al.compact_by_edges(g, spark.createDataFrame([("x",)], "eid string"))
    assert sorted((r["name"], r["sequence"], r["fu"]) for r in segments.collect()) == [("1", "ACGTAA", "1+,2+"), ("3", "AACC", None)]
    assert [(r["from_node"], r["to_node"]) for r in links.collect()] == [("1", "3")]
    pieces, rest, _ = al.compact_pieces(g)
    assert [(r["name"], r["piece"]) for r in pieces.orderBy("position").collect()] == [("1", "ACGT"), ("2", "AA"), ("3", "CC")] and rest.count() == 0


def test_selectors(spark):
    g = graph(spark, "S\tA\t*\nS\tB\t*\nS\tC\t*\nL\tA\t+\tB\t+\t1M\tID:Z:e1\nL\tB\t+\tC\t+\t1M\tID:Z:e2\nL\tA\t+\tC\t+\t*\tID:Z:e3")
    assert [(r["u"], r["v"]) for r in al.dfs_edges(g, "A", F.col("alignment") == "1M").orderBy("position").collect()] == [("A", "B"), ("B", "C")]
    paths = al.simple_paths(g.links, "A", "C", 3, edges=True).collect()
    assert sorted([(e["from_node"], e["to_node"], e["eid"]) for e in r["links"]] for r in paths) == [[("A", "B", "e1"), ("B", "C", "e2")], [("A", "C", "e3")]]


def test_functions(spark):
    assert sq.overlap_of(b"ATCGAAA", b"AAAGCCC") == 3 and sq.overlap_of("", "x") == 0
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randrange(60, 200))) for _ in range(2))
        b = a[len(a) // 2 :] + b
        assert sq.overlap_of(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])
    row = spark.sql("select 'aTcG*x' as s, 'i' as t, '12' as v, 'café' as n").select(sq.reverse_complement_as_is(F.col("s")), sq.sanitise(F.col("n")), sq.tag_value(F.col("t"), F.col("v")), sq.unpack_code(sq.pack_code(F.lit(1), F.lit(2), F.lit(3), F.lit(255)), 4), sq.is_dna(F.lit("*"))).first()
    assert row[0] == "x*CgAt" and row[1] == "caf?" and tuple(row[2]) == (True, "12", 12, None) and list(row[3]) == [1, 2, 3, 255] and row[4] is False
