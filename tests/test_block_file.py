"""The block format: round trips over codecs and block sizes, layout, statistics, broken files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from graphloom.functions import codecs as co
from graphloom.operators import graph as gr
from graphloom.sources import block_file as bf
from graphloom.sources import gfa_text

TEXT = """H\tVN:Z:1.0
S\t1\tACGTAA\tRC:i:5
S\t2\tCCGGTTn
S\t3\t*\tLN:i:9
S\t4\tTT
L\t1\t+\t2\t-\t2M\tID:Z:one
L\t2\t-\t3\t+\t*\tMQ:i:7
L\t3\t+\t3\t+\t1M2I
L\t4\t+\tunseen\t-\t1M
C\t1\t+\t4\t+\t4\t2M
P\tx\t1+,2-,3+\t2M,3M
P\ty\t1+
W\ts\t0\tchr\t0\t9\t>1<2>3
W\tt\t1\tchr\t12\t40\t1-2+3+"""


@pytest.fixture(scope="module")
def g(spark):
    return gfa_text.parse(gfa_text.lines_of(spark, TEXT))


def lines(g):
    return sorted(r["line"] for r in gfa_text.canonical(g).select("line").collect())


def expected(g):
    # No headers, tags of paths and walks; nodes that only links name get a segment.
    return sorted(x for x in lines(gr.with_implicit_nodes(g)) if x[0] != "H")


@pytest.mark.parametrize("options", [{}, {"block_size": 1}, {"path_steps": bf.walk_code("varint", "varint-none"), "walk_steps": bf.walk_code("rice", "bit_packing-gzip")}, {"sequences": "pfor_delta+2bit", "segment_names": "dictionary", "tags": "rle", "link_cigars": "huffman"}, {"link_endpoints": "group_varint", "walk_positions": "simple_8b", "path_cigars": "zstd", "path_names": "bwt_huffman"}])
def test_round_trip(spark, g, tmp_path, options):
    path = str(tmp_path / "g.bin")
    bf.write(g, path, **options)
    again = bf.read(spark, path)
    assert [x.replace("\tID:Z:one", "") for x in lines(again)] == [x.replace("\tID:Z:one", "") for x in expected(g)]
    assert again.links.filter("eid = 'one' and from_node = '1'").count() == 1
    assert again.links.filter("kind = 'C'").select("pos", "alignment").first() == (4, "2M")
    report = bf.validate(spark, path).collect()
    assert report and all(r["correct"] for r in report), [r for r in report if not r["correct"]]


def test_layout(spark, tmp_path):
    g = gfa_text.parse(gfa_text.lines_of(spark, "S\ta\tAC\nS\tbb\t*\nL\tbb\t+\ta\t-\t3M"))
    path = tmp_path / "g.bin"
    bf.write(g, str(path), segment_names="none", sequences="none")
    data = path.read_bytes()
    head = b"BGFA" + struct.pack("<HH", 1, 10) + b"H\tVN:Z:1.0\0"
    assert data.startswith(head)
    names, seqs = b"\1\2abb", b"\2\1AC*"
    segments = struct.pack("<BHHQQHQQ", 2, 2, 0x0100, len(names), 3, 0x0100, len(seqs), 2) + names + seqs
    ends = b"\2\1" + struct.pack("<QQ", 0, 1)
    links = struct.pack("<BHHQIQQ", 3, 1, 0x0100, len(ends), 0x00010101, 3, 2) + ends + b"\1\3\x0f"
    assert data == head + segments + links


def test_empty_graph(spark, tmp_path):
    path = str(tmp_path / "g.bin")
    bf.write(gr.Graph.of(spark), path)
    assert lines(bf.read(spark, path)) == []
    assert bf.header(path)["text"] == "H\tVN:Z:1.0"


def test_random_graph_over_blocks(spark, tmp_path):
    rng = random.Random(5)
    n = 300
    text = [f"S\ts{i}\t{''.join(rng.choice('ACGT') for _ in range(rng.randrange(1, 30)))}" for i in range(n)]
    text += [f"L\ts{rng.randrange(n)}\t{rng.choice('+-')}\ts{rng.randrange(n)}\t{rng.choice('+-')}\t{rng.randrange(9)}M" for _ in range(900)]
    text += [f"P\tp{i}\t{','.join(f's{rng.randrange(n)}' + rng.choice('+-') for _ in range(rng.randrange(1, 200)))}" for i in range(70)]
    g = gfa_text.parse(gfa_text.lines_of(spark, "\n".join(text)))
    path = str(tmp_path / "g.bin")
    bf.write(g, path, block_size=64)
    assert lines(bf.read(spark, path)) == expected(g)
    stats = bf.statistics(spark, path)
    assert dict(stats.filter("section_field in ('fromto', 'paths')").groupBy("section_type").agg(F.count("*")).collect()) == {"links": 15, "paths": 2}
    assert stats.agg(F.sum("compressed_length")).first()[0] > 0
    timed = bf.measure(spark, path, "sequences", 3.0).collect()
    assert len(timed) == 1 and timed[0]["encode_time_ms"] == 3.0 and timed[0]["uncompressed_length"] == sum(len(x.split("\t")[2]) for x in text if x[0] == "S")


def test_broken_files(spark, g, tmp_path):
    good = tmp_path / "g.bin"
    bf.write(g, str(good))
    data = good.read_bytes()
    bad = tmp_path / "bad.bin"

    def with_bytes(b):
        bad.write_bytes(b)
        return str(bad)

    for broken in (b"", b"XXXX" + data[4:], data[:17], data[:-3], data + b"\x63"):
        with pytest.raises(bf.BlockError):
            list(bf.walk(with_bytes(broken)))
    longer = bytearray(data)
    at = 19 + bf.HEADS[2].size - 16  # the stored size of the sequences' bytes
    longer[at + 6] = 0x7F
    with pytest.raises(bf.BlockError):
        list(bf.walk(with_bytes(bytes(longer))))
    other = bytearray(data)
    other[19 + bf.HEADS[2].size] ^= 3  # the length of the first name
    report = bf.validate(spark, with_bytes(bytes(other))).filter("not correct").collect()
    assert [(r["section_id"], r["section_field"]) for r in report] == [(2, "names")]


def test_side_file(spark, g, tmp_path):
    """The walk is the same with the side file, without it, and with one that does not fit."""
    path = tmp_path / "g.bin"
    bf.write(g, str(path), block_size=1)
    side = tmp_path / "g.bin.blocks"
    with_side = list(bf.walk(str(path)))
    noted = side.read_bytes()
    for other in (None, noted[:-8], b"", noted[8:], struct.pack("<2q", 40, path.stat().st_size), b"abc"):
        side.unlink(missing_ok=True)
        if other is not None:
            side.write_bytes(other)
        assert list(bf.walk(str(path))) == with_side


def test_options_that_cannot_be(spark, g, tmp_path):
    for options in ({"nonsense": "none"}, {"tags": "gamma"}, {"path_steps": bf.walk_code("varint", "varint-gzip")}, {"block_size": 0}, {"block_size": 70000}):
        with pytest.raises(ValueError):
            bf.blocks_of(g, **options)
    assert co.cigar_code() == 0x00010101


def test_reading_sends_no_records_through_the_driver(spark, g, tmp_path):
    """A block's row is small, what it decodes to is not: no plan may take the one's size for the other's."""
    path = str(tmp_path / "g.bin")
    bf.write(g, path)
    df = gfa_text.canonical(bf.read(spark, path))
    df.collect()  # plans change as they run
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_writing_in_pieces(spark, g, tmp_path, monkeypatch):
    bf.write(g, str(tmp_path / "whole.bin"), block_size=2)
    monkeypatch.setattr(bf, "PIECE", 7)
    monkeypatch.setattr(bf, "AT_ONCE", 50)
    bf.write(g, str(tmp_path / "pieces.bin"), block_size=2)
    for end in ("", ".blocks"):
        assert (tmp_path / f"pieces.bin{end}").read_bytes() == (tmp_path / f"whole.bin{end}").read_bytes()
