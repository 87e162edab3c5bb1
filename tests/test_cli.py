"""The command line and the choice of format."""

import json

import pytest

from graphloom import cli
from graphloom.sources import block_file, graph_file

TEXT = "S\tb\tACGT\tRC:i:3\nS\ta\tAC\nL\tb\t+\ta\t-\t2M\nP\tp\tb+,a-\t2M\nW\ts\t0\tc\t0\t4\t>b<a\n"
CANONICAL = ["H\tVN:Z:1.0", "S\ta\tAC", "S\tb\tACGT\tRC:i:3", "L\tb\t+\ta\t-\t2M", "P\tp\tb+,a-\t2M", "W\ts\t0\tc\t0\t4\t>b<a"]


def test_commands(spark, tmp_path, capsys):
    source, target = tmp_path / "g.gfa", str(tmp_path / "g.blocks")
    source.write_text(TEXT)
    config = tmp_path / "o.toml"
    config.write_text('segment-names = "rice+none"\nsequences = "varint+gzip"\nblock_size = 7\n')
    run = lambda *args: (cli.main(list(args)), capsys.readouterr().out.splitlines())
    assert run("encode", str(source), target, "--config", str(config), "--sequences", "varint+2bit") == (0, [])
    codes = {(p.field): p.code for b in block_file.walk(target) for p in b.parts if b.section == block_file.SEGMENTS}
    assert codes == {"names": 0x0700, "sequences": 0x0105}
    assert run("cat", target) == run("canonical", str(source)) == (0, CANONICAL)
    assert graph_file.format_of(target) == graph_file.BLOCKS and graph_file.format_of(str(source)) == graph_file.TEXT
    done, lines = run("validate", target)
    assert done == 0 and len(lines) == len(run("measure", target)[1]) - 1 == 13
    assert len(run("measure", target, "--option", "sequences")[1]) == 2
    assert json.loads(run("characterise", target)[1][0])["n_segments"] == 2
    tables = [json.loads(x).get("table") for x in run("dump", target)[1]]
    assert tables == [None, "segments", "segments", "links", "paths", "walks"]
    data = bytearray((tmp_path / "g.blocks").read_bytes())
    data[19 + block_file.HEADS[2].size + 1] ^= 64  # the first name's length
    (tmp_path / "g.blocks").write_bytes(bytes(data))
    assert run("validate", target)[0] == 1


def test_encodings(capsys):
    assert cli.main(["encodings"]) == 0
    assert "varint+zstd\t0x0101" in capsys.readouterr().out.splitlines()


def test_load_and_save(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(TEXT)
    g = graph_file.load(spark, str(tmp_path / "g.gfa"))
    graph_file.save(g, str(tmp_path / "copy.bgfa"))
    assert graph_file.load(spark, str(tmp_path / "copy.bgfa")).links.count() == 1
    with pytest.raises(ValueError):
        graph_file.load(spark, "x", "nonsense")


def test_dump_of_cut_files(spark, tmp_path, capsys):
    (tmp_path / "g.gfa").write_text(TEXT)
    target = tmp_path / "g.blocks"
    block_file.write(graph_file.load(spark, str(tmp_path / "g.gfa")), str(target))
    data = target.read_bytes()
    run = lambda *args: (cli.main(["dump", str(target), *args]), capsys.readouterr().out.splitlines())
    done, lines = run("--blocks")
    blocks = [json.loads(x)["block"] for x in lines if "block" in json.loads(x)]
    assert done == 0 and [b["section"] for b in blocks] == ["segments", "links", "paths", "walks", "tags"]
    assert sum(b["size"] for b in blocks) == len(data) - blocks[0]["start"]
    for whole, cut_at in ((2, blocks[2]["start"] + 3), (2, blocks[2]["start"] + blocks[2]["size"] - 1), (1, blocks[1]["start"] + 40), (0, blocks[0]["start"] + 5)):
        target.write_bytes(data[:cut_at])
        done, lines = run("--blocks")
        got = [json.loads(x) for x in lines]
        assert done == 1 and "ends early" in got[-1]["error"]
        assert [g["block"]["section"] for g in got if "block" in g] == ["segments", "links"][:whole]
        assert [g["table"] for g in got if "table" in g] == ["segments"] * (2 * (whole > 0)) + ["links"] * (whole > 1)
        done, lines = run("--text")
        assert done == 1 and lines[0] == "header" and lines[-1].startswith("error: ")
    # a payload that cannot be decoded leaves the other blocks alone
    broken = bytearray(data)
    at = blocks[0]["start"] + block_file.HEADS[block_file.SEGMENTS].size
    broken[at] = 0x7F
    target.write_bytes(bytes(broken))
    done, lines = run()
    tables = [json.loads(x).get("table") for x in lines]
    assert done == 1 and "segments" not in tables and {"links", "paths", "walks"} < set(tables)
    for short in (b"", data[:5], b"no such file" * 3):
        target.write_bytes(short)
        assert run()[0] == 1
