"""Command line: ``python -m graphloom.cli COMMAND …``.

encode text into a block file, cat a block file as canonical text, measure, validate or dump one,
canonical (text to canonical text), characterise a graph, pretty (a readable listing), same (whether two
graphs are equal, or equal but for names), rank (the best codecs of measurement CSV files), or list the
encodings.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
import tomllib

from pyspark.sql import functions as F

from graphloom.functions import codecs
from graphloom.operators import algorithms, analytics, graph, reports
from graphloom.session import session
from graphloom.sources import block_file, gfa_text, graph_file


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    encode = sub.add_parser("encode", help="text to a block file")
    encode.add_argument("input")
    encode.add_argument("output")
    encode.add_argument("--block-size", type=int)
    encode.add_argument("--config", help="TOML file of options; the command line goes before it")
    for name in block_file.OPTIONS:
        encode.add_argument("--" + name.replace("_", "-"), metavar="INT+STR")
    for name, text in (("cat", "block file to canonical text"), ("canonical", "text to canonical text"), ("characterise", "figures of a graph")):
        c = sub.add_parser(name, help=text)
        c.add_argument("input")
        if name != "characterise":
            c.add_argument("--output", help="folder; the standard output without")
    measure = sub.add_parser("measure", help="sizes and times by block and field, as CSV")
    measure.add_argument("input")
    measure.add_argument("--output")
    measure.add_argument("--option", choices=sorted(block_file.MEASURES))
    measure.add_argument("--encode-time-ms", type=float, default=0.0)
    sub.add_parser("validate", help="check each block and field; fails where one is wrong").add_argument("input")
    dump = sub.add_parser("dump", help="the decoded tables as JSON lines, as far as a cut or broken file goes; fails where it is one")
    dump.add_argument("input")
    dump.add_argument("--blocks", action="store_true", help="the blocks too, before the tables")
    dump.add_argument("--text", action="store_true", help="indented text, with the blocks")
    sub.add_parser("pretty", help="counts and every element, to be read").add_argument("input")
    same = sub.add_parser("same", help="whether two graphs are equal but for the names of segments; fails where not")
    same.add_argument("first")
    same.add_argument("second")
    same.add_argument("--strict", action="store_true", help="names count too")
    rank = sub.add_parser("rank", help="the best codecs of each option")
    rank.add_argument("inputs", nargs="+", help="CSV files of measurements")
    rank.add_argument("--mode", choices=reports.MODES, default="balanced")
    rank.add_argument("--top", type=int, default=5)
    rank.add_argument("--by", help="a characteristic to rank within the quartiles of")
    rank.add_argument("--format", choices=("text", "markdown", "json"), default="text")
    sub.add_parser("encodings", help="every pair of codecs with its code")
    return p


def _text(g, output: str | None) -> None:
    if output:
        gfa_text.write_text(g, output)
        return
    lines = gfa_text.canonical(g)
    if g.headers.isEmpty():
        print("H\tVN:Z:1.0")
    for r in lines.orderBy("section", "key", "line").select("line").toLocalIterator():
        print(r["line"])


def _dump(spark, path: str, text: bool, with_blocks: bool) -> int:
    """0 where every block could be decoded."""
    try:
        head = block_file.header(path)
    except block_file.BlockError as e:
        print(f"error: {e}" if text else json.dumps({"error": str(e)}))
        return 1
    print("\n".join(["header", *[f"  {k}: {v!r}" for k, v in head.items()]]) if text else json.dumps({"header": head}))
    errors = []
    for b in block_file.outline(path):
        if "error" in b:
            errors.append(b["error"])
        elif text:
            print(f"block {b['index']}: {b['section']}, {b['records']} records, {b['size']} bytes from {b['start']}")
            for p in b["fields"]:
                print(f"  {p['field']}: code {p['code']:#x}, {p['size']} bytes, {p['raw']} raw")
        elif with_blocks:
            print(json.dumps({"block": b}))
    for r in block_file.validate(spark, path, damaged=True).filter("not correct").orderBy("block_index", "section_field").toLocalIterator():
        errors.append(f"block {r['block_index']}, {r['section_field']}: {r['message']}")
    g = block_file.read(spark, path, damaged=True)
    for name in ("segments", "links", "paths", "walks"):
        rows = getattr(g, name).orderBy("ord")
        if text:
            print(name)
            for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
                print("  " + ", ".join(f"{k}: {v if isinstance(v, (str, int)) else json.dumps(v)}" for k, v in json.loads(r["j"]).items()))
        else:
            for r in rows.select(F.to_json(F.struct(F.lit(name).alias("table"), "*")).alias("j")).toLocalIterator():
                print(r["j"])
    for e in errors:
        print(f"error: {e}" if text else json.dumps({"error": e}))
    return int(bool(errors))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "encodings":
        for integer, string, code in codecs.catalogue():
            print(f"{integer}+{string}\t{code:#06x}")
        return 0
    spark = session(a.master)
    if a.command == "encode":
        options: dict = {}
        if a.config:
            with open(a.config, "rb") as f:
                options = {k.replace("-", "_"): v for k, v in tomllib.load(f).items()}
        options |= {k: v for k in [*block_file.OPTIONS, "block_size"] if (v := getattr(a, k)) is not None}
        began = time.perf_counter()
        block_file.write(graph_file.load(spark, a.input, graph_file.TEXT), a.output, **options)
        print(f"encoded in {1000 * (time.perf_counter() - began):.0f} ms", file=sys.stderr)
    elif a.command == "cat":
        _text(block_file.read(spark, a.input), a.output)
    elif a.command == "canonical":
        _text(graph_file.load(spark, a.input), a.output)
    elif a.command == "pretty":
        for line in reports.pretty(graph_file.load(spark, a.input)):
            print(line)
    elif a.command == "same":
        x, y = (graph_file.load(spark, p) for p in (a.first, a.second))
        equal = graph.equal(x, y) if a.strict else algorithms.isomorphic(x, y)
        print("equal" if equal else "different")
        return int(not equal)
    elif a.command == "rank":
        stats = reports.read_stats(spark, *a.inputs)
        if a.by:
            rows = reports.by_characteristic(stats, a.by, a.mode, a.top)
            for bucket in ("q1", "q2", "q3", "q4", "all"):
                part = rows.filter(F.col("bucket") == bucket)
                if not part.isEmpty():
                    print(f"{a.by} {bucket}\n{reports.report(part, a.format)}")
        else:
            print(reports.report(reports.chosen(stats, a.mode, a.top), a.format))
    elif a.command == "characterise":
        print(analytics.characterise(graph_file.load(spark, a.input)).toJSON().first())
    elif a.command == "measure":
        rows = block_file.measure(spark, a.input, a.option, a.encode_time_ms)
        if a.output:
            rows.write.csv(a.output, header=True)
        else:
            print(",".join(rows.columns))
            for r in rows.orderBy("block_index", "section_field").toLocalIterator():
                print(",".join(map(str, r)))
    elif a.command == "validate":
        report = block_file.validate(spark, a.input).orderBy("block_index", "section_field")
        wrong = 0
        for r in report.toLocalIterator():
            wrong += not r["correct"]
            print(json.dumps(r.asDict()))
        return int(wrong > 0)
    else:
        return _dump(spark, a.input, a.text, a.blocks or a.text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
