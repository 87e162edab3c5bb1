"""The binary block format: columns of up to 65,535 records a block, each with a codec of its own.

Reading: the driver walks the block heads; a task opens the file at its blocks and decodes those. Segment
ordinals become names by a join. The size of path steps is in no head: ``write`` notes where blocks
begin in a side file (``.blocks``), with which the walk reads no steps. Where that is missing, as with a
file of another program, or does not fit the file, the driver finds the end of the steps by
decoding them. Writing: records get ordinals side by side, each block is encoded by one task, and
the blocks are streamed in order into one file. The path must be one that every executor can open.

What the format cannot hold: header and jump lines, tags of paths and walks; unknown walk positions
become 0. Ids of links are kept in the tag ``ID``, the position of a containment in the tag ``zC``.
Names, sequences and tags must be ASCII. Empty tables have no blocks, except that of segments.
"""

from __future__ import annotations

import re
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import codecs as co
from graphloom.functions.sequence import tags_of, tags_text
from graphloom.operators.graph import TAGS, Graph, key_of_walk, with_implicit_nodes
from graphloom.plans.tables import cut

#: Fixed values of the format.
MAGIC, VERSION, HEADER_TEXT = 0x41464742, 1, b"H\tVN:Z:1.0"
SEGMENTS, LINKS, PATHS, WALKS, TAG_BLOCK = 2, 3, 4, 5, 6
HEAD = struct.Struct("<IHH")
HEADS = {SEGMENTS: struct.Struct("<BHHQQHQQ"), LINKS: struct.Struct("<BHHQIQQ"), PATHS: struct.Struct("<BHHIIQQQQ"), WALKS: struct.Struct("<BHHHHHI10Q"), TAG_BLOCK: struct.Struct("<BHHHQQ")}
NAMES = {SEGMENTS: "segments", LINKS: "links", PATHS: "paths", WALKS: "walks", TAG_BLOCK: "tags"}
MOST = 65535
CHUNK = 1 << 16
#: Bytes of a piece of a block on its way to the file, and about how many of them the driver holds.
PIECE, AT_ONCE = 1 << 16, 1 << 23


class BlockError(ValueError):
    """The bytes are no blocks of this format."""


@dataclass(frozen=True)
class Part:
    """One field of a block: where its bytes are, counted from the block's start."""

    field: str
    code: int
    start: int
    size: int
    raw: int


@dataclass(frozen=True)
class Block:
    index: int
    section: int
    n: int
    more: int  # links of a tag block, else 0
    base: int  # records of this section before this block
    more_base: int
    start: int
    size: int
    parts: tuple[Part, ...]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system, of any scheme that pyarrow knows, and the name in it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)


def _open(path: str):
    where, name = _place(path)
    return where.open_input_file(name)


def _steps_end(data: bytes, n: int, code: int) -> tuple[int, int]:
    """Bytes that the steps of ``n`` paths take at the start of ``data``, and how many steps they are."""
    if not n or code >> 24 == co.WALK_NONE:
        return 0, 0
    codec = co.integers_of(code & 255)
    counts, at = codec[1](data, n)
    total = sum(counts)
    if not total:
        return at, 0
    if code >> 24 == co.WALK_NUMBERS:
        at += co.undelta(data[at:], total, codec[1])[1]
    elif code >> 24 == co.WALK_NAMES and code >> 8 & 255 == co.STRING_CODES["none"]:
        lengths, used = co.integers_of(code >> 16 & 255)[1](data[at:], total)
        at += used + sum(lengths)
    else:
        raise BlockError("steps whose size is not known")
    at += 8 * -(-total // 64)
    if at > len(data):
        raise ValueError("the data end early")
    return at, total


def header(path: str) -> dict:
    """version and text of the file; raises where it is no such file."""
    with _open(path) as f:
        head = f.read(HEAD.size)
        if len(head) < HEAD.size:
            raise BlockError("the file is too short")
        magic, version, size = HEAD.unpack(head)
        if magic != MAGIC:
            raise BlockError("not a block file")
        text = f.read(size + 1)
        if len(text) != size + 1 or text[-1]:
            raise BlockError("the header text has no end")
    return {"version": version, "text": text[:-1].decode("ascii", "replace"), "size": HEAD.size + size + 1}


def _side(path: str) -> str:
    return path + ".blocks"


def _starts(path: str, size: int) -> dict[int, int]:
    """start -> end of the blocks that the side file notes; none where it is missing or of another file."""
    where, name = _place(_side(path))
    try:
        with where.open_input_stream(name) as f:
            noted = np.frombuffer(f.readall(), "<i8")
    except (OSError, ValueError):
        return {}
    if len(noted) < 2 or noted[-1] != size or (np.diff(noted) <= 0).any():
        return {}
    return dict(zip(noted[:-1].tolist(), noted[1:].tolist(), strict=True))


def _steps_total(f, at: int, size: int, n: int, code: int) -> int:
    """How many steps a block of paths has: only the counts, which come first, are read."""
    if not n or code >> 24 == co.WALK_NONE:
        return 0
    wanted = min(size, max(64, 4 * n))
    while True:
        f.seek(at)
        data = f.read(wanted)
        try:
            return sum(co.integers_of(code & 255)[1](data, n)[0])
        except (ValueError, IndexError, struct.error):
            if wanted >= size:
                raise
            wanted = min(size, 2 * wanted)


def walk(path: str) -> Iterator[Block]:
    """The file's blocks, by their heads."""
    at, index, done = header(path)["size"], 0, {}
    with _open(path) as f:
        end = f.size()
        noted = _starts(path, end)
        while at < end:
            f.seek(at)
            lead = f.read(max(h.size for h in HEADS.values()))
            section = lead[0]
            if section not in HEADS:
                raise BlockError(f"no section {section} at byte {at}")
            head = HEADS[section]
            if len(lead) < head.size:
                raise BlockError(f"the block of {NAMES[section]} at byte {at} ends early: its head has {head.size} bytes, {len(lead)} are there")
            _, n, *v = head.unpack_from(lead)
            more = 0
            if section == SEGMENTS:
                fields = [("names", v[0], v[1], v[2]), ("sequences", v[3], v[4], v[5])]
            elif section == LINKS:
                fields = [("fromto", v[0], v[1], 32 * n), ("cigars", v[2], v[3], v[4])]
            elif section == PATHS:
                fields = [("names", v[0], v[5], v[6]), ("cigars", v[2], v[3], v[4])]
            elif section == WALKS:
                fields = [(name, v[i], v[5 + 2 * i], v[6 + 2 * i]) for i, name in enumerate(("samples", "haplotypes", "sequences", "positions", "walks"))]
            else:
                more, fields = v[0], [("tags", v[1], v[2], v[3])]
            parts, inside = [], head.size
            for name, code, size, raw in fields:
                parts.append(Part(name, code, inside, size, raw))
                if at + inside + size > end:
                    raise BlockError(f"the block of {NAMES[section]} at byte {at} ends early: {name} has {size} bytes, {end - at - inside} are there")
                inside += size
            if section == PATHS:
                wanted = CHUNK
                size = noted.get(at, 0) - at - inside
                try:
                    known = (size, _steps_total(f, at + inside, size, n, v[1])) if size >= 0 else None
                except (ValueError, IndexError, struct.error):
                    known = None
                while known is None:
                    f.seek(at + inside)
                    data = f.read(wanted)
                    try:
                        known = _steps_end(data, n, v[1])
                    except (ValueError, IndexError, struct.error):
                        if len(data) < wanted:
                            raise BlockError(f"the block of paths at byte {at} ends early: its steps do not end") from None
                        wanted *= 2
                size, total = known
                parts.append(Part("paths", v[1], inside, size, 8 * (n + 2 * total)))
                inside += size
            base, more_base = done.get(section, (0, 0))
            yield Block(index, section, n, more, base, more_base, at, inside, tuple(parts))
            done[section] = (base + n, more_base + more)
            at, index = at + inside, index + 1


def outline(path: str) -> Iterator[dict]:
    """index, section, records, start, size and fields (field, code, size, raw) of each block by the heads, for
    people and reports. A file that is cut or broken is told as far as it can be read; the last dict then
    has only ``error``."""
    try:
        for b in walk(path):
            fields = [{"field": p.field, "code": p.code, "size": p.size, "raw": p.raw} for p in b.parts]
            yield {"index": b.index, "section": NAMES[b.section], "records": b.n, "start": b.start, "size": b.size, "fields": fields}
    except BlockError as e:
        yield {"error": str(e)}


def _blocks_until_broken(path: str) -> Iterator[Block]:
    try:
        yield from walk(path)
    except BlockError:
        return


# Decoding a block


def _steps(data: bytes, n: int, code: int) -> list[list[tuple[int | None, str | None, str]]]:
    """(segment ordinal, segment name, orientation) of each record's steps."""
    if not n or code >> 24 == co.WALK_NONE:
        return [[] for _ in range(n)]
    codec = co.integers_of(code & 255)
    counts, at = codec[1](data, n)
    total = sum(counts)
    numbers, names = [None] * total, [None] * total
    if code >> 24 == co.WALK_NUMBERS:
        numbers, used = co.undelta(data[at:], total, codec[1])
        at += used
    elif code >> 24 == co.WALK_NAMES:
        flags = 8 * -(-total // 64)
        if code >> 8 & 255 == co.STRING_CODES["none"]:
            lengths, used = co.integers_of(code >> 16 & 255)[1](data[at:], total)
            end = at + used + sum(lengths)
        else:
            end = len(data) - flags
        names, at = co.decode_strings(data[at:end], total, code >> 8 & 0xFFFF), end
    else:
        raise BlockError("no such decomposition of steps")
    flags, _ = co.unpack_flags(data[at:], total)
    steps = [(i, s, "-" if x else "+") for i, s, x in zip(numbers, names, flags, strict=True)]
    out, k = [], 0
    for c in counts:
        out.append(steps[k : k + c])
        k += c
    return out


def _field(b: Block, part: Part, data: bytes):
    """The values of one field: a list, or lists, of one value a record."""
    body, n = data[part.start : part.start + part.size], b.n
    if part.field == "fromto":
        codec = co.integers_of(part.code >> 8 & 255)
        a, at = codec[1](body, n)
        z, used = codec[1](body[at:], n)
        ends = [a, z]
        at += used
        for _ in range(2):
            flags, used = co.unpack_flags(body[at:], n)
            ends.append(["-" if x else "+" for x in flags])
            at += used
        return list(zip(*ends, strict=True))
    if part.field == "cigars":
        return co.decode_cigars(body, n, part.code)
    if part.field == "haplotypes":
        return co.integers_of(part.code >> 8 & 255)[1](body, n)[0]
    if part.field == "positions":
        decode = co.integers_of(part.code >> 8 & 255)[1]
        first, at = co.undelta(body, n, decode)
        return list(zip(first, co.undelta(body[at:], n, decode)[0], strict=True))
    if part.field in ("paths", "walks"):
        return _steps(body, n, part.code)
    return co.decode_strings(body, n + b.more, part.code)


def _records(b: Block, data: bytes) -> list[tuple]:
    values = [_field(b, p, data) for p in b.parts]
    order = range(b.base, b.base + b.n)
    if b.section == LINKS:
        return [(i, *ends, cigar or "*") for i, ends, cigar in zip(order, *values, strict=True)]
    if b.section == WALKS:
        return [(i, s, h, q, *p, w) for i, s, h, q, p, w in zip(order, *values, strict=True)]
    if b.section == TAG_BLOCK:
        rows = [(SEGMENTS, b.base + i, t) for i, t in enumerate(values[0][: b.n])] + [(LINKS, b.more_base + i, t) for i, t in enumerate(values[0][b.n :])]
        return [r for r in rows if r[2]]
    return list(zip(order, *values, strict=True))


_STEPS = "array<struct<i:bigint,name:string,orn:string>>"
SCHEMAS = {
    SEGMENTS: "ord bigint, name string, sequence string",
    LINKS: "ord bigint, a bigint, z bigint, from_orn string, to_orn string, alignment string",
    PATHS: f"ord bigint, path_name string, overlaps string, steps {_STEPS}",
    WALKS: f"ord bigint, sample_id string, hapindex bigint, seq_id string, seq_start bigint, seq_end bigint, steps {_STEPS}",
    TAG_BLOCK: "kind int, ord bigint, tags string",
}
_BLOCK = "index bigint, section int, n bigint, more bigint, base bigint, more_base bigint, start bigint, size bigint, parts array<struct<field:string,code:bigint,start:bigint,size:bigint,raw:bigint>>"


def block_table(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """One row a block: where it is, what it holds; of payloads only the step counts of paths are read, if the
    file has its side file. Where the heads break off, this raises, or with ``damaged`` ends before."""
    rows = [(b.index, b.section, b.n, b.more, b.base, b.more_base, b.start, b.size, [(p.field, p.code, p.start, p.size, p.raw) for p in b.parts]) for b in (_blocks_until_broken if damaged else walk)(path)]
    return spark.createDataFrame(rows, _BLOCK)


def _block(r: dict) -> Block:
    return Block(r["index"], r["section"], r["n"], r["more"], r["base"], r["more_base"], r["start"], r["size"], tuple(Part(**p) for p in r["parts"]))


def _decoded(blocks: DataFrame, path: str, section: int, many: int, damaged: bool = False) -> DataFrame:
    schema = SCHEMAS[section]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_list(kind):
            return pa.array(values, kind)
        flat = list(zip(*[s for steps in values for s in steps], strict=True)) or [(), (), ()]
        inner = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(flat, kind.value_type, strict=True)], fields=list(kind.value_type))
        ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), inner, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            for batch in batches:
                for r in batch.to_pylist():
                    b = _block(r)
                    f.seek(b.start)
                    try:
                        records = _records(b, f.read(b.size))
                    except Exception:
                        if not damaged:
                            raise
                        continue  # ``validate`` tells which
                    if records:
                        yield pa.RecordBatch.from_arrays([column(v, f.type) for v, f in zip(zip(*records, strict=True), target, strict=True)], schema=target)

    return blocks.filter(F.col("section") == section).repartition(many, "index").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, partitions: int | None = None, damaged: bool = False) -> Graph:
    """The graph in a block file; steps of numbers without a segment are named ``s`` and the number.

    With ``damaged`` only the blocks before the heads break off are read, of those the ones that can be
    decoded; ``outline`` and ``validate`` tell what is missing."""
    blocks = block_table(spark, path, damaged)
    many = partitions or max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism))
    got = {s: _decoded(blocks, path, s, many, damaged) for s in SCHEMAS}
    # These are read more than once. Plans take what a block decodes to for as large as its row in the table of
    # blocks and would send it through the driver to all: the hints say that joins are to be sorted.
    for section in (SEGMENTS, TAG_BLOCK):
        got[section] = cut(got[section], NAMES[section])
    names = got[SEGMENTS].select(F.col("ord").alias("__i"), F.col("name").alias("__name"))
    tags = {k: got[TAG_BLOCK].filter(F.col("kind") == k).select("ord", tags_of(F.split("tags", "\t")).alias("tags")).hint("merge") for k in (SEGMENTS, LINKS)}
    segments = got[SEGMENTS].join(tags[SEGMENTS], "ord", "left")
    known = F.element_at("tags", "LN")["value"].try_cast("bigint")
    segments = segments.select("ord", "name", "sequence", F.coalesce(known, F.when(F.col("sequence") != "*", F.length("sequence").cast("bigint"))).alias("slen"), "tags")
    links = got[LINKS]
    for i, name in (("a", "from_node"), ("z", "to_node")):
        # Link ends count segments from one.
        there = names.select((F.col("__i") + 1).alias(i), F.col("__name").alias(name))
        links = links.join(there.hint("merge"), i, "left").withColumn(name, F.coalesce(name, F.concat(F.lit("s"), F.col(i).cast("string"))))
    links = links.join(tags[LINKS], "ord", "left")
    inside = F.element_at("tags", "zC")["value"]
    rest = F.map_filter("tags", lambda k, v: k != "zC")
    links = links.select("ord", F.element_at("tags", "ID")["value"].alias("eid"), F.when(inside.isNull(), "L").otherwise("C").alias("kind"), "from_node", "from_orn", "to_node", "to_orn", "alignment", inside.try_cast("bigint").alias("pos"), F.lit(None).cast("bigint").alias("distance"), F.lit(None).cast("string").alias("variance"), rest.alias("tags"))
    none = F.lit(None).cast(TAGS).alias("tags")
    overlaps = F.when(F.col("overlaps").isin("*", ""), F.array().cast("array<string>")).otherwise(F.split("overlaps", ",")).alias("overlaps")
    paths = _named(got[PATHS], names).select("ord", "path_name", "steps", overlaps, none)
    walks = _named(got[WALKS], names).select("ord", key_of_walk().alias("walk_key"), "sample_id", "hapindex", "seq_id", "seq_start", "seq_end", "steps", none)
    return Graph.of(spark, segments=segments, links=links, paths=paths, walks=walks)


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Steps with names for ordinals; only steps are joined, and put back in their order."""
    steps = rows.select("ord", F.posexplode("steps").alias("p", "s")).select("ord", "p", "s.*").join(names.hint("merge"), F.col("i") == F.col("__i"), "left")
    name = F.coalesce("name", "__name", F.concat(F.lit("s"), F.col("i").cast("string")))
    lists = steps.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("p", name.alias("seg"), "orn"))).alias("__l"))
    back = F.transform("__l", lambda s: F.struct(s["seg"].alias("seg"), s["orn"].alias("orn")))
    out = rows.drop("steps").join(lists.hint("merge"), "ord", "left")
    return out.withColumn("steps", F.coalesce(back, F.array().cast("array<struct<seg:string,orn:string>>"))).drop("__l")


# Writing

#: Options and what they are where none is given: a strategy by name, or a code.
OPTIONS = {
    "segment_names": None, "sequences": None, "link_endpoints": "varint-none", "link_cigars": co.cigar_code(), "path_names": "varint-none",
    "path_steps": "varint", "path_cigars": "varint-none", "walk_samples": "varint-none", "walk_haplotypes": "varint-none",
    "walk_sequences": "varint-none", "walk_positions": "varint-none", "walk_steps": "varint", "tags": "varint-none",
}


def walk_code(integer: str = "varint", names: str | None = None) -> int:
    """The code of steps by number, or by name where a strategy for the names is given."""
    if names is None:
        return co.INTEGER_CODES[integer] | co.WALK_NUMBERS << 24
    return co.INTEGER_CODES[integer] | co.code_of(names) << 8 | co.WALK_NAMES << 24


def _codes(options: dict) -> dict[str, int]:
    unknown = set(options) - set(OPTIONS)
    if unknown:
        raise ValueError(f"no options named {sorted(unknown)}")
    out = {}
    for k, v in {**OPTIONS, **options}.items():
        if not isinstance(v, str):
            out[k] = v
        elif k.endswith("_steps"):
            out[k] = walk_code(co.describe(co.code_of(v + "-none" if "-" not in v and "+" not in v else v)).split("-")[0])
        elif k.endswith("_cigars"):
            code = co.code_of(v)
            out[k] = co.CIGAR_PLAIN | code & 0xFF00 | (code & 255) << 24
        else:
            out[k] = co.code_of(v)
    if out["path_steps"] >> 24 == co.WALK_NAMES and out["path_steps"] >> 8 & 255:
        raise ValueError("the names of path steps cannot be compressed: the format holds no size for them")
    return out


def _ordinals(df: DataFrame, key: str) -> DataFrame:
    """Adds ``i``, 0, 1, 2 … by ``ord``, then by key; rows without ``ord`` come last.

    Ranks inside ranges of ``ord`` and the ranges' offsets: the window over all has a row a range."""
    far = F.lit(1 << 50) + F.pmod(F.xxhash64(key), F.lit(4096))
    rows = df.withColumn("__part", F.coalesce(F.shiftright("ord", 16), far))
    sums = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("ord", key))
    placed = rows.withColumn("__in", inside).join(sums.select("__part", before.alias("__before")), "__part")
    return placed.withColumn("i", F.col("__before") + F.col("__in") - 1).drop("__part", "__in", "__before")


def _encode_steps(rows: list[dict], code: int) -> bytes:
    steps = [s for r in rows for s in r["steps"]]
    if any(s["i"] is None for s in steps):
        raise ValueError("a step names no segment")
    if code >> 24 == co.WALK_NAMES:
        middle = co.encode_strings([s["seg"] for s in steps], code >> 8 & 0xFFFF)
    else:
        middle = co.delta([s["i"] for s in steps], co.integers_of(code & 255)[0])
    middle += co.pack_flags([s["orn"] == "-" for s in steps])
    return co.before([len(r["steps"]) for r in rows], co.integers_of(code & 255), middle)


def encode_block(section: int, rows: list[dict], codes: dict[str, int]) -> bytes:
    """The bytes of one block from its records in order."""
    col = lambda c: [r[c] for r in rows]
    n = len(rows)
    total = lambda values: sum(map(len, values))
    if section == SEGMENTS:
        names, seqs = co.encode_strings(col("name"), codes["segment_names"]), co.encode_strings(col("sequence"), codes["sequences"])
        return HEADS[section].pack(section, n, codes["segment_names"], len(names), total(col("name")), codes["sequences"], len(seqs), total(s for s in col("sequence") if s != "*")) + names + seqs
    if section == LINKS:
        codec = co.integers_of(codes["link_endpoints"] >> 8 & 255)
        flags = co.pack_flags([x == "-" for x in col("from_orn")]) + co.pack_flags([x == "-" for x in col("to_orn")])
        ends = co.before([x + 1 for x in col("a")], codec, co.before([x + 1 for x in col("z")], codec, flags))
        cigars = co.encode_cigars(col("alignment"), codes["link_cigars"])
        return HEADS[section].pack(section, n, codes["link_endpoints"], len(ends), codes["link_cigars"], len(cigars), total(col("alignment"))) + ends + cigars
    if section == PATHS:
        names, cigars = co.encode_strings(col("path_name"), codes["path_names"]), co.encode_cigars(col("overlaps"), codes["path_cigars"])
        head = HEADS[section].pack(section, n, codes["path_names"], codes["path_steps"], codes["path_cigars"], len(cigars), total(col("overlaps")), len(names), total(col("path_name")))
        return head + names + cigars + _encode_steps(rows, codes["path_steps"])
    if section == WALKS:
        codec = co.integers_of(codes["walk_positions"] >> 8 & 255)
        ends = co.delta(col("seq_end"), codec[0])
        starts = co.delta(col("seq_start"), codec[0])
        if co.undelta(starts + ends[:16], n, codec[1])[1] != len(starts):
            raise ValueError("elias_omega cannot stand before these data")
        parts = [
            (co.encode_strings(col("sample_id"), codes["walk_samples"]), total(col("sample_id"))), (co.integers_of(codes["walk_haplotypes"] >> 8 & 255)[0](col("hapindex")), n),
            (co.encode_strings(col("seq_id"), codes["walk_sequences"]), total(col("seq_id"))), (starts + ends, 2 * n), (_encode_steps(rows, codes["walk_steps"]), total(col("steps"))),
        ]
        sizes = [x for body, raw in parts for x in (len(body), raw)]
        return HEADS[section].pack(section, n, *[codes[k] for k in ("walk_samples", "walk_haplotypes", "walk_sequences", "walk_positions", "walk_steps")], *sizes) + b"".join([body for body, _ in parts])
    texts = col("tags")
    body, segments = co.encode_strings(texts, codes["tags"]), sum(r["kind"] == SEGMENTS for r in rows)
    return HEADS[section].pack(section, segments, n - segments, codes["tags"], len(body), total(texts)) + body


def _blocks(rows: DataFrame, section: int, size: int, codes: dict[str, int], order: tuple[str, ...] = ("i",)) -> DataFrame:
    """(section, block, payload): one group of at most ``size`` records a block."""

    def run(table: pa.Table) -> pa.Table:
        records = sorted(table.to_pylist(), key=lambda r: [r[c] for c in order])
        return pa.table({"section": pa.array([section], pa.int32()), "block": pa.array([records[0]["block"]], pa.int64()), "payload": pa.array([encode_block(section, records, codes)], pa.binary())})

    return rows.withColumn("block", F.floor(F.col("i") / size).cast("bigint")).groupBy("block").applyInArrow(run, "section int, block bigint, payload binary")


def _numbered_steps(rows: DataFrame, names: DataFrame) -> DataFrame:
    steps = rows.select(F.col("i").alias("__r"), F.posexplode("steps").alias("p", "s")).select("__r", "p", "s.*").join(names, F.col("seg") == F.col("__name"), "left")
    lists = steps.groupBy("__r").agg(F.array_sort(F.collect_list(F.struct("p", F.col("__i").alias("i"), "seg", "orn"))).alias("__l"))
    empty = F.array().cast("array<struct<p:int,i:bigint,seg:string,orn:string>>")
    return rows.drop("steps").join(lists, rows["i"] == lists["__r"], "left").withColumn("steps", F.coalesce("__l", empty)).drop("__l", "__r")


def blocks_of(g: Graph, block_size: int = 1024, **options) -> DataFrame:
    """(section, block, payload) of a graph, to be put one after the other in that order.

    Without a strategy, names and sequences take the one that the first 100 names and the first
    100 letters of 50 sequences suggest."""
    if not 0 < block_size <= MOST:
        raise ValueError(f"a block holds 1 to {MOST} records")
    codes = _codes(options)
    g = with_implicit_nodes(g)
    text = lambda t: F.array_join(F.coalesce(tags_text(F.col(t)), F.array().cast("array<string>")), "\t")
    segments = cut(_ordinals(g.segments.withColumn("sequence", F.coalesce(F.when(F.col("sequence") != "", F.col("sequence")), F.lit("*"))), "name").select("i", "name", "sequence", text("tags").alias("tags")), "segments")
    head = segments.filter("i < 100").select("i", "name", F.left("sequence", F.lit(100)).alias("s")).orderBy("i").collect()
    for option, sample in (("segment_names", "".join([r["name"] for r in head])), ("sequences", "".join([r["s"] for r in head[:50]]))):
        if codes[option] is None:
            codes[option] = co.code_of("varint-" + co.suggest_strings(sample.encode("ascii")))
    names = segments.select(F.col("i").alias("__i"), F.col("name").alias("__name"))
    end = lambda c, node: names.select(F.col("__i").alias(c), F.col("__name").alias(node))
    ids = F.when(F.col("eid").isNotNull() & (F.col("eid") != "*"), F.map_from_arrays(F.array(F.lit("ID")), F.array(F.struct(F.lit("Z").alias("type"), F.col("eid").alias("value")))))
    inside = F.when(F.col("kind") == "C", F.map_from_arrays(F.array(F.lit("zC")), F.array(F.struct(F.lit("i").alias("type"), F.coalesce("pos", F.lit(0)).cast("string").alias("value")))))
    own = F.map_filter(F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<type:string,value:string>>"))), lambda k, v: (k != "zC") & ((k != "ID") | F.col("eid").isNull()))
    for extra in (ids, inside):
        own = F.when(extra.isNull(), own).otherwise(F.map_concat(own, extra))
    links = g.links.withColumn("__tags", own).withColumn("__key", F.concat_ws("\t", "from_node", "to_node", "from_orn", "to_orn", "alignment", "eid"))
    links = _ordinals(links, "__key").withColumn("alignment", F.coalesce("alignment", F.lit("*"))).join(end("a", "from_node"), "from_node").join(end("z", "to_node"), "to_node")
    links = cut(links.select("i", "a", "z", "from_orn", "to_orn", "alignment", text("__tags").alias("tags")), "links")
    overlaps = F.when(F.size("overlaps") > 0, F.array_join("overlaps", ",")).otherwise("*").alias("overlaps")
    paths = _numbered_steps(_ordinals(g.paths, "path_name").select("i", "path_name", overlaps, "steps"), names)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    walks = _ordinals(g.walks, "walk_key").select("i", F.coalesce("sample_id", F.lit("")).alias("sample_id"), zero("hapindex"), F.coalesce("seq_id", F.lit("")).alias("seq_id"), zero("seq_start"), zero("seq_end"), "steps")
    walks = _numbered_steps(walks, names)
    out = _blocks(segments.select("i", "name", "sequence"), SEGMENTS, MOST, codes)
    for rows, section in ((links.drop("tags"), LINKS), (paths, PATHS), (walks, WALKS)):
        out = out.union(_blocks(rows, section, block_size, codes))
    tags = segments.select(F.lit(SEGMENTS).alias("kind"), "i", "tags").union(links.select(F.lit(LINKS), "i", "tags"))
    if not tags.filter("tags <> ''").isEmpty():
        out = out.union(_blocks(tags, TAG_BLOCK, MOST, codes, ("kind", "i")))
    return out


def write(g: Graph, path: str, block_size: int = 1024, **options) -> None:
    """One block file. Blocks are encoded side by side and written to the shared folder first; the
    driver then streams them to ``path`` in pieces, some ``AT_ONCE`` bytes at a time."""
    blocks = cut(blocks_of(g, block_size, **options), "blocks")
    where, name = _place(path)
    starts = []
    with where.open_output_stream(name) as f:
        f.write(HEAD.pack(MAGIC, VERSION, len(HEADER_TEXT)) + HEADER_TEXT + b"\0")
        if blocks.isEmpty():
            codes = _codes(options)
            plain = co.code_of("varint-none")
            f.write(encode_block(SEGMENTS, [], {k: plain if v is None else v for k, v in codes.items()}))
        last = F.floor((F.octet_length("payload") - 1) / PIECE).cast("int")
        many = blocks.agg(F.sum(last + 1)).first()[0] or 0
        pieces = blocks.select("section", "block", "payload", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        pieces = pieces.select("section", "block", "piece", F.substring("payload", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("bytes"))
        order = ("section", "block", "piece")
        for r in pieces.repartitionByRange(1 + many * PIECE // AT_ONCE, *order).sortWithinPartitions(*order).toLocalIterator():
            if not r["piece"]:
                starts.append(f.tell())
            f.write(bytes(r["bytes"]))
        starts.append(f.tell())
    with where.open_output_stream(_place(_side(path))[1]) as f:
        f.write(np.array(starts, "<i8").tobytes())


# Inspection


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row a block and field: its codec, records, stored and raw size; payloads are not read."""
    p = F.col("p")
    rows = block_table(spark, path).select("index", "section", "n", F.explode("parts").alias("p"))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)]), F.col("section"))
    return rows.select(F.col("index").alias("block_index"), F.col("section").alias("section_id"), kind.alias("section_type"), p["field"].alias("section_field"), p["code"].alias("code"), F.col("n").alias("record_num"), p["size"].alias("compressed_length"), p["raw"].alias("uncompressed_length"))


_CHECK = "block_index bigint, section_id int, section_field string, decode_time_ms double, stored bigint, actual bigint, correct boolean, message string"


def _raw(b: Block, part: Part, values: list) -> int:
    """What the head should say of a field's raw size."""
    if part.field == "fromto":
        return 32 * b.n
    if part.field == "paths":
        return 8 * (b.n + 2 * sum(map(len, values)))
    if part.field == "haplotypes":
        return len(values)
    if part.field == "positions":
        return 2 * len(values)
    if part.field == "walks":
        return sum(map(len, values))
    return sum(len(v) for v in values if not (b.section == SEGMENTS and part.field == "sequences" and v == "*"))


def validate(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """One row a block and field: the stored and the actual raw size, whether they agree, and how long the
    decoding took. A field that cannot be decoded is incorrect. Where the heads break off, this raises, or
    with ``damaged`` ends before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    b = _block(r)
                    f.seek(b.start)
                    data = f.read(b.size)
                    for part in b.parts:
                        began, actual, message = time.perf_counter(), None, ""
                        try:
                            actual = _raw(b, part, _field(b, part, data))
                        except Exception as e:  # the report is what says so
                            message = f"{type(e).__name__}: {e}"
                        took = 1000 * (time.perf_counter() - began)
                        if not message and actual != part.raw:
                            message = "the raw size differs"
                        out.append((b.index, b.section, part.field, took, part.raw, actual, not message, message))
                names = [c.split()[0] for c in _CHECK.split(", ")]
                types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    blocks = block_table(spark, path, damaged)
    return blocks.repartition(max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism)), "index").mapInArrow(run, _CHECK)


#: Options of a measurement and the section and field that each means.
MEASURES = {
    "segment_names": (SEGMENTS, "names"), "sequences": (SEGMENTS, "sequences"), "link_endpoints": (LINKS, "fromto"), "link_cigars": (LINKS, "cigars"),
    "path_names": (PATHS, "names"), "path_steps": (PATHS, "paths"), "path_cigars": (PATHS, "cigars"), "walk_samples": (WALKS, "samples"),
    "walk_haplotypes": (WALKS, "haplotypes"), "walk_sequences": (WALKS, "sequences"), "walk_positions": (WALKS, "positions"), "walk_steps": (WALKS, "walks"), "tags": (TAG_BLOCK, "tags"),
}


def measure(spark: SparkSession, path: str, option: str | None = None, encode_time_ms: float = 0.0) -> DataFrame:
    """``statistics`` with encode_time_ms as given and decode_time_ms as measured; of one option's field where given."""
    timed = validate(spark, path).select("block_index", "section_field", "decode_time_ms")
    rows = statistics(spark, path).join(timed, ["block_index", "section_field"]).withColumn("encode_time_ms", F.lit(float(encode_time_ms)))
    if option is not None:
        section, field = MEASURES[option]
        rows = rows.filter((F.col("section_id") == section) & (F.col("section_field") == field))
    return rows
