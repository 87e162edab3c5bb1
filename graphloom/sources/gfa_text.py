"""GFA1 text: scan to tables and canonical emission.

The scan is a stateless projection over ``spark.read.text`` (or a text stream): one split, one
filter a record type; lines that fit no type become ``rejects``.
"""

from __future__ import annotations

import lzma

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.sequence import steps_of, steps_text, tags_of, tags_text
from graphloom.operators.graph import Graph, key_of_walk

#: The format's patterns for names, orientations, sequences, CIGARs and positions.
NAME, ORN, SEQ, CIGAR = "^[!-)+-<>-~][!-~]*$", "^[+-]$", "^(\\*|[A-Za-z=.]+)$", "^(\\*|([0-9]+[MIDNSHPX=])+)$"
POS = "^(\\*|[0-9]+)$"
#: Bits of an ``ord`` below the file's number, and lines of a batch that is unpacked.
FILE_BITS, UNPACKED = 41, 50_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of a file, or of a folder; plain, .gz and .zst by Spark, .xz by lzma, a file a task, as a stream.

    ``ord`` rises by file name, then by line; gaps are harmless."""
    if path.endswith(".xz"):
        return _unpacked(spark, path)
    rows = spark.read.text(path)
    files = sorted(rows.inputFiles())
    if files and all(f.endswith(".xz") for f in files):
        return _unpacked(spark, path)
    # A line's place: its split's first byte and its number in the task, which is below the bytes of a split.
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    if len(files) <= 1:
        return rows.select(place.alias("ord"), F.col("value").alias("line"))
    number = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "file string, k bigint")
    named = rows.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), F.col("value").alias("line"))
    # The paths of files are written in two ways: with one slash behind the scheme, or with three.
    plain = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")
    joined = named.withColumn("at", plain("path")).join(F.broadcast(number.select(plain("file").alias("at"), "k")), "at", "left")
    return joined.select((F.shiftleft(F.coalesce("k", F.lit(0)).cast("bigint"), FILE_BITS) + F.col("place")).alias("ord"), "line")


def _unpacked(spark: SparkSession, path: str) -> DataFrame:
    """The lines of .xz files, each unpacked as a stream by one task."""
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())

    def unpack(batches):
        from graphloom.sources.block_file import _open

        for batch in batches:
            for k, name in zip(batch.column("k").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with lzma.open(_open(name)) as f:
                    held, at = [], 0
                    for raw in f:
                        held.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                        if len(held) == UNPACKED:
                            yield pa.RecordBatch.from_pydict({"ord": [k << FILE_BITS | i for i in range(at, at + len(held))], "line": held})
                            held, at = [], at + len(held)
                    if held:
                        yield pa.RecordBatch.from_pydict({"ord": [k << FILE_BITS | i for i in range(at, at + len(held))], "line": held})

    numbered = spark.createDataFrame(list(enumerate(files)), "k bigint, path string")
    return numbered.repartition(max(1, len(files)), "k").mapInArrow(unpack, "ord bigint, line string")


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "ord bigint, line string")


def _long(c: Column) -> Column:
    return F.when(c != "*", c.try_cast("bigint"))


def parse(lines: DataFrame) -> Graph:
    """The tables of (ord, line) rows; blank lines and ``#`` comments are skipped."""
    f = F.split("line", "\t")
    rows = lines.withColumn("line", F.regexp_replace("line", "[\\s]+$", "")).filter(~F.col("line").rlike("^\\s*(#|$)")).withColumn("f", f)
    g = lambda i: F.get("f", F.lit(i))
    ok = {
        "S": g(1).rlike(NAME) & g(2).rlike(SEQ),
        "L": g(1).rlike(NAME) & g(2).rlike(ORN) & g(3).rlike(NAME) & g(4).rlike(ORN) & g(5).rlike(CIGAR),
        "C": g(1).rlike(NAME) & g(2).rlike(ORN) & g(3).rlike(NAME) & g(4).rlike(ORN) & g(5).rlike("^[0-9]+$") & g(6).rlike(CIGAR),
        "P": g(1).rlike(NAME) & F.forall(F.split(g(2), ","), lambda s: s.rlike("^[!-~]+[+-]$")),
        "W": g(2).rlike("^[0-9]+$") & g(4).rlike(POS) & g(5).rlike(POS) & g(6).rlike("^([<>][^<>]+)+$|^([^<>,+-]+[+-])+$"),
        "H": F.lit(True),
        "J": g(1).isNotNull() & g(3).isNotNull(),
    }
    at = {"S": 3, "L": 6, "C": 7, "P": 4, "W": 7, "H": 1, "J": 6}
    tags = lambda k: tags_of(F.slice("f", at[k] + 1, F.size("f"))).alias("tags")
    of = lambda k: rows.filter((g(0) == k) & F.coalesce(ok[k], F.lit(False)))
    ln = F.element_at(F.col("tags"), "LN")["value"].try_cast("bigint")
    segments = of("S").select("ord", g(1).alias("name"), g(2).alias("sequence"), tags("S"))
    segments = segments.select("ord", "name", "sequence", F.coalesce(ln, F.when(F.col("sequence") != "*", F.length("sequence").cast("bigint"))).alias("slen"), "tags")

    def edges(k: str) -> DataFrame:
        rows_ = of(k).select("ord", F.lit(k).alias("kind"), g(1).alias("from_node"), g(2).alias("from_orn"), g(3).alias("to_node"), g(4).alias("to_orn"), g(6 if k == "C" else 5).alias("alignment"), (g(5).try_cast("bigint") if k == "C" else F.lit(None).cast("bigint")).alias("pos"), tags(k))
        return rows_.select("ord", F.element_at("tags", "ID")["value"].alias("eid"), "kind", "from_node", "from_orn", "to_node", "to_orn", "alignment", "pos", F.lit(None).cast("bigint").alias("distance"), F.lit(None).cast("string").alias("variance"), "tags")

    steps = F.transform(F.split(g(2), ","), lambda s: F.struct(F.left(s, F.length(s) - 1).alias("seg"), F.right(s, F.lit(1)).alias("orn")))
    overlaps = F.when(g(3).isNull() | (g(3) == "*"), F.array().cast("array<string>")).otherwise(F.split(g(3), ","))
    paths = of("P").select("ord", g(1).alias("path_name"), steps.alias("steps"), overlaps.alias("overlaps"), tags("P"))
    walks = of("W").select("ord", g(1).alias("sample_id"), g(2).cast("bigint").alias("hapindex"), g(3).alias("seq_id"), _long(g(4)).alias("seq_start"), _long(g(5)).alias("seq_end"), steps_of(g(6)).alias("steps"), tags("W"))
    walks = walks.select("ord", key_of_walk().alias("walk_key"), "sample_id", "hapindex", "seq_id", "seq_start", "seq_end", "steps", "tags")
    jumps = of("J").select("ord", g(1).alias("from_node"), g(2).alias("from_orn"), g(3).alias("to_node"), g(4).alias("to_orn"), g(5).alias("distance"), tags("J"))
    good = F.lit(False)
    for k, test in ok.items():
        good = F.when(g(0) == k, F.coalesce(test, F.lit(False))).otherwise(good)
    reason = F.when(g(0).isin(*ok), F.concat(F.lit("fields of "), g(0))).otherwise("record type")
    rejects = rows.filter(~good).select("ord", "line", reason.alias("reason"))
    links = edges("L").unionByName(edges("C"))
    return Graph(segments, links, paths, walks, of("H").select("ord", tags("H")), jumps, rejects)


def parse_line(spark: SparkSession, line: str, kind: str | None = None) -> dict:
    """The fields of one record; ``kind`` stands for a leading type letter that is left out. Raises where the
    line is no record of its type."""
    from graphloom.operators.elements import MalformedLine

    if kind is not None and line.split("\t")[0] != kind:
        line = f"{kind}\t{line}"
    g = parse(lines_of(spark, line))
    for table in ("segments", "links", "paths", "walks", "headers", "jumps"):
        row = getattr(g, table).first()
        if row is not None:
            return {"table": table, **row.asDict(True)}
    bad = g.rejects.first()
    raise MalformedLine(bad["reason"] if bad else "an empty line")


def subgraphs_of(lines: DataFrame) -> DataFrame:
    """Stored subgraphs of (ord, line): paths, ordered (O) and unordered (U) groups, whose elements have an
    orientation only in the first two."""
    f = F.split("line", "\t")
    rows = lines.filter(F.col("line").rlike("^[POU]\t")).withColumn("f", f)
    kind, body = F.get("f", F.lit(0)), F.get("f", F.lit(2))
    oriented = F.transform(F.split(body, "[, ]+"), lambda s: F.struct(F.regexp_replace(s, "[+-]$", "").alias("id"), F.nullif(F.regexp_extract(s, "([+-])$", 1), F.lit("")).alias("orn")))
    bare = F.transform(F.split(body, "[, ]+"), lambda s: F.struct(s.alias("id"), F.lit(None).cast("string").alias("orn")))
    from_ = F.when(kind == "P", 4).otherwise(3)
    return rows.select("ord", F.get("f", F.lit(1)).alias("sub_id"), F.when(kind == "U", bare).otherwise(oriented).alias("elements"), tags_of(F.slice("f", from_ + 1, F.size("f"))).alias("tags"))


def scan(spark: SparkSession, path: str) -> Graph:
    return parse(read_lines(spark, path))


def canonical(g: Graph) -> DataFrame:
    """(section, key, line): H, S by name, L and C by both ends, P by name, W by sample and sequence."""
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    tags = F.coalesce(tags_text(F.col("tags")), F.array().cast("array<string>"))
    tab = lambda *cols: F.concat_ws("\t", *cols, tags)
    key = lambda *cols: F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("key")
    heads = g.headers.select(F.lit(0).alias("section"), F.array(F.format_string("%020d", "ord")).alias("key"), tab(F.lit("H")).alias("line"))
    segments = g.segments.select(F.lit(1), key("name"), tab(F.lit("S"), "name", star("sequence")))
    link = g.links.filter("kind = 'L'").select(F.lit(2), key("from_node", "to_node", "from_orn", "to_orn", "alignment"), tab(F.lit("L"), "from_node", "from_orn", "to_node", "to_orn", star("alignment")))
    inside = g.links.filter("kind = 'C'").select(F.lit(3), key("from_node", "to_node", "from_orn", "to_orn", "alignment"), tab(F.lit("C"), "from_node", "from_orn", "to_node", "to_orn", F.coalesce("pos", F.lit(0)).cast("string"), star("alignment")))
    overlaps = F.when(F.size("overlaps") > 0, F.array_join("overlaps", ",")).otherwise("*")
    paths = g.paths.select(F.lit(4), key("path_name"), tab(F.lit("P"), "path_name", steps_text(F.col("steps")), overlaps))
    walk = F.array_join(F.transform("steps", lambda s: F.concat(F.when(s["orn"] == "-", "<").otherwise(">"), s["seg"])), "")
    walks = g.walks.select(F.lit(5), key("sample_id", "seq_id", "hapindex", "seq_start"), tab(F.lit("W"), "sample_id", F.col("hapindex").cast("string"), "seq_id", star("seq_start"), star("seq_end"), walk))
    out = heads
    for part in (segments, link, inside, paths, walks):
        out = out.union(part)
    return out


def write_text(g: Graph, path: str) -> None:
    """Sorted across the files of a folder; one default header where the graph has none."""
    lines = canonical(g)
    if g.headers.isEmpty():
        lines = lines.union(lines.sparkSession.sql("select 0, array(''), 'H\\tVN:Z:1.0'"))
    lines.orderBy("section", "key", "line").select("line").write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence): records start with ``>``, the id is the first word, line ends are dropped."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", "^\\s*(\\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", "^[^\\n]*\\n?", ""), "\\s", "")
    return records.select(head.alias("id"), body.alias("sequence"))
