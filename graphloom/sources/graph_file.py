"""Graph files of either format: by suffix, or else by what the file begins with."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.operators.graph import Graph
from graphloom.sources import block_file, gfa_text

TEXT, BLOCKS = "text", "blocks"
#: The suffixes of the formats, and of compressed text.
SUFFIXES = {".gfa": TEXT, ".gfal": TEXT, ".bgfa": BLOCKS}
PACKED = (".gz", ".zst", ".zstd", ".xz")


def format_of(path: str) -> str:
    """The format that the suffix names, a compression's suffix left aside; else that of the first bytes."""
    name = path
    for suffix in PACKED:
        name = name.removesuffix(suffix)
    found = next((f for s, f in SUFFIXES.items() if name.endswith(s)), None)
    if found:
        return found
    try:
        block_file.header(path)
    except (block_file.BlockError, IsADirectoryError):
        return TEXT
    return BLOCKS


def load(spark: SparkSession, path: str, format: str | None = None) -> Graph:  # noqa: A002
    kind = format or format_of(path)
    if kind not in (TEXT, BLOCKS):
        raise ValueError(f"no format named {kind!r}")
    return block_file.read(spark, path) if kind == BLOCKS else gfa_text.scan(spark, path)


def save(g: Graph, path: str, format: str | None = None, **options) -> None:  # noqa: A002
    """A block file, or canonical text in a folder of parts; the suffix decides where no format is given."""
    kind = format or next((f for s, f in SUFFIXES.items() if path.endswith(s)), TEXT)
    if kind not in (TEXT, BLOCKS):
        raise ValueError(f"no format named {kind!r}")
    if kind == BLOCKS:
        block_file.write(g, path, **options)
    else:
        gfa_text.write_text(g, path, **options)
