"""Scalar functions on sequences, CIGARs, tags and walks, as Catalyst expressions.

Nulls give null unless a docstring says otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC nucleotide codes and their complements.
IUPAC, COMPLEMENT = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
#: The CIGAR operations in the order of their codes 0 to 8.
CIGAR_OPS = "MIDNSHPX="


def reverse_complement(seq: Column) -> Column:
    """Of the upper-case sequence; ``*`` stays ``*``, symbols outside IUPAC stay themselves."""
    return F.when(seq == "*", seq).otherwise(F.reverse(F.translate(F.upper(seq), IUPAC, COMPLEMENT)))


def is_dna(seq: Column) -> Column:
    return seq.rlike("^[ACGTNacgtn]*$") & (seq != "*")


def flip(orn: Column) -> Column:
    return F.translate(orn, "+-", "-+")


def oriented(seq: Column, orn: Column) -> Column:
    return F.when(orn == "-", reverse_complement(seq)).otherwise(seq)


def reverse_complement_as_is(seq: Column) -> Column:
    """Of the sequence in the case it has; ``*`` stays ``*``."""
    return F.when(seq == "*", seq).otherwise(F.reverse(F.translate(seq, IUPAC, COMPLEMENT)))


def oriented_name(name: Column, orn: Column) -> Column:
    """``name|orn``, the text form of an oriented segment."""
    return F.concat_ws("|", name, orn)


def overlap_of(a: str | bytes, b: str | bytes) -> int:
    """Length of the longest suffix of ``a`` that is a prefix of ``b``.

    Short texts are tried from the longest down; long ones by hashes of all prefixes and suffixes at once,
    so that the time grows with the length and not with its square; the texts themselves decide."""
    n = min(len(a), len(b))
    if n <= 64:
        return next((k for k in range(n, 0, -1) if a.endswith(b[:k])), 0)
    a, b = a[-n:], b[:n]
    x, y = (np.frombuffer(t if isinstance(t, bytes) else t.encode("utf-32-le"), "u1" if isinstance(t, bytes) else "<u4").astype(np.uint64) for t in (a, b))
    base = 0x9E3779B97F4A7C15
    up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))]).astype(np.uint64)
    head = np.cumsum(y * up)  # of the first 1 to n letters of b
    tail = np.cumsum((x * up)[::-1])  # of the last 1 to n letters of a, times base ** (n - k)
    for k in (np.flatnonzero(tail == head * up[::-1]) + 1)[::-1].tolist():
        if a[n - k :] == b[:k]:
            return k
    return 0


def overlap_length(a: Column, b: Column) -> Column:
    """Length of the longest suffix of ``a`` that is a prefix of ``b``; 0 where either is empty."""

    @F.pandas_udf("int")
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else overlap_of(x, y) for x, y in zip(first, second, strict=True)], dtype="Int32")

    return run(a, b)


def cigar_overlap(cigar: Column) -> Column:
    """n of a CIGAR that is nM alone; null for ``*`` and everything else."""
    return F.nullif(F.regexp_extract(cigar, "^([0-9]+)M$", 1), F.lit("")).try_cast("int")


def cigar_parse(cigar: Column) -> Column:
    """array<struct<n, op, code>>; empty for ``*``."""
    counts = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHPX=])"), F.lit(1)), lambda x: x.cast("bigint"))
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHPX=])"), F.lit(2))
    return F.zip_with(counts, ops, lambda n, o: F.struct(n.alias("n"), o.alias("op"), (F.instr(F.lit(CIGAR_OPS), o) - 1).alias("code")))


def steps_of(walk: Column) -> Column:
    """array<struct<seg, orn>> of a walk in either form: ``>a<b`` or ``a+b-``."""
    arrow = F.transform(F.regexp_extract_all(walk, F.lit("([<>])([^<>]+)"), F.lit(0)), lambda x: F.struct(F.substring(x, 2, 1 << 30).alias("seg"), F.when(F.left(x, F.lit(1)) == ">", "+").otherwise("-").alias("orn")))
    signed = F.transform(F.regexp_extract_all(walk, F.lit("([^+,-]+)([+-]?)"), F.lit(0)), lambda x: F.struct(F.regexp_replace(x, "[+-]$", "").alias("seg"), F.when(x.endswith("-"), "-").otherwise("+").alias("orn")))
    return F.when(walk.rlike("^[<>]"), arrow).otherwise(signed)


def steps_text(steps: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(s["seg"], s["orn"])), separator)


def tags_of(fields: Column) -> Column:
    """map<tag, struct<type, value>> of ``TAG:TYPE:VALUE`` strings; the last of a tag counts, a value may
    hold colons, strings of another shape are left out."""
    shaped = F.filter(fields, lambda f: f.rlike("^[A-Za-z][A-Za-z0-9]:[AifZJHB]:"))
    entries = F.transform(shaped, lambda f: F.struct(F.left(f, F.lit(2)).alias("key"), F.struct(F.substring(f, 4, 1).alias("type"), F.substring(f, 6, 1 << 30).alias("value")).alias("value")))
    latest = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(latest)


def tags_text(tags: Column) -> Column:
    """array<string> of a tag map, by tag."""
    return F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))


def tag_valid(type_: Column, value: Column) -> Column:
    """The format's pattern for each tag type."""
    patterns = {"A": "^[!-~]$", "i": "^[-+]?[0-9]+$", "f": "^[-+]?[0-9]*\\.?[0-9]+([eE][-+]?[0-9]+)?$", "Z": "^[ !-~]*$", "J": "^[ !-~]+$", "H": "^[0-9A-F]+$", "B": "^[cCsSiIf](,[-+]?[0-9]*\\.?[0-9]+([eE][-+]?[0-9]+)?)+$"}
    out = F.lit(False)
    for kind, pattern in patterns.items():
        out = F.when(type_ == kind, value.rlike(pattern)).otherwise(out)
    return out


def sanitise(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x{80}-\\x{ff}]", "?")


def pack_code(*numbers: Column) -> Column:
    """Codec numbers in one: a byte each, the first the highest (two of them, or four)."""
    out = F.lit(0).cast("bigint")
    for n in numbers:
        out = F.shiftleft(out, 8).bitwiseOR(n.cast("bigint"))
    return out


def unpack_code(code: Column, n: int = 2) -> Column:
    """array<bigint>: the ``n`` codec numbers in a code, the highest byte first."""
    return F.array(*[F.shiftright(code.cast("bigint"), 8 * k).bitwiseAND(255) for k in reversed(range(n))])


def tag_value(type_: Column, value: Column) -> Column:
    """struct<valid, text, whole, real>: whether the value fits its type, and the value as the type has it."""
    ok = tag_valid(type_, value)
    return F.struct(ok.alias("valid"), F.when(ok, value).alias("text"), F.when(ok & (type_ == "i"), value.try_cast("bigint")).alias("whole"), F.when(ok & (type_ == "f"), value.try_cast("double")).alias("real"))


def walk_length(start: Column, end: Column) -> Column:
    """End minus start; null where either is unknown."""
    return end - start


def pansn(sample: Column, hap: Column, seq: Column, start: Column, end: Column) -> Column:
    return F.concat(sample, F.lit("#"), hap.cast("string"), F.lit("#"), seq, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
