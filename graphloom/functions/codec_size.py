"""Encoded sizes of integer codecs in closed form, so that codecs are compared without encoding.

Each function takes a column of non-negative integers and gives an aggregate: bytes of the list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(x: Column) -> Column:
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def _ceil8(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("bigint")


def _total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("bigint")


def ascii_size(x: Column) -> Column:
    return _total(F.length(x.cast("string")) + 1)


def varint_size(x: Column) -> Column:
    return _total(F.greatest(F.lit(1), F.ceil(bit_length(x) / 7)))


def fixed_size(x: Column, width: int) -> Column:
    return (F.count(x) * width).cast("bigint")


def gamma_size(x: Column) -> Column:
    return _ceil8(_total(2 * (bit_length(x + 1) - 1) + 1))


def omega_bits(x: Column) -> Column:
    """Bits of x + 1: one, or those of its binary logarithm, that logarithm and one more."""
    m, total = x + 1, F.lit(1)
    for _ in range(6):  # log2 applied six times takes any 64-bit value to 1
        n = F.greatest(bit_length(m) - 1, F.lit(0))
        total = total + F.when(m > 1, n + 1).otherwise(0)
        m = F.greatest(n, F.lit(1))
    return total


def omega_size(x: Column) -> Column:
    return _ceil8(_total(omega_bits(x)))


def rice_size(x: Column, k: int = 4) -> Column:
    return 1 + _ceil8(_total(F.shiftright(x, k) + 1 + k))


def vbyte_size(x: Column) -> Column:
    return varint_size(x)


def group_varint_size(x: Column) -> Column:
    width = F.when(x < 1 << 8, 1).when(x < 1 << 16, 2).when(x < 1 << 24, 3).otherwise(4)
    return 4 + F.ceil(F.count(x) / 4).cast("bigint") + _total(width)


def bit_packing_size(x: Column) -> Column:
    width = F.greatest(F.lit(1), F.ceil(F.least(F.max(bit_length(x)), F.lit(32)) / 8))
    return 5 + (F.count(x) * F.coalesce(width, F.lit(1))).cast("bigint")


def byte_packed_size(x: Column) -> Column:
    m = F.max(x)
    return 5 + (F.count(x) * F.when(m < 1 << 8, 1).when(m < 1 << 16, 2).when(m < 1 << 32, 4).otherwise(8)).cast("bigint")


def length_prefixed_size(x: Column) -> Column:
    return 4 + _total(1 + F.greatest(F.lit(1), F.ceil(bit_length(x) / 7)))


def masked_vbyte_size(x: Column) -> Column:
    return 4 + varint_size(x)


def two_bit_size(sequence: Column) -> Column:
    """Packed bases of a column of sequences, four a byte."""
    return _total(F.ceil(F.length(sequence) / 4))


SIZES = {
    "none": ascii_size, "varint": varint_size, "fixed16": lambda x: fixed_size(x, 2), "fixed32": lambda x: fixed_size(x, 4), "fixed64": lambda x: fixed_size(x, 8),
    "elias_gamma": gamma_size, "elias_omega": omega_size, "rice": rice_size, "vbyte": vbyte_size, "group_varint": group_varint_size,
    "bit_packing": bit_packing_size, "fibonacci": length_prefixed_size, "byte_packed": byte_packed_size, "masked_vbyte": masked_vbyte_size,
}
