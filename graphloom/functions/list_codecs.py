"""String codecs beside those of the block format: common superstrings, CIGAR lists, an order-k model,
trained dictionaries.

They have no code in the format. Lists are of ASCII strings; empty lists give no bytes, what cannot be
held raises. A list is encoded in one task, so its size is the caller's choice.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import codecs as co

_U32 = struct.Struct("<I")
MODEL_ORDER = 4
#: Counts of a context are halved beyond this sum, which the coder's 32 bits have room for.
MODEL_SUM = 1 << 13
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


# Common superstrings


def _prefix_hashes(s: bytes) -> list[int]:
    out = [0]
    for b in s:
        out.append((out[-1] * _BASE + b + 1) % _PRIME)
    return out


def superstring(strings: list[bytes]) -> tuple[bytes, dict[bytes, int]]:
    """A common superstring by greedy overlaps, and where each string starts in it.

    Strings inside others are left out first. Then overlap lengths go down from the longest possible: at
    each, suffixes meet prefixes of equal hash, and a pair that is equal letter by letter is chained
    unless that closes a ring. Work beyond the search for contained strings is linear in the letters."""
    kept: list[bytes] = []
    joined = bytearray()
    for s in sorted(set(strings), key=lambda s: (-len(s), s)):
        if s and s not in joined:
            kept.append(s)
            joined += s + b"\xff"
    hashes = [_prefix_hashes(s) for s in kept]
    after: list[tuple[int, int] | None] = [None] * len(kept)
    first, last, led = list(range(len(kept))), list(range(len(kept))), [False] * len(kept)
    open_ends = list(range(len(kept)))
    power, powers = 1, [1]
    for _ in range(len(kept[0]) if kept else 0):
        power = power * _BASE % _PRIME
        powers.append(power)
    for size in range(len(kept[0]) - 1 if kept else 0, 0, -1):
        heads: dict[int, list[int]] = {}
        for i in range(len(kept)):
            if len(kept[i]) <= size:
                break  # in order of length
            if not led[i]:
                heads.setdefault(hashes[i][size], []).append(i)
        for j in open_ends:
            if len(kept[j]) <= size:
                break
            h = hashes[j]
            found = heads.get((h[-1] - h[len(kept[j]) - size] * powers[size]) % _PRIME, [])
            i = next((i for i in found if i != first[j] and kept[i].startswith(kept[j][-size:])), None)
            if i is not None:
                found.remove(i)
                after[j], led[i] = (i, size), True
                start, end = first[j], last[i]
                first[end], last[start] = start, end
        open_ends = [j for j in open_ends if after[j] is None]
    text, places = bytearray(), {b"": 0}
    for i in range(len(kept)):
        at, over = (None if led[i] else i), 0
        while at is not None:
            places[kept[at]] = len(text) - over
            text += kept[at][over:]
            at, over = after[at] or (None, 0)
    for s in strings:
        if s not in places:
            places[s] = text.index(s)
    return bytes(text), places


def encode_superstring(values: list[str], inner: str = "none", integers: str = "varint") -> bytes:
    """Starts, ends, then the superstring by a string codec of the block format (``none``, ``huffman``,
    ``two_bit_dna``, ``ppm`` or any other)."""
    if not values:
        return b""
    strings, codec = [v.encode("ascii") for v in values], co.INTEGERS[integers]
    text, places = superstring(strings)
    starts = [places[s] for s in strings]
    blob = co.STRINGS[inner][0]([text], codec)
    return co.before(starts, codec, co.before([a + len(s) for a, s in zip(starts, strings, strict=True)], codec, blob))


def decode_superstring(data: bytes, n: int, inner: str = "none", integers: str = "varint") -> list[str]:
    if not n:
        return []
    codec = co.INTEGERS[integers]
    starts, at = codec[1](data, n)
    ends, used = codec[1](data[at:], n)
    text = co.STRINGS[inner][1](data[at + used :], [max(ends)], codec)[0]
    if len(text) < max(ends):
        raise ValueError("the data end early")
    return [text[a:b].decode("ascii") for a, b in zip(starts, ends, strict=True)]


# CIGAR lists


def encode_cigar_list(values: list[str]) -> bytes:
    """Lengths in letters, then each CIGAR: count, operations by two in a byte (15 fills the last), numbers;
    ``*`` is the byte 255, an empty one 0. Other text and numbers with zeros in front raise."""
    out = bytearray(co.varint([len(v) for v in values])) if values else bytearray()
    for v in values:
        if v == "*":
            out.append(255)
            continue
        found = re.findall(r"(0|[1-9]\d*)([MIDNSHP=X])", v)
        if "".join(map("".join, found)) != v:
            raise ValueError(f"not a CIGAR: {v[:40]!r}")
        codes = [co.CIGAR_OPS.index(o) for _, o in found] + [15] * (len(found) % 2)
        out += co.varint([len(found)]) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        out += co.varint([int(k) for k, _ in found]) if found else b""
    return bytes(out)


def decode_cigar_list(data: bytes, n: int) -> list[str]:
    if not n:
        return []
    lengths, at = co.unvarint(data, n)
    out = []
    for length in lengths:
        # A count can begin with the byte 255 as well; only ``*`` has one letter.
        if length == 1:
            out.append("*")
            at += 1
            continue
        (k,), at = co.unvarint(data, 1, at)
        codes = [x for b in data[at : at + -(-k // 2)] for x in (b >> 4, b & 15)][:k]
        numbers, at = co.unvarint(data, k, at + -(-k // 2)) if k else ([], at)
        text = "".join([f"{m}{co.CIGAR_OPS[x]}" for m, x in zip(numbers, codes, strict=True)])
        if len(text) != length:
            raise ValueError("a stored length differs")
        out.append(text)
    return out


# An order-k model with escapes, and the arithmetic coder behind it

_TOP, _HALF, _QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30


class _Bits:
    """Arithmetic coder over 32-bit bounds; bits that are not settled yet are counted."""

    def __init__(self) -> None:
        self.low, self.high, self.waiting, self.bits = 0, _TOP, 0, []

    def put(self, a: int, b: int, total: int) -> None:
        width = self.high - self.low + 1
        self.high, self.low = self.low + width * b // total - 1, self.low + width * a // total
        while True:
            if self.high < _HALF or self.low >= _HALF:
                bit = int(self.low >= _HALF)
                self.bits += [bit] + [1 - bit] * self.waiting
                self.waiting = 0
                self.low, self.high = self.low - bit * _HALF, self.high - bit * _HALF
            elif self.low >= _QUARTER and self.high < 3 * _QUARTER:
                self.waiting += 1
                self.low, self.high = self.low - _QUARTER, self.high - _QUARTER
            else:
                return
            self.low, self.high = 2 * self.low, 2 * self.high + 1

    def end(self) -> bytes:
        bits = [*self.bits, 0, 1] if self.low < _QUARTER else [*self.bits, 1, 0]
        if self.waiting:
            bits[len(self.bits) + 1 : len(self.bits) + 1] = [1 - bits[len(self.bits)]] * self.waiting
        bits += [0] * (-len(bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


class _Unbits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.low, self.high = data, 32, 0, _TOP
        self.code = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def where(self, total: int) -> int:
        return ((self.code - self.low + 1) * total - 1) // (self.high - self.low + 1)

    def take(self, a: int, b: int, total: int) -> None:
        width = self.high - self.low + 1
        self.high, self.low = self.low + width * b // total - 1, self.low + width * a // total
        while True:
            if self.high < _HALF:
                off = 0
            elif self.low >= _HALF:
                off = _HALF
            elif self.low >= _QUARTER and self.high < 3 * _QUARTER:
                off = _QUARTER
            else:
                return
            i = self.at >> 3
            bit = self.data[i] >> (7 - (self.at & 7)) & 1 if i < len(self.data) else 0
            self.at += 1
            self.low, self.high, self.code = 2 * (self.low - off), 2 * (self.high - off) + 1, 2 * (self.code - off) + bit


def _seen(tables: dict[bytes, dict[int, int]], past: bytes, symbol: int, order: int) -> None:
    for k in range(min(order, len(past)) + 1):
        counts = tables.setdefault(past[len(past) - k :], {})
        counts[symbol] = counts.get(symbol, 0) + 1
        if sum(counts.values()) > MODEL_SUM:
            for s in counts:
                counts[s] = (counts[s] + 1) // 2


def model(data: bytes, order: int = MODEL_ORDER) -> bytes:
    """Length, order, then each byte in its longest known context; where that has not seen the byte, an
    escape as likely as the context has symbols leads to the next shorter one, at last to all bytes."""
    tables: dict[bytes, dict[int, int]] = {}
    coder, past = _Bits(), b""
    for symbol in data:
        for k in range(min(order, len(past)), -1, -1):
            counts = tables.get(past[len(past) - k :])
            if not counts:
                continue
            known = sum(counts.values())
            total, a = known + len(counts), 0
            if symbol in counts:
                for s, n in counts.items():
                    if s == symbol:
                        break
                    a += n
                coder.put(a, a + counts[symbol], total)
                break
            coder.put(known, total, total)
        else:
            coder.put(symbol, symbol + 1, 256)
        _seen(tables, past, symbol, order)
        past = (past + bytes([symbol]))[-order:] if order else b""
    return _U32.pack(len(data)) + bytes([order]) + (coder.end() if data else b"")


def unmodel(blob: bytes) -> bytes:
    size, order = _U32.unpack_from(blob)[0], blob[4]
    tables: dict[bytes, dict[int, int]] = {}
    coder, past, out = _Unbits(blob[5:]), b"", bytearray()
    for _ in range(size):
        if coder.at > 8 * len(coder.data) + 64:
            raise ValueError("the data end early")
        symbol = None
        for k in range(min(order, len(past)), -1, -1):
            counts = tables.get(past[len(past) - k :])
            if not counts:
                continue
            known = sum(counts.values())
            total, a = known + len(counts), 0
            at = coder.where(total)
            if at < known:
                for s, n in counts.items():
                    if at < a + n:
                        symbol = s
                        coder.take(a, a + n, total)
                        break
                    a += n
                break
            coder.take(known, total, total)
        if symbol is None:
            symbol = coder.where(256)
            coder.take(symbol, symbol + 1, 256)
        _seen(tables, past, symbol, order)
        past = (past + bytes([symbol]))[-order:] if order else b""
        out.append(symbol)
    return bytes(out)


def encode_modelled(values: list[str]) -> bytes:
    return co.varint([len(v) for v in values]) + model("".join(values).encode("ascii")) if values else b""


def decode_modelled(data: bytes, n: int) -> list[str]:
    if not n:
        return []
    lengths, at = co.unvarint(data, n)
    return [s.decode("ascii") for s in co.split(unmodel(data[at:]), lengths)]


# Trained dictionaries


def train(samples: list[bytes], size: int = 112_640) -> bytes:
    """A zstd dictionary of at most ``size`` bytes; raises ValueError where the samples are too few."""
    if not samples:
        raise ValueError("no samples")
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError as e:
        raise ValueError(f"no dictionary from these samples: {e}") from e


def with_dictionary(dictionary: bytes, level: int = 3) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """What compresses and restores bytes with a dictionary."""
    shared = zstandard.ZstdCompressionDict(dictionary)
    return (lambda data: zstandard.ZstdCompressor(level=level, dict_data=shared).compress(data), lambda data: zstandard.ZstdDecompressor(dict_data=shared).decompress(data))


# Columns


def _put(name: str) -> tuple[Callable[[list[str]], bytes], Callable[[bytes, int], list[str]]]:
    """The codec of a column: ``cigar``, ``model`` or ``superstring_`` with a string codec's name."""
    if name == "cigar":
        return encode_cigar_list, decode_cigar_list
    if name == "model":
        return encode_modelled, decode_modelled
    inner = name.removeprefix("superstring_")
    if inner == name or inner not in co.STRINGS:
        raise ValueError(f"no codec named {name!r}")
    return (lambda v: encode_superstring(v, inner)), (lambda b, n: decode_superstring(b, n, inner))


def encoded_list(values: Column, name: str) -> Column:
    """binary of an array<string> column."""
    _put(name)

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        put = _put(name)[0]
        return lists.map(lambda v: None if v is None else put(list(v)))

    return run(values)


def decoded_list(data: Column, n: Column, name: str) -> Column:
    """array<string> of a binary column and the numbers of strings."""
    _put(name)

    @F.pandas_udf("array<string>")
    def run(blobs: pd.Series, counts: pd.Series) -> pd.Series:
        get = _put(name)[1]
        return pd.Series([None if b is None else get(bytes(b), int(k)) for b, k in zip(blobs, counts, strict=True)], dtype=object)

    return run(data, n)
