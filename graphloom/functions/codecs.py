"""Byte codecs of integer lists, string lists and CIGAR lists, with the codes of the block format.

An integer codec is a pair: list -> bytes, and (bytes, count) -> (list, bytes used). A string codec
is a pair over byte strings: (list, integer codec) -> blob, and (blob, lengths, integer codec) -> list;
the lengths stand before the blob, written by the integer codec. Values that a codec cannot hold
raise; nothing is cut short. A null list gives null.
"""

from __future__ import annotations

import gzip
import heapq
import itertools
import lzma
import math
import re
import struct
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

Encode = Callable[[list[int]], bytes]
Decode = Callable[[bytes, int], tuple[list[int], int]]

#: The format's codes.
INTEGER_CODES = {
    "none": 0x00, "varint": 0x01, "fixed16": 0x02, "elias_gamma": 0x04, "elias_omega": 0x05, "golomb": 0x06, "rice": 0x07,
    "streamvbyte": 0x08, "vbyte": 0x09, "fixed32": 0x0A, "fixed64": 0x0B, "pfor_delta": 0x0C, "simple_8b": 0x0D,
    "group_varint": 0x0E, "bit_packing": 0x0F, "fibonacci": 0x10, "exp_golomb": 0x11, "byte_packed": 0x12, "masked_vbyte": 0x13,
}
STRING_CODES = {
    "none": 0x00, "zstd": 0x01, "gzip": 0x02, "lzma": 0x03, "huffman": 0x04, "two_bit_dna": 0x05, "arithmetic": 0x06,
    "bwt_huffman": 0x07, "rle": 0x08, "dictionary": 0x0A, "zstd_dict": 0x0B, "lz4": 0x0C, "brotli": 0x0D, "ppm": 0x0E,
}
CIGAR_OPS = "MIDNSHP=X"  # a letter's place is its code
CIGAR_PLAIN, CIGAR_SPLIT, CIGAR_STRING = 0, 1, 2
WALK_NONE, WALK_NAMES, WALK_NUMBERS = 0, 1, 2
RICE_K = 4
#: Simple-8b: (bits a value, values a word) for the selectors 1 to 14.
WORDS_8B = [(1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1)]
#: The shared text of the dictionary codec, and how often it is repeated.
ZSTD_TEXT, ZSTD_REPEATS = b"ACGTTGCAAAAATTTTGGGGCCCCATATTATAGCGCCGCGACGT", 1000
BWT_BLOCK, RUN, PPM_ORDER, DICTIONARY_ROWS = 65536, 3, 3, 65536
BASES = b"ACGT"

_U32 = struct.Struct("<I")


def _natural(values: list[int], below: int | None = None) -> list[int]:
    if any(x < 0 or below is not None and x >= below for x in values):
        raise ValueError("a value is outside the range of this codec")
    return values


# Bytes


def varint(values: list[int]) -> bytes:
    out = bytearray()
    for x in _natural(values):
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out)


def unvarint(data: bytes, n: int, at: int = 0) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        out.append(x)
    return out, at


def _fixed(letter: str) -> tuple[Encode, Decode]:
    width = struct.calcsize(f"<{letter}")
    return (lambda v: struct.pack(f"<{len(v)}{letter}", *v), lambda d, n: (list(struct.unpack_from(f"<{n}{letter}", d)), n * width))


def _ascii(values: list[int]) -> bytes:
    return "".join([f"{x}," for x in values]).encode()


def _unascii(data: bytes, n: int) -> tuple[list[int], int]:
    parts = data.split(b",", n)[:n]
    return [int(p) for p in parts], sum(len(p) + 1 for p in parts)


def _little(values: list[int], widths: list[int]) -> bytes:
    return b"".join([x.to_bytes(w, "little") for x, w in zip(values, widths, strict=True)])


def _unlittle(data: bytes, at: int, widths: list[int]) -> list[int]:
    ends = list(itertools.accumulate(widths, initial=at))
    if ends[-1] > len(data):
        raise ValueError("the data end early")
    return [int.from_bytes(data[a:b], "little") for a, b in itertools.pairwise(ends)]


def _counted(body: Encode, read: Callable[[bytes, int, int], tuple[list[int], int]], empty: bytes = _U32.pack(0)) -> tuple[Encode, Decode]:
    """A codec that writes its own count in front; an empty list is ``empty``."""

    def decode(data: bytes, n: int) -> tuple[list[int], int]:
        if _U32.unpack_from(data)[0] == 0:
            return [], len(empty)
        if _U32.unpack_from(data)[0] != n:
            raise ValueError("the stored count differs")
        return read(data, n, 4)

    return (lambda v: _U32.pack(len(v)) + body(_natural(v)) if v else empty), decode


def _quads(values: list[int], widths: list[int]) -> list[int]:
    """A tag byte for four values each: two bits a width."""
    return [sum((w - 1) << 2 * j for j, w in enumerate(widths[i : i + 4])) for i in range(0, len(values), 4)]


def _unquad(tags: bytes, n: int) -> list[int]:
    return [(tags[i >> 2] >> 2 * (i & 3) & 3) + 1 for i in range(n)]


def _stream(values: list[int]) -> bytes:
    widths = [min(4, max(1, -(-x.bit_length() // 7))) for x in _natural(values, 1 << 32)]
    return bytes(_quads(values, widths)) + _little(values, widths)


def _unstream(data: bytes, n: int, at: int) -> tuple[list[int], int]:
    body = at + (n + 3) // 4
    widths = _unquad(data[at:body], n)
    return _unlittle(data, body, widths), body + sum(widths)


def _groups(values: list[int]) -> bytes:
    widths = [max(1, -(-x.bit_length() // 8)) for x in _natural(values, 1 << 32)]
    tags = _quads(values, widths)
    return b"".join([bytes([t]) + _little(values[4 * i : 4 * i + 4], widths[4 * i : 4 * i + 4]) for i, t in enumerate(tags)])


def _ungroups(data: bytes, n: int, at: int) -> tuple[list[int], int]:
    out: list[int] = []
    while len(out) < n:
        widths = _unquad(data[at : at + 1], min(4, n - len(out)))
        out += _unlittle(data, at + 1, widths)
        at += 1 + sum(widths)
    return out, at


def _prefixed(values: list[int]) -> bytes:
    parts = [varint([x]) for x in _natural(values, 1 << 35)]
    return b"".join([bytes([len(p)]) + p for p in parts])


def _unprefixed(data: bytes, n: int, at: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        (x,), end = unvarint(data, 1, at + 1)
        if end != at + 1 + data[at]:
            raise ValueError("a stored length differs")
        out.append(x)
        at = end
    return out, at


def _packed(values: list[int]) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if max(values) < 1 << 8 * w)
    return bytes([width]) + _little(values, [width] * len(values))


def _unpacked(data: bytes, n: int, at: int) -> tuple[list[int], int]:
    return _unlittle(data, at + 1, [data[at]] * n), at + 1 + n * data[at]


def _bit_packing(values: list[int]) -> bytes:
    if not values:
        return struct.pack("<BI", 0, 0)
    bits = max(1, max(_natural(values, 1 << 32)).bit_length())
    return struct.pack("<BI", bits, len(values)) + _little(values, [-(-bits // 8)] * len(values))


def _unbit_packing(data: bytes, n: int) -> tuple[list[int], int]:
    bits, count = struct.unpack_from("<BI", data)
    if count != n:
        raise ValueError("the stored count differs")
    width = -(-bits // 8)
    return _unlittle(data, 5, [width] * n), 5 + n * width


def _pfor(values: list[int]) -> bytes:
    base = min(values)
    deltas = [x - base for x in values]
    limit = max(1, sorted(deltas)[min(int(len(deltas) * 0.95), len(deltas) - 1)])
    far = [i for i, d in enumerate(deltas) if d > limit]
    width = -(-limit.bit_length() // 8)
    near = [0 if d > limit else d for d in deltas]
    return struct.pack("<iII", base, limit, len(far)) + varint(far) + varint([deltas[i] for i in far]) + _little(near, [width] * len(near))


def _unpfor(data: bytes, n: int, at: int) -> tuple[list[int], int]:
    base, limit, k = struct.unpack_from("<iII", data, at)
    places, at = unvarint(data, k, at + 12)
    outliers, at = unvarint(data, k, at)
    width = -(-limit.bit_length() // 8)
    deltas = _unlittle(data, at, [width] * n)
    for i, d in zip(places, outliers, strict=True):
        deltas[i] = d
    return [base + d for d in deltas], at + n * width


def _words(values: list[int]) -> bytes:
    _natural(values, 1 << 60)
    out, at = [], 0
    while at < len(values):
        s, bits, k = next((s, b, k) for s, (b, k) in enumerate(WORDS_8B, 1) if max(values[at : at + k]) < 1 << b)
        out.append(s | sum(x << 4 + bits * j for j, x in enumerate(values[at : at + k])))
        at += k
    return struct.pack(f"<{len(out)}Q", *out)


def _unwords(data: bytes, n: int, at: int) -> tuple[list[int], int]:
    out: list[int] = []
    while len(out) < n:
        word = struct.unpack_from("<Q", data, at)[0]
        bits, k = WORDS_8B[(word & 15) - 1]
        out += [word >> 4 + bits * j & (1 << bits) - 1 for j in range(min(k, n - len(out)))]
        at += 8
    return out, at


# Bits, most significant first


def _to_bytes(codes: list[str]) -> bytes:
    text = "".join(codes)
    size = -(-len(text) // 8)
    return int(text.ljust(8 * size, "0"), 2).to_bytes(size, "big") if text else b""


def _to_bits(data: bytes) -> str:
    return f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}" if data else ""


def _low(x: int, bits: int) -> str:
    return f"{x & (1 << bits) - 1:0{bits}b}" if bits else ""


def _gamma(values: list[int]) -> bytes:
    sizes = [(x + 1).bit_length() - 1 for x in _natural(values)]
    return _to_bytes(["1" * k + "0" + _low(x + 1, k) for x, k in zip(values, sizes, strict=True)])


def _ungamma(data: bytes, n: int) -> tuple[list[int], int]:
    bits, at, out = _to_bits(data), 0, []
    for _ in range(n):
        zero = bits.index("0", at)
        k = zero - at
        out.append(int("1" + bits[zero + 1 : zero + 1 + k], 2) - 1)
        at = zero + 1 + k
    return out, -(-at // 8)


def _omega(values: list[int]) -> bytes:
    codes = []
    for x in _natural(values):
        groups, m = [], x + 1
        while m > 1:
            groups.append(f"{m:b}")
            m = m.bit_length() - 1
        codes.append("0" + "".join(reversed(groups)))
    return _to_bytes(codes)


def _unomega(data: bytes, n: int) -> tuple[list[int], int]:
    # Each code begins with 0 and each of its groups with 1, so a group ends where a 0 follows.
    bits, at, out = _to_bits(data), 0, []
    for _ in range(n):
        at, m = at + 1, 1
        while bits[at : at + 1] == "1":
            at, m = at + m + 1, int(bits[at : at + m + 1], 2)
        out.append(m - 1)
    return out, -(-at // 8)


#: What a unary part is made of: its bits, the byte of eight of them, and a run of such bytes.
_UNARY = {"1": (1, 0xFF, re.compile(b"\xff*+")), "0": (0, 0, re.compile(b"\0*+"))}


def _quotients(values: list[int], by: int, bits: int, unary: str) -> bytes:
    """Only stops and remainders are put in place; the unary parts are what the bytes are filled with."""
    bit, fill, _ = _UNARY[unary]
    pairs = [divmod(x, by) for x in _natural(values)]
    total = sum([q for q, _ in pairs]) + len(pairs) * (1 + bits)
    out = bytearray([fill]) * -(-total // 8)
    end = 0
    for q, r in pairs:
        at = end + q
        end = at + 1 + bits
        a, z = at >> 3, (end + 7) >> 3
        shift = 8 * z - end
        code = r if bit else r | 1 << bits
        old = int.from_bytes(out[a:z], "big") & ~((2 << bits) - 1 << shift)
        out[a:z] = (old | code << shift).to_bytes(z - a, "big")
    if end & 7:
        out[-1] &= 0xFF00 >> (end & 7) & 0xFF
    return bytes(out)


def _unquotients(data: bytes, at: int, n: int, by: int, k: int, unary: str) -> tuple[list[int], int]:
    _, fill, run = _UNARY[unary]
    out, size = [], len(data)
    at *= 8
    for _ in range(n):
        i = at >> 3
        rest = (data[i] ^ fill) & 0xFF >> (at & 7) if i < size else 0
        if not rest:
            i = run.match(data, i + 1).end()
            rest = data[i] ^ fill if i < size else 0
        stop = 8 * i + 8 - rest.bit_length()
        end = stop + 1 + k
        a, z = (stop + 1) >> 3, (end + 7) >> 3
        if not rest or z > size:
            raise ValueError("the data end early")
        out.append((stop - at) * by + (int.from_bytes(data[a:z], "big") >> 8 * z - end & (1 << k) - 1))
        at = end
    return out, -(-at // 8)


def _golomb_bits(by: int) -> int:
    return (by - 1).bit_length() if by > 1 else 1


def _golomb(values: list[int]) -> bytes:
    if not values:
        return b""
    by = max(1, int(math.sqrt(max(values) / len(values))))
    if by > 255:  # the head holds one byte; readers take any divisor
        by, _ = 255, _natural(values, 1 << 32)
    return bytes([by]) + _quotients(values, by, _golomb_bits(by), "1")


def _ungolomb(data: bytes, n: int) -> tuple[list[int], int]:
    return _unquotients(data, 1, n, data[0], _golomb_bits(data[0]), "1") if n else ([], 0)


def _rice(values: list[int]) -> bytes:
    return bytes([RICE_K]) + _quotients(values, 1 << RICE_K, RICE_K, "1")


def _unrice(data: bytes, n: int) -> tuple[list[int], int]:
    return _unquotients(data, 1, n, 1 << data[0], data[0], "1")


def _exp_golomb(values: list[int]) -> bytes:
    mean = sum(values) / len(values)
    k = max(0, int(math.log2(mean)) - 1) if mean > 1 else 0
    return bytes([k]) + _quotients(values, 1 << k, k, "0")


def _unexp_golomb(data: bytes, n: int, at: int) -> tuple[list[int], int]:
    return _unquotients(data, at + 1, n, 1 << data[at], data[at], "0")


INTEGERS: dict[str, tuple[Encode, Decode]] = {
    "none": (_ascii, _unascii), "varint": (varint, unvarint), "vbyte": (varint, unvarint),
    "fixed16": _fixed("H"), "fixed32": _fixed("I"), "fixed64": _fixed("Q"),
    "elias_gamma": (_gamma, _ungamma), "elias_omega": (_omega, _unomega), "golomb": (_golomb, _ungolomb), "rice": (_rice, _unrice),
    "streamvbyte": _counted(_stream, _unstream, b""), "pfor_delta": (lambda v: _U32.pack(len(v)) + (_pfor(v) if v else b""), _counted(_pfor, _unpfor)[1]),
    "simple_8b": _counted(_words, _unwords), "group_varint": _counted(_groups, _ungroups), "bit_packing": (_bit_packing, _unbit_packing),
    "fibonacci": _counted(_prefixed, _unprefixed), "exp_golomb": _counted(_exp_golomb, _unexp_golomb, _U32.pack(0) + b"\0"),
    "byte_packed": _counted(_packed, _unpacked, _U32.pack(0) + b"\1"), "masked_vbyte": _counted(varint, unvarint),
}
_stream_decode = INTEGERS["streamvbyte"][1]
INTEGERS["streamvbyte"] = (INTEGERS["streamvbyte"][0], lambda d, n: _stream_decode(d, n) if n else ([], 0))


def _checked(decode: Decode) -> Decode:
    def run(data: bytes, n: int) -> tuple[list[int], int]:
        values, used = decode(data, n)
        if len(values) != n or used > len(data):
            raise ValueError("the data end early")
        return values, used

    return run


INTEGERS = {name: (encode, _checked(decode)) for name, (encode, decode) in INTEGERS.items()}
BY_CODE = {code: INTEGERS[name] for name, code in INTEGER_CODES.items()}


#: Bits of the largest values that a codec holds, or (the unary ones) can hold in few bytes; others hold all of 64.
DIGITS = {
    "fixed16": 16, "fixed32": 32, "pfor_delta": 31, "streamvbyte": 32, "group_varint": 32, "bit_packing": 32, "fibonacci": 35,
    "simple_8b": 60, "golomb": 32, "rice": 32, "exp_golomb": 32,
}


def in_digits(codec: str) -> tuple[Encode, Decode]:
    """A codec for values that need not fit it: their number of digits, of as many bits as the codec holds, and
    a list of each digit, lowest first, by the codec. This is none of the format's codes."""
    (encode, decode), bits = INTEGERS[codec], DIGITS.get(codec, 64)

    def put(values: list[int]) -> bytes:
        parts = []
        while not parts or any(values):
            parts.append(encode([x & (1 << bits) - 1 for x in _natural(values)]))
            values = [x >> bits for x in values]
        return bytes([len(parts)]) + b"".join(parts)

    def get(data: bytes, n: int) -> tuple[list[int], int]:
        out, at = [0] * n, 1
        for i in range(data[0]):
            digits, used = decode(data[at:], n)
            out = [x | y << bits * i for x, y in zip(out, digits, strict=True)]
            at += used
        return out, at

    return put, get


def before(numbers: list[int], codec: tuple[Encode, Decode], rest: bytes) -> bytes:
    """The encoded numbers with ``rest`` behind them; raises where a reader could not tell the two apart.

    That happens with elias_omega only: a code that ends on a full byte is read on where a 1 follows."""
    head = codec[0](numbers)
    if codec is BY_CODE[INTEGER_CODES["elias_omega"]] and codec[1](head + rest[:16], len(numbers))[1] != len(head):
        raise ValueError("elias_omega cannot stand before these data")
    return head + rest


def delta(values: list[int], encode: Encode = varint) -> bytes:
    """Differences to the value before, the first as it is: runs of signs, then the absolute values."""
    steps = [b - a for a, b in itertools.pairwise([0, *values])]
    if not steps:
        return b""
    runs = [(negative, len(list(g))) for negative, g in itertools.groupby(steps, lambda x: x < 0)]
    # The first run is of signs +; it has a length of its own, 0 where the list begins with a minus.
    head = [0, runs[0][1] - 1] if runs[0][0] else [runs[0][1]]
    return varint(head + [k - 1 for _, k in runs[1:]]) + encode([abs(x) for x in steps])


def undelta(data: bytes, n: int, decode: Decode = unvarint) -> tuple[list[int], int]:
    if not n:
        return [], 0
    (first,), at = unvarint(data, 1)
    signs, sign = [1] * first, -1
    while len(signs) < n:
        (k,), at = unvarint(data, 1, at)
        signs += [sign] * (k + 1)
        sign = -sign
    sizes, used = decode(data[at:], n)
    return list(itertools.accumulate(s * x for s, x in zip(signs, sizes, strict=True))), at + used


def pack_flags(flags: list[int]) -> bytes:
    """Least significant bit first, in words of 64."""
    size = 8 * -(-len(flags) // 64)
    return np.packbits(np.array(flags, np.uint8), bitorder="little").tobytes().ljust(size, b"\0") if flags else b""


def unpack_flags(data: bytes, n: int) -> tuple[list[int], int]:
    size = 8 * -(-n // 64)
    if len(data) < size:
        raise ValueError("the data end early")
    return np.unpackbits(np.frombuffer(data[:size], np.uint8), bitorder="little")[:n].tolist(), size


# Strings


def split(blob: bytes, lengths: list[int]) -> list[bytes]:
    ends = list(itertools.accumulate(lengths, initial=0))
    if ends[-1] > len(blob):
        raise ValueError("the data end early")
    return [blob[a:b] for a, b in itertools.pairwise(ends)]


def _whole(put: Callable[[bytes], bytes], get: Callable[[bytes], bytes]) -> tuple[Callable, Callable]:
    """A codec of the joined strings that looks at no integer codec."""
    return (lambda strings, codec: put(b"".join(strings)), lambda blob, lengths, codec: split(get(blob), lengths))


def _unzstd(data: bytes, **options) -> bytes:
    return zstandard.ZstdDecompressor(**options).decompressobj().decompress(data)


def _shared() -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(ZSTD_TEXT * ZSTD_REPEATS)


def _arrow(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    def put(data: bytes) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, name) as out:
            out.write(data)
        return sink.getvalue().to_pybytes()

    return put, lambda data: pa.CompressedInputStream(pa.py_buffer(data), name).read()


def _code_lengths(data: bytes) -> list[int]:
    """Depths of the sixteen nibbles in a Huffman tree."""
    counts = Counter(x for b in data for x in (b >> 4, b & 15))
    depth = [0] * 16
    if len(counts) == 1:
        depth[next(iter(counts))] = 1
        return depth
    heap = [(n, x, [x]) for x, n in counts.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for x in left + right:
            depth[x] += 1
        heapq.heappush(heap, (a + b, i, left + right))
    return depth


def _canonical(depth: list[int]) -> dict[int, str]:
    codes, code, last = {}, 0, 0
    for d, x in sorted((d, x) for x, d in enumerate(depth) if d):
        code <<= d - last
        codes[x], code, last = f"{code:0{d}b}", code + 1, d
    return codes


def huffman(data: bytes, encode: Encode = varint) -> bytes:
    if not data:
        return _U32.pack(0)
    depth = _code_lengths(data)
    codes, book = _canonical(depth), encode(depth)
    pairs = {b: codes[b >> 4] + codes[b & 15] for b in set(data)}
    return _U32.pack(len(book)) + book + _to_bytes([pairs[b] for b in data])


def unhuffman(blob: bytes, size: int, decode: Decode = unvarint) -> bytes:
    if not size:
        return b""
    k = _U32.unpack_from(blob)[0]
    table = {code: x for x, code in _canonical(decode(blob[4 : 4 + k], 16)[0]).items()}
    nibbles, code = [], ""
    for bit in _to_bits(blob[4 + k :]):
        code += bit
        if code in table:
            nibbles.append(table[code])
            code = ""
            if len(nibbles) == 2 * size:
                break
    if len(nibbles) < 2 * size:
        raise ValueError("the data end early")
    return bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))


def two_bit(data: bytes) -> bytes:
    """Four bases a byte; every other byte, small letters too, is an exception that is kept as it is."""
    if not data:
        return b"\0"
    code = np.full(256, 4, np.uint8)
    code[list(BASES)] = range(4)
    x = code[np.frombuffer(data, np.uint8)]
    odd = np.flatnonzero(x == 4).tolist()
    x = np.where(x == 4, 0, x)
    x = np.pad(x, (0, -len(x) % 4)).reshape(-1, 4)
    body = (x << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8).tobytes()
    return bytes([bool(odd)]) + body + (varint([len(odd)]) + varint(odd) + bytes(data[i] for i in odd) if odd else b"")


def untwo_bit(blob: bytes, size: int) -> bytes:
    if not size:
        return b""
    end = 1 + -(-size // 4)
    body = np.frombuffer(blob[1:end], np.uint8)
    out = np.frombuffer(BASES, np.uint8)[(body[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].reshape(-1)[:size].copy()
    if blob[0] & 1:
        (k,), at = unvarint(blob, 1, end)
        places, at = unvarint(blob, k, at)
        out[places] = np.frombuffer(blob[at : at + k], np.uint8)
    if len(out) < size:
        raise ValueError("the data end early")
    return out.tobytes()


def _rotate(block: bytes) -> bytes:
    """Place of the text and last column of its sorted rotations, by doubling the sorted prefix."""
    text = np.frombuffer(block + (b"\1" if b"\0" in block else b"\0"), np.uint8)
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1]
    while True:
        after = np.roll(rank, -step)
        order = np.lexsort((after, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        rank, step = new, 2 * step
        if step >= n or rank[order[-1]] == n - 1:
            break
    order = np.argsort(rank, kind="stable")
    return struct.pack("<II", int(np.flatnonzero(order == 0)[0]), n) + text[order - 1].tobytes()


def _unrotate(column: bytes, place: int) -> bytes:
    x = np.frombuffer(column, np.uint8)
    order = np.argsort(x, kind="stable")
    out = bytearray()
    for _ in range(len(x)):
        place = int(order[place])
        out.append(column[place])
    return bytes(out[:-1])  # without the end mark


def bwt(data: bytes) -> bytes:
    blocks = [data[i : i + BWT_BLOCK] for i in range(0, len(data), BWT_BLOCK)]
    return _U32.pack(len(blocks)) + b"".join(map(_rotate, blocks))


def unbwt(data: bytes) -> bytes:
    out, at = [], 4
    for _ in range(_U32.unpack_from(data)[0]):
        place, n = struct.unpack_from("<II", data, at)
        out.append(_unrotate(data[at + 8 : at + 8 + n], place))
        at += 8 + n
    return b"".join(out)


def move_to_front(data: bytes) -> bytes:
    symbols, out = list(range(256)), bytearray()
    for b in data:
        i = symbols.index(b)
        out.append(i)
        symbols.insert(0, symbols.pop(i))
    return bytes(out)


def unmove_to_front(data: bytes) -> bytes:
    symbols, out = list(range(256)), bytearray()
    for i in data:
        symbols.insert(0, symbols.pop(i))
        out.append(symbols[0])
    return bytes(out)


def _bwt_huffman(data: bytes) -> bytes:
    moved = move_to_front(bwt(data)) if data else b""
    return _U32.pack(len(moved)) + (huffman(moved) if moved else b"")


def _unbwt_huffman(blob: bytes) -> bytes:
    size = _U32.unpack_from(blob)[0]
    return unbwt(unmove_to_front(unhuffman(blob[4:], size))) if size else b""


def run_lengths(data: bytes) -> bytes:
    """Segments: runs of three or more as (1, letter, count), what stands between them as (0, letters)."""
    if not data:
        return b""
    parts = [(b, len(list(g))) for b, g in itertools.groupby(data)]
    segments = []
    for long, group in itertools.groupby(parts, lambda p: p[1] >= RUN):
        if long:
            segments += [(1, bytes([b]) + varint([n])) for b, n in group]
        else:
            segments.append((0, b"".join([bytes([b]) * n for b, n in group])))
    return varint([len(segments)]) + b"".join([bytes([mode]) + varint([len(s)]) + s for mode, s in segments])


def _unrun_lengths(blob: bytes, lengths: list[int], codec: tuple[Encode, Decode]) -> list[bytes]:
    out, at = [], 0
    for length in lengths:
        text = b""
        (k,), at = unvarint(blob, 1, at) if length else ([0], at)
        for _ in range(k):
            mode = blob[at]
            (size,), at = unvarint(blob, 1, at + 1)
            body = blob[at : at + size]
            text += body[:1] * unvarint(body, 1, 1)[0][0] if mode else body
            at += size
        if len(text) != length:
            raise ValueError("a stored length differs")
        out.append(text)
    return out


def _dictionary(strings: list[bytes], codec: tuple[Encode, Decode]) -> bytes:
    if not strings:
        return b""
    places = {s: i for i, s in enumerate(dict.fromkeys(strings))}
    if len(places) > DICTIONARY_ROWS:
        raise ValueError("too many different strings for a dictionary")
    starts = list(itertools.accumulate(map(len, places), initial=0))[:-1]
    text = b"".join(places)
    return struct.pack("<II", len(places), len(text)) + codec[0](starts) + text + codec[0]([places[s] for s in strings])


def _undictionary(blob: bytes, lengths: list[int], codec: tuple[Encode, Decode]) -> list[bytes]:
    if not lengths:
        return []
    k, size = struct.unpack_from("<II", blob)
    starts, used = codec[1](blob[8:], k)
    at = 8 + used
    words = [blob[at + a : at + b] for a, b in itertools.pairwise([*starts, size])]
    return [words[i] for i in codec[1](blob[at + size :], len(lengths))[0]]


STRINGS: dict[str, tuple[Callable, Callable]] = {
    "none": _whole(bytes, bytes),
    "zstd": _whole(lambda b: zstandard.ZstdCompressor(level=6).compress(b), _unzstd),
    "gzip": _whole(lambda b: gzip.compress(b, 6, mtime=0), gzip.decompress),
    "lzma": _whole(lambda b: lzma.compress(b, preset=6), lzma.decompress),
    "huffman": (lambda s, c: huffman(b"".join(s), c[0]), lambda b, n, c: split(unhuffman(b, sum(n), c[1]), n)),
    "two_bit_dna": (lambda s, c: two_bit(b"".join(s)), lambda b, n, c: split(untwo_bit(b, sum(n)), n)),
    "arithmetic": _whole(lambda b: _U32.pack(len(b)) + b, lambda b: b[4 : 4 + _U32.unpack_from(b)[0]]),
    "bwt_huffman": _whole(_bwt_huffman, _unbwt_huffman),
    "rle": (lambda s, c: b"".join(map(run_lengths, s)), _unrun_lengths),
    "dictionary": (_dictionary, _undictionary),
    "zstd_dict": _whole(lambda b: zstandard.ZstdCompressor(level=3, dict_data=_shared()).compress(b), lambda b: _unzstd(b, dict_data=_shared())),
    "lz4": _whole(*_arrow("lz4")), "brotli": _whole(*_arrow("brotli")),
    "ppm": _whole(lambda b: _U32.pack(len(b)) + bytes([PPM_ORDER]) + (zstandard.ZstdCompressor(level=3).compress(b) if b else b""), lambda b: _unzstd(b[5:]) if len(b) > 5 else b""),
}
STRINGS_BY_CODE = {code: STRINGS[name] for name, code in STRING_CODES.items()}


def _known(table: dict, code: int, what: str):
    if code not in table:
        raise ValueError(f"no {what} codec has the code {code:#04x}")
    return table[code]


def integers_of(code: int) -> tuple[Encode, Decode]:
    return _known(BY_CODE, code, "integer")


def encode_strings(values: list[str], code: int) -> bytes:
    """Lengths, then the blob, by a two-byte code; strings must be ASCII."""
    strings, codec = [v.encode("ascii") for v in values], integers_of(code >> 8 & 255)
    return before([len(s) for s in strings], codec, _known(STRINGS_BY_CODE, code & 255, "string")[0](strings, codec))


def decode_strings(data: bytes, n: int, code: int) -> list[str]:
    codec = integers_of(code >> 8 & 255)
    lengths, used = codec[1](data, n)
    return [s.decode("ascii") for s in _known(STRINGS_BY_CODE, code & 255, "string")[1](data[used:], lengths, codec)]


# CIGAR lists, by a four-byte code: decomposition, integers of lengths, integers of counts, strings


def encode_cigars(values: list[str], code: int) -> bytes:
    """``*`` has no operations; a decomposed list holds one CIGAR each, so lists with commas raise."""
    if code & 255 != CIGAR_SPLIT:
        return encode_strings(values, code >> 24 | code & 0xFF00)
    found = [re.findall(r"(\d+)([MIDNSHP=X])", v) for v in values]
    if any("".join(map("".join, ops)) != v.replace("*", "") for ops, v in zip(found, values, strict=True)):
        raise ValueError("not a single CIGAR")
    packed = bytearray()
    for ops in found:
        codes = [CIGAR_OPS.index(o) for _, o in ops] + [15] * (len(ops) % 2)
        packed += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    blob = _known(STRINGS_BY_CODE, code >> 24 & 255, "string")[0]([bytes(packed)], integers_of(1))
    lengths = before([int(k) for ops in found for k, _ in ops], integers_of(code >> 8 & 255), blob)
    return before([len(ops) for ops in found], integers_of(code >> 16 & 255), lengths)


def decode_cigars(data: bytes, n: int, code: int) -> list[str]:
    if code & 255 not in (CIGAR_PLAIN, CIGAR_SPLIT, CIGAR_STRING):
        raise ValueError("no such decomposition")
    if code & 255 != CIGAR_SPLIT:
        return decode_strings(data, n, code >> 24 | code & 0xFF00)
    if not n:
        return []
    counts, at = integers_of(code >> 16 & 255)[1](data, n)
    lengths, used = integers_of(code >> 8 & 255)[1](data[at:], sum(counts))
    size = sum(-(-k // 2) for k in counts)
    packed = _known(STRINGS_BY_CODE, code >> 24 & 255, "string")[1](data[at + used :], [size], integers_of(1))[0]
    letters = "".join([CIGAR_OPS[x] for b in packed for x in (b >> 4, b & 15) if x != 15])
    parts = [f"{k}{o}" for k, o in zip(lengths, letters, strict=True)]
    ends = list(itertools.accumulate(counts, initial=0))
    return ["".join(parts[a:b]) or "*" for a, b in itertools.pairwise(ends)]


def cigar_code(lengths: str = "varint", counts: str = "varint", strings: str = "none", decomposition: int = CIGAR_SPLIT) -> int:
    return decomposition | INTEGER_CODES[lengths] << 8 | INTEGER_CODES[counts] << 16 | STRING_CODES[strings] << 24


# Names and codes


def code_of(strategy: str) -> int:
    """The two-byte code of ``integer-string`` or ``integer+string``; a single name is a string codec, or
    else an integer codec over plain strings. Case and underscores do not matter; unknown names raise."""
    flat = lambda table: {k.replace("_", ""): v for k, v in table.items()} | {"identity": 0}
    numbers, texts = flat(INTEGER_CODES), flat(STRING_CODES) | {"2bit": STRING_CODES["two_bit_dna"]}
    integer, _, string = re.sub(r"2-bit\b", "2bit", strategy.lower().replace("_", "")).replace("+", "-").rpartition("-")
    if not integer and string not in texts:
        integer, string = string, "none"
    try:
        return numbers[integer or "varint"] << 8 | texts[string]
    except KeyError as e:
        raise ValueError(f"no codec named {e.args[0]!r}") from None


def describe(code: int) -> str:
    """``integer-string`` of a two-byte code, ``?`` for what has no name."""
    name = lambda table, c: next((k for k, v in table.items() if v == c), "?")
    return f"{name(INTEGER_CODES, code >> 8 & 255)}-{name(STRING_CODES, code & 255)}"


def catalogue() -> list[tuple[str, str, int]]:
    """(integer codec, string codec, code) of every pair."""
    return [(i, s, a << 8 | b) for i, a in INTEGER_CODES.items() for s, b in STRING_CODES.items()]


def suggest_strings(sample: bytes) -> str:
    """The string codec that a sample suggests: bases, repeated runs of letters, short or other text."""
    if not sample:
        return "none"
    if sum(c in b"ACGTNacgtn" for c in sample) > 0.9 * len(sample):
        return "two_bit_dna"
    head = sample[:1024]
    most = lambda k: max(Counter(head[i : i + k] for i in range(len(head) - k + 1)).values())
    if len(head) >= 10 and any(most(k) > len(head) / (4 * k) for k in (2, 3, 4)):
        return "bwt_huffman"
    return "zstd_dict" if len(sample) < 1024 else "zstd"


# Columns


def encoded(values: Column, codec: str) -> Column:
    """binary of an array<bigint> column."""
    if codec not in INTEGER_CODES:
        raise ValueError(f"no codec named {codec!r}")

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: None if v is None else by_name(codec)[0]([int(x) for x in v]))

    return run(values)


def decoded(data: Column, n: Column, codec: str) -> Column:
    """array<bigint> of a binary column and the numbers of values."""
    if codec not in INTEGER_CODES:
        raise ValueError(f"no codec named {codec!r}")

    @F.pandas_udf("array<bigint>")
    def run(blobs: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else by_name(codec)[1](bytes(b), int(k))[0] for b, k in zip(blobs, counts, strict=True)], dtype=object)

    return run(data, n)


def round_trips(values: Column, *names: str, digits: bool = False) -> Column:
    """struct<codec: struct<size: bigint, same: boolean>> of an array<bigint> column: the bytes that each codec
    takes, and whether they decode to the values. One list's bytes are held at a time, and no column has them.
    With ``digits``, lists with values that a codec cannot hold go through it by ``in_digits``; else they raise."""
    for name in names:
        if name not in INTEGER_CODES:
            raise ValueError(f"no codec named {name!r}")

    @F.pandas_udf(f"struct<{','.join(f'{x}:struct<size:bigint,same:boolean>' for x in names)}>")
    def run(lists: pd.Series) -> pd.DataFrame:
        found = [[round_trip(x, name, digits) for name in names] for x in ([int(i) for i in v] if v is not None else None for v in lists)]
        none = {"size": None, "same": None}
        return pd.DataFrame({name: pd.Series([none if f[i] is None else dict(zip(none, f[i], strict=True)) for f in found], dtype=object) for i, name in enumerate(names)})

    return run(values)


def encoded_strings(values: Column, strategy: str) -> Column:
    """binary of an array<string> column, by a strategy's name."""
    code = code_of(strategy)

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: None if v is None else encode_strings(list(v), code))

    return run(values)


def decoded_strings(data: Column, n: Column, strategy: str) -> Column:
    """array<string> of a binary column and the numbers of strings."""
    code = code_of(strategy)

    @F.pandas_udf("array<string>")
    def run(blobs: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else decode_strings(bytes(b), int(k), code) for b, k in zip(blobs, counts, strict=True)], dtype=object)

    return run(data, n)


def by_name(codec: str) -> tuple[Encode, Decode]:
    """What tasks look codecs up with: they get the name, not the functions."""
    return INTEGERS[codec]


def round_trip(values: list[int] | None, codec: str, digits: bool = False) -> tuple[int, bool] | None:
    """How many bytes a list takes, and whether they decode to it."""
    if values is None:
        return None
    over = digits and values and max(values) >> DIGITS.get(codec, 64)
    encode, decode = in_digits(codec) if over else by_name(codec)
    data = encode(values)
    return len(data), decode(data, len(values))[0] == values
