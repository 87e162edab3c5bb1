"""Byte codecs: round trips, sizes against the closed forms, fixed layouts, values that do not fit."""

import random
import tracemalloc

import pytest

from graphloom.functions import codecs

NAMES = list(codecs.INTEGERS)
OMEGA = codecs.INTEGER_CODES["elias_omega"]


def lists():
    rng = random.Random(7)
    yield from ([], [0], [1, 2, 3], [0] * 70, [255, 256, 65535], list(range(200)))
    yield [rng.randrange(60_000) for _ in range(500)]
    yield [1] * 95 + [50_000] * 5
    yield [rng.randrange(1 << rng.randrange(1, 16)) for _ in range(333)]


@pytest.mark.parametrize("name", NAMES)
def test_integers(name):
    encode, decode = codecs.INTEGERS[name]
    for values in lists():
        data = encode(values)
        assert decode(data + b"rest", len(values)) == (values, len(data))
        signed = [(-1) ** (i // 3) * x for i, x in enumerate(values)]
        if name != "fixed16":
            data = codecs.delta(signed, encode)
            assert codecs.undelta(data + b"rest", len(signed), decode) == (signed, len(data))


#: What the closed forms of ``codec_size`` say of these four values.
@pytest.mark.parametrize(("name", "size"), [("none", 14), ("varint", 7), ("fixed16", 8), ("fixed32", 16), ("fixed64", 32), ("elias_gamma", 7), ("group_varint", 11), ("bit_packing", 13), ("fibonacci", 15), ("byte_packed", 13), ("masked_vbyte", 11), ("streamvbyte", 12), ("simple_8b", 20)])
def test_size(name, size):
    assert len(codecs.INTEGERS[name][0]([0, 1, 300, 40000])) == size


def test_layouts():
    put = lambda name, *v: codecs.INTEGERS[name][0](list(v)).hex()
    assert put("elias_gamma", 0, 1, 4) == "4c80"  # 0 | 10 0 | 110 01
    assert put("elias_omega", 0, 1, 3) == f"{int('0' + '010' + '010100' + '000000', 2):04x}"
    assert put("rice", 17) == "0484"  # 10 0001
    assert put("streamvbyte", 5, 300) == "0200000004052c01"
    assert put("group_varint", 5, 300) == "0200000004052c01"
    assert put("simple_8b", 1, 0, 1) == "030000005100000000000000"
    assert codecs.delta([5, 3, 1, 4]).hex() == "010100" + "05020203"
    assert codecs.delta([-2, 3]).hex() == "000000" + "0205"
    assert codecs.pack_flags([1, 0, 1]).hex() == "0500000000000000"
    assert codecs.two_bit(b"ACGTN").hex() == "011b00" + "0104" + "4e"
    assert codecs.run_lengths(b"AAAAxyBBB").hex() == "03" + "01024104" + "00027879" + "01024203"


@pytest.mark.parametrize("name", ["varint", "elias_gamma", "elias_omega", "golomb", "rice", "streamvbyte", "fibonacci", "exp_golomb", "byte_packed", "masked_vbyte", "group_varint", "bit_packing", "simple_8b"])
def test_negative_values_raise(name):
    with pytest.raises(ValueError):
        codecs.INTEGERS[name][0]([3, -1, 5])


@pytest.mark.parametrize(("name", "value"), [("fixed16", 1 << 16), ("streamvbyte", 1 << 32), ("group_varint", 1 << 32), ("bit_packing", 1 << 32), ("simple_8b", 1 << 60), ("fibonacci", 1 << 35), ("golomb", 1 << 40)])
def test_large_values_raise(name, value):
    with pytest.raises(Exception):  # noqa: B017
        codecs.INTEGERS[name][0]([value])


@pytest.mark.parametrize("string", list(codecs.STRINGS))
def test_strings(string):
    rng = random.Random(3)
    dna = "".join(rng.choice("ACGTNacgu*") for _ in range(3000))
    for values in ([], [""], ["", "ACGT" * 50, "x", "", "long " * 100], ["banana", "aaaa", "banana"], [dna, "*", dna[:7]]):
        for integer in NAMES:
            code = codecs.code_of(f"{integer}-{string}")
            try:
                data = codecs.encode_strings(values, code)
            except ValueError as e:
                assert code >> 8 == OMEGA and "elias_omega" in str(e)
                continue
            assert codecs.decode_strings(data, len(values), code) == values


def test_rotations_across_blocks():
    data = b"abracadabra" * 9000
    assert codecs.unbwt(codecs.bwt(data)) == data
    assert codecs.bwt(b"banana")[12:] == b"annb\0aa"


@pytest.mark.parametrize("decomposition", [codecs.CIGAR_PLAIN, codecs.CIGAR_SPLIT, codecs.CIGAR_STRING])
def test_cigars(decomposition):
    values = ["10M2I5D", "*", "3M", "1M1I1D1N1S1H1P1=1X"]
    for strings in ("none", "gzip", "zstd", "huffman"):
        code = codecs.cigar_code("varint", "bit_packing", strings, decomposition)
        assert codecs.decode_cigars(codecs.encode_cigars(values, code), len(values), code) == values
    with pytest.raises(ValueError):
        codecs.encode_cigars(["4M,3M"], codecs.cigar_code())


def test_names():
    assert codecs.code_of("varint-zstd") == 0x0101 and codecs.code_of("gzip") == 0x0102
    assert codecs.code_of("bit_packing+2-bit") == 0x0F05 and codecs.code_of("elias_gamma") == 0x0400
    assert codecs.describe(0x0F05) == "bit_packing-two_bit_dna" and codecs.describe(0xFF00) == "?-none"
    assert len(codecs.catalogue()) == 19 * 14
    for bad in ("nonsense", "gamma", "varint-nonsense"):
        with pytest.raises(ValueError):
            codecs.code_of(bad)
    assert [codecs.suggest_strings(x) for x in (b"", b"ACGTN" * 9, b"abab" * 90, bytes(range(65, 90)))] == ["none", "two_bit_dna", "bwt_huffman", "zstd_dict"]


def test_unary_parts_without_a_letter_a_bit():
    rng = random.Random(11)
    values = [rng.randrange(1 << 20) for _ in range(40)]
    low = lambda x, bits: f"{x % (1 << bits):0{bits}b}"
    for name, unary, stop, k in (("rice", "1", "0", 4), ("exp_golomb", "0", "1", None)):
        data = codecs.INTEGERS[name][0](values)
        head = 1 if name == "rice" else 5
        k = k or data[4]
        text = "".join([unary * (x >> k) + stop + low(x, k) for x in values])
        assert data[head:] == int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
        assert codecs.round_trip(values, name) == (len(data), True)
        with pytest.raises(ValueError):
            codecs.INTEGERS[name][1](data[: len(data) // 2], len(values))


def test_unary_parts_take_the_memory_of_their_bytes():
    encode, decode = codecs.INTEGERS["rice"]
    tracemalloc.start()
    data = encode([5_000_000] * 50)
    assert decode(data, 50) == ([5_000_000] * 50, len(data))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 1_900_000 and most < 4 * len(data)


def test_round_trips(spark):
    from pyspark.sql import functions as F

    lists = spark.range(0, 3000, 1, 1).select("id", F.array(F.lit(5_000_000) + F.col("id")).alias("v"))
    rows = lists.select(codecs.round_trips(F.col("v"), "rice", "varint").alias("t"))
    got = rows.agg(F.count("*"), F.bool_and(F.col("t")["rice"]["same"]), F.sum(F.col("t")["rice"]["size"]), F.sum(F.col("t")["varint"]["size"])).first()
    want = sum(1 + -(-(((5_000_000 + i) >> 4) + 5) // 8) for i in range(3000))
    assert tuple(got) == (3000, True, want, 12000)
    empty = spark.sql("select cast(null as array<bigint>) v union all select array()").select(codecs.round_trips(F.col("v"), "varint").alias("t")).collect()
    assert {tuple(r["t"]["varint"]) for r in empty} == {(None, None), (0, True)}


def test_golomb_divisor_is_one_byte():
    encode, decode = codecs.INTEGERS["golomb"]
    for values in ([120_000], [1_200_000, 5], [65_025, 0], [255, 256]):
        data = encode(values)
        assert decode(data + b"rest", len(values)) == (values, len(data))


@pytest.mark.parametrize("name", NAMES)
def test_values_in_digits(name):
    encode, decode = codecs.in_digits(name)
    for values in ([], [0, 7], [65_535, 65_536, 3], [(1 << 33) + 5, 0, (1 << 36) + 9]):
        if values and max(values) >> 32 and name in ("rice", "exp_golomb"):
            values = [x >> 16 for x in values]
        data = encode(values)
        assert decode(data + b"\0rest", len(values))[0] == values
        assert codecs.round_trip(values, name, digits=True)[1]


def test_parts_over_16_bits(spark, tmp_path):
    from graphloom.plans.queries import QUERIES

    spark.createDataFrame([(1, 120_000), (1, 65_536), (2, 7), (2, 1_199_999), (3, 65_535)], "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["integer_codecs_round_trip"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(name, 3, True) for name in codecs.INTEGER_CODES}
