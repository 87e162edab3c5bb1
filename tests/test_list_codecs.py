"""Superstrings, CIGAR lists, the order-k model and trained dictionaries: round trips, layouts, what raises."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions import list_codecs as lc

INNER = ["none", "huffman", "two_bit_dna", "ppm", "zstd"]


def test_superstring_overlaps():
    text, places = lc.superstring([b"ACGTA", b"GTACC", b"CCTT", b"GTA", b"", b"ACGTA"])
    assert text == b"ACGTACCTT"
    assert places == {b"": 0, b"ACGTA": 0, b"GTACC": 2, b"CCTT": 5, b"GTA": 2}


def test_superstring_rings_and_ties():
    # a ring of overlaps is cut once
    text, places = lc.superstring([b"abc", b"bca", b"cab"])
    assert len(text) == 5
    assert all(text[places[s] : places[s] + 3] == s for s in (b"abc", b"bca", b"cab"))
    assert lc.superstring([]) == (b"", {b"": 0})
    assert lc.superstring([b"", b""])[0] == b""


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ACG", max_size=12), max_size=20), st.sampled_from(INNER))
def test_superstring_round_trip(values, inner):
    data = lc.encode_superstring(values, inner)
    assert lc.decode_superstring(data, len(values), inner) == values


def test_superstring_long():
    rng = random.Random(3)
    whole = "".join(rng.choice("ACGT") for _ in range(20_000))
    values = [whole[i : i + 1000] for i in range(0, 19_001, 500)]
    text, _ = lc.superstring([v.encode() for v in values])
    assert text.decode() == whole
    data = lc.encode_superstring(values, "two_bit_dna")
    assert len(data) < 20_000 // 4 + 6 * len(values)


def test_superstring_short_data():
    data = lc.encode_superstring(["ACGT", "GTTT"])
    with pytest.raises(ValueError):
        lc.decode_superstring(data[:-2], 2)


def test_cigar_list():
    values = ["*", "", "10M2I5D", "3M", "1M1I" * 300, "1M" * 255, "5=6X7H8S9N1P0D"]
    data = lc.encode_cigar_list(values)
    assert lc.decode_cigar_list(data, len(values)) == values
    assert lc.encode_cigar_list(["*", "", "10M2I5D"]).hex() == "010007" + "ff" + "00" + "03" + "012f" + "0a0205"
    assert lc.encode_cigar_list([]) == b"" and lc.decode_cigar_list(b"", 0) == []
    for bad in ("05M", "M", "3Q", "3M,4M", "x"):
        with pytest.raises(ValueError):
            lc.encode_cigar_list([bad])


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300) | st.text("ab", max_size=600).map(str.encode), st.integers(0, 5))
def test_model_round_trip(data, order):
    assert lc.unmodel(lc.model(data, order)) == data


def test_model_size():
    rng = random.Random(5)
    bases = "".join(rng.choice("ACGT") for _ in range(4000)).encode()
    assert len(lc.model(bases, 1)) < 1100  # two bits a base
    assert len(lc.model(b"ACGGT" * 4000)) < 200
    # counts are halved on the way
    assert lc.unmodel(lc.model(b"ACGGT" * 4000)) == b"ACGGT" * 4000
    with pytest.raises(ValueError):
        lc.unmodel(lc.model(bases)[:100])


def test_trained_dictionary():
    rng = random.Random(1)
    samples = [f"chr{rng.randrange(20)}\tgene_{rng.randrange(999)}\texon\t{rng.randrange(10**6)}".encode() for _ in range(3000)]
    d = lc.train(samples, 4096)
    assert len(d) <= 4096
    put, get = lc.with_dictionary(d)
    assert all(get(put(s)) == s for s in samples[:50]) and get(put(b"")) == b""
    plain = lc.zstandard.ZstdCompressor(level=3)
    assert sum(len(put(s)) for s in samples) < sum(len(plain.compress(s)) for s in samples)
    for few in ([], [b"a"]):
        with pytest.raises(ValueError):
            lc.train(few)


def test_columns(spark):
    rows = [(1, ["ACGT", "GTAA", ""]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "i int, v array<string>")
    for name in ("superstring_none", "superstring_huffman", "superstring_two_bit_dna", "superstring_ppm", "model"):
        got = df.select("i", lc.decoded_list(lc.encoded_list("v", name), lc.F.coalesce(lc.F.size("v"), lc.F.lit(0)), name).alias("b")).orderBy("i").collect()
        assert [r.b for r in got] == [v for _, v in rows]
    for name in ("superstring", "superstring_none2", "x"):
        with pytest.raises(ValueError):
            lc.encoded_list("v", name)
