"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of ``MATCH`` words of the benchmark's items. Documents and items are joined on
them: a fixed-size bit table of the seeds' hashes tells most documents that they hold none; the
seeds that the others may hold are joined with the items' seeds, and a pair whose shared seeds
cannot cover the threshold is let go. Every remaining pair is tiled: the longest matches between words
that no tile covers yet are marked, again and again, until none of ``MATCH`` words is left. Each
length is found by Karp-Rabin hashes of the runs that are still free, the words decide. An
item whose words are covered by the threshold or more leaks; tiles may stand in any order, so
reordered passages are found.

Only documents that hold a seed move, and only their seeds' hashes do before the tiling. Nothing of
the benchmark but the bit table (``BITS`` bits, whatever its size) is sent to all tasks.

Defined cases: null text is the empty text; words are runs of word characters in lower case; items
of fewer than ``MATCH`` words are matched as wholes; items without words and rows with a null
item_id are never found; repeated rows of either table give one result each; empty tables give
empty results; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import WORD, Rolling, WordHashes, cut, map_batches, quoted, unused

MATCH, COVERAGE = 5, 0.6
#: Bits of the table of seeds (8 MB); a seed sets two.
BITS = 1 << 26


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _free(taken: np.ndarray, size: int) -> np.ndarray:
    """Where runs of ``size`` words start that no tile covers."""
    sums = np.concatenate([[0], np.cumsum(taken)])
    return np.flatnonzero(sums[size:] == sums[:-size])


def tiling(item: np.ndarray, doc: np.ndarray, match: int, rolling: Rolling | None = None) -> list[tuple[int, int, int]]:
    """Tiles (start in the item, start in the document, words) of two arrays of word hashes: always the
    longest match of free words, of those the first in the item, then in the document.

    A common run of some length has common runs of all lengths below: the greatest is found by halving.
    Memory grows with the words of both, never with the pairs of equal runs."""
    rolling = rolling or Rolling()
    pre_i, pre_d = rolling.prefix(item), rolling.prefix(doc)
    taken_i, taken_d = np.zeros(len(item), bool), ~np.isin(doc, item)  # a foreign word is in no match
    tiles: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free starts in the item whose run is also free in the document; those in the document, by hash."""
        at_i, at_d = _free(taken_i, size), _free(taken_d, size)
        if not len(at_i) or not len(at_d):
            return at_i[:0], at_d[:0], np.empty(0, np.uint64)
        hash_i, hash_d = rolling.runs(pre_i, at_i, size), rolling.runs(pre_d, at_d, size)
        here = np.isin(hash_i, hash_d)
        return at_i[here], at_d, hash_d

    top = min(len(item), len(doc))
    while top >= match:
        low, high = match - 1, top
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < match:
            break
        at_i, at_d, hash_d = common(low)
        order = np.argsort(hash_d, kind="stable")
        at_d, hash_d = at_d[order], hash_d[order]
        hash_i = rolling.runs(pre_i, at_i, low)
        first = dict(zip(hash_i.tolist(), np.searchsorted(hash_d, hash_i).tolist(), strict=True))
        for i, h in zip(at_i.tolist(), hash_i.tolist(), strict=True):
            if taken_i[i : i + low].any():
                continue
            k = first[h]
            while k < len(hash_d) and hash_d[k] == h:
                d = int(at_d[k])
                if not taken_d[d : d + low].any():
                    if np.array_equal(item[i : i + low], doc[d : d + low]):
                        tiles.append((i, d, low))
                        taken_i[i : i + low] = taken_d[d : d + low] = True
                        break
                k += 1
            # What is taken stays taken: equal runs start their search here.
            first[h] = k
        top = low - 1
    return tiles


class Cutter:
    """Word hashes and hashes of runs, as tasks need them."""

    def __init__(self):
        self.hashes, self.rolling = WordHashes(), Rolling()

    def words(self, text: str) -> np.ndarray:
        return self.hashes.of(words_of(text))

    def seeds(self, words: np.ndarray, size: int) -> np.ndarray:
        return self.rolling.runs(self.rolling.prefix(words), np.arange(len(words) - size + 1), size) if len(words) >= size else words[:0]


def _items(benchmark: DataFrame, match: int, coverage: float) -> DataFrame:
    """(item, item_id, text, size, need, seeds): a number for each row, the least tile, how many seed places
    must be shared, and (hash, places) of its seeds."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).filter("item_id is not null and text is not null")
    seeds = T.ArrayType(T.StructType([T.StructField("seed", T.LongType()), T.StructField("places", T.LongType())]))
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("size", T.LongType()), T.StructField("need", T.LongType()), T.StructField("seeds", seeds)])

    def make():
        cutter = Cutter()

        def step(batch):
            out = {f.name: [] for f in schema}
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = cutter.words(text)
                if not len(words):
                    continue
                size = min(match, len(words))
                found, places = np.unique(cutter.seeds(words, size), return_counts=True)
                out["item_id"].append(item_id)
                out["text"].append(text)
                out["size"].append(size)
                # Tiles of t words hold t - size + 1 seeds, that is t / size of them or more.
                out["need"].append(max(1, math.ceil(coverage * len(words) / size - 1e-9)))
                out["seeds"].append([{"seed": s, "places": n} for s, n in zip(found.view(np.int64).tolist(), places.tolist(), strict=True)])
            return out

        return step

    return cut(map_batches(rows, make, schema).select(F.monotonically_increasing_id().alias("item"), "*"), "items")


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash."""
    return (h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(BITS - 1)).astype(np.int64)


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """Both bits of every seed, as bytes; at most ``BITS / 32`` rows reach the driver."""
    low, high = F.col("seed").bitwiseAND(BITS - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(BITS - 1)
    bits = seeds.select(F.explode(F.array(low, high)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("mask"))
    got = words.select(F.col("at").cast("int").alias("at"), "mask").toArrow()
    table = np.zeros(BITS // 32, "<u4")
    table[got["at"].to_numpy()] = got["mask"].to_numpy().astype(np.uint32)
    return table.view(np.uint8)


def _seeded(docs: DataFrame, seeds: DataFrame, sizes: list[int], text_col: str, name: str) -> DataFrame:
    """``docs`` with an array of the seeds that each text may hold."""
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(seeds))
    cutter: list[Cutter] = []

    def held(text: str) -> np.ndarray:
        if not cutter:
            cutter.append(Cutter())
        words, bits, out = cutter[0].words(text), table.value, []
        for size in sizes:
            h = cutter[0].seeds(words, size)
            for bit in (0, 1):
                at = _places(h)[bit]
                h = h[bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
            out.append(h)
        return np.unique(np.concatenate(out)).view(np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def seeds_of(texts: pd.Series) -> pd.Series:
        return pd.Series([held(t) for t in texts], dtype=object)

    return docs.withColumn(name, seeds_of(F.coalesce(quoted(text_col).cast("string"), F.lit(""))))


def _leaking(rows: DataFrame, items: DataFrame, key: str, text: str, held: str, match: int, coverage: float) -> DataFrame:
    """(row, item_id, coverage, n_tiles, longest) of the rows' leaking items; ``rows`` is a table with a number
    for each row (``key``) and the seeds that it may hold."""
    seeds = cut(items.select("item", "need", F.explode("seeds").alias("s")).select("item", "need", "s.*"), "seeds")
    pairs = rows.select(quoted(key).alias("row"), F.explode(quoted(held)).alias("seed")).join(seeds, "seed")
    pairs = pairs.groupBy("row", "item").agg(F.sum("places").alias("places"), F.first("need").alias("need")).filter("places >= need").select("row", "item")
    # An item's text travels once for each of its pairs, a document's once for all of its own.
    wanted = pairs.join(items.select("item", "item_id", F.col("text").alias("body")), "item").groupBy("row").agg(F.collect_list(F.struct("item_id", "body")).alias("items"))
    texts = rows.filter(F.size(quoted(held)) > 0).select(quoted(key).alias("row"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    hit = T.StructType([T.StructField("row", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType()), T.StructField("longest", T.LongType())])

    def make():
        cutter = Cutter()

        def step(batch):
            out = {f.name: [] for f in hit}
            for row, text_, wanted_ in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                doc = cutter.words(text_)
                for x in wanted_:
                    item = cutter.words(x["body"])
                    tiles = tiling(item, doc, min(match, len(item)), cutter.rolling)
                    covered = sum(n for _, _, n in tiles) / len(item)
                    if tiles and covered >= coverage:
                        out["row"].append(row)
                        out["item_id"].append(x["item_id"])
                        out["coverage"].append(covered)
                        out["n_tiles"].append(len(tiles))
                        out["longest"].append(max(n for _, _, n in tiles))
            return out

        return step

    return map_batches(texts.join(wanted, "row").select("row", "text", "items"), make, hit)


def _prepared(docs: DataFrame, benchmark: DataFrame, match: int, coverage: float, text_col: str, held: str) -> tuple[DataFrame, DataFrame]:
    items = _items(benchmark, match, coverage)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``match`` of them
    seeds = items.select(F.explode("seeds.seed").alias("seed"))
    if not sizes:
        return items, docs.withColumn(held, F.array().cast("array<bigint>"))
    return items, _seeded(docs, seeds, sizes, text_col, held)


def leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and leaking item: doc_id, item_id, coverage, n_tiles, longest."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    items, rows = _prepared(rows, benchmark, match, coverage, "text", "held")
    # Only the documents that may hold a seed are written.
    rows = cut(rows.filter(F.size("held") > 0).select(F.monotonically_increasing_id().alias("row"), "*"), "held")
    found = _leaking(rows, items, "row", "text", "held", match, coverage)
    return rows.select("row", "doc_id").join(found, "row").select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with their own columns; they are written once on the way."""
    row, held = unused(docs, "row", "held")
    items, rows = _prepared(docs, benchmark, match, coverage, text_col, held)
    rows = cut(rows.select(F.monotonically_increasing_id().alias(row), "*"), "held")
    found = _leaking(rows, items, row, text_col, held, match, coverage)
    gone = cut(found.select(F.col("row").alias(row)).distinct(), "leaking")
    columns = [quoted(c) for c in docs.columns]
    free = rows.filter(F.size(quoted(held)) == 0)
    return free.select(*columns).union(rows.filter(F.size(quoted(held)) > 0).join(gone, row, "left_anti").select(*columns))
