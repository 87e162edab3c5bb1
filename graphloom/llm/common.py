"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.tables import cut  # noqa: F401

WORD = re.compile(r"\w+")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, as close to ``names`` as those of ``df`` allow."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` for a function from a record batch to columns; ``make`` runs once a task."""
    target = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (cols := step(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in t.fields])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
        "double": pa.float64(), "boolean": pa.bool_(),
    }[t.simpleString()]


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most ``bound`` words."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.bound:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all runs of ``k`` consecutive word hashes, from prefix sums modulo 2**64."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1024)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, self.base, np.uint64))]).astype(np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, self.inverse, np.uint64))]).astype(np.uint64)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self._powers(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((prefix[start + length] - prefix[start]) * self.down[start] + np.uint64(1) * np.asarray(length, np.uint64))

    def shingles(self, h: np.ndarray, k: int) -> np.ndarray:
        """One hash for each run of k words; a shorter text is one run; no words, none."""
        if not len(h):
            return h
        k = min(k, len(h))
        return self.runs(self.prefix(h), np.arange(len(h) - k + 1), k)


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
