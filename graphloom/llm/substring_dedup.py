"""Substring dedup by seed and extend.

A window is ``LENGTH`` consecutive words. Winnowing gives each window one anchor: the leftmost
smallest hash among the runs of ``SEED`` words inside it, so equal windows have equal anchors at
equal places. Consecutive windows with one anchor form a segment: the anchor extended both ways
as far as its windows reach.

Documents are joined on anchors that two of them share. Where all of an anchor's segments are
equal, the match is extended as a whole; where they differ, one segment of each kind is extended
window by window on both sides. A window's words go where its word sequence starts in a document
with a smaller id too; the union of those windows is the maximal repeat. Anchors are hashes of
64 bits and extensions are compared by 64 further bits under the same anchor.

No pairs are made: per anchor, kind and window only the smallest id is kept, by partial
aggregation, so a passage that very many documents share costs what its copies measure. A
segment costs one row, a text moves twice by its own id.

Defined cases: words are runs of characters other than the six ASCII white space characters; null
text has none; documents under ``LENGTH`` words keep all; rows without id neither lose words nor
make others lose them; rows with one id are one document, each judged by its own text; an empty
table gives an empty table; columns other than the two named are ignored; windows of over
65,535 words, or seeds that are longer than a window, are an error.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Rolling, WordHashes, cut, map_batches, mix

LENGTH, SEED = 50, 16
#: Bits of an offset or a count of windows inside a segment, which are below the window's length.
BITS = 16
LOW = (1 << BITS) - 1
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NO_ID = -(1 << 63)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text)


class Segmenter:
    def __init__(self, length: int, seed: int):
        if not 1 <= seed <= length <= LOW:
            raise ValueError(f"a window has {seed} (the seed) to {LOW} words")
        self.length, self.seed = length, seed
        self.hashes, self.rolling = WordHashes(), Rolling()

    def of(self, words: list[str]):
        """Per segment: first window, number of windows, anchor's offset from the first window,
        anchor hash, segment hash; and the prefix sums to hash windows from. None for short texts."""
        if len(words) < self.length:
            return None
        h = self.hashes.of(words)
        prefix = self.rolling.prefix(h)
        grams = self.rolling.runs(prefix, np.arange(len(h) - self.seed + 1), self.seed)
        width = self.length - self.seed + 1
        at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(h) - self.length + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.concatenate([first, [len(at)]]))
        offset = at[first] - first
        whole = self.rolling.runs(prefix, first, count + self.length - 1)
        segment = mix(whole ^ mix((offset << BITS | count).astype(np.uint64)))
        return first, count, offset, grams[at[first]], segment, prefix


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def segments(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """(id, version, place, anchor, segment); place holds first window, offset and count."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "version", "place", "anchor", "segment")])

    def make():
        cutter = Segmenter(length, seed)

        def step(batch):
            out = {f.name: [] for f in schema}
            for id_, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = cutter.of(words_of(text))
                if found is None:
                    continue
                first, count, offset, anchor, segment, _ = found
                out["id"].append(np.full(len(first), id_, np.int64))
                out["version"].append(np.full(len(first), version, np.int64))
                out["place"].append((first << 2 * BITS | offset << BITS | count).astype(np.int64))
                out["anchor"].append(_long(anchor))
                out["segment"].append(_long(segment))
            return {k: np.concatenate(v) for k, v in out.items()} if out["id"] else None

        return step

    return map_batches(texts, make, schema)


def _windows(joined: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, window, id, version, start) of the windows of the segments in ``places``."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "window", "id", "version", "start")])

    def make():
        cutter = Segmenter(length, seed)

        def step(batch):
            out = {f.name: [] for f in schema}
            for id_, version, text, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                first, _, _, anchor, _, prefix = cutter.of(words_of(text))
                anchors = dict(zip(first.tolist(), anchor.tolist(), strict=True))
                for place in places:
                    at, offset, count = place >> 2 * BITS, place >> BITS & LOW, place & LOW
                    start = np.arange(at, at + count)
                    window = mix(cutter.rolling.runs(prefix, start, length) ^ mix((start - at - offset + (1 << BITS)).astype(np.uint64)))
                    out["anchor"].append(np.full(count, anchors[at], np.uint64).view(np.int64))
                    out["window"].append(_long(window))
                    out["id"].append(np.full(count, id_, np.int64))
                    out["version"].append(np.full(count, version, np.int64))
                    out["start"].append(start.astype(np.int64))
            return {k: np.concatenate(v) for k, v in out.items()} if out["id"] else None

        return step

    return map_batches(joined, make, schema)


def repeats(texts: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(id, version, runs): the windows to remove, as first << BITS | count, from (id, version, text)."""
    # Two branches read the segments: written once, each text is cut up once.
    found = cut(segments(texts.filter(F.col("id") != NO_ID), length, seed), "segments")
    anchors = found.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), (F.min("segment") != F.max("segment")).alias("differ"))
    # Written first: the join then reads two plain exchanges, whose hot keys adaptive plans split.
    anchors = cut(anchors.filter("least < most").select("anchor", "least", "differ"), "anchors")
    shared = cut(found.join(anchors, "anchor").filter("differ or id > least"), "shared")
    run = F.col("place").bitwiseAND(LOW) + F.shiftleft(F.shiftright("place", 2 * BITS), BITS)
    alike = shared.filter("not differ").select("id", "version", run.alias("run"))
    mixed = shared.filter("differ")
    kinds = cut(mixed.groupBy("anchor", "segment").agg(F.min("id").alias("own")), "kinds")
    mixed = cut(mixed.join(kinds, ["anchor", "segment"]), "mixed")
    later = mixed.filter("id > own").select("id", "version", run.alias("run"))
    places = mixed.filter("id = own").groupBy("id", "version").agg(F.collect_list("place").alias("places"))
    joined = texts.join(places.hint("shuffle_hash"), ["id", "version"], "left").filter("places is not null")
    windows = cut(_windows(joined.select("id", "version", "text", "places"), length, seed), "windows")
    least = windows.groupBy("anchor", "window").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("anchor", "window", "least")
    least = cut(least, "least")
    edges = windows.join(least, ["anchor", "window"]).filter("id > least").select("id", "version", (F.shiftleft("start", BITS) + 1).alias("run"))
    return alike.unionByName(later).unionByName(edges).groupBy("id", "version").agg(F.collect_list("run").alias("runs"))


def remove_repeats(df: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """n_words, n_removed and the digest of the kept words; with ``outputs`` the kept text itself."""
    Segmenter(length, seed)
    body = F.coalesce(df[text_col].cast("string"), F.lit(""))
    texts = df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(body).alias("version"), body.alias("text"))
    joined = texts.join(repeats(texts, length, seed).hint("shuffle_hash"), ["id", "version"], "left")
    fields = [T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if outputs:
        fields.append(T.StructField("kept", T.StringType()))

    def make():
        def step(batch):
            out = {f.name: [] for f in fields}
            for id_, text, runs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = words_of(text)
                n = len(words)
                if runs:
                    change = np.zeros(n + 1, np.int64)
                    r = np.array(runs, np.int64)
                    np.add.at(change, r >> BITS, 1)
                    np.add.at(change, (r >> BITS) + (r & LOW) + length - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = " ".join(words)
                out[id_col].append(None if id_ == NO_ID else id_)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                if outputs:
                    out["kept"].append(kept)
            return out

        return step

    return map_batches(joined.select("id", "text", "runs"), make, T.StructType(fields))
