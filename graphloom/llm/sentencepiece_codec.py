"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model holds a whitespace marker after another character, so no merge crosses the
place where a run of markers begins: each chunk (markers, then the characters up to the next
marker) is segmented by itself, once for all documents:

1. ``cut_up``: each task cuts its texts into chunks and gathers them in blocks. A block numbers its
   distinct chunks in the order of first sight and puts out its documents as packed positions (those
   numbers) and its distinct chunks as one packed row a bucket; buckets go by a hash of the chunk.
2. ``segment``: rows meet by bucket, so all occurrences of a chunk are in one task. The table there
   holds each chunk once; the library segments it once; each block gets the ids of its chunks back.
3. ``put_together``: rows meet by block; ids come back by number, documents by position.

Texts do not move: packed positions, distinct chunks and ids do. A frequent chunk is one entry a
block, so no key is hot; a block ends at ``BLOCK_CHUNKS`` distinct chunks or ``BLOCK_CHARS`` characters
(or the end of the text that passes them), a bucket stands for about ``BUCKET_BYTES`` of the input.
A block is named by a hash of what it holds, so chunks of one block never meet positions of another.
Where a lost task is run again, the input must give its rows in the same order, as files do; write
others first (``common.cut``).

Defined cases: null text is the empty text; the empty text has no ids and decodes to the empty
text; repeated rows and ties give one row each; an empty table gives an empty table; columns other
than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import text_of

MARK = "▁"
CHUNK = re.compile(" *[^ ]+| +")
BLOCK_CHUNKS, BLOCK_CHARS = 300_000, 32_000_000
#: Chunks in a row of positions (or one longer text), characters of a batch of results.
PACK, STRETCH = 2_000_000, 2_000_000
BUCKET_BYTES, MIN_BUCKETS, MAX_BUCKETS = 32 << 20, 32, 1 << 22
#: The kinds of rows between the steps; documents sort behind the chunks of their block.
CHUNKS, DOCUMENTS = 0, 1
#: Begins the key of a text of spaces only, which is one chunk; other chunks have no space behind another character.
BLANK = "= "

PACKED = T.StructType([T.StructField("key", T.LongType()), T.StructField("block", T.BinaryType()), T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in "abc")])


def separable(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece has a marker after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", processor.id_to_piece(i)) for i in range(len(processor)))


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without the one space that it begins with."""
    text = text.replace(MARK, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " " and text:
        return text.split(" ")
    if not text.strip(" "):
        return [BLANK + text]
    return [c[1:] for c in CHUNK.findall(" " + text)]


class Segmenter:
    """Ids of chunks, and what they decode to."""

    def __init__(self, model_path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if not separable(self.processor):
            raise ValueError("pieces of this model cross whitespace markers")
        # A marker that ends a text is a chunk by itself, which no text of its own encodes to.
        self.lone = self.processor.encode("a ")[len(self.processor.encode("a")) :]

    def ids(self, chunks: list[str]) -> list[list[int]]:
        # The library puts back the one leading space, its dummy prefix.
        found = self.processor.encode([c[len(BLANK) :] if c.startswith(BLANK) else c for c in chunks], num_threads=1) if chunks else []
        return [x if c else self.lone for c, x in zip(chunks, found, strict=True)]

    def forms(self, ids: list[list[int]]) -> list[tuple[int, str, str]]:
        """Number of ids, ids joined by commas, and decoded text led by its space, of each chunk."""
        decoded = self.processor.decode(ids, num_threads=1) if ids else []
        return [(len(x), ",".join(map(str, x)), " " + d) for x, d in zip(ids, decoded, strict=True)]


def joined(forms: Iterable[tuple[int, str, str]]) -> tuple[int, str, str]:
    """Number of ids, ids joined by commas and decoded form of a text, from those of its chunks."""
    n, ids, decoded = zip(*forms, strict=True)
    return sum(n), ",".join(ids if 0 not in n else filter(None, ids)), "".join(decoded)[1:]


class ChunkTable(dict):
    """chunk -> its forms, for texts of one process."""

    def __init__(self, model_path: str):
        super().__init__()
        self.segmenter = Segmenter(model_path)

    def encode_decode(self, text: str) -> tuple[int, str, str]:
        chunks = chunks_of(text)
        new = [c for c in dict.fromkeys(chunks) if c not in self]
        self.update(zip(new, self.segmenter.forms(self.segmenter.ids(new)), strict=True))
        return joined(map(self.__getitem__, chunks))


# ---- packed columns ---------------------------------------------------------------------------


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(raw)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack_numbers(a: np.ndarray) -> bytes:
    """32-bit numbers by byte planes."""
    return _pack(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_places(places: np.ndarray, seen: int) -> bytes:
    """Chunk numbers by first sight, ``seen`` of them before: 0 where a chunk is new, else its number and 1."""
    highest = np.maximum.accumulate(np.concatenate([[seen - 1], places.astype(np.int64)]))
    return pack_numbers(np.where(np.diff(highest) > 0, 0, places.astype(np.int64) + 1))


def unpack_places(packed: bytes, seen: int) -> np.ndarray:
    places = unpack_numbers(packed).astype(np.int64) - 1
    new = places < 0
    places[new] = seen + np.arange(np.count_nonzero(new))
    return places


def pack_strings(strings: list[str]) -> tuple[bytes, bytes]:
    lengths = np.fromiter(map(len, strings), np.uint32, len(strings))
    return pack_numbers(lengths), _pack("".join(strings).encode())


def unpack_strings(lengths: bytes, text: bytes) -> list[str]:
    ends, text = np.cumsum(unpack_numbers(lengths), dtype=np.int64).tolist(), _unpack(text).decode()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pack_ids(ids: list[int | None]) -> bytes:
    """Row ids, then a byte for each that says whether it is null."""
    return _pack(np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is None for i in ids))


def unpack_ids(packed: bytes) -> list[int | None]:
    raw = _unpack(packed)
    n = len(raw) // 9
    return [None if null else i for i, null in zip(np.frombuffer(raw, "<i8", n).tolist(), raw[8 * n :], strict=True)]


def _batches(rows: Iterator[tuple], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED`` in batches of about ``limit`` bytes."""
    types = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    part, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=PACKED.names)

    for row in rows:
        part.append(row)
        size += sum(map(len, row[3:])) + 64
        if size > limit:
            yield batch()
            part, size = [], 0
    if part:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows, one at a time as Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


# ---- the three steps --------------------------------------------------------------------------


class Numbers(dict):
    """chunk -> its number, in the order of first sight."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


class Block:
    """Documents on their way into packed rows."""

    def __init__(self):
        self.numbers, self.ids, self.places, self.chars = Numbers(), [], [], 0

    def add(self, row_id: int | None, text: str) -> None:
        chunks = chunks_of(text)
        self.ids.append(row_id)
        self.places.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.uint32, len(chunks)))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.numbers) >= BLOCK_CHUNKS or self.chars >= BLOCK_CHARS

    def rows(self, buckets: int) -> Iterator[tuple]:
        if not self.ids:
            return
        chunks, places = list(self.numbers), np.concatenate(self.places)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(c.encode()) for c in chunks), np.uint64, len(chunks))
        digest = xxhash.xxh3_128(hashes.tobytes())
        digest.update(places.tobytes())
        digest.update(repr(self.ids).encode())
        name = digest.digest()
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
        for numbers in np.split(by_bucket, starts[1:]):
            yield (int(bucket[numbers[0]]), name, CHUNKS, pack_numbers(np.diff(numbers, prepend=0)), *pack_strings([chunks[i] for i in numbers.tolist()]))
        lengths = np.fromiter(map(len, self.places), np.int64, len(self.places))
        ends, first, seen = np.cumsum(lengths), 0, 0
        while first < len(self.ids):
            begin = int(ends[first] - lengths[first])
            last = max(first + 1, int(np.searchsorted(ends, begin + PACK, "right")))
            part = places[begin : int(ends[last - 1])]
            key = int.from_bytes(name[:4], "little") + first
            yield key, name, DOCUMENTS, pack_ids(self.ids[first:last]), pack_numbers(np.concatenate([[seen], lengths[first:last]])), pack_places(part, seen)
            first, seen = last, max(seen, int(part.max()) + 1)


def cut_up(rows: DataFrame, buckets: int) -> DataFrame:
    """Documents (id, text) as packed positions, and the distinct chunks of each block by bucket."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block = Block()
        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(row_id, text)
                if block.full():
                    yield from block.rows(buckets)
                    block = Block()
        yield from block.rows(buckets)

    return rows.mapInArrow(lambda batches: _batches(blocks(batches)), PACKED)


def segment(packed: DataFrame, model_path: str) -> DataFrame:
    """Ids in the place of chunks, each distinct chunk of a bucket segmented once."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        segmenter = Segmenter(model_path)
        for (kind, _), rows in groupby(_rows(batches), lambda row: (row[2], row[0])):
            table: dict[str, bytes] = {}
            for row in rows:
                if kind == DOCUMENTS:
                    yield row
                    continue
                key, block, _, numbers, lengths, text = row
                chunks = unpack_strings(lengths, text)
                new = [c for c in chunks if c not in table]
                table.update(zip(new, (np.array(x, "<u4").tobytes() for x in segmenter.ids(new)), strict=True))
                ids = list(map(table.__getitem__, chunks))
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                yield key, block, CHUNKS, numbers, pack_numbers(counts), pack_numbers(np.frombuffer(b"".join(ids), "<u4"))

    by_bucket = packed.repartition("key").sortWithinPartitions("kind", "key")
    return by_bucket.mapInArrow(lambda batches: _batches(tables(batches)), PACKED)


def put_together(packed: DataFrame, model_path: str, schema: T.StructType, outputs: bool) -> DataFrame:
    """The documents, from positions and from the ids of their block's chunks."""
    id_col = schema.names[0]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        segmenter = Segmenter(model_path)
        for _, rows in groupby(_rows(batches), lambda row: row[1]):
            forms: dict[int, tuple[int, str, str]] = {}
            for _, _, kind, a, b, c in rows:
                if kind == CHUNKS:
                    ends, ids = np.cumsum(unpack_numbers(b), dtype=np.int64).tolist(), unpack_numbers(c).tolist()
                    numbers = np.cumsum(unpack_numbers(a), dtype=np.int64).tolist()
                    forms.update(zip(numbers, segmenter.forms([ids[s:e] for s, e in zip([0, *ends], ends, strict=False)]), strict=True))
                    continue
                ids, (seen, *lengths) = unpack_ids(a), unpack_numbers(b).tolist()
                ends, places = np.cumsum(lengths, dtype=np.int64).tolist(), unpack_places(c, seen)
                if len(forms) <= places.max():
                    raise RuntimeError("a block lacks chunks: its input was read again in another order")
                for row_id, s, e in zip(ids, [0, *ends], ends, strict=False):
                    yield row_id, *joined(map(forms.__getitem__, places[s:e].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        out, size = {name: [] for name in schema.names}, 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

        for row_id, n, ids, decoded in texts(batches):
            out[id_col].append(row_id)
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if outputs:
                out["ids"].append([int(x) for x in ids.split(",")] if ids else [])
                out["decoded"].append(decoded)
            size += len(decoded) + 100
            if size > STRETCH:
                yield batch()
                out, size = {name: [] for name in schema.names}, 0
        if size:
            yield batch()

    return packed.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def buckets_for(df: DataFrame) -> int:
    """Buckets for the size that the plan's statistics give (files: their bytes; unknown: the most)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(size // BUCKET_BYTES, MIN_BUCKETS), MAX_BUCKETS)


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """ids and decoded text of each row, with the digests; ``outputs=False`` leaves out the ids and the text."""
    fields = [T.StructField(id_col, T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if outputs:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]
    rows = df.select(df[id_col].cast("long").alias(id_col), text_of(df, text_col).alias("text"))
    packed = segment(cut_up(rows, buckets_for(df)), model_path)
    return put_together(packed, model_path, T.StructType(fields), outputs)
