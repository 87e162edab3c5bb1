"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; the join finds the pairs with Jaccard similarity of 0.8 or
more. Texts with equal sets are one class, with a number of its own, by which all steps know it. In each run
the classes are split on a sampled token of their min-hash embedding (``COORDINATES`` tokens, shared
with the probability of the similarity). A bucket over ``BUCKET`` members or ``WEIGHT`` shingles is
cut into tiles, each pair of tiles a task, so nothing is dropped. One that needs over ``TILES`` of
them is split again first, down to ``DEPTH``, each member following ``FOLLOW`` sampled tokens; one
that no token splits (near copies of each other) is tiled where it is. Runs are repeated until they
reach the target recall for a pair whose buckets are split at every level, pairs that the filter
below lets go counted as missed.

Small buckets are brute-forced: first on the embeddings, where a pair belongs to the first bucket
that both are in, so that a member's shingles travel to the buckets only where it has a pair of
its own; then exactly, on the shingles. A task gives each member's number of links and the least
member that it hangs together with: rows grow with members, not with pairs. Groups are the
components over those rows, by alternating stars on tables in the shared folder.

Defined cases: words are white-space separated, in lower case; a text of one to four words is one
shingle; null and wordless texts have no shingles and no links, and each row is a group of its
own; rows with one id and equal sets count as one member; an id with several texts is as many
members as it has different sets, each linked by its own text; rows without id are left out of all
links; a class is named by the least id of its group and, among that id's texts in the group, by
the least version; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Rolling, WordHashes, cut, map_batches, mix

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
COORDINATES, BUCKET, WEIGHT, DEPTH = 48, 1024, 2_000_000, 6
#: Tiles of a bucket that is not split; tokens that a member follows at the first split and at later ones.
TILES, FOLLOW = 4, (3, 2)
NO_ID = -(1 << 63)
MULTIPLIERS = (np.random.default_rng(20_05).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def follow(level: int) -> int:
    return FOLLOW[min(level, len(FOLLOW) - 1)]


def _lost(agreeing: int, drawn: int, lost: float) -> float:
    """The probability that no drawn token keeps a pair, each of the agreeing ones losing it with ``lost``."""
    rest = COORDINATES - agreeing
    ways = sum(math.comb(agreeing, h) * math.comb(rest, drawn - h) * lost**h for h in range(drawn + 1))
    return ways / math.comb(COORDINATES, drawn)


def needed(similarity: float, recall: float) -> int:
    """The equal tokens that the filter asks for: it may let go a fifth of what the recall allows."""
    share, lost = (1 - recall) / 5, 0.0
    for agreeing in range(COORDINATES + 1):
        lost += math.comb(COORDINATES, agreeing) * similarity**agreeing * (1 - similarity) ** (COORDINATES - agreeing)
        if lost > share:
            return agreeing
    return COORDINATES


def missed(similarity: float, runs: int, depth: int, least: int = 0) -> float:
    """The probability that all runs miss a pair of the similarity, split at every level, or that the
    pair has fewer than ``least`` equal tokens."""
    out = 0.0
    for agreeing in range(COORDINATES + 1):
        lost = 0.0
        for level in reversed(range(depth)):
            lost = _lost(agreeing, follow(level), lost)
        share = math.comb(COORDINATES, agreeing) * similarity**agreeing * (1 - similarity) ** (COORDINATES - agreeing)
        out += share * (1.0 if agreeing < least else _lost(agreeing, runs, lost))
    return out


def runs_for(similarity: float, recall: float, depth: int = DEPTH) -> int:
    least = needed(similarity, recall)
    return next((r for r in range(1, COORDINATES) if missed(similarity, r, depth, least) <= 1 - recall), COORDINATES)


class Shingler:
    def __init__(self, k: int):
        self.k, self.hashes, self.rolling = k, WordHashes(), Rolling()

    def of(self, text: str) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        return np.unique(self.rolling.shingles(self.hashes.of(text.lower().split()), self.k))


def embed(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, ((shingles[at : at + 4096] * MULTIPLIERS[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32).view(np.int32)


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >= 1 << 63 else x


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body).alias("version"), body.alias("text"))


def embeddings(texts: DataFrame, k: int) -> DataFrame:
    """(doc, version, high, low, n, tokens): two hashes of the set, its size, its embedding."""
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc", "version", "high", "low", "n")), T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def make():
        shingler = Shingler(k)

        def step(batch):
            out = {f.name: [] for f in schema}
            out["doc"], out["version"] = batch.column(0), batch.column(1)
            for text in batch.column(2).to_pylist():
                s = shingler.of(text)
                out["n"].append(len(s))
                out["high"].append(_signed(mix(s).sum(dtype=np.uint64)) if len(s) else 0)
                out["low"].append(_signed(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) if len(s) else 0)
                out["tokens"].append(embed(s) if len(s) else [])
            return out

        return step

    return map_batches(texts, make, schema)


def buckets(classes: DataFrame, runs: int, limit: int = BUCKET, weight: int = WEIGHT, depth: int = DEPTH) -> DataFrame:
    """(bucket, tiles, id): the leaves, by class number, of the chosen paths that have two members or more."""
    roots = F.array(*[F.xxhash64(F.lit(r), F.element_at("tokens", r % COORDINATES + 1)) for r in range(runs)])
    nodes = classes.select("id", "n", F.explode(roots).alias("bucket"))
    leaves = None
    for level in range(depth + 1):
        sizes = nodes.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("load")).filter("members > 1")
        # Written first: the join then reads two plain exchanges, whose hot buckets adaptive plans split.
        sized = cut(nodes.join(cut(sizes, "sizes"), "bucket"), "nodes")
        sized = sized.withColumn("tiles", F.greatest(F.ceil(F.col("members") / limit), F.ceil(F.col("load") / weight)).cast("int"))
        large, last = F.col("tiles") > TILES, level == depth
        ready = sized.filter(~large | F.lit(last)).select("bucket", "tiles", "id")
        leaves = ready if leaves is None else leaves.unionByName(ready)
        if last or sized.filter(large).isEmpty():
            return leaves
        again = sized.filter(large).select("id", "bucket", "members").join(classes.select("id", "n", "tokens"), "id")
        # Tokens at a stride below half of all: up to three that differ.
        first, stride = F.pmod(F.xxhash64("bucket", F.lit(0)), F.lit(COORDINATES)), F.pmod(F.xxhash64("bucket", F.lit(1)), F.lit(COORDINATES // 2 - 1)) + 1
        pick = [F.pmod(first + j * stride, F.lit(COORDINATES)).cast("int") + 1 for j in range(follow(level))]
        children = F.array(*[F.xxhash64("bucket", p, F.element_at("tokens", p)) for p in pick])
        split = cut(again.select("id", "n", "bucket", "members", F.posexplode(children).alias("branch", "child")), "split")
        most = split.groupBy("bucket", "branch", "child").agg(F.count("*").alias("stay"), F.max("members").alias("members")).groupBy("bucket", "branch").agg(F.max(F.col("stay") / F.col("members")).alias("stay"))
        alike = F.broadcast(cut(most.groupBy("bucket").agg(F.min("stay").alias("stay")).filter("stay > 0.5").select("bucket"), "alike"))
        leaves = leaves.unionByName(sized.filter(large).join(alike, "bucket", "left_semi").select("bucket", "tiles", "id"))
        nodes = split.join(alike, "bucket", "left_anti").select("id", "n", F.col("child").alias("bucket"))
    return leaves


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of a sorted stream, by its first columns; one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = not held or any(held[-1].column(k)[-1].as_py() != cols[k][0].item() for k in range(keys))
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        if cuts[0] > 0:
            held.append(batch.slice(0, cuts[0]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)


def _owned(paths: list[list[int]], bucket: int) -> np.ndarray:
    """Which pairs belong to this bucket: those with no earlier bucket in common."""
    n = len(paths)
    own = np.ones((n, n), bool)
    where: dict[int, list[int]] = {}
    for i, path in enumerate(paths):
        for b in path:
            if b >= bucket:
                break
            where.setdefault(b, []).append(i)
    for members in where.values():
        if len(members) > 1:
            own[np.ix_(members, members)] = False
    return own


def _crossing(sides: np.ndarray, tile: int, tiles: int) -> np.ndarray | None:
    """The pairs of a tile: all of a diagonal one, those between the sides of another."""
    if tiles == 1 or tile // tiles == tile % tiles:
        return None
    return sides[:, None] != sides[None, :]


def _tiled(leaves: DataFrame) -> DataFrame:
    """Rows (bucket, tile, side, tiles, id): each member once for each pair of tiles it is in."""
    side = F.pmod(F.xxhash64("id", F.lit(11)), F.col("tiles")).cast("int")
    other = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = leaves.withColumn("side", side).withColumn("other", F.explode(other))
    tile = F.least("side", "other") * F.col("tiles") + F.greatest("side", "other")
    return rows.select("bucket", tile.alias("tile"), "side", "tiles", "id")


def candidates(classes: DataFrame, leaves: DataFrame, least: int) -> DataFrame:
    """(bucket, tile, side, tiles, id, paths): members with a likely pair of their own there."""
    paths = leaves.groupBy("id").agg(F.array_sort(F.collect_set("bucket")).alias("paths"))
    rows = _tiled(leaves).join(classes.select("id", "tokens").join(paths, "id"), "id")
    rows = rows.select("bucket", "tile", "side", "tiles", "id", "paths", "tokens").repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "id")
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("tile", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("tiles", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("paths", T.ArrayType(T.LongType()))])

    def run(batches):
        for group in _grouped(batches, 2):
            n = group.num_rows
            if n < 2:
                continue
            tokens = group.column("tokens").combine_chunks().flatten().to_numpy().reshape(n, -1)
            near = np.zeros((n, n), bool)
            for at in range(0, n, 64):
                same = np.zeros((min(64, n - at), n), np.int16)
                for c in range(tokens.shape[1]):
                    same += tokens[at : at + 64, c, None] == tokens[None, :, c]
                near[at : at + 64] = same >= least
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            first = group.slice(0, 1).to_pylist()[0]
            if (cross := _crossing(group.column("side").to_numpy(), first["tile"], first["tiles"])) is not None:
                near &= cross
            near &= _owned(group.column("paths").to_pylist(), first["bucket"])
            if (some := near.any(axis=1)).any():
                kept = group.select(schema.names).filter(pa.array(some)).combine_chunks()
                yield from kept.to_batches()

    return rows.mapInArrow(run, schema)


def verify(texts: DataFrame, classes: DataFrame, found: DataFrame, k: int, similarity: float) -> DataFrame:
    """(id, root, links): exact links of each member in a bucket, weighted by class sizes, and the
    least member it hangs together with there."""
    place = F.struct("bucket", "tile", "side", "tiles")
    wanted = found.groupBy("id", "paths").agg(F.collect_list(place).alias("places")).join(classes.select("id", "doc", "version", "copies"), "id")
    joined = texts.join(wanted.hint("shuffle_hash"), ["doc", "version"])
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("tile", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("tiles", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("paths", T.ArrayType(T.LongType())), T.StructField("shingles", T.BinaryType())])

    def make():
        shingler = Shingler(k)

        def step(batch):
            out = {f.name: [] for f in schema}
            for id_, text, copies, paths, places in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                data = shingler.of(text).tobytes()
                for p in places:
                    for c in ("bucket", "tile", "side", "tiles"):
                        out[c].append(p[c])
                    out["id"].append(id_)
                    out["copies"].append(copies)
                    out["paths"].append(paths)
                    out["shingles"].append(data)
            return out

        return step

    # Repeated rows of one document bring the same set: the group below reads the first of each class.
    rows = map_batches(joined.select("id", "text", "copies", "paths", "places"), make, schema).repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "id")
    result = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "root", "links")])

    def run(batches):
        for group in _grouped(batches, 2):
            ids = group.column("id").to_numpy()
            fresh = np.concatenate([[True], ids[1:] != ids[:-1]])
            if not fresh.all():
                group, ids = group.filter(pa.array(fresh)), ids[fresh]
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
            first = group.slice(0, 1).select(["bucket", "tile", "tiles"]).to_pylist()[0]
            linked = _similar(sets, similarity) & _owned(group.column("paths").to_pylist(), first["bucket"])
            if (cross := _crossing(group.column("side").to_numpy(), first["tile"], first["tiles"])) is not None:
                linked &= cross
            links = linked @ group.column("copies").to_numpy()
            roots = _least(linked, ids)
            some = linked.any(axis=1)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(roots[some]), pa.array(links[some].astype(np.int64))], names=["id", "root", "links"])

    return rows.mapInArrow(run, result)


def _similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each pair has the similarity, exactly; shared shingles are counted in blocks of columns."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        common[1] = common[0][::-1]
    else:
        owner = np.repeat(np.arange(n), sizes)
        values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(often > 1) - 1  # only shingles of two members or more count
        kept = often[column] > 1
        owner, column = owner[kept], rank[column[kept]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((n, n), np.float32)
        width = max(256, 16_000_000 // n)
        for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            block = np.zeros((n, min(width, int(rank[-1]) + 1 - at)), np.float32)
            block[owner[a:b], column[a:b] - at] = 1
            common += block @ block.T
        common = np.rint(common).astype(np.int64)
    # |a & b| / |a | b| >= s, in whole numbers for a similarity of thousandths
    s = round(similarity * 1000)
    out = common * (1000 + s) >= s * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(out, False)
    return out


def _least(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each member's component."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return low
        low = new


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the components of (id, root) edges: alternating large and small stars."""
    edges = cut(edges.filter("id <> root").select(F.greatest("id", "root").alias("id"), F.least("id", "root").alias("root")).distinct(), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("id"), F.col("id").alias("root")))
        # Written first, so that both sides of the joins are plain exchanges, in which hubs can be split.
        least = cut(both.groupBy("id").agg(F.min("root").alias("m")).select("id", F.least("id", "m").alias("m")), "least")
        large = both.join(least, "id").filter("root > id").select(F.col("root").alias("id"), F.col("m").alias("root"))
        large = cut(large.distinct(), "large")
        low = cut(large.groupBy("id").agg(F.min("root").alias("m")), "low")
        small = large.join(low, "id")
        edges = cut(small.select(F.when(F.col("root") == F.col("m"), F.col("id")).otherwise(F.col("root")).alias("id"), F.col("m").alias("root")).distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first())
        if now == before:
            return edges
        before = now


def _named(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, links, class_id, class_version) of the classes that have links to others."""
    groups = components(links.select("id", "root"))
    both = groups.unionByName(groups.select(F.col("root").alias("id"), "root").distinct())
    grouped = cut(both.join(classes.select("id", "doc", "version"), "id"), "grouped")
    first = cut(grouped.groupBy("root").agg(F.min(F.struct("doc", "version")).alias("first")), "first")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = grouped.select("id", "root").join(first, "root").select("id", F.col("first.doc").alias("class_id"), F.col("first.version").alias("class_version"))
    return counts.join(named, "id")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, limit: int = BUCKET, depth: int = DEPTH, weight: int = WEIGHT) -> DataFrame:
    """Per row: id, version (a hash of the text), class_id and class_version (id and text that stand for the
    group), n_links (other members with the similarity, copies included), n_copies (members with
    the same set, itself included) and n_shingles."""
    texts = _texts(df, id_col, text_col)
    rows = cut(embeddings(texts, k), "embedded")
    sets = rows.filter((F.col("n") > 0) & (F.col("doc") != NO_ID))
    one = F.min(F.struct("doc", "version", "n", "tokens")).alias("one")
    classes = sets.groupBy("high", "low").agg(one, F.countDistinct("doc").alias("copies"))
    # Numbers stay what they are once they are written.
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "high", "low", "copies", "one.*"), "classes")
    leaves = cut(buckets(classes, runs_for(similarity, recall, depth), limit, weight, depth), "leaves")
    found = cut(candidates(classes, leaves, needed(similarity, recall)), "candidates")
    links = cut(verify(texts, classes, found, k, similarity), "links")
    known = classes.select("high", "low", "copies", "id", "doc", F.col("version").alias("own")).join(_named(classes, links), "id", "left")
    known = known.select("high", "low", "copies", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("class_version", "own").alias("class_version"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    solo = (F.col("n") == 0) | (F.col("doc") == NO_ID)
    alone = rows.filter(solo).select("doc", "version", F.col("doc").alias("class_id"), F.col("version").alias("class_version"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.col("n").alias("n_shingles"))
    linked = rows.filter(~solo).join(known, ["high", "low"]).select("doc", "version", "class_id", "class_version", "n_links", F.col("copies").alias("n_copies"), F.col("n").alias("n_shingles"))
    out = linked.unionByName(alone)
    back = [F.expr(f"nullif({c}, {NO_ID}L)").alias(n) for c, n in (("doc", id_col), ("class_id", "class_id"))]
    return out.select(back[0], "version", back[1], "class_version", "n_links", "n_copies", "n_shingles")
