"""Secret scans over an incremental blob ledger; DataFrame functions only.

Every historical version of every path is addressed by the SHA-256 of its text. The ledger has one
row for each (blob, rule, rule version) that was ever scanned, with the spans found. A commit scans
only blobs with an unseen pair, once each however many paths hold them, runs the unseen rules only,
and appends what it found to the ledger; the findings of all paths are then joined from the
ledger. A commit's texts move once, by a hash of their path (those of blobs with an unseen pair meet
their blob there), so a text with very many copies is scanned once and weighs no task down.

Spans are in code points, end exclusive; per rule they are the leftmost non-overlapping matches,
without those whose secret is shorter than the rule's least length.

Defined cases: null text is the empty text; null paths and repeated rows give a row each, with the
findings of their text; an empty table gives an empty table; an absent or empty ledger means that
nothing was seen; an interrupted commit is repeated without harm, as rows of one pair are equal;
columns other than those named pass through only where a function says so, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, quoted, unused
from graphloom.plans.tables import noted, shared_dir


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: Patterns and least lengths of the three base kinds, in the order of the digests.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
SPANS = "array<struct<s:int,e:int>>"
NO_SPANS = f"cast(array() as {SPANS})"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text: what a split leaves between the matches gives their places."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.transform(matches, lambda m: F.struct(F.length(m).alias("n"), (F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least).alias("ok")))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    steps = F.zip_with(gaps, kept, lambda g, m: F.struct(g.alias("g"), m["n"].alias("n"), m["ok"].alias("ok")))
    start = F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.coalesce(x["n"], F.lit(0))
        found = F.when(F.coalesce(x["ok"], F.lit(False)), F.concat(acc["found"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["found"])
        return F.struct(e.alias("at"), found.alias("found"))

    some = F.aggregate(steps, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), some).otherwise(F.expr(NO_SPANS))


def address(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob, text) of every version."""
    body = F.coalesce(df[text].cast("string"), F.lit(""))
    return df.select(df[path].cast("string").alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text"))


@dataclass
class Ledger:
    """A folder of Parquet files that commits append to: blob, rule, version, spans."""

    spark: SparkSession
    path: str

    SCHEMA = f"blob string, rule string, version int, spans {SPANS}"

    @staticmethod
    def fresh(spark: SparkSession) -> Ledger:
        """An empty one in the shared folder."""
        return Ledger(spark, noted(f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"))

    def rows(self) -> DataFrame:
        """All rows so far; none where nothing was committed."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def commit(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scans the unseen pairs of ``versions`` (as ``address`` gives them) and appends their rows."""
        had = {r.name: f"had_{k}" for k, r in enumerate(rules)}
        seen = self.rows().groupBy("blob").agg(*[F.max((F.col("rule") == r.name) & (F.col("version") == r.version)).alias(had[r.name]) for r in rules])
        blobs = versions.groupBy("blob").agg(F.min(F.coalesce("path", F.lit(""))).alias("at")).join(seen, "blob", "left")
        blobs = blobs.select("blob", "at", *[F.coalesce(h, F.lit(False)).alias(h) for h in had.values()])
        todo = cut(blobs.filter(~reduce(lambda a, b: a & b, [F.col(h) for h in had.values()])), "unseen")
        bodies = versions.select(F.coalesce("path", F.lit("")).alias("at"), "blob", "text")
        found = bodies.join(todo.hint("shuffle_hash"), ["at", "blob"]).select("blob", *[F.when(~F.col(had[r.name]), spans(F.col("text"), r)).alias(r.name) for r in rules])
        # Repeated rows of one path scan the same text: one row a blob.
        found = found.groupBy("blob").agg(*[F.first(r.name).alias(r.name) for r in rules])
        each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.col(r.name).alias("spans")) for r in rules])
        rows = found.select("blob", F.explode(each).alias("x")).select("blob", "x.*").filter("spans is not null")
        rows.write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob and one span column per rule, of the blobs where a rule found something."""
        now = reduce(lambda a, b: a | b, [(F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules])
        some = self.rows().filter(now & (F.size("spans") > 0))
        each = [F.first(F.when(F.col("rule") == r.name, F.col("spans")), ignorenulls=True) for r in rules]
        return some.groupBy("blob").agg(*[F.coalesce(x, F.expr(NO_SPANS)).alias(r.name) for x, r in zip(each, rules, strict=True)])


def replay(df: DataFrame, path: str, text: str, rules: tuple[Rule, ...], ledger: Ledger | None, commits: int) -> tuple[DataFrame, DataFrame]:
    """(path, blob) of every version, and the findings of their blobs, after the rows were committed to the
    ledger, in ``commits`` parts by a hash of the path."""
    ledger = ledger or Ledger.fresh(df.sparkSession)
    versions = address(df, path, text)
    part = F.pmod(F.xxhash64(F.coalesce("path", F.lit(""))), F.lit(commits))
    for k in range(commits):
        ledger.commit(versions.filter(part == k) if commits > 1 else versions, rules)
    return cut(versions.select("path", "blob"), "addressed"), ledger.findings(rules)


def scan_paths(df: DataFrame, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None, commits: int = 1) -> DataFrame:
    """Every version's path and blob with one span column per rule."""
    addressed, some = replay(df, path, text, rules, ledger, commits)
    joined = addressed.join(some, "blob", "left")
    return joined.select("path", "blob", *[F.coalesce(r.name, F.expr(NO_SPANS)).alias(r.name) for r in rules])


def span_list(rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all rules' spans, by start, then in the rules' order, joined by commas."""

    def named(k: int, name: str) -> Column:
        return F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), F.concat_ws(":", F.lit(name), x["s"], x["e"]).alias("t")))

    each = [named(k, r.name) for k, r in enumerate(rules)]
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*each)), lambda x: x["t"]))


def digest(df: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None, commits: int = 1) -> DataFrame:
    """The op4 columns for (doc_id, text)."""
    found = scan_paths(df, "doc_id", "text", rules, ledger, commits)
    listed = span_list(rules)
    return found.select(F.col("path").cast("long").alias("doc_id"), *[F.size(r.name).cast("long").alias(f"n_{r.name}") for r in RULES], F.sha2(span_list(RULES).cast("binary"), 256).alias("base_sha256"), listed.alias("spans"), "blob")


def _cut_out(text: Column, found: Column, put: str = "[SECRET]") -> Column:
    """A text with each of the sorted spans replaced by ``put``; overlapping spans are one."""

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(put))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A text with every span of every rule replaced."""
    any_ = reduce(lambda a, b: a | b, [text.rlike(r.pattern) for r in rules])
    return F.when(any_, _cut_out(text, F.array_sort(F.concat(*[spans(text, r) for r in rules])))).otherwise(text)


def mask(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None, commits: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with secrets masked and n_chars, where there is such a column, counted anew.

    The spans come from the ledger; they meet each row again by id and blob, so texts move once more and
    are not scanned a second time."""
    addressed, findings = replay(docs, id_col, text_col, rules, ledger, commits)
    path, blob, found = unused(docs, "path", "blob", "found")
    places = F.array_sort(F.concat(*[F.col(r.name) for r in rules]))
    some = addressed.filter("path is not null").distinct().join(findings.select("blob", places.alias("found")), "blob")
    some = some.select(F.col("path").alias(path), F.col("blob").alias(blob), F.col("found").alias(found))
    body = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.withColumns({path: quoted(id_col).cast("string"), blob: F.sha2(body.cast("binary"), 256)})
    joined = rows.join(some.hint("shuffle_hash"), [path, blob], "left")
    own = quoted(text_col)
    text = F.when(F.col(path).isNull(), redacted(own, rules)).when(F.col(found).isNull(), own).otherwise(_cut_out(own, F.col(found)))
    masked = joined.select(*[text.alias(c) if c == text_col else quoted(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length(quoted(text_col)).cast(dict(docs.dtypes)["n_chars"]))
    return masked
