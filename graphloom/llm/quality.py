"""Quality classifier: hierarchical empirical Bayes.

Two document classifiers, fitted on a bounded sample of labelled rows (``SAMPLE`` of them at most in
expectation, chosen by a hash of the id), give each document log-likelihood ratios: one for
toxicity (presence of learned words), one for low quality (a logistic regression over the text's
style). Hosts and their sections (paths) get priors by grouped aggregation over all documents:
a path's rate is shrunk to its host's, a host's to the global rate, each with a strength that the
method of moments estimates from how far rates lie from their parents'. A document's own share is
taken out of all three sums first, so its evidence counts once. Its posterior combines its evidence
with its path's prior; it is rejected where either posterior is over one half.

Defined cases: null text is the empty text; null host or path is a group of its own; labels that
are null, or whose id meets no document, teach nothing; where labels of one id differ, the worse one
counts (toxic, or of low quality); without labels of both kinds a classifier gives no evidence and
rejects nothing; repeated rows are judged alike; an empty table gives an empty table; other columns
pass through untouched, whatever their names, but for columns named like the result's, which the
result's replace.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import WORD, cut, map_batches, quoted, unused, within

#: Labelled rows to learn from (they bound the lexicon too); groups that are broadcast.
SAMPLE, BROADCAST_ROWS = 20_000, 100_000
#: Least likelihood-ratio statistic of a word in the lexicon (one in a million words by chance).
SURPRISE = 25.0
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?-]")
KINDS = ("toxic", "low")
RESULTS = ("__p_toxic", "__p_low", "__keep")
EVIDENCE = T.StructType([T.StructField(k, T.DoubleType()) for k in KINDS])


def style(text: str) -> list[float]:
    words = text.split()
    n = len(words) or 1
    codes, counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
    chars = dict(zip(map(chr, codes.tolist()), counts.tolist(), strict=True))
    marks = [k for c, k in chars.items() if SYMBOLS.match(c)]
    lengths = (len(text) - sum(k for c, k in chars.items() if c.isspace())) / n
    return [
        1.0, math.log1p(len(words)), lengths / 10, min(3.0, sum(marks) / n), sum(map(str.isupper, words)) / n,
        len(set(words)) / n, sum(k for c, k in chars.items() if c.isdigit()) / (len(text) or 1), len(marks) / 10,
    ]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Classifier:
    """Log-likelihood ratios; base rates are the labelled sample's."""

    words: dict[str, float]
    toxic_start: float
    toxic_rate: float
    weights: np.ndarray | None
    scale: tuple[np.ndarray, np.ndarray] | None
    low_rate: float

    def evidence(self, text: str) -> tuple[float, float]:
        toxic = low = 0.0
        if self.words:
            toxic = self.toxic_start + sum(self.words[w] for w in self.words.keys() & set(words_of(text)))
        if self.weights is not None:
            x = (np.array(style(text)) - self.scale[0]) / self.scale[1]
            low = float(x @ self.weights) - logit(self.low_rate)
        return toxic, low


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic and low of the sampled labelled documents; the sample is small enough to broadcast."""
    rows = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("quality"), labels["toxic"].cast("int").alias("toxic")).filter("id is not null and (quality is not null or toxic is not null)")
    rows = rows.groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30))
    docs = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text")).filter("text is not null")
    return docs.join(F.broadcast(rows), "id").select("text", "toxic", (1 - F.col("quality")).alias("low"))


def _lexicon(rows: DataFrame, toxic: int, clean: int) -> dict[str, tuple[int, int]]:
    """Words that mark toxic documents, with how many toxic and clean documents have them; rows hold
    each distinct text once.

    Where documents first use a word it has to stand between many different words: one that only
    copies of a text share does not. Each word is held against this before any is chosen."""

    def counted():
        def step(batch):
            seen = Counter()
            for text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words_of(text)
                if not t:
                    seen.update((w, None) for w in set(ws))
                    continue
                first = {}
                for p, w, n in zip(["", *ws], ws, [*ws[1:], ""], strict=False):
                    if w not in first:
                        first[w] = f"{p} {n}"
                seen.update(first.items())
            return {"word": [w for w, _ in seen], "around": [p for _, p in seen], "n": list(seen.values())}

        return step

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("around", T.StringType()), T.StructField("n", T.LongType())])
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))

    def surprise(seen: Column, of: int) -> Column:
        expected = (a + b) * of / (toxic + clean)
        without = of - seen
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) + F.when(without > 0, without * F.log(without / (of - expected))).otherwise(0.0)

    # The likelihood-ratio statistic: unlike a z-score it ranks words that no clean document has first.
    g = 2 * (surprise(a, toxic) + surprise(b, clean))
    pairs = map_batches(rows.select("text", "toxic"), counted, schema).groupBy("word", "around").agg(F.sum("n").alias("n"))
    known = F.col("around").isNotNull()
    table = pairs.groupBy("word").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("a", known), ("b", ~known))], F.count("around").alias("kinds"))
    kept = table.filter((a >= 4) & (F.col("kinds") >= 0.5 * a)).withColumn("g", g).filter((F.col("g") > SURPRISE) & (odds > 2))
    return {r["word"]: (r["a"], r["b"]) for r in kept.orderBy(F.desc("g"), "word").collect()}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    rows = cut(_labelled(docs, labels, sample), "labelled")

    def styles():
        def step(batch):
            return {"x": [style(t) for t in batch.column(0).to_pylist()], "low": batch.column(1)}

        return step

    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("low", T.IntegerType())])
    seen = map_batches(rows.filter("low is not null").select("text", "low"), styles, schema).collect()
    y = np.array([r["low"] for r in seen], float)
    weights, scale, low_rate = None, None, 0.0
    if len(y) and 0 < y.sum() < len(y):
        x = np.array([r["x"] for r in seen])
        scale = (x.mean(0), np.maximum(x.std(0), 1e-6))
        scale[0][0], scale[1][0] = 0.0, 1.0
        weights, low_rate = _logistic((x - scale[0]) / scale[1], y), float(y.mean())
    # Words are counted once a distinct text, however many copies it has; the rate is that of all rows.
    texts = cut(rows.filter("toxic is not null").groupBy("text", "toxic").agg(F.count("*").alias("copies")), "texts")
    n = {r["toxic"]: (r["rows"], r["texts"]) for r in texts.groupBy("toxic").agg(F.sum("copies").alias("rows"), F.count("*").alias("texts")).collect()}
    total, (toxic_rows, toxic) = sum(r for r, _ in n.values()), n.get(1, (0, 0))
    clean = sum(t for _, t in n.values()) - toxic
    words, start = {}, 0.0
    if toxic and clean:
        for w, (a, b) in _lexicon(texts, toxic, clean).items():
            p, q = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1)
            absent = math.log((1 - p) / (1 - q))
            words[w] = math.log(p / q) - absent
            start += absent
    return Classifier(words, start, toxic_rows / max(1, total), weights, scale, low_rate)


def _evidence(classifier: Classifier, text: Column) -> Column:
    @F.pandas_udf(EVIDENCE)
    def evidence(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classifier.evidence(t) for t in texts], columns=list(KINDS))

    return evidence(F.coalesce(text.cast("string"), F.lit("")))


def _strength(groups: DataFrame, kind: str, parent: Column, parents: int) -> float:
    """How many documents the parent's rate counts for: method of moments over the groups' rates, each held
    against its own parent's; ``parents`` of them."""
    m, n = parent, F.col("n")
    v = m * (1 - m)
    r = groups.agg(F.count("*").alias("g"), F.sum(n * (F.col(f"s_{kind}") / n - m) ** 2).alias("s"), F.sum(v).alias("v"), F.sum(n * v).alias("nv")).first()
    if not r["g"] or r["g"] <= parents or not r["nv"]:
        return 10.0
    between = r["s"] - r["v"] * (r["g"] - parents) / r["g"]
    return float(min(1e4, max(5.0, r["nv"] / between - 1))) if between > 0 else 1e4


@dataclass
class Priors:
    """Sums over all documents, and per path (with its host's sums) as a table: host, path, n, s_toxic, s_low,
    hn, hs_toxic, hs_low. ``shrink`` has the strengths of the host's and of the global rate, by kind."""

    paths: DataFrame
    n: int
    sums: dict[str, float]
    rates: dict[str, float]
    shrink: dict[str, tuple[float, float]]

    def without(self, kind: str, chance: Column) -> Column:
        """The prior of a document in its path, from all others: ``chance`` is its own share of the sums."""
        path, host = self.shrink[kind]
        base = (self.sums[kind] - chance) / (self.n - 1) if self.n > 1 else F.lit(self.rates[kind])
        up = (F.col(f"hs_{kind}") - chance + host * base) / (F.col("hn") - 1 + host)
        return (F.col(f"s_{kind}") - chance + path * up) / (F.col("n") - 1 + path)


def chance(kind: str, evidence: Column, rate: float) -> Column:
    """A document's probability by its own evidence and the sample's rate."""
    return 1 / (1 + F.exp(-(evidence[kind] + logit(rate))))


def priors(scored: DataFrame, classifier: Classifier) -> Priors:
    """From (host, path, ev)."""
    rates = {"toxic": classifier.toxic_rate, "low": classifier.low_rate}
    shares = [F.sum(chance(k, F.col("ev"), rates[k])).alias(f"s_{k}") for k in KINDS]
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *shares), "paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{k}").alias(f"hs_{k}") for k in KINDS]), "hosts")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("hn").alias("n"), *[F.sum(f"hs_{k}").alias(k) for k in KINDS]).first()
    n = total["n"] or 0
    both = cut(paths.join(hosts, "host"), "both")
    shrink = {}
    for k in KINDS:
        base = F.lit((total[k] or 0.0) / max(1, n))
        host = _strength(hosts.select(F.col("hn").alias("n"), F.col(f"hs_{k}").alias(f"s_{k}")), k, base, 1)
        path = _strength(both, k, F.col(f"hs_{k}") / F.col("hn"), total["hosts"])
        shrink[k] = (path, host)
    return Priors(both, n, {k: total[k] or 0.0 for k in KINDS}, rates, shrink)


def _judged(docs: DataFrame, classifier: Classifier, host_col: str, path_col: str, columns: list[str], results: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with three more, named ``results``. The evidence is written with those columns, so
    each text is read by the classifiers once."""
    group = [F.coalesce(quoted(c).cast("string"), F.lit("\0")).alias(name) for c, name in ((host_col, "host"), (path_col, "path"))]
    # One struct for what passes through: its names cannot meet ours.
    rows = cut(docs.select(F.struct(*[quoted(c) for c in columns]).alias("whole"), *group, _evidence(classifier, quoted("text")).alias("ev")), "evidence")
    found = priors(rows.select("host", "path", "ev"), classifier)
    groups = found.paths
    rows = rows.join(F.broadcast(groups) if within(groups, BROADCAST_ROWS) else groups, ["host", "path"])
    known = {"toxic": bool(classifier.words), "low": classifier.weights is not None}

    def posterior(k: str) -> Column:
        if not known[k] or not found.rates[k]:
            return F.lit(0.0)
        prior = found.without(k, chance(k, F.col("ev"), found.rates[k]))
        prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prior))
        return 1 / (1 + F.exp(-(F.col("ev")[k] + F.log(prior / (1 - prior)))))

    p = {k: posterior(k) for k in KINDS}
    more = [p["toxic"], p["low"], (p["toxic"] <= 0.5) & (p["low"] <= 0.5)]
    return rows.select(*[F.col("whole")[c].alias(c) for c in columns], *[m.alias(r) for m, r in zip(more, results, strict=True)])


def score(docs: DataFrame, classifier: Classifier, host_col: str = "source", path_col: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all of them) with __p_toxic, __p_low and __keep."""
    columns = [c for c in (docs.columns if columns is None else columns) if c.lower() not in RESULTS]
    return _judged(docs, classifier, host_col, path_col, columns, list(RESULTS))


def keep(docs: DataFrame, classifier: Classifier, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    results = unused(docs, *RESULTS)
    judged = _judged(docs, classifier, host_col, path_col, docs.columns, results)
    return judged.filter(quoted(results[2])).select(*[quoted(c) for c in docs.columns])
