"""Language ID by hierarchical discrimination.

A text's letters become hashed counts of character 1- to 3-grams. One-versus-one linear support
vector machines pick the language family, then others, trained within that family only, separate
its languages. The models learn from a bounded sample: about ``per_lang`` labelled texts of each
language, chosen by a hash of the id (all of them where there are fewer). Each pair's machine is
trained by a task of its own, from the sampled texts of its two classes; only weights reach the driver.

Defined cases: null texts and texts without a letter (a character of the Unicode categories L) are
``und`` with score 0, and so is every text where nothing could be learned; a language whose family is not listed is a family of its
own; rows without id count as not held out; repeated rows give one row each; an empty table
gives an empty table; columns other than the three named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cut, map_batches, mix

#: Languages by family; a parameter of ``fit``.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"), "romance": ("fr", "es", "it", "pt", "ro", "ca")}
PER_LANG, DIMS, ROUNDS, COST = 800, 2048, 300, 20.0
#: Least change of a weight in a round that training goes on for.
STILL = 1e-5


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def features(text: str, dims: int = DIMS) -> np.ndarray | None:
    """Unit vector of damped n-gram counts over the whole text, in lower case; what stands between letters
    counts as one space. None without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[c]
    if not letter.any():
        return None
    c = np.concatenate([[32], np.where(letter, c, 32), [32]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    two = c[:-1] * np.uint64(0x1F1F1F1F1) + c[1:]
    three = two[:-1] * np.uint64(0x1000193) + c[2:] + np.uint64(1 << 50)
    grams = np.concatenate([c[1:-1] + np.uint64(1 << 60), two, three])
    counts = np.bincount((mix(grams) % np.uint64(dims)).astype(np.int64), minlength=dims)
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last one the bias) that minimise ridge plus mean squared hinge loss, by
    accelerated gradient steps until they stand still; classes weigh the same whatever their sizes."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * 10
    step = 1 / (1 + 2 * weight.sum() * 2)
    x, y, weight = x.astype(np.float32), y.astype(np.float32), weight.astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - np.float32(step) * (v - 2 * (weight * slack * y) @ x)
        change = np.abs(new - w).max()
        w, v = new, new + np.float32(t / (t + 3)) * (new - w)
        if change < STILL:
            break
    return w.astype(float)


@dataclass
class Model:
    """Classes are families, then the languages of each; a pair's weights favour its first class."""

    families: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def _vote(self, names: list[str], x: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        margin = dict.fromkeys(names, np.inf)
        votes = dict.fromkeys(names, 0)
        for a, b in combinations(names, 2):
            w = self.pairs[a, b]
            m = float(x @ w[:-1] + w[-1])
            votes[a if m >= 0 else b] += 1
            margin[a], margin[b] = min(margin[a], m), min(margin[b], -m)
        best = max(names, key=lambda n: (votes[n], margin[n], n))
        return best, 1 / (1 + float(np.exp(-np.clip(3 * margin[best], -50, 50))))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if text and self.families else None
        if x is None:
            return "und", 0.0
        family, p = self._vote(sorted(self.families), x)
        lang, q = self._vote(self.families[family], x)
        return lang, p * q


def tree_of(langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> dict[str, list[str]]:
    """family -> its languages, of those that were seen."""
    known = {lang: "family:" + name for name, members in families.items() for lang in members}
    tree: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        tree.setdefault(known.get(lang, "family:only-" + lang), []).append(lang)
    return tree


def pairs_of(tree: dict[str, list[str]]) -> dict[str, list[tuple[str, str, bool]]]:
    """Of each language, the machines (first class, second class) that learn from its texts, and whether
    they are of the first."""
    out: dict[str, list[tuple[str, str, bool]]] = {}
    for family, members in tree.items():
        for lang in members:
            for own, names in ((family, sorted(tree)), (lang, members)):
                for other in names:
                    if other != own:
                        a, b = sorted((own, other))
                        out.setdefault(lang, []).append((a, b, own == a))
    return out


def train(rows: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """The model of (lang, x) rows, x the bytes of a feature vector."""
    tree = tree_of([r["lang"] for r in rows.select("lang").distinct().collect()], families)
    pairs = [(lang, a, b, first) for lang, of in pairs_of(tree).items() for a, b, first in of]
    if not pairs:
        return Model(tree, {})
    plan = F.broadcast(rows.sparkSession.createDataFrame(pairs, "lang string, a string, b string, first boolean"))

    def fit_pair(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # One order, whatever the partitions: sums of floats depend on it.
        pdf = pdf.sort_values(["first", "x"])
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf.x])
        w = linear_svm(x, np.where(pdf["first"], 1.0, -1.0))
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "w": [w.tolist()]})

    fitted = rows.join(plan, "lang").groupBy("a", "b").applyInPandas(fit_pair, "a string, b string, w array<double>")
    return Model(tree, {(r["a"], r["b"]): np.array(r["w"]) for r in fitted.collect()})


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(df: DataFrame, per_lang: int = PER_LANG, families: dict[str, tuple[str, ...]] = FAMILIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on rows that are not held out and have a language and a letter."""
    rows = df.select(df[id_col].cast("string").alias("id"), df[lang_col].cast("string").alias("lang"), df[text_col].cast("string").alias("text"), held_out(df[id_col].cast("long")).alias("out"))
    rows = rows.filter(~F.col("out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, per_lang / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model({}, {})
    rate = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang"))
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30)).select("lang", "text")

    def make():
        def step(batch):
            out = {"lang": [], "x": []}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := features(text)) is not None:
                    out["lang"].append(lang)
                    out["x"].append(x.tobytes())
            return out

        return step

    found = map_batches(chosen, make, T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())]))
    return train(cut(found, "features"), families)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of each row."""
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        def step(batch):
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            return {id_col: batch.column(0), "held_out": batch.column(1), "lang_pred": [a for a, _ in found], "score": [b for _, b in found]}

        return step

    rows = df.select(df[id_col].cast("long").alias(id_col), held_out(df[id_col].cast("long")).alias("held_out"), df[text_col].cast("string").alias("text"))
    return map_batches(rows, make, schema)
