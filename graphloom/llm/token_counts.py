"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link and the number of pieces that following it
completes (popped), so a word's greedy longest-match length comes from one pass over its
characters, and no piece is ever built. A word starts with the marker of word starts; pieces
without it continue a word. A word that greedy matching cannot cover counts as one unknown token.
Distinct words are counted once a task, in a bounded table.

Defined cases: null text is the empty text, which has no words and no tokens; words are maximal
runs of characters other than white space; repeated rows give one row each; an empty table gives
an empty table; columns other than the two named are ignored.
"""

from __future__ import annotations

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import map_batches, text_of

MARK = "▁"
TABLE_ROWS, TABLE_CHARS = 400_000, 64


def pieces_of(model_path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [p.id_to_piece(i) for i in range(len(p)) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


class Automaton:
    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = self.next[node][c]
            whole[node] = node > 0
        # -1: no piece ends on the way, so the word cannot be covered.
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        layer = [0]
        while layer:
            below = []
            for u in layer:
                for c, v in self.next[u].items():
                    below.append(v)
                    if whole[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n
            layer = below

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match, or -1 where it gets stuck."""
        nxt, fail, popped = self.next, self.fail, self.popped
        u = n = 0
        for c in word:
            while (v := nxt[u].get(c)) is None:
                if fail[u] < 0:
                    return -1
                n += popped[u]
                u = fail[u]
            u = v
        while u:
            if fail[u] < 0:
                return -1
            n += popped[u]
            u = fail[u]
        return n


class WordCounts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(MARK + word)
        if len(self) >= TABLE_ROWS:
            self.clear()
        if len(word) <= TABLE_CHARS:
            self[word] = n
        return n


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_tokens (an unknown word is one token) and n_unknown of each row's text."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in (id_col, "n_words", "n_tokens", "n_unknown")])

    def make():
        counts = WordCounts(Automaton(pieces_of(model_path)))

        def step(batch):
            out = {id_col: batch.column(0), "n_words": [], "n_tokens": [], "n_unknown": []}
            for text in batch.column(1).to_pylist():
                each = [counts[w] for w in text.split()]
                unknown = each.count(-1)
                out["n_words"].append(len(each))
                out["n_tokens"].append(sum(each) + 2 * unknown)
                out["n_unknown"].append(unknown)
            return out

        return step

    rows = df.select(df[id_col].cast("long").alias(id_col), text_of(df, text_col).alias("text"))
    return map_batches(rows, make, schema)
