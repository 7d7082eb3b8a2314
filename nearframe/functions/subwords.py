"""Subword tokens by the longest match in a given vocabulary.

A text is lower-cased and cut at white space; a word is cut, from its start, into the
longest pieces that the vocabulary has. Pieces inside a word carry a mark there
(``##``). A word that cannot be cut to its end is one unknown token. The vocabulary is a
trie in sorted arrays, and the distinct words of a batch walk it together, one code
point at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import BROADCAST_BYTES
from .text import pieces

_WORD = re.compile(r"[^ \t\n\x0B\f\r]+")
_POINTS = 0x110000


class Vocabulary:
    """Tokens by their place in a list, as a trie: edges (node, code point) sorted, and the token of each node."""

    def __init__(self, tokens: Sequence[str], unknown: str = "[UNK]", inside: str = "##"):
        number = {token: i for i, token in enumerate(tokens)}
        if len(number) < len(tokens):
            raise ValueError("a token stands twice in the vocabulary")
        if unknown not in number:
            raise ValueError(f"the vocabulary lacks {unknown!r}")
        self.unknown, self.size = number[unknown], len(tokens)
        # Node 0 begins a word, node 1 goes on in one.
        edges: dict[tuple[int, int], int] = {}
        accepted = {}
        for token, i in number.items():
            node, body = (1, token[len(inside):]) if inside and token.startswith(inside) and token != inside else (0, token)
            if i == self.unknown or not body:
                continue
            for point in map(ord, body):
                node = edges.setdefault((node, point), len(edges) + 2)
            accepted[node] = i
        keys = np.array([n * _POINTS + p for n, p in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.token = np.full(len(edges) + 2, -1, np.int32)
        self.token[list(accepted)] = list(accepted.values())
        if not inside:  # no marks: pieces are the same anywhere
            self.start = 0
        else:
            self.start = 1

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.child.nbytes + self.token.nbytes

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in a row, and how many each word has."""
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size) - size
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        found_word, found_token = [], []
        bad = np.zeros(len(words), bool)
        live, at = np.flatnonzero(size > 0), np.zeros(len(words), np.int64)
        while len(live):
            best, end = np.full(len(live), -1), at[live].copy()
            walk, place = np.arange(len(live)), at[live].copy()
            node = np.where(place == 0, 0, self.start)
            while len(walk):
                inside = place < size[live[walk]]
                walk, place, node = walk[inside], place[inside], node[inside]
                key = node * _POINTS + points[first[live[walk]] + place]
                edge = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                there = self.keys[edge] == key if len(self.keys) else np.zeros(len(key), bool)
                walk, place, node = walk[there], place[there] + 1, self.child[edge[there]]
                token = self.token[node]
                whole = token >= 0
                best[walk[whole]], end[walk[whole]] = token[whole], place[whole]
            bad[live[best < 0]] = True
            live, best, end = live[best >= 0], best[best >= 0], end[best >= 0]
            found_word.append(live)
            found_token.append(best)
            at[live] = end
            live = live[end < size[live]]
        word = np.concatenate([*found_word, np.flatnonzero(bad)])
        token = np.concatenate([*found_token, np.full(bad.sum(), self.unknown)]).astype(np.int32)
        # Words that failed lose what they had; tokens of one word were found in order.
        good = ~bad[word]
        good[len(word) - bad.sum():] = True
        order = np.argsort(word[good], kind="stable")
        return token[good][order], np.bincount(word[good], minlength=len(words))

    def ids(self, texts: pa.Array) -> pa.Array:
        """The tokens of every text; null stays null."""
        words = [_WORD.findall(t.lower()) if t is not None else [] for t in texts.to_pylist()]
        counts = np.array([len(w) for w in words], np.int64)
        coded = pa.array([w for own in words for w in own], pa.string()).dictionary_encode()
        tokens, sizes = self.cut(coded.dictionary.to_pylist())
        starts, which = np.cumsum(sizes) - sizes, np.asarray(coded.indices)
        per_word = sizes[which]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        flat = tokens[np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[which], per_word)]
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32()),
                                        mask=pa.array(~np.asarray(texts.is_valid())))


def read_vocabulary(path: str, unknown: str = "[UNK]", inside: str = "##") -> Vocabulary:
    """A vocabulary file with one token a line."""
    with open(path, encoding="utf-8") as lines:
        return Vocabulary([line.rstrip("\n") for line in lines], unknown, inside)


def subword_ids(spark: SparkSession, vocabulary: Vocabulary):
    """Column function from texts to arrays of token numbers."""
    if vocabulary.nbytes > BROADCAST_BYTES:
        raise ValueError("the vocabulary is too large to send to every task")
    shared = spark.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in pieces(batch):
                yield shared.value.ids(part)

    # Otherwise the optimizer copies the call into filters and texts are cut twice.
    return F.arrow_udf(cut, "array<int>").asNondeterministic()


def fitted(ids: Column, most: int, pad: int = 0, side: str = "right") -> Column:
    """(ids, mask) of exactly ``most`` tokens: cut off at one side, or padded; the mask is 1 for tokens of the text."""
    if side not in ("left", "right"):
        raise ValueError("side is 'left' or 'right'")
    kept = F.slice(ids, 1, most) if side == "right" else F.slice(ids, F.greatest(F.size(ids) - most + 1, F.lit(1)), F.lit(most))
    rest = F.lit(most) - F.size(kept)
    one, none = F.transform(kept, lambda x: F.lit(1)), F.array_repeat(F.lit(0), rest)
    return F.when(ids.isNotNull(), F.struct(F.concat(kept, F.array_repeat(F.lit(pad), rest)).alias("ids"),
                                            F.concat(one, none).alias("mask")))


def subword_counters(df: DataFrame, ids: str, *by: str) -> DataFrame:
    """Inputs and tokens per batch key, from a column of token numbers."""
    return df.groupBy(*by).agg(F.count(ids).alias("inputs"), F.coalesce(F.sum(F.when(F.col(ids).isNotNull(), F.size(ids))), F.lit(0)).alias("tokens"))
