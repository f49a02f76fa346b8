"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a batch are sorted, which makes them a trie: a node is a run of neighbours that share a
prefix. Depth by depth the forward step of `pieces` is taken once for each node (scores for unigram models; for BPE
models, where sums of scores give other counts than the tokenizer has, the last stable piece), with the number of tokens
so far, and the count at a word's end is stored for it. Pre-tokens of over LONG characters (see `pieces`), which share
little, are counted by themselves. A text's count is the sum over its pre-tokens. No text is
shuffled: each task keeps the counts of the pre-tokens that it has seen, up to a number of them.

Defined cases: a null text has a null count and an empty one 0; texts are counted whole; repeated rows get equal rows; an
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks
from .pieces import BPE, LONG, SPACE, Forward, Model, code_points, prefix_hashes, pretokens, utf8_lengths
from .sentencepiece import encode_words, load_model

CELLS = 1 << 20
KEPT_WORDS = 1_000_000
KEPT_CHARS = 16_000_000
WIDE = 64


def trie_counts(words: list[str], forward: Forward) -> np.ndarray:
    """Tokens of each of the sorted, distinct words."""
    m = forward.m
    points, lengths = code_points(words)
    n, wide = points.shape
    hashes = prefix_hashes(points)
    same = points[1:] == points[:-1]
    shared = np.concatenate([[0], np.where(same.all(1), wide, same.argmin(1))])
    tokens, score, last = np.zeros((n, wide + 1), np.int32, "F"), np.zeros((n, wide + 1), np.float32, "F"), np.full((n, wide + 1), -2, np.int32, "F")
    for d in range(1, wide + 1):
        long_enough = lengths >= d
        head = long_enough & (shared < d)
        nodes = np.flatnonzero(head)
        best, piece, length = forward.step(points, hashes, nodes, d, score, last)
        # Without byte pieces a run of unknown characters is one token.
        lone = utf8_lengths(points[nodes, d - 1]) if m.byte_fallback else (last[nodes, d - 1] != -2) | (d == 1)
        used = tokens[nodes, d - length] + np.where(piece == -2, lone, 1)
        of = np.cumsum(head)[long_enough] - 1
        tokens[long_enough, d], score[long_enough, d], last[long_enough, d] = used[of], best[of], piece[of]
    return tokens[np.arange(n), lengths]


class Counter:
    def __init__(self, model: Model) -> None:
        self.forward = Forward(model)
        self.known: dict[str, int] = {}
        self.chars = 0

    def learn(self, words: set[str]) -> None:
        runs = [w for w in words if len(w) > LONG or self.forward.m.kind == BPE and w.startswith(SPACE * 2)]
        if runs:
            self.known.update(zip(runs, encode_words(runs, self.forward)[1].tolist()))
        rest = sorted(words.difference(runs)) if runs else sorted(words)
        wide = np.fromiter(map(len, rest), np.int64, len(rest))
        # Long words apart, so that they don't widen the tables of the others; sorted words share prefixes with neighbours.
        for size in np.unique(np.maximum(np.ceil(np.log2(np.maximum(wide, 1))), np.log2(WIDE))):
            group = rest if (wide <= WIDE).all() else [rest[i] for i in np.flatnonzero(np.maximum(np.ceil(np.log2(np.maximum(wide, 1))), np.log2(WIDE)) == size)]
            step = max(1, 2 * CELLS // int(2 ** min(size, 60) if size > np.log2(WIDE) else 40))
            for s in range(0, len(group), step):
                part = group[s : s + step]
                self.known.update(zip(part, trie_counts(part, self.forward).tolist()))

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.known, self.chars = {}, 0
        lists = [pretokens(t, self.forward.m.prefix) for t in texts]
        new = set().union(*lists).difference(self.known)
        if new:
            self.learn(new)
            self.chars += sum(map(len, new))
        known = self.known.__getitem__
        return np.array([sum(map(known, ws)) for ws in lists], np.int64)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            text = b.column("text")
            parts = [counter(part.to_pylist()) for _, part in chunks(text, 1 << 22)]
            counts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, mask=text.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint")
