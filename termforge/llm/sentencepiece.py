"""SentencePiece encoding and decoding by a batched numpy Viterbi pass.

Distinct pre-tokens of equal length (beyond SHORT characters: of about equal length) advance together, a character at a
time; those of over LONG characters by overlapping windows. Prefix hashes give the hash of every
substring that ends there; these probe the sorted hashes of the pieces, and the best of the candidates (vectorised
maxima) and its length are stored as backpointers. See `pieces` for what is maximised in unigram and in BPE models: the
ids are the sentencepiece library's own for the model file. Characters without a piece become byte pieces, or, where the
model has none, a run of them one unknown id.

Defined cases: a null text has null ids and a null decoded text; an empty one has no ids; texts are encoded whole, however
long; repeated rows get equal rows; an empty table gives an empty result. Only the id and text columns are read.
Decoding leaves control pieces out, drops the dummy space in front, and replaces what is no UTF-8 with U+FFFD; a null
among the ids is left out, and an id outside the model raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import chunks, list_array, ragged
from .pieces import BPE, BYTE, CONTROL, LONG, SPACE, Forward, Model, code_points, pretokens, utf8_lengths

CELLS = 1 << 20
SHORT = 32
KEPT_WORDS = 400_000
KEPT_IDS = 4_000_000


def utf8_bytes(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes of code points, end to end."""
    at = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    out[at] = np.select([lengths == 1, lengths == 2, lengths == 3], [points, 0xC0 | points >> 6, 0xE0 | points >> 12], 0xF0 | points >> 18)
    for k in range(1, 4):
        more = lengths > k
        out[at[more] + k] = 0x80 | (points[more] >> (6 * (lengths[more] - 1 - k)).astype(np.uint32)) & 0x3F
    return out


def encode_words(words: list[str], forward: Forward) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, number of ids of each word)."""
    m = forward.m
    if m.kind == BPE and any(w.startswith(SPACE * 2) for w in words):
        return _encode_runs(words, forward)
    all_lengths = np.array([len(w) for w in words], np.int64)
    counts = np.zeros(len(words), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Short words with those of their length, others with those of about it, long ones each by itself.
    group = np.where(all_lengths <= SHORT, all_lengths, 1 << np.ceil(np.log2(np.maximum(all_lengths, 1))).astype(np.int64))
    group = np.where((group > SHORT) & (all_lengths <= group * 3 // 4), group * 3 // 4, group)
    for length in np.unique(group[(all_lengths > 0) & (all_lengths <= LONG)]):
        same = np.flatnonzero((group == length) & (all_lengths <= LONG))
        step = max(1, CELLS // (int(length) + 1))
        for s in range(0, len(same), step):
            rows = same[s : s + step]
            points, _ = code_points([words[i] for i in rows])
            _, last, back = forward.run(points)
            at, taken, row, piece, char = all_lengths[rows].copy(), [], [], [], []
            open_ = np.arange(len(rows))
            while len(open_):
                row.append(open_)
                piece.append(last[open_, at[open_]])
                char.append(points[open_, at[open_] - 1])
                at[open_] -= back[open_, at[open_]]
                open_ = open_[at[open_] > 0]
            row, piece, char = (np.concatenate(x)[::-1] for x in (row, piece, char))
            order = np.argsort(row, kind="stable")
            n_ids, ids = _ids(row[order], piece[order], char[order], len(rows), m)
            counts[rows] = n_ids
            parts.append((rows, n_ids, ids))
    for i in np.flatnonzero(all_lengths > LONG):
        piece, char = forward.long(code_points([words[i]])[0][0])
        counts[i : i + 1], ids = _ids(np.zeros(len(piece), np.int64), piece, char, 1, m)
        parts.append((np.array([i]), counts[i : i + 1], ids))
    if not parts:
        return np.zeros(0, np.int32), counts
    ids = np.concatenate([p[2] for p in parts])
    which, n_ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    start = np.zeros(len(words), np.int64)
    start[which] = np.cumsum(n_ids) - n_ids
    return ids[ragged(start, counts)], counts


def _ids(row: np.ndarray, piece: np.ndarray, char: np.ndarray, n: int, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each of n rows, ids) of pieces in order; without byte pieces a run of unknown characters is one id."""
    lone = piece == -2
    times = np.where(lone & m.byte_fallback, utf8_lengths(char), 1)
    if not m.byte_fallback:
        times[1:][lone[1:] & lone[:-1] & (row[1:] == row[:-1])] = 0
    ids = np.repeat(np.where(lone, m.unknown, piece), times).astype(np.int32)
    if lone.any() and m.byte_fallback:
        raw = utf8_bytes(char[lone], times[lone])
        ids[ragged((np.cumsum(times) - times)[lone], times[lone])] = m.bytes[raw]
    return np.bincount(row, weights=times, minlength=n).astype(np.int64), ids


def _encode_runs(words: list[str], forward: Forward) -> tuple[np.ndarray, np.ndarray]:
    """As encode_words, for BPE pre-tokens that may begin with several spaces: runs merge last, from the left."""
    m = forward.m
    bare = [SPACE + b if (b := w.lstrip(SPACE)) and w != b else b for w in words]
    ids, counts = encode_words(bare, forward)
    ends = np.cumsum(counts)
    out = []
    for w, b, e, c in zip(words, bare, ends, counts):
        own, spaces = ids[e - c : e].tolist(), len(w) - len(w.lstrip(SPACE))
        if b and spaces > 1:
            loose = own[0] == m.space_runs.get(SPACE, m.unknown)
            own = m.run(spaces if loose else spaces - 1) + own[int(loose) :]
        elif not b:
            own = m.run(spaces)
        out.append(own)
    return np.array([i for o in out for i in o], np.int32), np.array([len(o) for o in out], np.int64)


class Encoder:
    """Encodes texts; the ids of pre-tokens seen before are kept, up to a number of them."""

    def __init__(self, model: Model) -> None:
        self.forward = Forward(model)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text)."""
        if len(self.index) > KEPT_WORDS or len(self.ids) > KEPT_IDS:
            self.clear()
        lists = [pretokens(t, self.forward.m.prefix) for t in texts]
        words = [w for ws in lists for w in ws]
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            ids, counts = encode_words(new, self.forward)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        start = np.cumsum(self.counts) - self.counts
        code = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        per_word = self.counts[code]
        ends = np.cumsum(np.array([len(ws) for ws in lists], np.int64))
        total = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], ends])]
        return self.ids[ragged(start[code], per_word)], np.diff(total)


class Decoder:
    def __init__(self, model: Model) -> None:
        out = []
        for i, (text, kind) in enumerate(zip(model.texts, model.kinds)):
            out.append(b"" if kind == CONTROL else bytes([int(text[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if i == model.unknown else text.replace(SPACE, " ").encode())
        self.length = np.array([len(b) for b in out], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(out), np.uint8)
        self.prefix = model.prefix

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.length):
            raise ValueError("an id is outside the model")
        size = self.length[ids]
        raw = self.raw[ragged(self.start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:])]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


def load_model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, decoded) of every row: the text's ids, and the text that these decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decode = Encoder(shared.value), Decoder(shared.value)
        for b in batches:
            for row, part in chunks(b.column("text"), 1 << 22):
                null = b.column("text").slice(row, len(part)).is_null().to_numpy(zero_copy_only=False)
                ids, counts = encoder(part.to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)])
                masked = pa.array(offsets.astype(np.int32), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(part)), pa.ListArray.from_arrays(masked, pa.array(ids)), pa.array(decode(ids, counts), pa.string(), mask=null)], names=["doc_id", "token_ids", "decoded"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, token_ids array<int>, decoded string")


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, decoded) of every row of ids; a null list gives null."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = Decoder(shared.value)
        for b in batches:
            lists = b.column("ids")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode_ids(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "decoded"])

    rows = tokens.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.filter(F.col(f"`{ids_col}`").cast("array<int>"), lambda i: i.isNotNull()).alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, decoded string")
