"""SentencePiece model files, and the forward step that token counting and encoding share.

Two kinds of model are read. For a unigram model the best segmentation of a prefix has the largest sum of piece scores.
For a BPE model (the public file in /opt/tokenizers is one) sums of scores do not give the library's result; there the
segmentation of a prefix is the one whose neighbouring pieces are all *stable*: encoding the two pieces' joined text gives
just these two pieces again. Exactly one last piece of each prefix is stable with the segmentation before it, so the same
forward pass over prefixes, with a test in place of a sum, finds the library's ids, and its state depends on the
prefix alone.

Text is cut into pre-tokens before each space that follows another character; no piece may hold such a place, which is
checked when the file is read. Runs of spaces merge after everything else, and are looked up by length.

A pre-token of over LONG characters (text without spaces) is cut into windows that overlap and advance together. The state
after a prefix depends on those of the `longest` prefixes before it, so where two windows agree on as many in a row, the
later one goes on as the whole text would. Where any two don't agree, which a text of few characters over and over can
bring about, the pre-token is segmented by a loop over its characters.

Ties of a unigram model go to the longer last piece, as in the library. Scores are summed from the start of each pre-token,
and what differs by under 1e-4 is a tie. The library sums in single precision from the start of the text, so where its
rounding parts two segmentations of one score, it may take the other one: as many pieces' scores, in another order.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Iterator

import numpy as np

from .kernels import U64, mix

SPACE = "▁"
SPLIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_BASE = U64(0x9E3779B97F4A7C15)
_LOST = np.float32(-np.inf)
_TIE = np.float32(1e-4)
LONG = 384


def _fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """Fields of a protocol-buffer message: (number, wire type, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, kind, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, kind, raw[at : at + n]
            at += n


def merge_order(symbols: list[str], rank: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain BPE by a heap: best rank first, then leftmost. Returns the pieces and the last merge."""
    left = list(range(-1, len(symbols) - 1))
    right = list(range(1, len(symbols) + 1))
    alive = list(symbols)
    heap: list[tuple[float, int, int, str]] = []

    def push(i: int, j: int) -> None:
        if 0 <= i and j < len(alive):
            joined = alive[i] + alive[j]
            if joined in rank:
                heapq.heappush(heap, (rank[joined], i, j, joined))

    for i in range(len(symbols) - 1):
        push(i, i + 1)
    last = None
    while heap:
        _, i, j, joined = heapq.heappop(heap)
        if not alive[i] or not alive[j] or alive[i] + alive[j] != joined or right[i] != j:
            continue
        last = alive[i], alive[j]
        alive[i], alive[j] = joined, ""
        right[i] = right[j]
        if right[j] < len(alive):
            left[right[j]] = i
        push(left[i], i)
        push(i, right[i])
    return [s for s in alive if s], last


class Model:
    """The arrays of a model file. Ids are the file's; `last` states use them too, and -2 for a character without a piece."""

    def __init__(self, raw: bytes) -> None:
        self.texts: list[str] = []
        kinds, scores = [], []
        self.kind, self.prefix, self.byte_fallback = UNIGRAM, True, False
        self.unknown = 0
        for number, _, value in _fields(raw):
            if number == 1:
                piece = {n: v for n, _, v in _fields(value)}
                self.texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = {n: v for n, _, v in _fields(value)}
                self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24):
                    raise ValueError("spaces after a word are not supported")
            elif number == 3:
                spec = {n: v for n, _, v in _fields(value)}
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only the identity normaliser is supported, with spaces kept and escaped")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.kinds, self.scores = np.array(kinds), np.array(scores, np.float32)
        if (self.kinds == USER).any():
            raise ValueError("user-defined pieces are not supported")
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = np.full(256, self.unknown, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.bytes[int(self.texts[i][3:5], 16)] = i
        normal = np.flatnonzero(self.kinds == NORMAL)
        if any(SPACE in t.lstrip(SPACE) for t in (self.texts[i] for i in normal)):
            raise ValueError("a piece holds a space after another character")
        runs = {self.texts[i]: self.scores[i] for i in normal if set(self.texts[i]) == {SPACE}}
        if any(t.startswith(SPACE * 2) and t not in runs for t in (self.texts[i] for i in normal)):
            raise ValueError("a piece holds several spaces and another character")
        index = {self.texts[i]: i for i in normal}
        if SPACE not in index and not self.byte_fallback:
            raise ValueError("the space has no piece")
        self.space_runs = {t: i for t, i in index.items() if t in runs}
        self.run_scores = runs
        # Order of merging: characters first, then merged pieces from the best score on.
        self.order = np.full(len(kinds), -1, np.int64)
        self.left, self.right = (np.full(len(kinds), -1, np.int32) for _ in range(2))
        use = [i for i in normal if self.kind == UNIGRAM or self.texts[i] not in runs or self.texts[i] == SPACE]
        if self.kind == BPE:
            merged = sorted((i for i in use if len(self.texts[i]) > 1), key=lambda i: (-self.scores[i], i))
            if len({self.scores[i] for i in merged}) < len(merged):
                raise ValueError("merged pieces share a score")
            self.order[[i for i in use if len(self.texts[i]) == 1]] = 0
            for n, i in enumerate(merged):
                self.order[i] = n + 1
            rank = self.rank = {self.texts[i]: int(self.order[i]) for i in merged}
            reached = []
            for i in use:
                got, last = merge_order(list(self.texts[i]), rank)
                if len(got) == 1:
                    reached.append(i)
                    if last:
                        self.left[i], self.right[i] = index.get(last[0], -1), index.get(last[1], -1)
                else:
                    # Never the result of merging its own characters, so never a token; it may still outrank others.
                    self.left[i] = -3
            self.usable = np.zeros(len(kinds), bool)
            self.usable[reached] = True
        else:
            self.usable = np.zeros(len(kinds), bool)
            self.usable[use] = True
        self.index = {self.texts[i]: int(i) for i in use}
        points = [np.array([ord(c) for c in self.texts[i]], U64) for i in use]
        self.longest = max((len(p) for p in points), default=1)
        hashes = np.array([_poly(p) for p in points], U64)
        by = np.argsort(hashes)
        self.keys, self.ids = hashes[by], np.array(use, np.int32)[by]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.poly = np.zeros(len(kinds), U64)
        self.poly[use] = hashes
        self.chars = np.array([len(t) for t in self.texts])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys * _BASE) >> U64(44)] = True
        self.floor = np.float32(self.scores[normal].min()) - np.float32(10)
        self.power = np.cumprod(np.concatenate([[U64(1)], np.full(self.longest * 2, _BASE, U64)]))

    def find(self, keys: np.ndarray, usable: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(positions, piece ids) of the keys that are the hash of a piece."""
        # The product's high bits depend on all of the key's; the filter leaves few keys to search for.
        maybe = np.flatnonzero(self.filter[(keys * _BASE) >> U64(44)])
        probe = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
        hit = self.keys[at] == probe
        where, ids = maybe[hit], self.ids[at[hit]]
        if usable:
            can = self.usable[ids]
            return where[can], ids[can]
        return where, ids

    def run(self, spaces: int) -> list[int]:
        """Ids of a run of spaces that no other piece takes (BPE)."""
        rank = {t: -s for t, s in self.run_scores.items() if len(t) > 1}
        return [self.space_runs.get(t, self.unknown) for t in merge_order([SPACE] * spaces, rank)[0]]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding text(a) + text(b) gives [a, b], for arrays of usable ids; -2 is a character without a piece.

        Merges are undone from the latest on, on either side of the seam; a merge across the seam that would have come
        earlier than the last one undone shows that the pair is not stable.
        """
        out = np.ones(len(a), bool)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[open_].astype(np.int64), b[open_].astype(np.int64)
        limit = np.full(len(x), np.iinfo(np.int64).max)
        while len(open_):
            some, joined = self.find(self.poly[x] * self.power[self.chars[y]] + self.poly[y], usable=False)
            wins = np.zeros(len(x), bool)
            # Twice the order, so that "not after" on the right and "before" on the left are both thresholds.
            wins[some] = 2 * self.order[joined] < limit[some]
            out[open_[wins]] = False
            ox, oy = self.order[x], self.order[y]
            first = ox > oy
            can_x, can_y = ox > 0, oy > 0
            undo_x = np.where(first, True, can_x & ~can_y)
            done = wins | (~can_x & ~can_y)
            limit = np.where(undo_x, 2 * ox, 2 * oy + 1)
            x, y = np.where(undo_x & can_x, self.right[x], x), np.where(~undo_x & can_y, self.left[y], y)
            keep = ~done & (x >= 0) & (y >= 0)
            open_, x, y, limit = open_[keep], x[keep], y[keep], limit[keep]
        return out


def _poly(points: np.ndarray) -> np.uint64:
    h = np.zeros(1, U64)
    for p in points:
        h = h * _BASE + (p + U64(1))
    return h[0]


class Forward:
    """The forward step over prefixes of many pre-tokens at once."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.pairs = np.full(1 << 20, -1, np.int64)
        self.answers = np.zeros(1 << 20, bool)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As Model.stable, through a table of pairs already answered."""
        key = (a.astype(np.int64) + 2) << 32 | b.astype(np.int64)
        slot = (mix(key.view(U64)) >> U64(44)).astype(np.int64)
        out = self.answers[slot]
        new = np.flatnonzero(self.pairs[slot] != key)
        if len(new):
            ask, back = np.unique(key[new], return_inverse=True)
            got = self.m.stable((ask >> 32) - 2, ask & 0xFFFFFFFF)
            out[new] = got[back]
            # Where slots collide both assignments keep the last row's value.
            self.pairs[slot[new]] = key[new]
            self.answers[slot[new]] = out[new]
        return out

    def step(self, points: np.ndarray, hashes: np.ndarray, rows: np.ndarray, depth: int, score: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, last piece or -2, its length) of the prefixes of `depth` characters of these rows.

        points, hashes, score and last are tables with a column for each prefix length; hashes and states are known
        up to depth - 1, hashes at depth too.
        """
        m = self.m
        best = np.full(len(rows), _LOST)
        piece, length = np.full(len(rows), -2, np.int32), np.ones(len(rows), np.int32)
        alone = np.zeros(len(rows), bool)
        whole = len(rows) == len(points)
        to = hashes[:, depth] if whole else hashes[rows, depth]
        # The longest first, so that among values that are equal up to rounding it stays.
        for n in range(min(depth, m.longest), 0, -1):
            at, ids = m.find(to - (hashes[:, depth - n] if whole else hashes[rows, depth - n]) * m.power[n])
            if n == 1:
                alone[at] = True
            if not len(at):
                continue
            before = rows[at]
            if m.kind == BPE:
                good = self.stable(last[before, depth - n], ids) if depth > n else np.ones(len(at), bool)
                value = np.where(good, np.float32(0), _LOST)
            else:
                value = score[before, depth - n] + m.scores[ids]
            better = value > best[at] + _TIE
            best[at[better]], piece[at[better]], length[at[better]] = value[better], ids[better], n
        lone = np.flatnonzero(~alone)
        if len(lone):
            # A character without a piece stands alone, at the unknown score, unless a longer piece holds it.
            value = np.zeros(len(lone), np.float32) if m.kind == BPE else score[rows[lone], depth - 1] + m.floor
            better = value > best[lone] + _TIE
            best[lone[better]], piece[lone[better]], length[lone[better]] = value[better], -2, 1
        return best, piece, length

    def run(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, last piece, its length) of every prefix of every row; column 0 is the empty prefix."""
        hashes, (n, wide) = prefix_hashes(points), points.shape
        score, last, back = np.zeros((n, wide + 1), np.float32, "F"), np.full((n, wide + 1), -2, np.int32, "F"), np.ones((n, wide + 1), np.int32, "F")
        every = np.arange(n)
        for d in range(1, wide + 1):
            score[:, d], last[:, d], back[:, d] = self.step(points, hashes, every, d, score, last)
        return score, last, back

    def long(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, their last characters) of one long pre-token, in order."""
        m, n = self.m, len(points)
        over = 3 * m.longest
        step = max(over, math.isqrt(n))
        begin = np.arange(0, max(1, n - over), step)
        text = np.concatenate([points, np.zeros(step + over, points.dtype)])
        score, last, back = self.run(text[begin[:, None] + np.arange(step + over)])
        # The prefixes that a window shares with the one before, as far as both have come furthest.
        one, two = slice(step + over - m.longest + 1, step + over + 1), slice(over - m.longest + 1, over + 1)
        agree = (last[:-1, one] == last[1:, two]).all() and (back[:-1, one] == back[1:, two]).all()
        if m.kind == UNIGRAM:
            # Sums from another place on, so differences are equal up to rounding; nearer calls than that are left to the loop.
            apart = score[:-1, one].astype(np.float64) - score[1:, two]
            agree = agree and bool((np.ptp(apart, axis=1) < 0.01).all()) if len(begin) > 1 else agree
        if not agree:
            return self.slow(points)
        pieces, lengths = (np.concatenate([x[0, : over + 1], x[:, over + 1 :].ravel()])[: n + 1] for x in (last, back))
        out, at = [], n
        steps = lengths.tolist()
        while at:
            out.append(at)
            at -= steps[at]
        ends = np.array(out[::-1])
        return pieces[ends], points[ends - 1]

    def slow(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, text = self.m, points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        if m.kind == BPE:
            found = merge_order(list(text), m.rank)[0]
        else:
            score, back = [np.float32(0)], [0]
            for d in range(1, len(text) + 1):
                best, length = _LOST, 1
                for n in range(min(d, m.longest), 0, -1):
                    i = m.index.get(text[d - n : d])
                    value = score[d - n] + (m.scores[i] if i is not None else m.floor) if i is not None or n == 1 else _LOST
                    if value > best + _TIE:
                        best, length = value, n
                score.append(best)
                back.append(length)
            found, at = [], len(text)
            while at:
                found.append(text[at - back[at] : at])
                at -= back[at]
            found.reverse()
        return np.array([m.index.get(t, -2) for t in found], np.int32), points[np.cumsum([len(t) for t in found]) - 1]


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    # Column by column, as they are read.
    out = np.zeros((len(points), points.shape[1] + 1), U64, "F")
    for d in range(points.shape[1]):
        out[:, d + 1] = out[:, d] * _BASE + (points[:, d].astype(U64) + U64(1))
    return out


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (a row for each word, zero-padded) and lengths."""
    lengths = np.array([len(w) for w in words])
    wide = max(1, int(lengths.max(initial=0)))
    return np.array(words, f"U{wide}").view(np.uint32).reshape(len(words), wide), lengths


def utf8_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)


def pretokens(text: str, prefix: bool = True) -> list[str]:
    """Runs of spaces with what follows them, up to the next space; the dummy space is put in front."""
    if not text:
        return []
    text = (SPACE if prefix else "") + text.replace(" ", SPACE)
    if SPACE * 2 not in text and text[-1] != SPACE and text[0] == SPACE:
        return [SPACE + w for w in text[1:].split(SPACE)]
    return SPLIT.findall(text)
