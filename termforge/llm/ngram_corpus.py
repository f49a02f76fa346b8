"""Every document of a corpus scored by n-grams of any length, each word against the corpus without its own occurrence.

C(i, m) is how often the m words that end at place i occur in the corpus, and F(i, m) how often before another word of their
document; both fall with m. Lengths 1 to DENSE are asked for at each place whose parts occur twice. Beyond, two facts leave few
questions, and no greatest length:

- If all occurrences of the DENSE - 1 words that end at i are followed by the same word, F(i, m) = C(i, m) = C(i + 1, m + 1) from
  there on. So a run of such places has one table of counts, that of its last place. That is seen from the counts of lengths
  DENSE - 1 and DENSE, and is a property of the words, so all occurrences of a run's end are ends.
- If all occurrences of DENSE - 1 words are preceded by the same word, no count changes when a context that begins with them
  takes in that word. So only the other places, its *branches*, are candidates for a change.

1. Texts with the same least hash of DENSE words, as most copies and edited copies have, are sent to one task (`near`). Each task
   cuts its texts into shards of about SHARD_BYTES, which are written once, as word hashes, to the shared folder, with the
   questions that are open. Equal texts of a shard are one text with a weight, and count as often; "twice" then means more
   often than the own weight. How texts meet decides only how much is asked, never a count.
2. In a round, each shard sends the hashes it asks about, each once with its sum, to buckets by range of hash; a bucket sums them
   and answers in the order of the question, so no hash is sent back. After DENSE rounds, an end of a run asks about a few branches at once, further
   and further to the left until its words are unique, and then, between two that differ, about up to SPLIT more.
   Counts are kept as a tree of contexts by shard (`Tree`), and an interval that several ends share is one question.
3. When nothing is open, each shard scores its own documents from its answers:

    p_n = (C(i, n + 1) - 1 + ALPHA * p_{n-1}) / (F(i - 1, n) - 1 + ALPHA)   for n = 1, 2, ... while F(i - 1, n) > 1
    p_0 = (C(i, 1) - 1 + ALPHA / N) / (N - 1 + ALPHA)                       in a corpus of N words

   A step keeps at most ALPHA / (1 + ALPHA) of what was before it. So while the word is seen, the last lengths alone decide, as
   far as a double can hold (`reach`); once it is unseen, only
   factors follow, of which sums of logarithms are kept.

Defined cases: only the place itself is left out, so other places of the same document and equal rows count; each row is
scored, also those that repeat an id or have none; a null text has null scores; a text without a word has 0 words, log2
probability 0 and null averages; the only word of a corpus has probability 1; an empty table gives an empty result; words
are as in `ngram`; texts are read whole; only the named columns are read.
"""

from __future__ import annotations

import gc
import math
import time
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, new_path, partitions, written
from .kernels import Powers, chunks, list_array, mix, release, space_table, tidy, window_hashes
from .ngram import ALPHA
from .passages import words_of

_BASE = 0xD6E8FEB86659FD93
_powers = Powers()
SHARD_BYTES = 4 << 20
DENSE = 4
SPLIT = 7
ENTRIES = 750_000
STATE = "shard string, answers array<string>, runs string, questions string, open bigint, n_words bigint, nodes bigint"
STATE_ARROW = pa.schema([("shard", pa.string()), ("answers", pa.list_(pa.string())), ("runs", pa.string()), ("questions", pa.string()), ("open", pa.int64()), ("n_words", pa.int64()), ("nodes", pa.int64())])
LISTS = "shard string, bucket int, hashes binary, found binary, followed binary"
COUNTS = "shard string, bucket int, found binary, followed binary"
SCORES = "doc_id bigint, n_words int, log2_probability double, mean_context double"
# An interval of branches of a run, the counts and nodes at its ends, and the occurrences that it stands for.
LOW, HIGH, STANDS = ("a", "found_a", "followed_a", "node_a"), ("b", "found_b", "followed_b", "node_b"), ("run", "n", "n_followed")
QUESTION = (*STANDS, *LOW, *HIGH)


def packed(values: np.ndarray) -> np.ndarray:
    """Integers in the fewest bytes that hold them all."""
    for kind in (np.int8, np.int16, np.int32):
        if values.dtype.kind == "i" and len(values) and np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def save(folder: str, **arrays: np.ndarray) -> str:
    """The name of a new file with these arrays; no name is used twice, so a task may be tried again."""
    where, at = fs.FileSystem.from_uri(folder)
    where.create_dir(at)
    name = uuid.uuid4().hex
    table = pa.table({k: list_array(packed(v), np.array([0, len(v)])) for k, v in arrays.items()})
    with where.open_output_stream(f"{at}/{name}") as out, ipc.new_file(out, table.schema, options=ipc.IpcWriteOptions(compression="zstd")) as file:
        file.write_table(table)
    return name


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    where, at = fs.FileSystem.from_uri(folder)
    with where.open_input_file(f"{at}/{name}") as file:
        table = ipc.open_file(file).read_all()
    out = {k: table.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in table.column_names}
    return {k: v.astype(np.int64) if v.dtype.kind == "i" else v for k, v in out.items()}


def to_bytes(values: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold them all, after one that says how many; nothing for none but ones."""
    if len(values) and values.min() == values.max() == 1:
        return b""
    values = packed(values)
    return bytes([values.dtype.itemsize]) + values.tobytes()


def from_bytes(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).astype(np.int64) if data else np.ones(n, np.int64)


class Shard:
    """The words of a shard's distinct texts, end to end; weight is the number of rows that have a text."""

    def __init__(self, folder: str, name: str) -> None:
        kept = load(folder, name)
        self.doc_id, self.has_id, self.has_text, self.text, self.n_words, self.weights = (kept[k] for k in ("doc_id", "has_id", "has_text", "text", "n_words", "weight"))
        self.word, self.code = kept["word"], kept["code"]

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    @cached_property
    def at(self) -> np.ndarray:
        return np.arange(len(self.code)) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)

    @cached_property
    def weight(self) -> np.ndarray:
        return np.repeat(self.weights, self.n_words)

    @cached_property
    def followed(self) -> np.ndarray:
        out = self.weight.copy()
        out[np.cumsum(self.n_words)[self.n_words > 0] - 1] = 0
        return out

    @cached_property
    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        up, down = _powers(_BASE, len(self.code))
        total = np.zeros(len(self.code) + 1, np.uint64)
        np.cumsum(self.word.view(np.uint64)[self.code] * up, out=total[1:])
        return total, down

    def hashes(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of the words that end at each place."""
        begin, (total, down) = place + 1 - length, self.sums
        return mix(mix((total[place + 1] - total[begin]) * down[begin]) + length.astype(np.uint64))

    def level(self, folder: str, names: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
        """C and F of all places at a length up to DENSE; what occurs once is counted as such, what would begin before its text as 0."""
        if m > len(names):
            return self.alone(m)
        kept = load(folder, names[m - 1])
        return (kept["found"][self.code], kept["followed"][self.code]) if m == 1 else (kept["found"], kept["followed"])

    def alone(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """C and F of all places at a length, were no n-gram to occur in another place."""
        whole = self.at >= m - 1
        return self.weight * whole, self.followed * whole


def askers(s: Shard, found: np.ndarray, m: int) -> np.ndarray:
    """Places to ask for at length m, from the counts of length m - 1: an n-gram of which a part occurs once occurs once."""
    twice = found > s.weight
    some = twice & (s.at >= m - 1)
    some[1:] &= twice[:-1]
    return np.flatnonzero(some)


class Runs:
    """Ends of runs of places, and the branches to the left of each, as far as all parts of DENSE words occur twice."""

    def __init__(self, kept: dict[str, np.ndarray]) -> None:
        self.kept = kept
        self.end, self.start, self.branch = (np.cumsum(kept[k]) for k in ("end", "start", "branch"))
        self.base = np.searchsorted(self.branch, self.end)
        self.branches = self.base - np.searchsorted(self.branch, self.start)

    @classmethod
    def of(cls, s: Shard, before: np.ndarray, found: np.ndarray) -> Runs:
        """From C at lengths DENSE - 1 and DENSE."""
        twice, at = found > s.weight, np.arange(len(found))
        inner = np.zeros(len(found), bool)
        inner[:-1] = twice[1:] & (found[1:] == before[:-1])
        end = np.flatnonzero(twice & ~inner)
        first = twice.copy()
        first[1:] &= ~twice[:-1]
        start = np.maximum.accumulate(np.where(first, at, 0))[end]
        return cls({"end": np.diff(end, prepend=0), "start": np.diff(start, prepend=0), "branch": np.diff(np.flatnonzero(twice & (found < before)), prepend=0)})

    def length(self, run: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Words from the k-th branch to a run's end; with one more than there are branches, words that hold a unique part."""
        at = np.append(self.branch, 0)[np.maximum(self.base[run] - k, 0)]
        at = np.where(k > self.branches[run], self.start[run] - 1, at)
        return self.end[run] - np.where(k == 0, self.end[run], at) + DENSE


def n_probes(q: dict[str, np.ndarray]) -> np.ndarray:
    return np.where(q["b"] > 0, np.minimum(q["b"] - q["a"] - 1, SPLIT), np.where(q["a"] > 0, 2, 3))


def probes(q: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(question, branch) of all that is asked in a round, in order; b is 0 where an interval has no end yet.

    An interval's ends alone decide, so all runs that hold an n-gram ask for it in the same round. Were it to depend on anything
    else, as on how many branches a run has, some occurrences would be missing from the sum.
    """
    n = n_probes(q)
    which = np.repeat(np.arange(len(n)), n)
    j = np.arange(1, len(which) + 1) - np.repeat(np.cumsum(n) - n, n)
    at = q["a"][which] + j * (q["b"] - q["a"])[which] // (n + 1)[which]
    some = np.flatnonzero((q["b"] == 0)[which])
    at[some] = np.maximum(q["a"][which[some]], 1) << j[some]
    return which, at


def narrowed(q: dict[str, np.ndarray], which: np.ndarray, at: np.ndarray, found: np.ndarray, followed: np.ndarray, node: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """The questions that these answers leave open; weight is that of the text behind each."""
    first, last = edges(which)
    here = (at, found, followed, node)
    low = tuple(np.where(first, q[k][which], np.append(0, x[:-1])) for k, x in zip(LOW, here))
    high = tuple(q[k][which] for k in HIGH)
    zero = np.zeros(len(which), np.int64)

    def differ(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
        return (y[0] - x[0] > 1) & (x[1] > weight) & ((x[1] != y[1]) | (x[2] != y[2]))

    on = last & (high[0] == 0) & (found > weight)
    upper = (*here[:3], np.where(found > weight, node, -1))
    parts = [(differ(low, here), low, upper), (last & (high[0] > 0) & differ(here, high), here, high), (on, here, (zero, zero, zero, zero - 1))]
    rows = [[x[some] for x in (*(q[k][which] for k in STANDS), *one, *two)] for some, one, two in parts]
    return merged({k: np.concatenate(x) for k, x in zip(QUESTION, zip(*rows))})


def edges(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a question's probes begin and end."""
    first, last = np.ones(len(which), bool), np.ones(len(which), bool)
    first[1:] = last[:-1] = which[1:] != which[:-1]
    return first, last


def merged(q: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Intervals up to one node are one question, which stands for all of them: their words are the same."""
    shared = q["node_b"] >= 0
    own = np.flatnonzero(~shared)
    _, rep, group = np.unique(q["node_b"][shared], return_index=True, return_inverse=True)
    out = {}
    for k, x in q.items():
        one = np.bincount(group.reshape(-1), x[shared], len(rep)).astype(np.int64) if k in STANDS[1:] else x[shared][rep]
        out[k] = np.append(one, x[own])
    return out


def grown(q: dict[str, np.ndarray], of: np.ndarray, at: np.ndarray, length: np.ndarray, key: np.ndarray, found: np.ndarray, followed: np.ndarray, weight: np.ndarray, base: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The last node up to each probe, and what a round adds to a shard's tree of contexts, whose nodes are counted from base on.

    key says which n-gram a probe is. It becomes a node if it has another count than the probe before; its parent is the node
    before, until a later round finds one between.
    """
    first, last = edges(of)
    prior = [np.where(first, q[k][of], np.append(0, x[:-1])) for k, x in zip(LOW[1:3], (found, followed))]
    twice = found > weight
    new = np.flatnonzero(twice & ((found != prior[0]) | (followed != prior[1])))
    _, some, inverse = np.unique(key[new], return_index=True, return_inverse=True)
    node, latest = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    node[new], latest[new] = base + inverse.reshape(-1), new + 1
    latest = np.maximum.accumulate(latest) - 1
    begin = np.flatnonzero(first)[np.cumsum(first) - 1]
    inside = latest >= begin
    node = np.where(inside, node[latest], q["node_a"][of])
    before = np.where(first, q["node_a"][of], np.append(0, node[:-1]))
    ends = np.flatnonzero(last & inside & (q["node_b"][of] >= 0))
    some = new[some]
    # Where an interval has no node at its end, its last n-gram that occurs in another place is the longest of its run.
    deep = twice & (q["node_b"][of] < 0)
    deep[:-1] &= last[:-1] | ~twice[1:]
    return node, {
        "length": length[some], "found": found[some], "followed": followed[some], "parent": before[some], "child": q["node_b"][of[ends]], "between": node[ends],
        "run": q["run"][of[deep]], "at": at[deep], "node": node[deep],
    }


def asked(s: Shard, folder: str, before: str, r: dict, turn: int) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
    """(place, length, occurrences and those before another word) of what a shard asks in a round, and the questions behind it."""
    if turn == 0:
        return np.arange(len(s.at)), np.ones(len(s.at), np.int64), (s.weight, s.followed), ()
    if turn < DENSE:
        place = askers(s, s.level(folder, r["answers"], turn)[0], turn + 1)
        return place, np.full(len(place), turn + 1), (s.weight[place], s.followed[place]), ()
    runs, q = Runs(load(folder, r["runs"])), load(before, r["questions"])
    which, at = probes(q)
    run = q["run"][which]
    real = at <= runs.branches[run]
    stands = tuple(q[k][which[real]] for k in STANDS[1:])
    return runs.end[run[real]], runs.length(run[real], at[real]), stands, (runs, q, which, at, real)


def sent(s: Shard, place: np.ndarray, m: np.ndarray, stands: tuple, turn: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(bucket, hash, occurrences, those before another word) in the order of buckets, each hash once, and which is each question's."""
    if turn == 0:
        hashes, which = s.word.view(np.uint64), s.code
    else:
        hashes, which = np.unique(s.hashes(place, m), return_inverse=True)
        which = which.reshape(-1)
    # They are in order, and so are ranges of them.
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    found, followed = (np.bincount(which, x, len(hashes)).astype(np.int64) for x in stands)
    return bucket, hashes, found, followed, which


def near(rows: DataFrame) -> DataFrame:
    """rows with the least hash of DENSE words of each text, of its words if there are fewer, of its id if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, table = Powers(), space_table()
        for b in batches:
            doc_id = b.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            for row, part in chunks(b.column("text")):
                w = words_of(part, power, table)
                least, n = mix(doc_id[row : row + len(part)].view(np.uint64)), np.diff(w.first)
                for size in (1, DENSE):
                    some = np.flatnonzero(n >= size)
                    if len(some):
                        grams = np.append(window_hashes(w.hashes, size, power), np.uint64(0))
                        cuts = np.stack([w.first[some], w.first[some + 1] - size + 1], axis=1)
                        least[some] = np.minimum.reduceat(grams, cuts.reshape(-1))[::2]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(row, len(part)) for k in ("doc_id", "text")), pa.array(least.view(np.int64))], names=["doc_id", "text", "near"])

    return rows.mapInArrow(tidy(run), "doc_id bigint, text string, near bigint")


def shards(rows: DataFrame, folder: str, shard_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, table = Powers(), space_table()
        for b in batches:
            has_id, has_text = (b.column(k).is_valid().to_numpy(zero_copy_only=False) for k in ("doc_id", "text"))
            doc_id = b.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            for row, part in chunks(b.column("text"), shard_bytes):
                distinct = part.dictionary_encode()
                text = distinct.indices.to_numpy().astype(np.int64)
                w = words_of(distinct.dictionary, power, table)
                n_words, weight = np.diff(w.first), np.bincount(text)
                word, code = np.unique(w.hashes, return_inverse=True)
                own = slice(row, row + len(part))
                name = save(folder, doc_id=doc_id[own], has_id=has_id[own], has_text=has_text[own], text=text, weight=weight, n_words=n_words, word=word.view(np.int64), code=code.reshape(-1).astype(np.int64))
                yield pa.RecordBatch.from_pylist([{"shard": name, "answers": [], "runs": "", "questions": "", "open": len(word), "n_words": int((n_words * weight).sum()), "nodes": 0}], schema=STATE_ARROW)

    return rows.mapInArrow(tidy(run), STATE)


def ask(state: DataFrame, before: str, folder: str, turn: int, buckets: int) -> DataFrame:
    """Each shard's open questions by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Shard(folder, r["shard"])
                bucket, hashes, found, followed, _ = sent(s, *asked(s, folder, before, r, turn)[:3], turn, buckets)
                keys, at = np.unique(bucket, return_index=True)
                cuts = [*at.tolist(), len(bucket)]
                parts = [slice(i, j) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array([hashes[p].tobytes() for p in parts], pa.binary()), *(pa.array([to_bytes(x[p]) for p in parts], pa.binary()) for x in (found, followed))], names=["shard", "bucket", "hashes", "found", "followed"])

    return state.mapInArrow(tidy(run), LISTS)


def summed(table: pa.Table) -> pa.Table:
    """Sums over the shards, in the order in which each asked."""
    rows = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    cuts = np.cumsum([len(x) for x in rows]).tolist()
    hashes, which = np.unique(np.concatenate(rows), return_inverse=True)
    which, out = which.reshape(-1), []
    for k in ("found", "followed"):
        given = np.concatenate([from_bytes(x, len(row)) for x, row in zip(table.column(k).to_pylist(), rows)])
        sums = packed(np.bincount(which, given, len(hashes)).astype(np.int64))[which].astype(np.int64)
        out.append(pa.array([to_bytes(sums[i:j]) for i, j in zip([0, *cuts], cuts)], pa.binary()))
    return pa.table([table.column("shard"), table.column("bucket"), *out], names=["shard", "bucket", "found", "followed"])


def taker(folder: str, before: str, after: str, turn: int, buckets: int):
    """Takes in the answers of a round and says what is open then."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        r = state.to_pylist()[0]
        s = Shard(folder, r["shard"])
        place, m, stands, more = asked(s, folder, before, r, turn)
        bucket, _, _, _, which = sent(s, place, m, stands, turn, buckets)
        del stands
        answers = answers.sort_by("bucket")
        sizes = np.unique(bucket, return_counts=True)[1].tolist()
        found, followed = (np.concatenate([np.zeros(0, np.int64), *(from_bytes(x, n) for x, n in zip(answers.column(k).to_pylist(), sizes, strict=True))]) for k in ("found", "followed"))
        r |= {"questions": "", "open": 0}
        if turn == 0:
            r["answers"] = [save(folder, found=found, followed=followed)]
            r["open"] = len(askers(s, found[s.code], 2))
        elif turn < DENSE:
            full, full_followed = s.alone(turn + 1)
            full[place], full_followed[place] = found[which], followed[which]
            earlier = s.level(folder, r["answers"], turn)[0]
            r["answers"] = [*r["answers"], save(folder, found=full, followed=full_followed)]
            if turn + 1 < DENSE:
                r["open"] = len(askers(s, full, turn + 2))
            else:
                runs = Runs.of(s, earlier, full)
                r["runs"] = save(folder, **runs.kept)
                one = np.flatnonzero(runs.branches > 0)
                none = np.zeros(len(one), np.int64)
                end = runs.end[one]
                q = dict(zip(QUESTION, (one, s.weight[end], s.followed[end], none, full[end], full_followed[end], one, none, none, none, none - 1)))
                r["open"], r["nodes"] = int(n_probes(q).sum()), len(runs.end)
        else:
            runs, q, of, at, real = more
            sums = found[which], followed[which]
            # Words from beyond the last branch hold a part that occurs once.
            weight, followed = (x[runs.end[q["run"][of]]] for x in (s.weight, s.followed))
            found = weight.copy()
            found[real], followed[real] = sums
            length, key = np.zeros((2, len(of)), np.int64)
            length[real], key[real] = m, which
            node, more = grown(q, of, at, length, key, found, followed, weight, r["nodes"])
            r["answers"] = [*r["answers"], save(folder, **more)]
            r["nodes"] += len(more["length"])
            q = narrowed(q, of, at, found, followed, node, weight)
            # Beyond its last branch a run holds nothing that others ask for.
            more = q["a"] < runs.branches[q["run"]]
            q = {k: x[more] for k, x in q.items()}
            r["open"] = int(n_probes(q).sum())
        if turn + 1 >= DENSE and r["open"]:
            r["questions"] = save(after, **q)
        return pa.Table.from_pylist([r], schema=STATE_ARROW)

    return run


class Tree:
    """Contexts of a shard, from DENSE words on: a node is an n-gram from which on counts are others than those of its parent, which
    ends it. Each end of a run has the node of its longest context; those of more places are alone."""

    def __init__(self, s: Shard, folder: str, runs: Runs, names: list[str], found: np.ndarray, followed: np.ndarray, more: np.ndarray, alpha: float) -> None:
        n, parts = len(runs.end), [load(folder, name) for name in names]
        ends = np.arange(n)
        m, parent, found, followed = (np.concatenate([x, *(p[k] for p in parts)]) for k, x in (("length", np.full(n, DENSE)), ("parent", ends), ("found", found[runs.end]), ("followed", followed[runs.end])))
        longest, deep = np.zeros(n, np.int64), ends
        for p in parts:
            parent[p["child"]], longest[p["run"]], deep[p["run"]] = p["between"], p["at"], p["node"]
        del parts
        # The least length that occurs in no other place, and one that no text has. What equal texts hold is a node as well.
        place = np.append(runs.end, more)
        once, out, weight = np.append(runs.length(np.arange(n), longest + 1), np.full(len(more), DENSE)), s.at[place] + 2, s.weight[place]
        own = np.flatnonzero((weight > 1) & (once < out))
        ids = len(m) + np.arange(len(own))
        self.deep = np.append(deep, np.zeros(len(more), np.int64))
        above = np.where(own < n, self.deep[own], ids)
        self.deep[own] = ids
        self.m, self.parent = np.append(m, once[own]), np.append(parent, above)
        self.counts = np.stack([np.append(followed, s.followed[place[own]]), np.append(found, weight[own])])
        # The first length at which a count is 1 or less, by kind of count.
        end = np.where(weight > 1, out, np.minimum(once, out))
        low = self.counts[0] <= 1
        jump = np.where(low & low[self.parent], self.parent, np.arange(len(self.m)))
        while (further := jump[jump]).tobytes() != jump.tobytes():
            jump = further
        self.stop = np.stack([np.where(low[self.deep], np.minimum(self.m[jump[self.deep]], end), end), end])
        self.log = np.log2(alpha / (np.maximum(self.counts - 1, 0) + alpha))
        self.sums = self.log[:, self.parent] * (self.m - self.m[self.parent])
        self.jumps = [self.parent.astype(np.int32)]
        while True:
            last = self.jumps[-1]
            self.sums = self.sums + self.sums[:, last]
            further = last[last]
            if (further == last).all():
                break
            self.jumps.append(further)

    def seek(self, run: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The longest node of no more than m words on the way to a run's longest context; its first if there is none."""
        at = self.deep[run]
        for jump in reversed(self.jumps):
            to = jump[at]
            at = np.where(self.m[to] > m, to, at)
        return np.where(self.m[at] > m, self.parent[at], at)

    def factors(self, kind: np.ndarray, run: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Logarithm of the product of all factors from DENSE words up to m."""
        at = self.seek(run, m)
        return self.sums[kind, at] + (m - self.m[at] + 1) * self.log[kind, at]


def reach(alpha: float) -> int:
    """Steps after which less is left of a probability than a double can tell from its sum with another one."""
    return math.ceil(64 / math.log2(1 + 1 / alpha))


def probabilities(s: Shard, folder: str, r: dict, total: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(log2 probability, words of the longest context) of each place of a shard, in a corpus of `total` words."""
    names = r["answers"]
    found, followed = s.level(folder, names, 1)
    p = (found - 1 + alpha / total) / (total - 1 + alpha)
    log, context = np.log2(p), np.zeros(len(s.at), np.int64)
    live = np.flatnonzero(s.at > 0)
    for n in range(1, DENSE):
        f = followed[live - 1] - 1
        live, f = live[f > 0], f[f > 0]
        found, followed = s.level(folder, names, n + 1)
        c = found[live] - 1
        some, none = live[c > 0], live[c == 0]
        p[some] = (c[c > 0] + alpha * p[some]) / (f[c > 0] + alpha)
        log[some] = np.log2(p[some])
        log[none] += np.log2(alpha / (f[c == 0] + alpha))
        context[live] = n
    live = live[followed[live - 1] > 1]
    twice = found > s.weight
    # A context in no other place goes on, with its word, to the beginning of a text that several rows have.
    x, live = live[~twice[live - 1]], live[twice[live - 1]]
    p[x] = 1 + (p[x] - 1) * (alpha / (s.weight[x] - 1 + alpha)) ** (s.at[x] - DENSE + 1)
    log[x], context[x] = np.log2(p[x]), s.at[x]
    if not len(live):
        return log, context
    runs = Runs(load(folder, r["runs"]))
    more = live[~twice[live] & (s.weight[live] > 1)]
    t = Tree(s, folder, runs, names[DENSE:], found, followed, more, alpha)
    # The context's run, whether all its occurrences go on alike, and its words to the run's end; then the same of the word.
    run_f = np.searchsorted(runs.end, live - 1)
    ahead_f = runs.end[run_f] - (live - 1)
    kind = (ahead_f > 0).astype(np.int64)
    longest = t.stop[kind, run_f] - 1 - ahead_f
    context[live] = longest
    run_c = np.minimum(np.searchsorted(runs.end, live), len(runs.end) - 1)
    ahead_c = np.where(twice[live], runs.end[run_c] - live, 0)
    run_c = np.where(twice[live] | (s.weight[live] == 1), run_c, len(runs.end) + np.searchsorted(more, live))
    seen = np.where(found[live] > 1, np.minimum(t.stop[1, run_c] - 2 - ahead_c, longest), 0)
    on = np.flatnonzero(seen >= DENSE)
    x, top, run_a, ahead_a, kind_a, run_b, ahead_b = live[on], seen[on], run_f[on], ahead_f[on], kind[on], run_c[on], ahead_c[on]
    n = np.maximum(DENSE, top - reach(alpha) + 1)
    p[x[n > DENSE]] = 1.0
    # From the longest context down: what a length adds, and how much of the shorter ones is left.
    at_f, at_c = t.seek(run_a, top + ahead_a), t.seek(run_b, top + 1 + ahead_b)
    left, kept = np.ones(len(x)), np.zeros(len(x))
    to, go = x, np.arange(len(x))
    while len(go):
        f, c = t.counts[kind_a, at_f] - 1, t.counts[1, at_c] - 1
        from_f, from_c = t.m[at_f] - ahead_a, t.m[at_c] - 1 - ahead_b
        least = np.maximum(np.maximum(from_f, from_c), n)
        ratio = (alpha / (f + alpha)) ** (top - least + 1)
        kept[go] += left[go] * (c / f) * (1 - ratio)
        left[go] *= ratio
        at_f, at_c, top = np.where(from_f >= least, t.parent[at_f], at_f), np.where(from_c >= least, t.parent[at_c], at_c), least - 1
        on_ = top >= n
        go, top, n, ahead_a, kind_a, ahead_b, at_f, at_c = (v[on_] for v in (go, top, n, ahead_a, kind_a, ahead_b, at_f, at_c))
    p[to] = kept + left * p[to]
    log[live[on]] = np.log2(p[live[on]])
    seen = np.maximum(seen, DENSE - 1)
    rest = np.flatnonzero(longest > seen)
    kind, run_f, ahead_f, longest, seen = (v[rest] for v in (kind, run_f, ahead_f, longest, seen))
    log[live[rest]] += t.factors(kind, run_f, longest + ahead_f) - t.factors(kind, run_f, seen + ahead_f)
    return log, context


def collected(spark: SparkSession) -> None:
    """Exchanges that nothing reads again: their files go when the driver collects what stands for them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def score_corpus(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, log2_probability, perplexity, mean_context) of every row."""
    spark = corpus.sparkSession
    rows = corpus.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    folder = new_path(spark, "ngram")
    together = near(rows).hint("rebalance", "near").sortWithinPartitions("near", F.xxhash64("text")).select("doc_id", "text")
    state = written(shards(together, folder, shard_bytes), "shards")
    del together
    collected(spark)
    n_shards, total, pending, turn = state.count(), state.agg(F.sum("n_words")).first()[0] or 0, state.agg(F.sum("open")).first()[0] or 0, 0
    while pending:
        before, after = f"{folder}-{turn}", f"{folder}-{turn + 1}"
        buckets = max(partitions(spark), math.ceil(pending / ENTRIES))
        questions = ask(state.where("open > 0").repartition(n_shards), before, folder, turn, buckets)
        answers = questions.groupBy("bucket").applyInArrow(summed, COUNTS)
        taken = state.where("open > 0").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(taker(folder, before, after, turn, buckets), STATE)
        state = written(taken.union(state.where("open = 0")), "shards")
        asked_now = pending
        pending, turn = state.agg(F.sum("open")).first()[0] or 0, turn + 1
        drop_path(spark, before)
        if asked_now > ENTRIES:
            # Nothing reads this round's exchanges again.
            del questions, answers, taken
            collected(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.select(["shard", "answers", "runs"]).to_pylist():
                s = Shard(folder, r["shard"])
                n = len(s.n_words)
                log, context = np.zeros(0), np.zeros(0, np.int64)
                if len(s.at):
                    log, context = probabilities(s, folder, r, total, alpha)
                sums = [np.bincount(s.row, x, n) for x in (log, context)]
                n_words, log, mean = (x[s.text] for x in (s.n_words.astype(np.int32), sums[0], sums[1] / np.maximum(s.n_words, 1)))
                null = ~s.has_text
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_id, mask=~s.has_id), pa.array(n_words, mask=null), pa.array(log, mask=null), pa.array(mean, mask=null)], names=["doc_id", "n_words", "log2_probability", "mean_context"])

    scored = state.repartition(max(1, n_shards)).mapInArrow(tidy(run), SCORES)
    some = F.col("n_words") > 0
    return scored.select(
        "doc_id",
        "n_words",
        F.round("log2_probability", 6).alias("log2_probability"),
        F.when(some, F.round(F.pow(F.lit(2.0), -F.col("log2_probability") / F.col("n_words")), 4)).alias("perplexity"),
        F.when(some, F.round("mean_context", 6)).alias("mean_context"),
    )
