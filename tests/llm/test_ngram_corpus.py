"""Scores of a corpus' own documents, against counts of all word sequences."""

import math
import random
from collections import Counter

import pytest

from termforge.llm import ngram_corpus
from termforge.llm.queries import queries


def test_scores_of_every_document(spark):
    rng = random.Random(2)
    passage = [f"w{rng.randrange(90)}" for _ in range(60)]
    texts = [[f"w{rng.randrange(90)}" for _ in range(rng.randint(1, 80))] for _ in range(30)]
    texts += [passage, passage[:41], ["x", *passage], [*passage[7:], "y", *passage], passage[25:], ["one"], "the same the same the same the same".split()]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (90, None), (91, " \n")]
    words = [(d, None if t is None else t.split()) for d, t in rows]
    found, followed = Counter(), Counter()
    for _, ws in words:
        for i in range(len(ws or [])):
            for j in range(i + 1, len(ws) + 1):
                found[tuple(ws[i:j])] += 1
                followed[tuple(ws[i:j])] += j < len(ws)
    total = sum(len(ws or []) for _, ws in words)
    want = []
    for d, ws in words:
        log, contexts = 0.0, 0
        for i, w in enumerate(ws or []):
            p, n = (found[(w,)] - 1 + 1 / total) / total, 1
            while n <= i and followed[tuple(ws[i - n : i])] > 1:
                p = (found[tuple(ws[i - n : i + 1])] - 1 + p) / followed[tuple(ws[i - n : i])]
                n += 1
            log, contexts = log + math.log2(p), contexts + n - 1
        want.append((d, None, None, None, None) if ws is None else (d, 0, 0.0, None, None) if not ws else (d, len(ws), log, 2 ** (-log / len(ws)), contexts / len(ws)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, ngram_corpus.score_corpus(docs, shard_bytes=300).collect()), key=lambda r: (r[0] is None, r))
    for g, x in zip(got, sorted(want, key=lambda r: (r[0] is None, r)), strict=True):
        assert g[:2] == x[:2] and g[2:] == tuple(v if v is None else pytest.approx(v, abs=1e-4) for v in x[2:])
    assert ngram_corpus.score_corpus(docs.limit(0)).count() == 0
    assert [r["log2_probability"] for r in ngram_corpus.score_corpus(docs.where("doc_id = 35")).collect()] == [0.0]


def test_query_scores_the_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["op7_ngram_scoring"](spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_few_rounds_for_long_copies(spark, monkeypatch):
    """Edited copies of 200 words: rounds follow the places where copies part, not the lengths between them."""
    rng = random.Random(5)
    passage = [f"v{rng.randrange(5000)}" for _ in range(200)]
    docs = [[*passage[:k], f"edit{k}", *passage[k + 1 :]] for k in (20, 60, 61, 120, 180)] + [passage]
    counts = Counter()
    for ws in docs:
        for i in range(len(ws)):
            counts.update((tuple(ws[i:j]), j < len(ws)) for j in range(i + 1, len(ws) + 1))
    n_words, want = 1200, []
    for ws in docs:
        log, contexts = 0.0, 0
        for i, w in enumerate(ws):
            p, n = (counts[(w,), True] + counts[(w,), False] - 1 + 1 / n_words) / n_words, 1
            # The logarithm of what was seen last, and of factors from there on.
            log_p = math.log2(p)
            while n <= i and (f := counts[tuple(ws[i - n : i]), True] - 1) > 0:
                gram = tuple(ws[i - n : i + 1])
                c = counts[gram, True] + counts[gram, False] - 1
                p = (c + p) / (f + 1)
                log_p = math.log2(p) if c else log_p - math.log2(f + 1)
                n += 1
            log, contexts = log + log_p, contexts + n - 1
        want.append((len(ws), pytest.approx(log, abs=1e-5), pytest.approx(contexts / len(ws), abs=1e-5)))
    rounds, ask = [], ngram_corpus.ask
    monkeypatch.setattr(ngram_corpus, "ask", lambda *args: rounds.append(1) or ask(*args))
    rows = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(docs)], "doc_id bigint, text string").repartition(2)
    got = ngram_corpus.score_corpus(rows, shard_bytes=2500).orderBy("doc_id").collect()
    assert [(r["n_words"], r["log2_probability"], r["mean_context"]) for r in got] == want
    assert len(rounds) <= 8


def test_copies_are_asked_for_once(spark, monkeypatch):
    """Equal texts weigh as many, wherever they lie, and a shard asks for what its texts share once."""
    rng = random.Random(8)
    passage = [f"u{rng.randrange(4000)}" for _ in range(120)]
    docs = [passage] * 12 + [[*passage[:k], "edit", *passage[k + 1 :]] for k in (9, 30, 31, 77, 118)]
    docs += [docs[-1], passage[3:90], passage[3:90], passage[:50], "a b".split(), "a b".split(), "a b c d e".split(), ["a"] * 9, ["a"] * 9]
    docs += [f"x{i}" for i in range(30) for _ in range(2)], [f"y{i}" for i in range(25)], [f"y{i}" for i in range(25)]
    found, followed = Counter(), Counter()
    for ws in docs:
        for i in range(len(ws)):
            for j in range(i + 1, len(ws) + 1):
                found[tuple(ws[i:j])] += 1
                followed[tuple(ws[i:j])] += j < len(ws)
    total, want = sum(map(len, docs)), []
    for ws in docs:
        log, contexts = 0.0, 0
        for i, w in enumerate(ws):
            p, n = (found[(w,)] - 1 + 1 / total) / total, 1
            log_p = math.log2(p)
            while n <= i and (f := followed[tuple(ws[i - n : i])] - 1) > 0:
                c = found[tuple(ws[i - n : i + 1])] - 1
                p = (c + p) / (f + 1)
                log_p = math.log2(p) if c else log_p - math.log2(f + 1)
                n += 1
            log, contexts = log + log_p, contexts + n - 1
        want.append((len(ws), pytest.approx(log, abs=1e-5), pytest.approx(contexts / len(ws), abs=1e-5)))
    rows = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(docs)], "doc_id bigint, text string").repartition(3)
    for shard_bytes in (1 << 20, 900):
        hashes, ask = [], ngram_corpus.ask
        with monkeypatch.context() as m:
            m.setattr(ngram_corpus, "ask", lambda *args, ask=ask, hashes=hashes: hashes.append(ask(*args).selectExpr("sum(octet_length(hashes)) / 8").first()[0]) or ask(*args))
            got = ngram_corpus.score_corpus(rows, shard_bytes=shard_bytes).orderBy("doc_id").collect()
        assert [(r["n_words"], r["log2_probability"], r["mean_context"]) for r in got] == want
        if shard_bytes > 900:
            assert max(hashes) < 600


def test_questions_stay_within_the_words(spark, monkeypatch):
    """What edited copies share is asked for and kept once in a shard: eighty copies have no more questions in a round than three for each word."""
    rng, docs, rounds, ask = random.Random(3), [], [], ngram_corpus.ask
    passage = [f"z{rng.randrange(3000)}" for _ in range(150)]
    for i in range(80):
        ws = list(passage)
        for k in rng.sample(range(150), 3):
            ws[k] = f"edit{rng.random()}"
        docs.append((i, " ".join(ws)))
    monkeypatch.setattr(ngram_corpus, "ask", lambda state, before, folder, turn, buckets: rounds.append(state.selectExpr("sum(open)").first()[0]) or ask(state, before, folder, turn, buckets))
    assert ngram_corpus.score_corpus(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)).count() == 80
    assert max(rounds[ngram_corpus.DENSE :]) < 3 * 80 * 150, rounds
