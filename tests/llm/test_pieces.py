"""Token counts and encoding against the sentencepiece library: long texts without spaces, and unigram models trained here."""

import base64
import io
import random

import numpy as np
import pytest
import sentencepiece

from termforge.llm import pieces, sentencepiece as coding, token_counts
from termforge.llm.queries import MODEL

RNG = random.Random(8)
CHINESE = "".join(chr(0x4E00 + RNG.randrange(3000)) for _ in range(20_000))
BASE64 = base64.b64encode(RNG.randbytes(60_000)).decode()
LETTERS = "".join(RNG.choice("etaoinshrdlu") for _ in range(30_000))
PERIODS = ["a" * 5000, "ab" * 3000, "the" * 2000, "🙂" * 1500]
MIXED = [f"{LETTERS[:n]} {CHINESE[:n]}{BASE64[:n]}" for n in (40, 383, 384, 385, 700, 2000)]
WORDS = ["".join(RNG.choices("abcdefgh$%", k=RNG.randint(1, 9))) for _ in range(300)]
PROSE = [" ".join(RNG.choices(WORDS, k=RNG.randint(1, 200))) for _ in range(150)]
ODD = ["", " ", "   x   y ", "漢字漢字 🙂🙂🙂 x🙂🙂y", "$$$ $$$$ $", " " * 500 + "x"]


def coded(model, texts):
    ids, counts = coding.Encoder(model)(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_long_texts_without_spaces(monkeypatch):
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), coding.load_model(MODEL)
    texts = [CHINESE, BASE64, LETTERS, *PERIODS, *MIXED, *ODD]
    want = library.encode(texts)
    assert coded(model, texts) == want and token_counts.Counter(model)(texts).tolist() == [len(w) for w in want]
    # Windows agree on all but the texts of few characters over and over, so nothing else goes character by character.
    monkeypatch.setattr(pieces.Forward, "slow", None)
    assert coded(model, [CHINESE, BASE64, LETTERS]) == want[:3]
    with pytest.raises(TypeError):
        coded(model, PERIODS[:1])


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_model(byte_fallback):
    out = io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(PROSE[:100]), model_writer=out, vocab_size=700, hard_vocab_limit=False, model_type="unigram", byte_fallback=byte_fallback, normalization_rule_name="identity", remove_extra_whitespaces=False, minloglevel=2, num_threads=1)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=out.getvalue()), pieces.Model(out.getvalue())
    assert model.kind == pieces.UNIGRAM and model.byte_fallback == byte_fallback
    texts = [*PROSE, *ODD, LETTERS[:3000], CHINESE[:1000], BASE64[:3000], *(p[:1200] for p in PERIODS), "".join(WORDS)]
    want = library.encode(texts)
    got = coded(model, texts)
    assert token_counts.Counter(model)(texts).tolist() == [len(g) for g in got]
    same = [g == w for g, w in zip(got, want)]
    # The library's rounding decides between segmentations of one score; nothing else may differ.
    for g, w in zip(got, want):
        assert g == w or sum(map(library.get_score, g)) == pytest.approx(sum(map(library.get_score, w)), abs=2e-3)
    assert sum(same) >= 0.98 * len(texts)
    assert [library.decode(g) for g in got] == coding.Decoder(model)(np.array([i for g in got for i in g]), np.array(list(map(len, got))))


def test_decoding_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, [None, 15043, None]), (2, None), (3, [])], "doc_id bigint, token_ids array<int>")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted(map(tuple, coding.decode(rows, MODEL).collect())) == [(1, library.decode([15043])), (2, None), (3, "")]
    for bad in (-1, 32_000):
        with pytest.raises(ValueError):
            coding.Decoder(coding.load_model(MODEL))(np.array([bad]), np.array([1]))
