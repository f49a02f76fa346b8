"""Different texts under one doc_id are documents of their own."""

import random

import corpus_pipeline


def test_texts_that_share_an_id(spark):
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    passage, own, short = some(60), some(90), some(30)
    rows = [(1, some(20) + passage), (2, own + passage), (2, short), (3, own[:88] + ["x", "y"] + passage), (None, passage)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id bigint, text string")
    got = [(r["doc_id"], r["text"].split()) for r in corpus_pipeline.passage_dedup(spark, docs, "").collect()]
    # The passage goes from all but the first, and 88 words of the third from it; the short text stays whole.
    assert sorted(got, key=repr) == sorted([(1, rows[0][1]), (2, own), (2, short), (3, ["x", "y"]), (None, passage)], key=repr)
    left = [(r["doc_id"], len(r["text"].split())) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(left, key=repr) == sorted([(1, 80), (2, 150), (2, 30), (None, 60)], key=repr)
