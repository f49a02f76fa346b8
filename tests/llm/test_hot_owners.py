"""One passage in every document: owners with many anchors, through buckets, through the aggregate, and through both."""

import random

import pytest
from test_operators import repeats_of

from termforge.llm import substring_index, suffix_dedup
from termforge.llm.passages import anchor_table, repeated


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(90)]
    other = [f"q{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"w{rng.randrange(200)}" for _ in range(rng.randint(0, 80))]
        rows.append((i, " ".join(own + passage + (other if i % 9 == 0 else []) + own[:5])))
    rows += [(5, " ".join(passage)), (5, " ".join(passage)), (99, " ".join(passage * 30)), (100, None), (101, ""), (None, " ".join(passage))]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_hot_owners_lose_nothing(hot):
    docs = hot.where("doc_id is not null")
    want = repeats_of([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    counts = sorted(r["n"] for r in repeated(anchor_table(docs)).collect())
    assert counts[0] < 20 < 60 <= counts[-1]
    for bound in (0, 20, 4096):
        assert sorted(map(tuple, suffix_dedup.repeats(hot, hot=bound).collect())) == want
        for batches in (1, 3):
            assert sorted(map(tuple, substring_index.repeats(hot, batches=batches, hot=bound).collect())) == want
