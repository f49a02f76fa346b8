"""The substring index over several loads and sessions, against all loads at once."""

import random

from termforge.llm import substring_index
from termforge.llm.common import new_path


def test_reopened_index_goes_on(spark):
    rng = random.Random(21)
    passages = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(24):
        own = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 120))]
        texts.append(own + passages[i % 4] + own[:10] if i % 2 else own)
    texts += [texts[1], ["x"], None]
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = sorted(map(tuple, substring_index.repeats(docs, batches=1).collect()))
    assert len(want) >= 8
    folder, got = new_path(spark, "kept-index"), []
    for low, high in ((0, 9), (9, 10), (10, 18), (18, 99)):
        index = substring_index.Index.open(spark, folder)
        assert bool(index.runs) == (low > 0)
        got += map(tuple, substring_index.append(index, docs.where(f"doc_id >= {low} and doc_id < {high}")).collect())
        index.close()  # as if the session ended: nothing but the folder is left
    assert sorted(got) == want
    last = substring_index.Index.open(spark, folder)
    assert len(last.texts) == 4 and last.version == 4 and len(last.runs) <= 2
    assert "Bucketed: true" in last.read(last.runs[0]).groupBy("hash").count()._jdf.queryExecution().toString()
    last.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("termforge_run_")]
