"""One hash of a corpus, taken by several tasks in turn."""

import hashlib
import random

from termforge.operators import evaluate


def test_no_task_reads_the_whole_corpus(spark, monkeypatch):
    rng, sizes, stored = random.Random(1), [], evaluate.stored
    rows = [(f"{i:06d}", bytes(rng.randrange(256) for _ in range(rng.randrange(2000)))) for i in range(400)]
    want = hashlib.sha256(b"".join(n.encode() + c for n, c in rows)).hexdigest()
    rng.shuffle(rows)
    files = spark.createDataFrame([*rows, (None, b"x"), ("x", None)], "name string, content binary").repartition(5)
    monkeypatch.setattr(evaluate, "stored", lambda df, what: sizes.extend(stored(df, what).inputFiles()) or stored(df, what))
    for piece, least in ((40_000, 8), (1 << 30, 1)):
        sizes.clear()
        assert [r[0] for r in evaluate.corpus_hash(files, "name", "content", piece).collect()] == [f"sha256:{want}"]
        assert len(sizes) >= least
    assert evaluate.corpus_hash(files.limit(0), "name", "content").first()[0] == f"sha256:{hashlib.sha256().hexdigest()}"
