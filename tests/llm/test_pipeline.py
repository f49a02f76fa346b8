"""The pipeline and its stages, on the smallest table and on odd rows."""

from collections import Counter

import corpus_pipeline
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from termforge.llm import langid, packing, simhash
from termforge.llm.common import written
from test_operators import grouped, repeats_of

SF = "/root/testdata/sf0.001"


def sizes_of(models, texts):
    """The language with the smallest size for each text, if by enough."""
    coders = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k, v in models.items()}
    for t in texts:
        plain = langid.folded(pa.array([t]))[0].as_py().encode()
        sizes = sorted(sum(len(c.compress(plain[i : i + 4096])) for i in range(0, len(plain), 4096)) for c in coders.values())
        yield bool(plain) and (sizes[1] - sizes[0]) / sizes[1] >= langid.MARGIN


def test_stages_in_turn(spark, tmp_path):
    """Each stage against brute force on what the stage before kept; some texts hold a passage of another."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = [r["text"].split() for r in docs.where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(8).collect()]
    mixed = [(10_000 + i, " ".join(long[i][100:160] + long[i + 1][200:300] + long[i + 2][300:400]), "en", "s", 0) for i in range(5)]
    docs.unionByName(spark.createDataFrame(mixed, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before, models = docs.count(), langid.fit(docs)
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = written(stage(spark, docs, str(tmp_path)), name)
        if name == "language_id":
            want = {r["doc_id"]: r["text"] for r, kept in zip(rows, sizes_of(models, [r["text"] for r in rows])) if kept}
        elif name == "simhash_near_dedup":
            high, low, has = simhash.fingerprints(pa.array([r["text"] for r in rows]))
            prints = {r["doc_id"]: int(h) << 64 | int(l) for r, h, l, some in zip(rows, high, low, has) if some}
            gone = grouped(prints, simhash.DISTANCE)
            assert gone  # so small a table is one list, so all pairs are found
            want = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in gone}
        elif name == "suffix_array_dedup":
            spans, want = {}, {}
            for d, s, e, _ in repeats_of([(r["doc_id"], r["text"]) for r in rows], 50):
                spans.setdefault(d, []).append((s, e))
            for r in rows:
                left = [w for i, w in enumerate(r["text"].split()) if not any(s <= i < e for s, e in spans.get(r["doc_id"], []))]
                if left or r["doc_id"] not in spans:
                    want[r["doc_id"]] = left
            assert spans
        else:
            packs, sizes = Counter(), Counter()
            for r in out.collect():
                packs[r["pack_id"]] += r["length"]
                sizes[r["doc_id"]] += r["length"]
            assert sizes == {r["doc_id"]: len(r["text"].encode()) + 1 for r in rows} and max(packs.values()) <= packing.WINDOW
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
            continue
        assert out.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert ({d: t.split() for d, t in got.items()} if name == "suffix_array_dedup" else got) == want
        docs = out
    assert 0.8 * before < docs.count() < before


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, gone_doc string, span_doc string, lang_ string"
    rows = [(None, "no id but words", "en", "s", 3, "g", "s", "l"), (1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "g", "s", "l"), (2, "", "en", "s", 0, "g", "s", "l")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns and out.count() == len(data)
            else:
                assert out.count() == (2 if data else 0)
        assert corpus_pipeline.language_id(spark, docs, SF).columns == docs.columns
