"""The plan from layout dumps to output documents, its sinks, the stream and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from termforge import cli, registry
from termforge.functions import text as T
from termforge.functions.patterns import ARMY, get_profile
from termforge.operators import layout
from termforge.operators.dedup import dedupe
from termforge.plans import pipeline
from termforge.sources import readers, writers
from termforge.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_payloads_keep_the_schema(spark):
    out = registry.queries()["payload_documents"](spark, SF).collect()
    assert len(out) == 50 and len({r["source_doc_id"] for r in out}) == 50
    for r in out:
        entries = json.loads(r["entries_json"])
        assert len(entries) == r["n_entries"] == r["entries_after_dedup"] <= r["entries_glossary"] + r["entries_inline"]
        assert all(e["term"] and e["definition"] and e["pdf_page_index"] >= 1 for e in entries)


def test_statuses_cover_every_document(spark):
    out = registry.queries()["payload_statuses"](spark, SF)
    assert out.count() == 200 and {r["status"] for r in out.select("status").distinct().collect()} <= {"ok", "no-defs", "fail"}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "a.pdf", None), ("b", "b.pdf", None)], "doc_id string, filename string, gcs_key string")
    pages = spark.createDataFrame([("a", 0, "words " * 100, 792.0, None, False)], "doc_id string, page_idx int, text string, height double, label string, read_error boolean")
    spans = spark.createDataFrame([], "doc_id string, page_idx int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, font string, flags int")
    payload = pipeline.payloads(docs, pages, spans, ARMY)
    writers.write_table(payload, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2
    writers.write_documents(payload, f"{tmp_path}/json")
    assert sorted(os.listdir(tmp_path / "json")) == ["a.json", "b.json"]
    assert writers.write_reports(payload, f"{tmp_path}/reports") == {"no-defs": 2}
    bad = pipeline.violations(payload.withColumn("schema_version", F.lit("9")))
    assert {tuple(r["violations"]) for r in bad.collect()} == {("schema_version",)}


def test_command_line_usage(spark, capsys):
    assert cli.main([]) == 2
    assert cli.main(["--input-dir", "/x", "--output-dir", "/y", "--doc-id", "1"]) == 2
    assert cli.main(["--input", "/nowhere.json", "--output", "/tmp/x"], spark) == 1
    with pytest.raises(SystemExit) as ended:
        cli.main(["--version"])
    assert ended.value.code == 0 and pipeline.EXTRACTOR_VERSION in capsys.readouterr().out


DUMP = {
    "doc_id": "d1",
    "filename": "sub/AR_25-2.pdf",
    "pages": [
        {"text": "Cover " + "words " * 40, "height": 792.0, "label": "", "read_error": False, "blocks": []},
        {"text": "Glossary\nSection II\nTerms\n" + "words " * 40, "height": 792.0, "label": "Glossary-1", "read_error": False, "blocks": [{"lines": [
            {"spans": [{"text": "Section II", "bbox": [72.0, 180.0, 100.0, 190.0], "font": "Bold", "flags": 16}]},
            {"spans": [{"text": "Acceptance", "bbox": [72.0, 200.0, 100.0, 210.0], "font": "Bold", "flags": 16}]},
            {"spans": [{"text": "The formal approval of a product by the user.", "bbox": [90.0, 214.0, 300.0, 224.0], "font": "Roman", "flags": 4}]},
            {"spans": [{"text": "  ", "bbox": [72.0, 220.0, 80.0, 224.0], "font": "Roman", "flags": 4}]},
            {"spans": [{"text": "*Access control", "bbox": [72.0, 228.0, 100.0, 238.0], "font": "Bold", "flags": 16}]},
            {"spans": [{"text": "The process of granting or denying requests.", "bbox": [90.0, 242.0, 300.0, 252.0], "font": "Roman", "flags": 4}]},
        ]}]},
    ],
}


def test_command_line_over_a_dump(spark, tmp_path):
    source = tmp_path / "in.json"
    source.write_text(json.dumps(DUMP) + "\n" + json.dumps(DUMP | {"doc_id": "d2", "filename": "other/AR_25-2.pdf", "pages": DUMP["pages"][:1]}))
    assert cli.main(["--input", str(source), "--output", str(tmp_path / "out"), "--gcs-key", "bucket/key", "--deterministic"], spark) == 0
    names = sorted(n for n in os.listdir(tmp_path / "out") if n.endswith(".json"))
    assert len(names) == 2 and "AR_25-2.json" in names
    got = {r["source_doc_id"]: r for r in (json.loads((tmp_path / "out" / n).read_text()) for n in names)}
    one, two = got["d1"], got["d2"]
    assert [(e["term"], e["definition"], e["pdf_page_index"], e["printed_page_label"], e["flags"]) for e in one["entries"]] == [
        ("Acceptance", "The formal approval of a product by the user.", 2, "Glossary-1", []),
        ("Access control", "The process of granting or denying requests.", 2, "Glossary-1", [T.CHANGED_FLAG]),
    ]
    assert one["source_gcs_key"] == "bucket/key" and one["source_pub_number"] == "AR 25-2" and one["metadata"]["section_structure"] == "section_ii_only"
    assert two["entries"] == [] and (tmp_path / "out" / "NO_DEFINITIONS").is_dir() and not (tmp_path / "out" / "FAILURES").exists()


def test_failures_and_names(spark, tmp_path):
    docs = spark.createDataFrame([("a", "https://x/y/page?q=1", None), ("b", "z/page?q=1", None)], "doc_id string, filename string, gcs_key string")
    pages = spark.createDataFrame([("a", 0, "words " * 100, 792.0, None, False)], "doc_id string, page_idx int, text string, height double, label string, read_error boolean")
    spans = spark.createDataFrame([], "doc_id string, page_idx int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, font string, flags int")
    payload = pipeline.payloads(docs, pages, spans, ARMY)
    writers.write_documents(payload, f"{tmp_path}/json")
    names = sorted(os.listdir(tmp_path / "json"))
    assert len(names) == 2 and names[1] == "page_q_1.json"
    failed = spark.createDataFrame([("c.pdf", "cannot open")], "source_pdf string, message string")
    assert writers.write_reports(payload, f"{tmp_path}/reports", failed) == {"no-defs": 2, "fail": 1}
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/reports/FAILURES").collect()] == ["c.pdf\tcannot open"]


def test_pdfs_that_cannot_be_decoded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"no PDF at all")
    assert cli.main(["--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--workers", "2"], spark) == 1
    lines = [r["value"].split("\t") for r in spark.read.text(f"{tmp_path}/out/FAILURES").collect()]
    assert [x[0] for x in lines] == ["a.pdf"] and lines[0][1]


def test_stream_takes_each_text_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(DUMP) + "\n")

    def run():
        incremental.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", ARMY).awaitTermination(300)
        rows = spark.read.parquet(f"{tmp_path}/out")
        return sorted((r["source_doc_id"], r["n"]) for r in rows.select("source_doc_id", F.size("entries").alias("n")).collect())

    assert run() == [("d1", 2)]
    # Equal text under another id is not extracted again, another text is.
    other = DUMP | {"doc_id": "d3", "pages": [DUMP["pages"][1]]}
    (tmp_path / "in" / "2.json").write_text(json.dumps(DUMP | {"doc_id": "d2"}) + "\n" + json.dumps(other) + "\n")
    assert run() == [("d1", 2), ("d3", 2)]


def test_profiles():
    assert get_profile("army").name == "army"
