"""Runs of single letters beside what is no ASCII letter, against the SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from termforge import registry

TEXTS = ["éa b c d e f", "a b c d é f g", "v w x y zé", "中a b c d e中", "a b c d é", "1a b c d e f", "a b c d e_", "a b c d e‍", "a b c d e", "a b c dé", "", None, "a " * 5000 + "b"]


def test_edges_of_words_are_ascii(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": range(len(TEXTS)), "text": pa.array(TEXTS, pa.string())}), f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = registry.queries()["ocr_spacing"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle_sql()["ocr_spacing"]).fetchall())
    assert dict(map(tuple, got))[2] == "vwxyzé"
