"""PDF decoding, where the optional pymupdf is installed on the executors. A file that can't be read gives an error, not a failed
job; so does every file where there is no pymupdf."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.layout import DUMP_SCHEMA

SCHEMA = f"path string, {DUMP_SCHEMA}, error string"


def decode(files: DataFrame) -> DataFrame:
    """Layout dumps of (path, filename, content), with the error of those that can't be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, filename, content in zip(batch["path"], batch["filename"], batch["content"]):
                try:
                    import fitz

                    rows.append((path, path, filename, [_page(p) for p in fitz.open(stream=content, filetype="pdf")], None))
                except Exception as e:  # one document's fault is that document's status
                    rows.append((path, path, filename, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "doc_id", "filename", "pages", "error"])

    return files.select("path", "filename", "content").mapInPandas(run, SCHEMA)


def _page(page: object) -> dict:
    try:
        blocks = [
            {"lines": [{"spans": [{"text": s.get("text"), "bbox": list(s["bbox"]), "font": s.get("font"), "flags": int(s.get("flags") or 0)} for s in line.get("spans", [])]} for line in block.get("lines", [])]}
            for block in page.get_text("dict").get("blocks", [])
        ]
        return {"text": page.get_text("text"), "height": float(page.rect.height), "label": page.get_label() or None, "read_error": False, "blocks": blocks}
    except Exception:  # the page is marked as unreadable; the range operators know what that means
        return {"text": None, "height": None, "label": None, "read_error": True, "blocks": []}
