"""Language identification by compression.

A language's model is a raw-content zstandard dictionary: texts of that language, put end to end. A text gets the
language whose dictionary makes it smallest. Texts and dictionaries are first put into lower case, with every run of
other characters than letters as one space; a text is encoded as consecutive pieces of 4 KB, each from the dictionary
afresh, and their sizes are summed, so a long text does not become its own dictionary. Where the runner-up's size is within a relative margin of the smallest,
or the text is null, or has no letter, the text is rejected (lang null).

Fitting is the one step that reads a bounded sample: of each of the `languages` most frequent labels the `rows` labelled
texts with the least hash of their id, cut at `dict_bytes` bytes in all. All three bounds are parameters. Deciding reads every text whole.

Defined cases: null or empty texts and texts without a letter are rejected with margin 0; equal sizes have margin 0 and
are rejected; with fewer than two languages to choose from nothing can be rejected for its margin; repeated rows get
equal rows; a null id is kept as null; with no labelled row, or an empty table, every text is rejected or none exists.
Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import chunks, tidy

ROWS = 128
LANGUAGES = 64
DICT_BYTES = 1 << 18
LEVEL = 3
MARGIN = 0.005
PIECE = 4096


def folded(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "), " ")


def chosen(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", rows: int = ROWS, languages: int = LANGUAGES) -> DataFrame:
    """(k, lang, rank): the ids that the dictionaries are made of, at most rows x languages."""
    labelled = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{lang_col}`").alias("lang")).where("k is not null and lang is not null").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k")
    common = labelled.groupBy(F.col("lang").alias("own")).count().orderBy(F.desc("count"), "own").limit(languages)
    ranked = labelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    return ranked.join(F.broadcast(common), F.col("lang") == F.col("own"), "left_semi")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, dict_bytes: int = DICT_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionaries of the `languages` most frequent labels, from at most `rows` labelled texts of each and at most `dict_bytes` bytes."""
    # Of each text only the end can get into a dictionary; letters aren't shortened by more than a third in lower case.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.substring(F.col(f"`{text_col}`"), -4 * dict_bytes, 4 * dict_bytes).alias("text"))
    # At most rows x languages ids: a bounded side.
    found = texts.join(F.broadcast(chosen(docs, id_col, lang_col, rows, languages)), F.col("id") == F.col("k")).where("text is not null").select("lang", "rank", "text").collect()
    out: dict[str, bytes] = {}
    for lang, _, text in sorted(tuple(x) for x in found):
        out[lang] = out.get(lang, b"") + folded(pa.array([text]))[0].as_py().encode() + b" "
    # A dictionary's end is nearest to the text, so what is over the bound goes from its front.
    return {k: v[-dict_bytes:] for k, v in out.items()}


class Decider:
    def __init__(self, models: dict[str, bytes], margin: float = MARGIN) -> None:
        self.langs, self.margin = sorted(models), margin
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(models[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, margin) of each text."""
        best, margins = np.full(len(texts), -1), np.zeros(len(texts))
        if self.langs:
            for row, part in chunks(texts):
                best[row : row + len(part)], margins[row : row + len(part)] = self._part(part)
        return best, margins

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        best, margins = np.full(len(texts), -1), np.zeros(len(texts))
        plain = folded(texts)
        rows = np.flatnonzero(pc.binary_length(plain).to_numpy(zero_copy_only=False))
        sizes = np.zeros((len(rows), len(self.langs)))
        for i, r in enumerate(rows):
            raw = memoryview(plain[int(r)].as_buffer())
            pieces = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]
            for j, coder in enumerate(self.coders):
                sizes[i, j] = sum(len(coder.compress(p)) for p in pieces)
        if len(self.langs) == 1:
            best[rows], margins[rows] = 0, 1.0
            return best, margins
        if len(rows):
            two = np.partition(sizes, 1, axis=1)[:, :2]
            margins[rows] = (two[:, 1] - two[:, 0]) / two[:, 1]
            best[rows] = np.where(margins[rows] >= self.margin, sizes.argmin(1), -1)
            margins[rows] = np.round(margins[rows], 6)
        return best, margins


def identify(docs: DataFrame, models: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, predicted_lang, margin) of every row; predicted_lang is null where the text is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = Decider(shared.value, margin)
        names = pa.array([*decide.langs, None], pa.string())
        for b in batches:
            best, margins = decide(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), names.take(pa.array(best % len(names))), pa.array(margins)], names=["doc_id", "predicted_lang", "margin"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, predicted_lang string, margin double")


def keep_identified(docs: DataFrame, models: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of docs, with all their columns, whose language is found; the rejected go. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = Decider(shared.value, margin)
        for b in batches:
            yield b.filter(pa.array(decide(b.column(at))[0] >= 0))

    return docs.mapInArrow(tidy(run), docs.schema)
