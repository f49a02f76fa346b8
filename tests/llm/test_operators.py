"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from termforge.llm import cover_tree, langid, ngram, packing, sentencepiece as pieces, simhash, substring_index, suffix_dedup, token_counts, topk
from termforge.llm.queries import MODEL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, bucket string, node string, class string, d string"
WORDS = [f"w{i}" for i in range(400)]


def texts():
    rng = random.Random(5)
    passage = " ".join(rng.choices(WORDS, k=70))
    base = [" ".join(rng.choices(WORDS, k=rng.randint(3, 200))) for _ in range(30)]
    near = base[0].split()
    out = [None, "", " \n\t ", "x", "Ünïcode  ▁ 漢字 🙂  two  spaces ", *base, *base[:3], " ".join([*near[:-1], "changed"])]
    out += [f"{' '.join(rng.choices(WORDS, k=40))} {passage} {' '.join(rng.choices(WORDS, k=40))}" for _ in range(3)]
    return [*out, " ".join(rng.choices(WORDS, k=40_000)), "the same " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), "h", "b", "n", "c", "d") for i, t in enumerate(texts())]
    rows += [(None, "a text without an id", None, None, None, None, None, None, None, None), rows[6], rows[6]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, column):
    return sorted(((r["doc_id"], r[column]) for r in df.collect()), key=repr)


def test_token_counts_and_encoding_are_the_librarys(odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = odd.collect()
    coded = {r["doc_id"]: None if r["text"] is None else sp.encode(r["text"]) for r in rows}
    want = sorted(((r["doc_id"], coded[r["doc_id"]]) for r in rows), key=repr)
    assert by_id(pieces.encode(odd, MODEL), "token_ids") == want
    assert by_id(token_counts.count_tokens(odd, MODEL), "n_tokens") == sorted(((k, None if v is None else len(v)) for k, v in want), key=repr)
    text = sorted(((k, None if v is None else sp.decode(v)) for k, v in want), key=repr)
    assert by_id(pieces.encode(odd, MODEL), "decoded") == text
    assert by_id(pieces.decode(pieces.encode(odd, MODEL), MODEL), "decoded") == text
    assert pieces.encode(none, MODEL).count() == token_counts.count_tokens(none, MODEL).count() == 0


def test_fingerprints_do_not_depend_on_the_slice():
    some = [t for t in texts() if t]
    high, low, _ = simhash.fingerprints(pa.array(some * 3))
    for i, t in enumerate(some):
        h, l, _ = simhash.fingerprints(pa.array([t]))
        assert (h[0], l[0]) == (high[i], low[i]) == (high[i + len(some)], low[i + len(some)])


def grouped(prints, distance):
    """doc -> least doc of its component, by comparing all pairs."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in prints.items():
        for b, y in prints.items():
            if a < b and bin(x ^ y).count("1") <= distance and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in prints if find(d) != d}


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_simhash_groups(spark, odd, source):
    docs = odd if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    unsigned = lambda x: x & (2**64 - 1)
    prints = {r["doc_id"]: unsigned(r["high"]) << 64 | unsigned(r["low"]) for r in simhash.fingerprint_table(docs).collect()}
    want = grouped(prints, simhash.DISTANCE)
    got = {r["doc_id"]: r["kept_doc_id"] for r in simhash.near_duplicates(docs).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and want
    if source == "odd":
        # Ids 5, 6, 7 have copies in 35, 36, 37, and 38 is a near copy of 5.
        assert {35: 5, 36: 6, 37: 7, 38: 5}.items() <= got.items()


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0


def test_language_on_held_out_texts(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models, fitted = langid.fit(docs, rows=40), langid.chosen(docs, rows=40).select("k")
    out = langid.identify(docs, models).join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    # Texts that are in no dictionary, nor equal to one that is.
    text_of = docs.select("doc_id", "text")
    seen = text_of.join(fitted, F.col("doc_id") == F.col("k"), "left_semi").select("text").distinct()
    held_out = out.join(text_of.join(seen, "text", "left_anti").select("doc_id"), "doc_id", "left_semi").where("n_chars >= 200").collect()
    kept = [r for r in held_out if r["predicted_lang"] is not None]
    assert len(held_out) > 500 and len(kept) >= 0.97 * len(held_out)
    assert np.mean([r["predicted_lang"] == r["lang"] for r in kept]) >= 0.95
    got = {r["doc_id"]: r for r in langid.identify(odd, models).collect()}
    assert all(got[i]["predicted_lang"] is None and got[i]["margin"] == 0 for i in (0, 1, 2))
    assert langid.identify(odd, models).count() == odd.count()
    kept = langid.keep_identified(odd, models)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted_lang"] is not None for r in langid.identify(odd, models).collect())
    assert langid.identify(none, models).count() == 0 and langid.fit(none) == {}
    assert all(r["predicted_lang"] is None for r in langid.identify(odd, {}).collect())


def test_language_by_sizes(spark):
    """Against sizes taken one by one; equal ones are a tie, which is rejected."""
    models = {"aa": b"the cat sat on the mat and the dog ran to the house " * 20, "bb": b"le chat est sur le tapis et le chien court vers la maison " * 20}
    texts = ["The CAT sat; on the mat 12 times", "le chien court!", "zqj", "the cat " * 3000, "", None]
    coders = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k, v in models.items()}
    want = []
    for t in texts:
        plain = re.sub(r"[^a-z]+", " ", (t or "").lower()).strip().encode()
        sizes = sorted((sum(len(c.compress(plain[i : i + 4096])) for i in range(0, len(plain), 4096)), k) for k, c in coders.items())
        want.append(sizes[0][1] if plain and (sizes[1][0] - sizes[0][0]) / sizes[1][0] >= langid.MARGIN else None)
    assert want[:2] == ["aa", "bb"] and want[4:] == [None, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["predicted_lang"] for r in sorted(langid.identify(docs, models).collect())] == want
    same = langid.identify(docs, {"aa": models["aa"], "bb": models["aa"]}).collect()
    assert all(r["predicted_lang"] is None and r["margin"] == 0 for r in same)
    # Many labels: only so many languages get a dictionary.
    many = spark.createDataFrame([(i, f"text number {i}", f"l{i}") for i in range(60)], "doc_id bigint, text string, lang string")
    assert len(langid.fit(many, languages=10)) == 10


def repeats_of(docs, words):
    """(doc, start, end, first doc) of maximal repeated passages, window by window."""
    split = {}
    for d, t in docs:
        split.setdefault(d, [])
        if t:
            split[d].append(t.split())
    first, out = {}, []
    for d in sorted(split):
        for ws in split[d]:
            for s in range(len(ws) - words + 1):
                first.setdefault(tuple(ws[s : s + words]), d)
    for d in sorted(split):
        found = {s: first[tuple(ws[s : s + words])] for ws in split[d] for s in range(len(ws) - words + 1) if first[tuple(ws[s : s + words])] < d}
        spans = []
        for s in sorted(found):
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], s + words, min(spans[-1][2], found[s]))
            else:
                spans.append((s, s + words, found[s]))
        out += [(d, *x) for x in spans]
    return sorted(out)


def test_repeated_passages(odd, none):
    want = repeats_of([(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()], 50)
    assert len(want) >= 5
    assert sorted(map(tuple, suffix_dedup.repeats(odd).collect())) == want
    for batches in (1, 3):
        assert sorted(map(tuple, substring_index.repeats(odd, batches=batches).collect())) == want
    assert suffix_dedup.repeats(none).count() == substring_index.repeats(none).count() == 0


def test_remove_repeats(odd, none):
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and suffix_dedup.remove_repeats(none).count() == 0
    spans = {}
    for d, s, e, _ in repeats_of([(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()], 50):
        spans.setdefault(d, []).append((s, e))
    want = []
    for r in odd.collect():
        gone = {i for s, e in spans.get(r["doc_id"], []) for i in range(s, e)}
        left = [w for i, w in enumerate((r["text"] or "").split()) if i not in gone]
        if not gone or left:
            want.append((r["doc_id"], left))
    got = [(r["doc_id"], (r["text"] or "").split()) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["doc_id"] in spans)


@pytest.mark.parametrize("window", [64, 8192])
def test_packing_covers_every_byte_once(odd, none, window):
    out = packing.pack(odd, window=window).collect()
    sizes = Counter(len(r["text"].encode()) + 1 for r in odd.where("doc_id is not null and text is not null").collect())
    whole = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["copy"], r["piece"])):
        assert r["start"] == whole.get((r["doc_id"], r["copy"]), 0) and r["length"] >= 1
        whole[r["doc_id"], r["copy"]] = r["start"] + r["length"]
    assert Counter(whole.values()) == sizes
    packs = Counter()
    for r in out:
        packs[r["pack_id"]] += r["length"]
    assert max(packs.values()) <= window and sorted(packs) == list(range(len(packs)))
    assert len(packs) <= 1.15 * sum(packs.values()) / window + 2
    assert packing.pack(none).count() == 0


def test_packing_plans_against_all_packings():
    rng = random.Random(12)

    def least(pieces, room):
        """Packs that the pieces need, with this much room in the last one, by trying all."""
        if not pieces:
            return 0
        best = 1 + least(pieces[1:], 12 - pieces[0])  # in a new pack
        for i, p in enumerate(pieces):
            if p <= room and p not in pieces[:i]:
                best = min(best, least(pieces[:i] + pieces[i + 1 :], room - p))
        return best

    over = 0
    for _ in range(25):
        pieces = tuple(sorted((rng.randint(1, 12) for _ in range(7)), reverse=True))
        packs = packing.plan(np.bincount(pieces, minlength=13))
        assert Counter(c for way, times in packs for c in way * times) == Counter(pieces) and all(sum(way) <= 12 for way, _ in packs)
        over += sum(times for _, times in packs) - least(pieces, 0)
    assert 0 <= over <= 2


def test_packing_by_a_column_of_lengths(spark):
    rows = [(1, None, 5, "a"), (2, "text", None, "b"), (3, "text", 0, "c"), (4, "", 20, "d"), (4, "", 20, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, split string")
    out = sorted((r["doc_id"], r["copy"], r["piece"], r["start"], r["length"]) for r in packing.pack(docs, length_col="n", window=16).collect())
    assert out == [(1, 0, 0, 0, 5), (4, 0, 0, 0, 16), (4, 0, 1, 16, 4), (4, 1, 0, 0, 16), (4, 1, 1, 16, 4)]


def test_ngram_scores(spark, odd, none):
    rng = random.Random(3)
    items = ["", None, "never seen words", texts()[5], texts()[7][:300], "the same the same the", " ".join(rng.choices(WORDS, k=20)), texts()[5]]
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    corpus = [t.split() for (t,) in odd.select("text").collect() if t]
    counts = Counter(tuple(ws[i : i + n]) for ws in corpus for i in range(len(ws)) for n in range(1, 260) if i + n <= len(ws) and (len(ws) < 1000 or n <= 12))
    followed = Counter(tuple(ws[i : i + n]) for ws in corpus for i in range(len(ws)) for n in range(1, 260) if i + n < len(ws) and (len(ws) < 1000 or n <= 12))
    total = sum(map(len, corpus))
    got = {r["item_id"]: r for r in ngram.score(table, odd, shard_bytes=4000).collect()}
    for i, t in enumerate(items):
        if t is None:
            assert got[i]["n_words"] is None and got[i]["log2_probability"] is None
            continue
        ws, log = t.split(), 0.0
        for k, w in enumerate(ws):
            p = (counts[(w,)] + 1 / (total + 1)) / (total + 1)
            n = 1
            while n <= k and followed[tuple(ws[k - n : k])]:
                p = (counts[tuple(ws[k - n : k + 1])] + p) / (followed[tuple(ws[k - n : k])] + 1)
                n += 1
            log += math.log2(p)
        assert got[i]["n_words"] == len(ws) and got[i]["log2_probability"] == pytest.approx(log, abs=1e-5)
        assert (got[i]["perplexity"] is None) == (not ws)
    assert ngram.score(table.limit(0), odd).count() == 0
    assert {r["log2_probability"] for r in ngram.score(table, none).collect()} == {None, 0.0}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:60] = v[40:50] + 0.01
    v[60:63] = v[40]
    rows = [(i, x.tolist(), "p", "c") for i, x in enumerate(v)]
    rows += [(300, None, "p", "c"), (301, [], "p", "c"), (302, [0.0] * 8, "p", "c"), (303, [float("nan")] * 8, "p", "c"), (304, [1.0, None], "p", "c"), (305, [1.0, 2.0], "p", "c"), (None, [1.0] * 8, "p", "c"), rows[0]]
    return v.astype(np.float64), spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, pivot string, cell string")


def classes_of(near):
    """(class, links) of each row of a matrix of links, by following them."""
    root = list(range(len(near)))
    while True:
        new = [min(root[j] for j in [i, *np.flatnonzero(near[i])]) for i in range(len(near))]
        if new == root:
            return {i: (r, int(near[i].sum())) for i, r in enumerate(root)}
        root = new


@pytest.mark.parametrize("cell", [None, 40])
def test_near_classes(vectors, cell):
    v, rows = vectors
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for threshold in (0.9, 0.5):
        near = np.round(u @ u.T, 10) >= threshold
        np.fill_diagonal(near, False)
        got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in cover_tree.near_classes(rows, threshold, cell=cell).collect()}
        assert got == classes_of(near) | {305: (305, 0)}
        # Equal vectors are one node of the pairs.
        least = [min(j for j in range(len(v)) if (v[j] == v[i]).all()) for i in range(len(v))]
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1))) if least[i] == i and least[j] == j}
        pairs = [(r["vec_a"], r["vec_b"]) for r in cover_tree.near_pairs(rows, threshold, cell=cell).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) >= 10
    assert cover_tree.near_classes(rows.limit(0)).count() == cover_tree.near_pairs(rows.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [2, 8, 64])
def test_cover_tree_holds_its_bounds_and_finds_all_links(dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(700, dim))
    v[:300] = v[300] + rng.normal(size=(300, dim)) * rng.random((300, 1)) * 0.1  # a dense cluster, a hot pivot
    v /= np.linalg.norm(v, axis=1)[:, None]
    times, ids = rng.integers(1, 4, 700), np.arange(700)
    tree = cover_tree.build(ids, times, v)
    assert sorted(tree.ids.tolist()) == ids.tolist()
    for s, e, r in zip(tree.start, tree.end, tree.radius):
        assert cover_tree.distances(tree.v[s : s + 1], tree.v[s:e]).max() <= r + cover_tree.SLACK
    for threshold in (0.98, 0.7, -0.2, 1.0):
        near = np.round(v @ v.T, 10) >= threshold
        found = cover_tree.Links(tree, tree, True, threshold, False).run()
        assert dict(zip(tree.ids.tolist(), np.cumsum(found.left[:-1]).tolist())) == dict(enumerate((near * times).sum(1).tolist()))
        one, two = cover_tree.build(ids[:350], times[:350], v[:350]), cover_tree.build(ids[350:], times[350:], v[350:])
        pairs = cover_tree.pairs_of(cover_tree.Links(one, two, False, threshold, True).run())
        assert sorted(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())) == [(i, j + 350) for i, j in zip(*np.nonzero(near[:350, 350:]))]


def test_top_k(vectors):
    v, rows = vectors
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ u.T, 10)
    np.fill_diagonal(s, -9)
    for every, tile, tile_bytes in ((20, 2048, 64 << 20), (20, 32, 512), (1, 32, 4096), (1000, 32, 4096)):
        want = {(i, k + 1): (j, s[i, j]) for i in range(0, len(v), every) for k, j in enumerate(sorted(range(len(v)), key=lambda j: (-s[i, j], j))[:5])}
        got = {(r["query_id"], r["rank"]): (r["neighbour_id"], pytest.approx(r["similarity"], abs=1e-6)) for r in topk.search(rows, 5, every=every, tile=tile, tile_bytes=tile_bytes).collect()}
        assert got == want
    assert topk.search(rows.limit(0)).count() == topk.search(rows.where("vec_id = 1")).count() == topk.search(rows.where("vec_id = 20")).count() == 0
