"""The recursion with several levels and with lists that go on by themselves, against all pairs; the distance on generated copies."""

import random

import numpy as np
import pyarrow as pa
import pytest

from termforge.llm import simhash
from termforge.llm.components import joined


def prints(bits):
    return np.packbits(bits, axis=1).view(np.uint64).T


def planted(n, near, seed):
    """Random fingerprints, of which the first `near` have a copy at up to the full distance, at the end."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n, 128), np.uint8)
    for i in range(near):
        bits[n - near + i] = bits[i]
        bits[n - near + i, rng.permutation(128)[: rng.integers(1, simhash.DISTANCE + 1)]] ^= 1
    return bits


def roots_of(spark, bits, **how):
    high, low = prints(bits)
    nodes = spark.createDataFrame([(i, int(h), int(l)) for i, (h, l) in enumerate(zip(high.view(np.int64), low.view(np.int64)))], "node bigint, high bigint, low bigint")
    edges = [(r["a"], r["b"]) for r in simhash.close_edges(nodes, **how).collect()]
    apart = (bits[[a for a, _ in edges]] != bits[[b for _, b in edges]]).sum(1)
    x, y = (np.array([e[k] for e in edges], np.int64) for k in range(2))
    return joined(len(bits), x, y), apart


def test_plan_goes_deeper_with_the_number():
    depths = [len(simhash.plan(n)) for n in (simhash.SMALL, 10**5, 10**8, 10**10)]
    assert depths[0] == 0 and depths == sorted(depths) and depths[-1] >= 3
    for n in (10**5, 10**7, 10**9):
        length = n
        for level in simhash.plan(n):
            length *= level.share
        assert length <= simhash.SMALL


@pytest.mark.parametrize("how", [simhash.Level(13, 5, 100, 0.19), simhash.Level(11, 18, 60, 0.055)])
def test_levels_find_the_pairs(spark, monkeypatch, how):
    bits = planted(500, 150, 6)
    steps = (how, simhash.Level(how.bound, how.centres, 1, how.share)) if how.bound == 13 else (how,)
    monkeypatch.setattr(simhash, "plan", lambda n, *_: steps if n > 100 else ())
    root, _ = roots_of(spark, bits)
    found = sum(root[i] == root[350 + i] for i in range(150))
    assert found >= 0.97 * 150 and len(np.unique(root)) == 500 - found


def test_no_list_over_the_bound_is_compared(spark, monkeypatch):
    # A third of all are within a few bits of one another, so no strip parts them; lists may hold 60.
    bits, rng = planted(450, 80, 9), np.random.default_rng(1)
    cluster = bits[:1].repeat(150, 0)
    for row in cluster[1:]:
        row[rng.permutation(128)[:6]] ^= 1
    bits = np.concatenate([bits, cluster])
    bits = np.unique(bits, axis=0)[rng.permutation(len(np.unique(bits, axis=0)))]
    seen = []

    class Seen(simhash.Lists):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append(self)

    monkeypatch.setattr(simhash, "Lists", Seen)
    monkeypatch.setattr(simhash, "plan", lambda n, *_: (simhash.Level(13, 5, 30, 0.19),))
    root, _ = roots_of(spark, bits, hot=60)
    i, j = np.nonzero(np.triu((bits[:, None] != bits[None]).sum(2) <= simhash.DISTANCE, 1))
    assert (root[i] == root[j]).mean() >= 0.97 and len(i) > 10_000
    # What each list compares: its rest with itself and with what is near the pivot.
    hot, sizes = seen[0].hot, {}
    for number, rows, near in seen[0].members(*prints(bits)):
        sizes.setdefault(number, [0, 0])[near] += len(rows)
    assert len(hot) >= 30 and max(map(sum, sizes.values())) <= 100 and max(h.near_parts for h in hot.values()) > 1


def test_list_of_close_pairs_is_a_forest():
    bits = planted(300, 100, 4)
    high, low = prints(bits)
    a, b = simhash.close_in(high, low, simhash.DISTANCE, block=64)
    i, j = np.nonzero(np.triu((bits[:, None] != bits[None]).sum(2) <= simhash.DISTANCE, 1))
    assert (joined(300, a, b) == joined(300, i, j)).all() and len(a) <= 299


def test_distance_on_generated_copies():
    """Another set than those by which the distance was chosen."""
    rng = random.Random(303)
    words, weight = [f"w{i}" for i in range(5000)], [1 / (i + 3) for i in range(5000)]
    base = [rng.choices(words, weight, k=rng.randint(30, 400)) for _ in range(500)]

    def edited(text, share):
        text = list(text)
        for _ in range(max(1, round(share * len(text)))):
            k = rng.randrange(len(text))
            if rng.random() < 0.6:
                text[k] = rng.choices(words, weight)[0]
            elif rng.random() < 0.5:
                del text[k]
            else:
                text.insert(k, rng.choices(words, weight)[0])
        return text

    def bits_of(texts):
        high, low, _ = simhash.fingerprints(pa.array([" ".join(t) for t in texts]))
        return np.unpackbits(np.stack([high, low], 1).view(np.uint8), axis=1)

    own = bits_of(base)
    assert ((own[:, None] != own[None]).sum(2)[np.triu_indices(500, 1)] > simhash.DISTANCE).all()
    for share, least in ((0.02, 0.99), (0.05, 0.97)):
        assert ((own != bits_of([edited(t, share) for t in base])).sum(1) <= simhash.DISTANCE).mean() >= least
