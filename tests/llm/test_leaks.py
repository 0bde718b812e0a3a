import random
import re

import numpy as np
import pytest

from peerlens.llm import leaks as L
from peerlens.llm.kernels import Words


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def brute(docs, items, n):
    windows = {}
    for i, p in items:
        w = words(p)
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in windows.get(tuple(w[k : k + n]), ()) if d is not None and i is not None}
    return out


def data(seed):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40)))) for i in range(20)]
    items += [(5, items[6][1]), (None, items[0][1]), (77, None), (78, "")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            p = words(rng.choice(items[:20])[1])
            a = rng.randrange(len(p))
            w[10:10] = p[a : a + rng.randrange(5, 40)]
        docs.append((d, rng.choice([" ", "-", ".\n"]).join(w).upper() if d % 2 else " ".join(w)))
    return docs + [(100, None), (101, ""), (None, items[0][1]), docs[0], (102, "x " * 5000 + items[3][1])], items


def run(spark, docs, items, **options):
    a = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc BIGINT, t STRING, item STRING")
    b = spark.createDataFrame([(i, p, "y") for i, p in items], "num BIGINT, p STRING, id STRING")
    got = [tuple(r) for r in L.find_leaks(a, "doc", "t", b, "num", "p", **options).collect()]
    assert len(got) == len({g[:2] for g in got})
    return {g[:2] for g in got}


@pytest.mark.parametrize("seed", range(3))
def test_exact(spark, seed):
    docs, items = data(seed)
    assert run(spark, docs, items, words=8) == brute(docs, items, 8)


def test_items_in_blocks(spark):
    docs, items = data(7)
    assert run(spark, docs, items, words=8, block_items=5) == brute(docs, items, 8)


def test_empty_sides(spark):
    docs, items = data(1)
    assert run(spark, [], items) == set() == run(spark, docs, [])


def test_edited_windows_are_found(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(24))) for i in range(60)]
    docs = []
    for i, p in items:
        w = p.split()
        w[rng.randrange(24)] = "changed"
        docs.append((i, " ".join([rng.choice(vocabulary) for _ in range(30)] + w + [rng.choice(vocabulary) for _ in range(9)])))
    got = run(spark, docs, items, words=24, edits=1)
    assert all(d == i for d, i in got)
    assert len(got) >= 0.9 * len(items)


def test_equal_windows_collide_and_others_do_not():
    w = Words(["a b c d e f g", "x a b c d e f g", "a b c d e f h"])
    at = w.windows(7)
    keys = L.cgk_keys(w.hashes, at, 7, 0, 14)
    spelled = [w.spelled(int(i), 7) for i in at]
    same = [k for k, s in zip(keys, spelled) if s == "a b c d e f g"]
    assert len(same) == 2 and len(set(same)) == 1 and len(set(keys)) >= 3


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 4])
def test_edit_distances(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(0, 3, (200, 7)), rng.integers(0, 3, (200, 7))
    b[:60] = a[:60]
    b[20:40, 1:] = a[20:40, :-1]
    b[40:60, 3] = 9
    assert L.edit_distances(a, b, most).tolist() == [min(most + 1, plain_distance(x, y)) for x, y in zip(a.tolist(), b.tolist())]


@pytest.mark.parametrize("kind", ["replaced", "moved"])
def test_recall_of_two_edits(spark, kind):
    """One window each: two words replaced, or one put in and one taken out."""
    rng = random.Random(kind)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(24))) for i in range(1500)]
    docs = []
    for i, p in items:
        w = p.split()
        if kind == "replaced":
            for at in rng.sample(range(24), 2):
                w[at] = "changed"
        else:
            del w[rng.randrange(24)]
            w.insert(rng.randrange(24), "changed")
        docs.append((i, " ".join(w)))
    got = run(spark, docs, items, words=24, edits=2, sampled=8, recall=0.99)
    assert all(d == i for d, i in got)
    assert len(got) >= 0.98 * len(items)


def test_unusual_case_mapping():
    w = Words(["Kelvin İx ñA1"])  # these lower-case to ASCII letters
    assert [w.spelled(i, 1) for i in range(len(w.hashes))] == words("Kelvin İx ñA1")
    assert np.unique(w.hashes).size == len(set(words("Kelvin İx ñA1")))
