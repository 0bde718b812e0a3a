import numpy as np
import pytest

from peerlens.llm import neighbors as N


def brute(rows, dim, k, least):
    """Pairs by comparing everything with everything."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and np.any(v):
            good.setdefault(i, np.asarray(v, np.float32).astype(float))
    out = set()
    for i, x in good.items():
        near = []
        for j, y in good.items():
            if i != j:
                s = round(float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), 6)
                near.append((-s, j))
        out |= {(min(i, j), max(i, j)) for s, j in sorted(near)[:k] if -s >= least}
    return out


def clustered(n, dim, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(1, n // 15), dim))
    return (centre[rng.integers(0, len(centre), n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


SCHEMA = "id BIGINT, vec ARRAY<FLOAT>, home STRING, other INT"


def pairs(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in N.neighbour_pairs(df, "id", "vec", **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_exact_in_one_leaf_with_bad_rows(spark):
    x = clustered(200, 8, 1)
    rows = list(enumerate(x)) + list(enumerate(x[:30]))  # delivered twice
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (None, x[0]), (905, [None] + [1.0] * 7), (906, 3 * x[0])]
    assert pairs(spark, rows, dim=8, k=5, least=0.9) == brute(rows, 8, 5, 0.9)


def test_recall_over_many_leaves(spark):
    x = clustered(1200, 16, 2)
    rows = list(enumerate(x))
    want = brute(rows, 16, 5, 0.9)
    got = pairs(spark, rows, dim=16, k=5, least=0.9, leaf_size=50, branch=16)
    assert len(want & got) >= 0.98 * len(want)


def test_equal_vectors_in_a_third_of_the_rows(spark):
    x = clustered(300, 8, 3)
    x[:100] = x[0]
    rows = list(enumerate(x))
    assert pairs(spark, rows, dim=8, k=4, least=0.9, leaf_size=2000) == brute(rows, 8, 4, 0.9)
    got = pairs(spark, rows, dim=8, k=4, least=0.9, leaf_size=60, branch=8)
    assert {p for p in brute(rows, 8, 4, 0.9) if p[1] < 100} <= got


def test_empty_table(spark):
    assert pairs(spark, [], dim=8) == set()
    assert pairs(spark, [(1, None)], dim=8) == set()
    assert pairs(spark, [(1, [1.0] * 8)], dim=8) == set()


def test_search_visits_all_leaves_without_margin():
    x = N._unit(clustered(500, 8, 4))
    tree = N.Tree.fit(x, 20, 4)
    leaves = int((tree.count == 0).sum())
    q, leaf, needed = tree.search(x[:50], np.inf, leaves)
    assert leaves > 10
    assert all(len(set(leaf[q == i])) == leaves for i in range(50))
    assert all((np.diff(needed[q == i]) >= 0).all() for i in range(50))


@pytest.mark.parametrize("n", [1, 2, 7])
def test_tree_of_equal_points_is_one_leaf(n):
    tree = N.Tree.fit(np.ones((n, 4), np.float32), 1, 4)
    assert (tree.count == 0).all() or n > 1


def test_crowds_keep_the_best(spark):
    rng = np.random.default_rng(6)
    x = (np.ones(8) + 0.05 * rng.normal(size=(400, 8))).astype(np.float32)
    rows = list(enumerate(x))
    assert pairs(spark, rows, dim=8, k=3, least=0.9, leaf_size=1000) == brute(rows, 8, 3, 0.9)


def test_visits_are_widened_until_the_recall_is_reached(spark, monkeypatch):
    """All vectors are near copies of one: their neighbours lie in far more leaves than are visited at first."""
    rng = np.random.default_rng(7)
    rows = list(enumerate((np.ones(16) + 0.1 * rng.normal(size=(1200, 16))).astype(np.float32)))
    want = brute(rows, 16, 5, 0.9)
    monkeypatch.setattr(N, "VISITORS", 100)
    monkeypatch.setattr(N, "VISITS", 4000)
    got = pairs(spark, rows, dim=16, k=5, least=0.9, leaf_size=20, branch=64, most=2)
    assert len(want & got) >= 0.98 * len(want)


def test_few_true_pairs_are_found_all(spark):
    """Two of a hundred vectors have a neighbour, so that the first calibrating vectors show none."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, 32))
    x[-8:] = x[:8] + 0.5 * rng.normal(size=(8, 32))
    rows = list(enumerate(x.astype(np.float32)))
    want = brute(rows, 32, 5, 0.85)
    assert len(want) >= 5
    assert pairs(spark, rows, dim=32, k=5, least=0.85, leaf_size=8, branch=128, calibrate=4) == want


@pytest.mark.parametrize("leaf_size", [60, 2000])
def test_leaves_in_parts(spark, leaf_size):
    """Two thirds of the vectors are near copies, in leaves of many parts each."""
    rng = np.random.default_rng(9)
    x = np.concatenate([np.ones((600, 16)) + 0.2 * rng.normal(size=(600, 16)), rng.normal(size=(300, 16))]).astype(np.float32)
    x[50:60] = x[0]
    rows = list(enumerate(x))
    want = brute(rows, 16, 5, 0.9)
    got = pairs(spark, rows, dim=16, k=5, least=0.9, leaf_size=leaf_size, branch=8, part=25)
    assert got == want if leaf_size == 2000 else len(want & got) >= 0.98 * len(want)


def test_queue_grows():
    x = N._unit(clustered(600, 8, 5))
    tree = N.Tree.fit(x, 4, 3)
    q, leaf, _ = tree.search(x[:20], np.inf, 6)
    near = [np.argsort(((x[i] - tree.centroids[tree.count == 0]) ** 2).sum(axis=1))[:1] for i in range(20)]
    assert (np.bincount(q) == 6).all() and len(near) == 20
    assert all(len(set(leaf[q == i])) == 6 for i in range(20))
