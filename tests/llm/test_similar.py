import random
import re

import numpy as np
import pyarrow as pa
import pytest

from peerlens.llm import similar as S
from peerlens.llm.queries import p4_found


def shingles(text, n):
    w = re.findall("[a-z0-9]+", text.lower())
    return frozenset(zip(*(w[i:] for i in range(n)))), len(w)


def brute(rows, n, threshold, least):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None:
            s, k = shingles(t, n)
            if k >= least:
                sets[i] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(15, 120))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(w) // 8)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(3)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "r BIGINT, t STRING, id STRING, rep DOUBLE")
    got = [tuple(x) for x in S.similar_pairs(df, "r", "t", **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("n, threshold", [(3, 0.6), (5, 0.8)])
def test_all_pairs(spark, n, threshold):
    rows = corpus(random.Random(n), 160) + [(900, None), (901, ""), (None, "a b c " * 20), (902, "too few words"), (903, "ＡＢ ｃ é ü 漢 " * 30)]
    rows += rows[:5]
    assert run(spark, rows, shingle=n, threshold=threshold) == brute(rows, n, threshold, 20)


def test_hot_class_is_a_star_and_keeps_links(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more words here"
    rows = [(i, text.upper() if i % 2 else text) for i in range(50)] + [(100, near), (101, near)]
    got = run(spark, rows, shingle=3, threshold=0.6)
    assert got == {(0, i) for i in range(1, 50)} | {(0, 100), (0, 101), (100, 101)}
    assert run(spark, rows, shingle=3, threshold=0.6, expand=1000) == brute(rows, 3, 0.6, 20)


def test_only_exact_copies_are_a_star(spark, tmp_path):
    """60 texts of the same words: 40 exact copies and 20 that differ in case or punctuation, and two near texts."""
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    rows = [(i, text) for i in range(40)] + [(40 + i, " ".join(words[:i]).upper() + "; " + " ".join(words[i:])) for i in range(20)]
    rows += [(100, text + " more words here"), (101, text + " More words, here")]
    spark.createDataFrame(rows, "row_id BIGINT, text_content STRING").write.parquet(str(tmp_path / "filing_item.parquet"))
    got = {tuple(r) for r in p4_found(spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a, b in brute(rows, 3, 0.6, 20) if b >= 40 and (a == 0 or a >= 40) or a == 0}


def test_blocks_of_a_hot_key(spark, monkeypatch):
    rng = random.Random(5)
    text = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(text)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(S, "BLOCK", 8)
    assert run(spark, rows, shingle=3, threshold=0.6) == brute(rows, 3, 0.6, 20)


def test_pairs_of_blocks_over_batches():
    """Small and large keys, keys in blocks, and batches that end anywhere."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (12, S.BITS // 8), dtype=np.uint8)
    rows, want = [], set()
    for key in range(60):
        n = int(rng.choice([1, 2, 3, 40, 70]))
        of, ids, parts = rng.integers(0, 12, n), rng.permutation(500)[:n], 3 if n == 70 else 1
        want |= {(min(a, b), max(a, b)) for a, x in zip(ids.tolist(), of) for b, y in zip(ids.tolist(), of) if x == y and a != b}
        rows += [(key, min(b, o), max(b, o), b, int(i), base[x].tobytes()) for x, i in zip(of, ids) for b in [int(i) % parts] for o in range(parts)]
    rows.sort(key=lambda r: r[:3])
    columns = ["key", "i", "j", "block", "id", "sketch"]
    for size in (7, 64, 10_000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in rows[a : a + size]]) for a in range(0, len(rows), size)]
        got = [(r["a"], r["b"]) for out in S._compare(10)(batches) for r in out.to_pylist()]
        assert set(got) == want


def test_empty(spark):
    assert run(spark, []) == set()


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for j in (0.6, 0.8, 0.95):
        both = int(round(2000 * j / (1 + j)))
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, 1000 - both, dtype=np.uint64)])
        x, y = S.odd_sketches(np.stack([S.min_hashes(s) for s in (a, b)]))
        bits = int(np.unpackbits(x ^ y).sum())
        assert abs(bits - S.differing_bits(j)) < 50
        assert bits <= S.sketch_limit(0.6)


def test_cells_hold_all_texts_of_an_id(spark, monkeypatch):
    """Many cells, and an id that comes with two texts, either of which makes it similar to others."""
    monkeypatch.setattr(S, "CELL", 5)
    rng = random.Random(11)
    rows = corpus(rng, 120)
    rows += [(0, rows[50][1]), (1, rows[60][1] + " more")]
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, 3))
    near = lambda x, y: x[1] >= 20 and y[1] >= 20 and len(x[0] & y[0]) >= 0.6 * len(x[0] | y[0]) - 1e-12
    want = {(a, b) for a in sets for b in sets if a < b and any(near(x, y) for x in sets[a] for y in sets[b])}
    assert run(spark, rows, shingle=3, threshold=0.6) == want
