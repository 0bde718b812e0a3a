import random

import pytest

from peerlens.llm import spans as S


def brute(rows, span):
    owners = {}
    for i, t in rows:
        if i is not None and t:
            for p in range(len(t) - span + 1):
                owners.setdefault(t[p : p + span], set()).add(i)
    out = set()
    for i, t in rows:
        if i is None or not t:
            continue
        now = None
        for p in range(len(t) - span + 1):
            if len(owners[t[p : p + span]]) > 1:
                if now and p <= now[1]:
                    now[1] = p + span
                else:
                    if now:
                        out.add((i, *now))
                    now = [p, p + span]
        if now:
            out.add((i, *now))
    return out


def run(spark, rows, span):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "r BIGINT, t STRING, id INT, key STRING")
    got = [tuple(x) for x in S.shared_spans(df, "r", "t", span).collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_rows(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abc déé漢😀\n") for _ in range(n))
    shared = [make(rng.randrange(10, 80)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.4 else make(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 7))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 90), (104, rows[0][1]), (None, rows[1][1]), (105, "ab" * 100), (106, "ba" * 70)]
    return rows + rows[:3]


@pytest.mark.parametrize("seed", range(4))
def test_all_stretches(spark, seed):
    rows = random_rows(seed)
    assert run(spark, rows, 20) == brute(rows, 20)


def test_repeats_within_one_row_are_not_shared(spark):
    assert run(spark, [(1, "abcdefghij" * 10), (1, "abcdefghij" * 10), (2, "zyx" * 30)], 20) == set()


def test_hot_copies(spark):
    text = "".join(random.Random(9).choice("abcdef ") for _ in range(90))
    rows = [(i, text) for i in range(40)] + [(99, "prefix " + text[10:60])]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_share_and_empty(spark):
    df = spark.createDataFrame([(1, "x" * 5 + "q" * 30), (2, "q" * 30), (3, ""), (4, None)], "r BIGINT, t STRING")
    got = {r.r: (r.n_chars, r.shared_chars, r.share) for r in S.shared_share(df, "r", "t", 20).collect()}
    assert got == {1: (35, 30, 0.857143), 2: (30, 30, 1.0), 3: (0, 0, None), 4: (None, 0, None)}
    assert S.shared_spans(df.where("r > 9"), "r", "t", 20).collect() == []


@pytest.mark.parametrize("crowded", [0, 2, 10_000])
def test_crowded_keys_take_another_way_to_the_same_result(spark, crowded):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = make(33)
    rows = [(i, make(rng.randrange(5, 30)) + passage[: rng.randrange(20, 34)] + make(rng.randrange(5, 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "r BIGINT, t STRING")
    assert {tuple(x) for x in S.shared_spans(df, "r", "t", 20, crowded).collect()} == brute(rows, 20)
