import random

import pytest

from peerlens.llm import splitting as S

SPACE = " \t\r\n"


def stated(text):
    """The stated rule, character by character."""
    n, kinds = len(text), {}
    for p in range(1, n):
        if text[p - 1] in SPACE and text[p] not in SPACE:
            a = p
            while a > 0 and text[a - 1] in SPACE:
                a -= 1
            if a == 0:
                continue
            before = text[:a]
            ends = before[-1] in ".!?" or len(before) > 1 and before[-1] in "\"')”’" and before[-2] in ".!?"
            kinds[p] = 2 if text[a:p].count("\n") >= 2 else 1 if ends else 0
    s, out = 0, []
    while n - s > 2000:
        e = s + 2000
        for kind in (2, 1, 0):
            at = [p for p in kinds if kinds[p] == kind and s + 1000 < p <= s + 2000]
            if at:
                e = max(at)
                break
        out.append((s, e))
        again = [p for p in kinds if e - 200 <= p <= e - 1]
        s = min(again) if again else e - 200
    return [*out, (s, n)]


def random_text(rng, n):
    words = ["a", "word", "long" * 30, "end.", 'said."', "x!)", "é漢字", "y?’", " ", "z:" * 700]
    gaps = [" "] * 9 + ["\n", "\r\n", "\n\n", "\r\n\r\n", "\t ", " \n \n"]
    out = ""
    while len(out) < n:
        out += rng.choice(words[: rng.choice([3, 9, 10])]) + rng.choice(gaps)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_both_ways_give_the_stated_rule(seed):
    text = random_text(random.Random(seed), 2001 + 1500 * seed)
    assert S.split_forward(text, 2000, 1000, 200) == stated(text)
    assert S.split_stitched(text, 2000, 1000, 200) == stated(text)


@pytest.mark.parametrize("seed", range(60))
def test_stitched_is_forward(seed):
    rng = random.Random(seed)
    text = random_text(rng, rng.randrange(200, 6000))
    limit = rng.randrange(60, 400)
    least = rng.randrange(limit // 3, limit)
    overlap = rng.randrange(0, least)
    if len(text) > limit:
        assert S.split_stitched(text, limit, least, overlap) == S.split_forward(text, limit, least, overlap)


@pytest.mark.parametrize("text", ["x" * 7001, " " * 5000, "\n\n" + "a b. " * 900 + "\n\n", "word " * 500])
def test_odd_texts(text):
    assert S.split_forward(text, 2000, 1000, 200) == S.split_stitched(text, 2000, 1000, 200) == stated(text)


@pytest.mark.parametrize("seed", range(6))
def test_bisection_covers_within_the_limit(seed):
    text = random_text(random.Random(seed), 9000 + seed)
    pieces = S.split_even(text, 2000, 1000, 200)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= 2000 for a, b in pieces)
    assert all(0 < prev[1] - nxt[0] <= 200 for prev, nxt in zip(pieces, pieces[1:]))


def test_operator(spark):
    long = "漢 " * 1500
    rows = [(1, long, 0, "a"), (1, long, 0, "a"), (2, None, 1, "b"), (3, "", 1, "b"), (4, "x" * 2000, 1, "c"), (None, long, 1, "d")]
    df = spark.createDataFrame(rows, "k BIGINT, t STRING, id INT, start_pos STRING")
    got = sorted(map(tuple, S.split_oversized(df, "k", "t").collect()))
    assert got == [(1, *p) for p in stated(long)]
    assert S.split_oversized(df.where("k > 9"), "k", "t", method="even").collect() == []
