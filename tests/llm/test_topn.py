import random

import pyarrow as pa

from peerlens.llm import topn as T


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if i is not None and s is not None and s == s:
            of = best.setdefault(g, {})
            of[i] = max(of.get(i, s), s)
    return {(g, i, k + 1) for g, of in best.items() for k, (i, _) in enumerate(sorted(of.items(), key=lambda x: (-x[1], x[0]))[:n])}


def test_loser_tree_merges():
    rng = random.Random(1)
    runs = [sorted((rng.randrange(50), r) for _ in range(rng.randrange(9))) for r in range(7)]
    at = [0] * 7
    tree = T.LoserTree([r[0] if r else None for r in runs])
    out = []
    while not tree.done:
        w = tree.winner
        out.append(runs[w][at[w]])
        at[w] += 1
        tree.replay(runs[w][at[w]] if at[w] < len(runs[w]) else None)
    assert out == sorted(sum(runs, []))


def test_ties_repeats_nulls_and_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(("hot", 1), f"p{rng.randrange(4000):05}", float(rng.randrange(20))) for _ in range(6000)]
    rows += [((f"g{rng.randrange(300)}", rng.choice([None, 1, 2])), f"p{rng.randrange(40):05}", rng.choice([None, float("nan"), float("inf"), -float("inf"), 5.0, 7.0, 0.0, -0.0])) for _ in range(6000)]
    rows += [((None, None), None, 1.0), ((None, None), "a", 1.0)] + rows[:50]
    df = spark.createDataFrame([(g[0], g[1], i, s, "rank", 7) for g, i, s in rows], "g STRING, y INT, i STRING, s DOUBLE, item STRING, bucket INT").repartition(6)
    got = {((r.g, r.y), r.item, r["rank"]) for r in T.top_n_per_group(df, ["g", "y"], "i", "s", 10).collect()}
    assert got == brute(rows, 10)


def test_small_batches_are_runs(spark):
    rng = random.Random(3)
    rows = [((rng.randrange(5),), rng.randrange(900), rng.random()) for _ in range(3000)]
    df = spark.createDataFrame([(g[0], i, s) for g, i, s in rows], "g INT, i INT, s DOUBLE").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {((r.g,), r.item, r["rank"]) for r in T.top_n_per_group(df, ["g"], "i", "s", 7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute(rows, 7)


def test_pages_are_merged_as_they_come():
    """Pages by the hash of their first group, with groups of one hash and groups over several pages of a run."""
    rng = random.Random(5)
    rows = [((rng.randrange(40), rng.choice(["a", None])), rng.randrange(60), float(rng.randrange(9))) for _ in range(4000)]
    pages = []
    for r in range(9):
        run = sorted((g[0] // 3, str(g[1]), g[0], g, -s, i) for g, i, s in rows[r::9])
        for a in range(0, len(run), 17):
            part = run[a : a + 17]
            columns = [[x[0] for x in part], [x[3][0] for x in part], [x[3][1] for x in part], [x[5] for x in part], [-x[4] for x in part]]
            pages.append((part[0][0], pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.string()), pa.array(columns[3]), pa.array(columns[4], pa.float64())], ["hash", "g0", "g1", "item", "score"])))
    merger, out, most = T.Merger(7, ["g0", "g1"]), [], 0
    for first, page in sorted(pages, key=lambda x: x[0]):
        out += merger.before(first)
        merger.add(page)
        most = max(most, len(merger.open))
    out += merger.before(float("inf"))
    assert {((a, b), i, k) for a, b, i, _, k in out} == brute(rows, 7) and len(out) == len(set(out))
    assert most < len(pages) / 3 and not merger.open and not merger.codes


def test_empty(spark):
    df = spark.createDataFrame([], "g INT, i STRING, s DOUBLE")
    assert T.top_n_per_group(df, ["g"], "i", "s", 3).collect() == []


def test_padding(spark):
    df = spark.createDataFrame([("12",), (" 0000000012 ",), ("",), (None,), ("12345678901",)], "a STRING")
    assert [r[0] for r in df.select(T.padded_id(df.a)).collect()] == ["0000000012", "0000000012", None, None, "12345678901"]
