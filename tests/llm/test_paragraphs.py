import random

from peerlens.llm import paragraphs as P


def test_paragraph_positions(spark):
    text = "one\n\ntwo\r\n \r\n\r\nthree\n  \n"
    df = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9), (4, " \n\n ", 9)], "k BIGINT, t STRING, id INT")
    got = P.paragraphs(df, "k", "t").collect()
    assert [(r.k, r.paragraph, text[r.start_pos : r.end_pos]) for r in got] == [(1, 0, "one"), (1, 1, "two"), (1, 2, "three")]
    assert P.paragraphs(df.where("k > 9"), "k", "t").collect() == []


def test_components_are_those_of_the_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for e in edges for x in e if e[0] != e[1] or any(x in f and f[0] != f[1] for f in edges)}
    got = {r.node: r.root for r in P.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"), "a", "b").collect()}
    assert got == want
    assert P.components(spark.createDataFrame([], "a BIGINT, b BIGINT"), "a", "b").collect() == []


def test_clusters(spark):
    w = [f"word{i}" for i in range(60)]
    same, near, other = " ".join(w), " ".join(w[:-1] + ["changed"]), " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{same}\n\nshort"), (2, f"{other}\n\n{near}"), (3, same), (3, same), (4, None)], "k BIGINT, t STRING")
    got = {(r.k, r.paragraph): (r.cluster, r.removable) for r in P.shared_paragraphs(df, "k", "t").collect()}
    assert got == {(1, 0): ("1:0", False), (2, 1): ("1:0", True), (3, 0): ("1:0", True)}


def test_short_equal_paragraphs_are_clusters(spark):
    df = spark.createDataFrame([(1, "a few words\n\nalone"), (2, "漢字\n\na few words"), (3, "漢字\n\nA few words"), (4, "x\n\nx")], "k BIGINT, t STRING")
    got = {(r.k, r.paragraph): (r.cluster, r.removable) for r in P.shared_paragraphs(df, "k", "t").collect()}
    assert got == {(1, 0): ("1:0", False), (2, 1): ("1:0", True), (2, 0): ("2:0", False), (3, 0): ("2:0", True), (4, 0): ("4:0", False), (4, 1): ("4:0", True)}
