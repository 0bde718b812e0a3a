import random

import pytest

from peerlens.llm import truncation as T


def corpus(seed, n=700):
    rng = random.Random(seed)
    who = ["The company", "Our segment", "The board", "Management", "A large customer", "The auditor"]
    does = ["expects to reduce", "has increased", "may not recover", "believes in", "will report on", "does not disclose"]
    what = ["its operating expenses", "the value of inventory", "several pending claims", "revenue from licensing", "the cost of new facilities"]
    when = ["during the year", "in the next quarter", "as of December", "over several periods"]
    sentence = lambda: f"{rng.choice(who)} {rng.choice(does)} {rng.choice(what)} {rng.choice(when)}."
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(sentence() for _ in range(rng.randrange(3, 9)))
        ending = rng.random()
        if ending < 0.15:
            body = text[: rng.randrange(60, len(text) - 12)].rstrip(" .")
            if body[-1].isalpha() and text[len(body)] != ".":
                rows.append((i, body + rng.choice(["", "", "…", "...", " [more]", "  "]), "en", "s1"))
                cut.add(i)
                continue
        tail = "\n\nSIGNATURES" if ending < 0.3 else "\n\nExhibit 10.1" if ending < 0.4 else rng.choice(["", "", "\n"])
        rows.append((i, text + tail, rng.choice(["en", "EN", None]), "s2"))
    return rows, cut


def test_cut_texts(spark):
    rows, cut = corpus(1)
    rows += [(9001, None, "en", "s1"), (9002, "", "en", "s1"), (9003, " \n", "en", "s1"), (9004, "x", "en", "s1"), (9005, "…", "en", None), (None, "gone", "en", "s1")]
    df = spark.createDataFrame([(*r, "odds", 1) for r in rows], "k BIGINT, t STRING, l STRING, s STRING, key STRING, id INT")
    out = T.truncated(df, "k", "t", "l", "s").collect()
    assert len(out) == len({r.id for r in out}) and not {9001, 9002, 9003, None} & {r.id for r in out}
    got = {r.id for r in out if r.cut}
    hits = len(got & cut)
    assert hits >= 0.97 * len(cut) and hits >= 0.95 * len({i for i in got if i < 9000})


def test_copies_of_a_cut_text_do_not_vouch_for_it(spark):
    rows, cut = corpus(2)
    one = next(r for r in rows if r[0] in cut and r[1][-1].isalpha())
    rows += [(20_000 + i, *one[1:]) for i in range(300)]
    df = spark.createDataFrame(rows, "k BIGINT, t STRING, l STRING, s STRING")
    got = {r.id for r in T.truncated(df, "k", "t", "l", "s").where("cut").collect()}
    assert {20_000 + i for i in range(300)} <= got


def test_thresholds_by_language_and_column(spark):
    rows = [(lang, column, odds) for column, valley in (("a", -2.5), ("b", -0.5)) for lang in ("en", "de") for odds in [valley - 0.6 - i / 100 for i in range(500)] + [valley + 0.6 + i / 400 for i in range(900)]]
    rows += [("xx", "a", 9.0), ("yy", "b", -1.0)]
    got = {(r.lang, r.column): r.limit for r in T.thresholds(spark.createDataFrame(rows, "lang STRING, column STRING, odds DOUBLE")).collect()}
    assert abs(got["en", "a"] + 2.5) <= 0.5 and abs(got["de", "b"] + 0.5) <= 0.5 and set(got) == {(x, c) for x in ("en", "de") for c in "ab"} | {("xx", "a"), ("yy", "b")}
    texts, cut = corpus(5)
    df = spark.createDataFrame([(i, t, t, x, s) for i, t, x, s in texts], "k BIGINT, t STRING, u STRING, l STRING, s STRING")
    out = T.truncated(df, "k", ["t", "u"], "l", "s").collect()
    assert {r.column for r in out} == {"t", "u"} and len(out) == 2 * len({r.id for r in out})
    assert {r.id for r in out if r.cut and r.column == "t"} == {r.id for r in out if r.cut and r.column == "u"}


def test_rates_and_empty(spark):
    rows, cut = corpus(3)
    df = spark.createDataFrame(rows, "k BIGINT, t STRING, l STRING, s STRING")
    rates = {r.source: r for r in T.truncation_rates(df, "k", "t", "s", "l").collect()}
    assert rates["s2"].n_cut <= 0.02 * rates["s2"].n_texts and rates["s1"].share >= 0.95
    none = df.where("k < 0")
    assert T.truncated(none, "k", "t", "l", "s").collect() == [] == T.truncation_rates(none, "k", "t", "s").collect()


@pytest.mark.parametrize("text, left", [("abc…", "abc"), ("abc ...", "abc"), ("ab [more]\n", "ab"), ("a &hellip;", "a"), ("a&am", "a"), ("a <b", "a"), ("abc.", "abc."), ("…", "…"), ("x" + " " * 500, "x"), ("we shall see...”", "we shall see...”")])
def test_bare(text, left):
    assert T.bare(text) == left
