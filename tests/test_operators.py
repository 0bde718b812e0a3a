import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerlens.functions import text as X
from peerlens.operators import chunks, evaluate, index_records, models, overlap, peers, vectors


def one(spark, value, f, kind="STRING"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


# --- text ---


def test_text_columns(spark):
    assert one(spark, "  a  b\t\nc ", X.collapse) == "a b c"
    assert one(spark, "\n a\r\n\r\n\r\n\r\nb \t c\r", X.canonical) == "a\n\nb c"
    assert one(spark, "abcdefghij", lambda c: X.head_and_tail(c, 5)) == "ab\n...\nhij"
    assert one(spark, " a  b ", lambda c: X.first_words(c, 2)) == " a  b "
    assert one(spark, " a  b c", lambda c: X.first_words(c, 2)) == "a b"
    assert one(spark, " 1 a ", X.item_id) == "1A"
    assert one(spark, "Items 1 and 2. Business", X.item_numbers) == ["1", "2"]
    assert [one(spark, t, X.item_number) for t in ("1Business", "Item 7A. Risk", "1A Risk", "nothing", "Part II - Item 5")] == ["1", "7A", "1A", None, "5"]
    assert one(spark, "Costs $1,200.5 (30) and 7.5 %", X.mask_numbers) == "Costs NUM NEG_NUM and PCT"
    assert [str(one(spark, t, X.any_date)) for t in ("2024-02-29", "02/29/2024", "20240229", "2023-02-29", "soon")] == ["2024-02-29"] * 3 + ["None"] * 2
    assert [one(spark, t, X.cik) for t in ("320193", "0000320193", "AAPL", None)] == ["0000320193", "0000320193", None, None]
    assert one(spark, None, X.token_count) is None


def test_item_sort_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("10", "1A", "X", "2", "1", "7A")], "i STRING")
    assert [r.i for r in rows.orderBy(X.item_sort_key(F.col("i"))).collect()] == ["1", "1A", "2", "7A", "10", "X"]


def test_ixbrl(spark):
    html = '<ix:nonNumeric name="dei:DocumentPeriodEndDate">September <b>28</b>, 2019</ix:nonNumeric><ix:nonNumeric name="dei:TradingSymbol">abc</ix:nonNumeric><ix:nonNumeric name="dei:TradingSymbol">ABC</ix:nonNumeric><ix:nonNumeric name="dei:TradingSymbol">x</ix:nonNumeric>'
    got = one(spark, html, X.ixbrl_tags)
    assert (got.fiscal_year, got.period_of_report, got.ticker_symbols) == (2019, "September 28 , 2019", ["ABC", "X"])
    assert one(spark, html + '<ix:nonNumeric name="dei:DocumentFiscalYearFocus">2020</ix:nonNumeric>', X.ixbrl_tags).fiscal_year == 2020


# --- index ---

PIPE = "head\n-----\nACME|10-K|320193|2021-01-02|a/0000320193-21-000001.txt\nOTHER|10-Q|7|2021-01-02|b.txt\nshort line\n"
FIXED = "Company\n---\n" + "ACME INC".ljust(62) + "10-K".ljust(12) + "0000320193".ljust(12) + "2021-01-02".ljust(12) + "edgar/0000320193-21-000002.txt\n"


def test_index_layouts(spark):
    files = spark.createDataFrame([("p", PIPE), ("f", FIXED)], "path STRING, value STRING")
    got = {r.accession_number: r for r in index_records.parse_index(files, "10-K").collect()}
    assert set(got) == {"0000320193-21-000001", "0000320193-21-000002"}
    assert all((r.cik, r.cik_padded) == ("320193", "0000320193") for r in got.values())
    assert index_records.parse_index(files).count() == 3


@pytest.mark.parametrize("lookahead, last", [(1, "2024-01-31"), (2, "2024-02-29"), (6, "2024-06-30"), (12, "2024-12-31")])
def test_fiscal_windows(spark, lookahead, last):
    w = index_records.fiscal_windows(spark, [2023], lookahead).first()
    assert (str(w.first_day), str(w.last_day)) == ("2023-01-01", last)


def test_overlapping_windows_count_twice(spark):
    rows = spark.createDataFrame([("1", "2024-03-01"), ("1", "20240301"), ("2", "bad"), ("3", None)], "cik_padded STRING, date_filed STRING")
    got = sorted(map(tuple, index_records.fiscal_counts(rows, [2023, 2024, 2024]).collect()))
    assert got == [(2023, 1, 2), (2024, 1, 2)]


def test_status_report(spark):
    rows = spark.createDataFrame([(2020, False, False), (2020, True, False), (None, False, False), (2019, False, False), (2020, False, True)], "fiscal_year INT, e BOOLEAN, f BOOLEAN")
    got = index_records.status_report(index_records.download_status(rows, [2020], F.col("e"), F.col("f"))).where("is_total").first()
    assert [got[s] for s in index_records.STATUSES] == [1, 1, 1, 1, 1]


def test_upsert_and_lookup(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k INT, v STRING, t INT")
    new = spark.createDataFrame([(1, "c", 2)], "k INT, v STRING, t INT")
    assert sorted(map(tuple, index_records.upsert(old, new, ["k"], [F.desc("t")]).collect())) == [(1, "c", 2), (2, "b", 1)]
    tickers = spark.createDataFrame([("ABC", "7"), ("abc", "9"), ("X", "bad")], "ticker STRING, cik STRING")
    asked = spark.createDataFrame([("abc ",), ("12",), ("none",), (None,)], "id STRING")
    assert [r.cik for r in index_records.resolve_ids(asked, "id", tickers).orderBy("id").collect()] == [None, "0000000012", "0000000007", None]
    assert index_records.filing_estimate("10-K", 2) == {"filings": 9000, "quarters": 8}


# --- chunks ---


def test_packing_order():
    short, long = "s " * 90, "l " * 200
    units = chunks.pack_paragraphs("\n\n".join([short, long, short, "t " * 30]), 190, 40, 80)
    assert [len(u.split()) for u in units] == [190, 180] or [len(u.split()) for u in units][0] == 190
    assert units[0].startswith("l") and units[-1].startswith("s")


def test_tail_window():
    units = chunks.pack_paragraphs(" ".join(f"w{i}" for i in range(850)), 480, 96, 80)
    assert [len(u.split()) for u in units] == [480, 466, 82]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(2, 20), st.integers(0, 10), st.integers(1, 5))
def test_units_have_least_words(text, chunk, overlap, least):
    units = chunks.pack_paragraphs(text, chunk, overlap, least)
    assert all(least <= len(u.split()) <= chunk for u in units)


def test_units_by_another_counter(spark):
    text = "\n\n".join(f"{'ab ' * 5}" for _ in range(6))
    df = spark.createDataFrame([(1, "1", text)], "k INT, item STRING, t STRING")
    letters = lambda x: sum(c.isalpha() for c in x)
    got = chunks.units(df, ["k"], "item", "t", chunk=25, overlap=0, least=5, min_units=1, counter=letters).orderBy("unit_id").collect()
    assert [(r.unit_id, r.unit_tokens) for r in got] == [(1, 20), (2, 20), (3, 20)]


def test_tokenizer_file(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = str(tmp_path / "t.json")
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 0, "b": 1, "?": 2}, "?"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.save(path)
    assert chunks.FileCounter(path)("a b, c") == 4


def test_units_and_windows(spark):
    df = spark.createDataFrame([(1, "1a", "w " * 1000), (2, "1A", "w " * 90), (3, "9", None), (4, "9", " ")], "k INT, item STRING, t STRING")
    got = chunks.units(df, ["k"], "item", "t").groupBy("k", "item_id", "chunk_tokens", "overlap_tokens").count().collect()
    assert [tuple(r) for r in got] == [(1, "1A", 480, 96, 3)]
    assert one(spark, "a b c d e", lambda c: chunks.word_windows(c, F.lit(3), F.lit(2))) == ["a b c", "c d e", "e"]
    assert one(spark, "", lambda c: chunks.word_windows(c, F.lit(3), F.lit(2))) == []


# --- vectors ---


def test_pool_forms_agree_and_ignore_order(spark):
    rng = np.random.default_rng(1)
    groups = {"many": rng.normal(size=(30, 4)), "one": rng.normal(size=(1, 4)), "same": np.ones((5, 4)), "two": rng.normal(size=(2, 4))}
    groups["many"][0] *= 50
    rows = [(g, [float(x) for x in v]) for g, m in groups.items() for v in m]
    for order in (rows, rows[::-1]):
        got = vectors.distinctiveness_pool(spark.createDataFrame(order, "g STRING, v ARRAY<DOUBLE>"), ["g"], "v", 4).collect()
        for r in got:
            pooled, top, mean = vectors.pool(groups[r.g])
            assert np.allclose(r.pooled, pooled) and math.isclose(r.w_max, top) and math.isclose(r.w_mean, mean)
            assert math.isclose(np.linalg.norm(r.pooled), 1, rel_tol=1e-6) and r.num_units == len(groups[r.g])


def test_candidates_cut_with_self_and_ties(spark):
    rows = [(f"f{i:02}", 2020, "1", [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(20)] + [("f00", 2021, "1", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "firm STRING, year INT, item_id STRING, vec ARRAY<DOUBLE>")
    got = sorted((r.focal_firm, r.peer_firm) for r in vectors.candidates(df, F.col("firm").isin("f00", "f03")).where("year = 2020").collect())
    assert got == [("f00", "f01"), ("f00", "f02"), ("f03", "f00"), ("f03", "f01"), ("f03", "f02")]  # ties push f03 out of its own list
    assert vectors.candidates(df, F.col("year") == 2021).count() == 0
    assert vectors.candidate_cut(20) == 3 and vectors.candidate_cut(1) == 1
    single = vectors.candidates(df, F.col("firm") == "f00").count() + vectors.candidates(df, F.col("firm") == "f03").count()
    assert vectors.candidates(df, F.col("firm").isin("f00", "f03")).count() == single


@pytest.mark.parametrize("options", [{}, {"k": 4}, {"q_share": 0.5}])
def test_universes_in_parts_give_the_same(spark, options):
    rng = np.random.default_rng(3)
    rows = [(f"f{i:03}", 2020 + i % 2, "1" if i % 3 else "7", [float(x) for x in rng.integers(-1, 2, 6) + 0.5]) for i in range(120)]
    df = spark.createDataFrame([*rows, ("none", 2020, "1", None)], "firm STRING, year INT, item_id STRING, vec ARRAY<DOUBLE>")
    focal = F.col("firm") < "f030"
    whole, parts = (sorted(map(tuple, vectors.candidates(df, focal, part=n, **options).collect())) for n in (1000, 7))
    assert whole == parts and len(whole) > 30 and "none" not in {r[0] for r in whole}
    if not options.get("k"):
        whole, parts = (sorted(map(tuple, vectors.orthogonal_candidates(df, 6, focal, part=n, **options).collect())) for n in (1000, 7))
        assert whole == parts and len(whole) > 30
    assert vectors.candidates(df.where("year = 1"), focal).collect() == []


def test_percentile_in_two_steps(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.lognormal(size=400), "b": rng.random(1), "c": np.repeat([1.0, 2.0], 9), "d": 1 + rng.random(50) * 1e-7}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g STRING, w DOUBLE")
    for share in (0.95, 0.5, 0.0, 1.0):
        got = {r.g: r._cap for r in vectors.percentile_cap(df, ["g"], "w", share).collect()}
        assert all(math.isclose(got[g], np.percentile(v, 100 * share), rel_tol=1e-12) for g, v in groups.items())


def test_residuals(spark):
    df = spark.createDataFrame([("a", 1, "1", [1.0, 0.0]), ("b", 1, "1", [0.0, 1.0]), ("c", 1, "2", [1.0, 1.0])], "firm STRING, year INT, item_id STRING, vec ARRAY<DOUBLE>")
    got = {r.firm: r for r in vectors.orthogonal_residuals(df, 2).collect()}
    assert got["a"].common_loading == 0 and np.allclose(got["a"].residual, [1, 0]) and got["c"].residual is None


def test_embedder(spark):
    df = spark.createDataFrame([("one two",), ("",), (None,)], "t STRING")
    a, b, c = (r.embedding for r in vectors.embed(df, "t", vectors.HashEmbedder(16)).collect())
    assert math.isclose(np.linalg.norm(a), 1, rel_tol=1e-5) and not np.any(b) and c is None


# --- rankings and evaluation ---


def test_final_ranking(spark):
    rows = [("f", 2020, i, p, c, r, 150) for i, p, c, r in [("1", "a", 0.9, 0.5), ("2", "a", 0.7, 0.5), ("1", "b", 0.9, 0.5), ("1", "c", 0.9, 0.5)]]
    detail = spark.createDataFrame(rows, "focal_firm STRING, year INT, item_id STRING, peer_firm STRING, cosine_score DOUBLE, rerank_score DOUBLE, universe_n BIGINT")
    got = peers.final_ranking(detail, 3).orderBy("rank").collect()
    assert [(r.peer_firm, r.rank) for r in got] == [("a", 1), ("b", 2)]
    assert got[0].coverage_share == 0.666667 and math.isclose(got[0].final_score, 0.59 * 0.666667, abs_tol=1e-6)
    assert peers.final_ranking(detail, 3, None).count() == 3


def test_band_match(spark):
    nan = float("nan")
    df = spark.createDataFrame([(2.0, 1.0), (2.1, 1.0), (0.0, 1.0), (-1.0, -1.0), (None, 1.0), (nan, 1.0), (1.0, nan)], "a DOUBLE, b DOUBLE")
    assert [r.m for r in df.select(evaluate.band_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True] + [False] * 6


def test_weak_labels_agree_with_the_plain_disjunction(spark):
    rng = np.random.default_rng(4)
    pick = lambda x: None if rng.random() < 0.1 else x
    rows = [(str(int(rng.integers(1, 60))), int(rng.integers(2020, 2022)), pick(str(rng.integers(8))), pick(str(rng.integers(30))), pick(str(rng.integers(30))), pick(float(10 ** rng.uniform(-1, 3))), pick(float(rng.normal()))) for _ in range(150)]
    schema = "firm_id STRING, year INT, sic STRING, naics STRING, gics STRING, market_cap DOUBLE, revenue DOUBLE"
    first: dict = {}
    key = lambda r: tuple((v is None, v) for v in r[2:])
    for r in sorted(set(rows), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r[2:])):
        first.setdefault((r[0], r[1]), r)
    near = lambda a, b: a is not None and b is not None and a > 0 and b > 0 and max(a, b) / min(a, b) <= 2
    want = set()
    for (f, y), r in first.items():
        for p in rows:
            if p[1] == y and p[0] != f and (any(r[i] is not None and r[i] == p[i] for i in (2, 3, 4)) or near(r[5], p[5]) or near(r[6], p[6])):
                want.add((f.zfill(10), y, p[0].zfill(10)))
    assert set(map(tuple, evaluate.weak_labels(spark.createDataFrame(rows, schema)).collect())) == want
    assert evaluate.weak_labels(spark.createDataFrame(rows, schema).drop("sic", "revenue")).count() <= len(want)


def test_labels_and_analysts_without_a_shuffle_of_labels(spark):
    """Every label once, also of firms with several rows, of analysts' pairs those that are no labels, and no exchange
    above the step that finds the labels."""
    meta = spark.createDataFrame([("20", 2020, "1", 5.0), ("7", 2020, "1", None), ("7", 2020, "2", 9.0), ("8", 2020, "3", 11.0), ("9", 2021, "1", 5.0), ("40", 2020, None, 10.0)], "firm_id STRING, year INT, sic STRING, market_cap DOUBLE")
    analysts = spark.createDataFrame([("20", 2020, "7"), ("20", 2020, "8"), ("20", 2020, "8"), ("20", None, "8"), ("20", 2020, "20"), ("7", 2020, "20"), (None, 2020, "7")], "focal_firm STRING, year INT, peer_firm STRING")
    focal = F.col("firm").cast("long") % 20 == 0
    got = evaluate.labels_and_analysts(meta, analysts, focal)
    want = evaluate.with_analysts(evaluate.weak_labels(meta, focal), analysts).collect()
    labels = {(a.zfill(10), 2020, b.zfill(10)) for a, b in (("20", "7"), ("20", "40"), ("40", "20"), ("40", "7"), ("40", "8"))}
    assert set(map(tuple, evaluate.weak_labels(meta, focal).collect())) == labels
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 5 + 5
    plan = evaluate.weak_labels(meta, focal)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Exchange" in plan


def test_metrics_of_agree_with_metrics_and_write_no_labels(spark):
    rng = np.random.default_rng(5)
    meta = spark.createDataFrame([(str(i), int(rng.integers(2020, 2022)), str(rng.integers(5)), float(rng.uniform(1, 9))) for i in range(1, 60) for _ in range(2)], "firm_id STRING, year INT, sic STRING, market_cap DOUBLE")
    ranking = spark.createDataFrame([(f"{f:010}", y, f"{p:010}", r) for f in (20, 40, 61, 7) for y in (2020, 2021, None) for r, p in enumerate(rng.permutation(70)[:60].tolist(), 1) if p != f], "focal_firm STRING, year INT, peer_firm STRING, rank INT").where("rank > 0")
    focal = F.col("firm").cast("long") % 20 == 0
    want = evaluate.metrics(ranking, evaluate.weak_labels(meta, focal))
    got = evaluate.metrics_of(ranking, meta, focal)
    assert got.schema.names == want.schema.names and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    counts = {(r.focal_firm, r.year): r["count"] for r in evaluate.weak_labels(meta, focal).groupBy("focal_firm", "year").count().collect()}
    assert {(r.focal_firm, r.year): r.label_count for r in evaluate.label_counts(meta, focal).collect()} == counts and counts


def test_label_counts_agree_with_weak_labels(spark):
    """Counted without pairs: firms with one row and with several, equal numbers, numbers just at the band's ends, missing
    and unusable values, columns that are not there."""
    rng = np.random.default_rng(6)
    pick = lambda x: None if rng.random() < 0.15 else x
    size = lambda: float(rng.choice([1.0, 2.0, 4.0, 3.0, 6.0, np.nextafter(2, 3), 0.1, 0.2, 0.3, 0.0, -1.0, np.nan, np.inf, 5e-324, 1.7e308, rng.lognormal()]))
    rows = [(str(i), y, pick(str(rng.integers(9))), pick(str(rng.integers(9))), pick(str(rng.integers(5))), pick(size()), pick(size())) for i in range(1, 160) for y in (2020, 2021, 2022) for _ in range(1 + (rng.random() < 0.15 and y != 2022))]
    meta = spark.createDataFrame(rows, "firm_id STRING, year INT, sic STRING, naics STRING, gics STRING, market_cap DOUBLE, revenue DOUBLE")
    for some in (meta, meta.drop("sic", "revenue"), meta.drop("naics", "gics", "sic"), meta.drop("market_cap", "revenue"), meta.where("firm_id = '1'")):
        for ratio in (2.0, 1.1):
            want = {(r.focal_firm, r.year): r["count"] for r in evaluate.weak_labels(some, ratio=ratio).groupBy("focal_firm", "year").count().collect()}
            assert {(r.focal_firm, r.year): r.label_count for r in evaluate.label_counts(some, ratio=ratio).collect()} == want


def test_metrics_and_stability(spark):
    ranking = spark.createDataFrame([("f", y, p, r) for y, ps in ((2020, "abc"), (2021, "bcd"), (2023, "xyz")) for r, p in enumerate(ps, 1)], "focal_firm STRING, year INT, peer_firm STRING, rank INT")
    labels = spark.createDataFrame([("f", 2020, "a"), ("f", 2020, "c"), ("f", 2020, "q")], "focal_firm STRING, year INT, peer_firm STRING")
    got = {r.year: r for r in evaluate.metrics(ranking, labels).collect()}
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert (got[2020].label_count, got[2020].recall_at_50) == (3, 0.666667)
    assert math.isclose(got[2020].ndcg_at_10, (1 + 1 / math.log2(4)) / ideal, abs_tol=1e-6)
    assert (got[2021].label_count, got[2021].recall_at_50, got[2021].ndcg_at_10) == (0, None, None)
    assert sorted((r.prev_year, r.year, r.jaccard) for r in evaluate.stability(ranking).collect()) == [(2020, 2021, 0.5), (2021, 2023, 0.0)]


# --- models ---


def test_replies(spark):
    none, bad = "no JSON object in the reply", "the score is no number"
    want = {
        '{"score": 50, "reason": "r"}': (0.5, "r", None),
        'Sure! {"score": 140} bye': (1.0, "", None),
        '{"reason": " x "}': (0.0, "x", None),
        '{"score": "90", "reason": 5}': (0.9, "5", None),
        '{"score": " 7 ", "reason": null}': (0.07, "", None),
        '{"score": -3}': (0.0, "", None),
        "{bad}": (None, None, none),
        '{"score": 80} or {"score": 20}': (None, None, none),
        '{"score": 80}, {"score": 20}': (None, None, none),
        '{"score": null}': (None, None, bad),
        '{"score": "high"}': (None, None, bad),
        '{"score": [1]}': (None, None, bad),
        "[1, 2]": (None, None, none),
        "5": (None, None, none),
        "": (None, None, none),
        "no object": (None, None, none),
        None: (None, None, None),
    }
    df = spark.createDataFrame([(r,) for r in want], "x STRING").select("x", models.parse_reply(F.col("x")).alias("r"))
    assert {r.x: tuple(r.r) for r in df.collect()} == want


def test_summaries_in_windows(spark):
    df = spark.createDataFrame([(1, "7", " ".join(f"w{i}" for i in range(8000))), (2, "7", "short text"), (3, "7", " ")], "k INT, item STRING, t STRING")
    got = {r.k: r for r in models.summarize(df, ["k"], "item", "t", models.lead_words(5), "llama3.2:3b").collect()}
    assert got[2].summary == "short text" and got[2].windows == 1 and 3 not in got
    assert got[1].windows == 3 and got[1].summary == "w0 w1 w2 w3 w4"


def test_previous_year_is_exactly_one_before(spark):
    df = spark.createDataFrame([("a", 2020, "x"), ("a", 2021, "y"), ("a", 2023, "z")], "f STRING, year INT, t STRING")
    assert sorted((r.year, r.previous_text) for r in models.with_previous_year(df, ["f"], "t").collect() if r.previous_text) == [(2021, "x")]


def test_failed_calls_are_isolated_on_request(spark):
    def broken(prompt, as_json=False):
        raise RuntimeError("down")

    df = spark.createDataFrame([("p",)], "p STRING")
    r = models.call(df, "p", broken, "a", error="e").first()
    assert (r.a, r.e) == (None, "down")


def test_rerank_drops_pairs_without_text(spark):
    cand = spark.createDataFrame([("f", 2020, "1", "p", 0.5), ("f", 2020, "1", "q", 0.4)], "focal_firm STRING, year INT, item_id STRING, peer_firm STRING, cosine_score DOUBLE")
    texts = spark.createDataFrame([("f", 2020, "1", "a b"), ("p", 2020, "1", "a c"), ("q", 2020, "1", " \xa0\n")], "firm STRING, year INT, item_id STRING, text STRING")
    got = models.rerank(cand, texts).collect()
    assert [(r.peer_firm, r.rerank_score) for r in got] == [("p", pytest.approx(1 / 3, abs=1e-5))]


def test_overlap_ranking_agrees_with_prompts_and_shuffles_no_pairs(spark):
    rng = np.random.default_rng(6)
    firms = [f"f{i:02}" for i in range(40)]
    rows = [(f, y, i, rng.normal(size=6).tolist()) for f in firms for y in (2020, 2021) for i in ("1", "7") if rng.random() < 0.7]
    vecs = spark.createDataFrame(rows, "firm STRING, year INT, item_id STRING, vec ARRAY<DOUBLE>")
    word = lambda: rng.choice(["a", "B", "c", "d", "E", "f", "g", "\xe9"])
    told = spark.createDataFrame([(f, " \xa0\n" if f == "f03" else " ".join(word() for _ in range(rng.integers(1, 12)))) for f in firms[:30]], "firm STRING, text STRING")
    focal = F.col("firm").isin("f00", "f03", "f05", "f35")
    texts = vecs.select("firm", "year", "item_id").join(told, "firm")
    want = peers.final_ranking(models.rerank(vectors.candidates(vecs, focal, 1.0), texts), 3, None)
    got = overlap.overlap_ranking(vecs, told, focal, 3)
    assert got.schema.names == want.schema.names and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    a, b = ({(r.focal_firm, r.year, r.peer_firm): r for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and {k[0] for k in a} == {"f00", "f05"}
    for k, r in a.items():
        assert r.items_matched == b[k].items_matched and all(math.isclose(r[c], b[k][c], abs_tol=2e-6) for c in ("avg_cosine", "avg_rerank", "avg_item_score", "coverage_share", "final_score"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    best = sorted((r for r in a.values() if (r.focal_firm, r.year) == ("f00", 2020)), key=lambda r: r["rank"])
    assert [r["rank"] for r in best] == list(range(1, len(best) + 1)) and best == sorted(best, key=lambda r: (-r.final_score, -r.avg_rerank, -r.avg_cosine, r.peer_firm))
    assert overlap.half_away(np.array([0.5, -0.5, 1.5, 0.78125 * 1e-2]), 0).tolist() == [1.0, -1.0, 2.0, 0.0] and overlap.half_away(np.array([0.78125]), 4)[0] == 0.7813
