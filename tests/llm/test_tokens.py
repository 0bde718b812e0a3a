import os

import pytest

from peerlens.llm import tokens as T

PATH = T.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file here")
TEXTS = ["Hello world", "", None, "<|endoftext|> is text", "漢字 and 😀👨‍💻", "tab\tand\r\nlines   ", "é" * 5000, "\x00\x7f"]


def test_round_trip_and_columns(spark):
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(TEXTS)], "k BIGINT, t STRING, ids STRING")
    coded = T.encode(df, "k", "t", block_chars=20)
    assert coded.columns == ["k", "ids"]
    ids = {r.k: r.ids for r in coded.collect()}
    assert ids[1] == ids[2] == [] and 50256 not in ids[3]
    back = {r.k: r.text for r in T.decode(coded, "k", "ids").collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_agrees_with_the_ranks_of_the_same_vocabulary(spark):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k BIGINT, t STRING")
    for r in T.encode(df, "k", "t").collect():
        assert r.ids == other.encode_ordinary(TEXTS[r.k] or "")


def test_offsets(spark):
    df = spark.createDataFrame([(1, "ab 漢 cd"), (2, None)], "k BIGINT, t STRING")
    rows = {r.k: r for r in T.encode(df, "k", "t", offsets=True).collect()}
    assert rows[2].starts == rows[2].ends == []
    text = "ab 漢 cd"
    assert len(rows[1].ids) == len(rows[1].starts) == len(rows[1].ends)
    assert "漢" in {text[a:b].strip() for a, b in zip(rows[1].starts, rows[1].ends)}


def test_split_characters_decode():
    ids = T.load(PATH).encode("漢", add_special_tokens=False).ids
    assert len(ids) > 1
    assert T.decode_ids(ids, PATH) == "漢"
    assert "�" in T.decode_ids(ids[:1], PATH)


def test_byte_table_is_a_bijection():
    assert sorted(T.byte_of_character().values()) == list(range(256))


def test_empty_table(spark):
    assert T.encode(spark.createDataFrame([], "k BIGINT, t STRING"), "k", "t").collect() == []
