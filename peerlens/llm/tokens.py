"""Problem 6: token ids of a whole corpus by a public byte-level vocabulary.

The vocabulary is read from a path that every worker sees; it isn't part of this repository. Encoding runs over Arrow
batches in the tokenizers library. Byte-level vocabularies spell each byte as one printable character: printable
bytes stand for themselves, the others are moved up to 256 and on. Decoding reverses that table, joins the bytes of
all tokens of a text, and only then reads them as UTF-8, as a character's bytes may be split over several tokens.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from peerlens.llm.kernels import text_blocks


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """The path of a vocabulary file: in `folder`, or PUBLIC_TOKENIZERS, or the installed public_tokenizers, or
    /opt/tokenizers."""
    if not (folder := folder or os.environ.get("PUBLIC_TOKENIZERS")):
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, one for each worker process; strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a worker on each core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=1)
def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every token of a byte-level vocabulary."""
    table, t = byte_of_character(), load(path)
    special = {i: token.content.encode() for i, token in t.get_added_tokens_decoder().items()}
    return {i: special.get(i) or bytes(table[c] for c in token) for token, i in t.get_vocab(with_added_tokens=True).items()}


def decode_ids(ids: list[int], path: str, errors: str = "replace") -> str:
    """The text of token ids; bytes that form no character, as in a cut list, become U+FFFD."""
    of = token_bytes(path)
    return b"".join(of[i] for i in ids).decode("utf-8", errors)


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum(np.fromiter(map(len, rows), np.int32, len(rows)), out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None, offsets: bool = False, block_chars: int = 1_000_000) -> DataFrame:
    """Token ids of every row: the id (under its own name), ids ARRAY<INT>, and with offsets also starts and ends
    ARRAY<INT>, the characters from which each token came (a character split over tokens is named by each of them).

    One row for each row of the input, rows without id and repeated rows included. Null and empty texts give empty
    lists. No special tokens are added, and strings that look like them are encoded as plain text. Narrow: no shuffle.
    """
    path, kind = path or vocabulary_path(), df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for a, b, texts in text_blocks(pc.fill_null(batch.column(1), ""), block_chars):
                coded = (tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast)(texts, add_special_tokens=False)
                columns = [batch.column(0).slice(a, b - a), _lists([e.ids for e in coded])]
                if offsets:
                    columns += [_lists([[o[k] for o in e.offsets] for e in coded]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "starts", "ends"][: len(columns)])

    schema = f"id {kind.simpleString()}, ids ARRAY<INT>" + ", starts ARRAY<INT>, ends ARRAY<INT>" * offsets
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str | None = None) -> DataFrame:
    """Texts of token ids: the id (under its own name) and text. A null list gives null, an empty list an empty text."""
    path, kind = path or vocabulary_path(), df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, path) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind.simpleString()}, text STRING").withColumnRenamed("id", id_col)
