"""Problem 3: texts over a size limit, cut into overlapping pieces at natural boundaries.

Both methods bisect: they cut at the strongest boundary near the middle, recurse on halves that exceed the limit less
the overlap, and attach the overlaps last. "stitched" gives the stated pieces, of which each ends where the one before
lets it: each half is cut by the stated rule from its own beginning, as if a piece ended there, and where that isn't so
the left half's cuts go on until they meet one of the right half's; from there on both are the same. They meet soon, as
a piece ends at the last of the strongest boundaries in its reach, wherever it starts. "even" keeps the middle cuts
themselves, so its pieces are of more even size. "forward" fills pieces one after another; it is what "stitched" is
tested against.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


_RUN = re.compile(r"[ \t\r\n]+")
_SENTENCE_END = re.compile(r"[.!?][\"')”’]?\Z")

PARAGRAPH, SENTENCE, WORD = 2, 1, 0


def boundaries(text: str) -> list[list[int]]:
    """Positions after a run of white space that neither starts nor ends the text: word, sentence, paragraph
    boundaries, each in its own ascending list."""
    out: list[list[int]] = [[], [], []]
    n = len(text)
    for m in _RUN.finditer(text):
        a, b = m.span()
        if a == 0 or b == n:
            continue
        if text.count("\n", a, b) >= 2:
            out[PARAGRAPH].append(b)
        elif _SENTENCE_END.search(text, max(0, a - 2), a):
            out[SENTENCE].append(b)
        else:
            out[WORD].append(b)
    return out


def _last(of: list[int], lo: int, hi: int) -> int | None:
    """The last position p with lo < p <= hi."""
    i = bisect_right(of, hi)
    return of[i - 1] if i and of[i - 1] > lo else None


def _restart(every: list[int], end: int, overlap: int) -> int:
    """Where a piece starts that repeats at most `overlap` characters before `end`."""
    i = bisect_left(every, end - overlap)
    return every[i] if i < len(every) and every[i] <= end - 1 else end - overlap


def split_forward(text: str, limit: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces that end at the last strongest boundary of (start + least, start + limit]."""
    by_kind = boundaries(text)
    every = sorted(sum(by_kind, []))
    start, pieces = 0, []
    while len(text) - start > limit:
        end = start + limit
        for kind in (PARAGRAPH, SENTENCE, WORD):
            if (p := _last(by_kind[kind], start + least, start + limit)) is not None:
                end = p
                break
        pieces.append((start, end))
        start = _restart(every, end, overlap)
    pieces.append((start, len(text)))
    return pieces


def _middle(by_kind: list[list[int]], a: int, b: int) -> int:
    """The strongest boundary within the middle half of (a, b), of equals the one nearest to the middle; the middle if
    there is none."""
    middle, reach = (a + b) // 2, (b - a) // 4
    for kind in (PARAGRAPH, SENTENCE, WORD):
        of = by_kind[kind]
        i = bisect_left(of, middle)
        near = [p for p in of[max(0, i - 1) : i + 1] if abs(p - middle) <= reach and a < p < b]
        if near:
            return min(near, key=lambda p: (abs(p - middle), p))
    return middle


def split_stitched(text: str, limit: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces of split_forward by recursive bisection and stitching."""
    by_kind = boundaries(text)
    every, n = sorted(sum(by_kind, [])), len(text)

    def following(cut: int) -> int:
        """The end of the piece that repeats the characters before `cut`."""
        start = _restart(every, cut, overlap) if cut else 0
        if n - start <= limit:
            return n
        ends = (_last(by_kind[kind], start + least, start + limit) for kind in (PARAGRAPH, SENTENCE, WORD))
        return next((p for p in ends if p is not None), start + limit)

    def cuts(a: int, b: int) -> list[int]:
        """The cuts after a, if a is one, up to the first at or after b."""
        out, cut = [], a
        if b - a > limit - overlap:
            middle = _middle(by_kind, a, b)
            out, right = cuts(a, middle), cuts(middle, b)
            cut = out[-1]
            while cut != middle and cut < b:
                i = bisect_left(right, cut)
                if i < len(right) and right[i] == cut:
                    return out + right[i + 1 :]
                out.append(cut := following(cut))
            return out + right if cut == middle else out
        while cut < b:
            out.append(cut := following(cut))
        return out

    ends = cuts(0, n)
    return [(_restart(every, a, overlap) if a else 0, b) for a, b in zip([0, *ends], ends)]


def split_even(text: str, limit: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces by recursive halving at the strongest boundary within the middle half; `least` isn't used."""
    by_kind = boundaries(text)
    every = sorted(sum(by_kind, []))
    room, cuts, todo = limit - overlap, [0], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            cuts.append(b)
            continue
        cut = _middle(by_kind, a, b)
        todo += [(cut, b), (a, cut)]
    return [(_restart(every, a, overlap) if a else 0, b) for a, b in zip(cuts, cuts[1:])]


METHODS: dict[str, Callable] = {"stitched": split_stitched, "even": split_even, "forward": split_forward}


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 2000, least: int = 1000, overlap: int = 200, method: str = "stitched") -> DataFrame:
    """The pieces of every text of more than `limit` characters: id (under its own name), start_pos, end_pos.

    Positions count Unicode code points; ends are exclusive. A row per piece, repeated rows of the input once. Null,
    empty and short texts have no pieces; so has a row without id. Texts may be of any length: the work is linear in
    it. No shuffle but for making the rows distinct; other columns are ignored, whatever their names.
    """
    if not 0 <= overlap < least < limit:
        raise ValueError("0 <= overlap < least < limit is needed")
    split, kind = METHODS[method], df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(batch.column(0), batch.column(1).to_pylist()):
                pieces = split(text, limit, least, overlap)
                ids += [i] * len(pieces)
                starts += [p[0] for p in pieces]
                ends += [p[1] for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "start_pos", "end_pos"])

    long = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where(f"id IS NOT NULL AND length(text) > {limit}")
    return long.mapInArrow(run, f"id {kind.simpleString()}, start_pos BIGINT, end_pos BIGINT").distinct().withColumnRenamed("id", id_col)
