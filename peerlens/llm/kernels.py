"""Vectorised text kernels used by several operators: code points, rolling hashes, words.

All work on a list of texts at once, joined by a separator, so that the cost of numpy calls is paid per block of
texts and not per text. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd base of the rolling hash; its inverse modulo 2**64 follows from it.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters that one block of texts holds at most, unless a single text is longer.
BLOCK_CHARS = 400_000
MAX_CODE = 0x110000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of a public generator)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=1)
def char_values() -> np.ndarray:
    """A random 64-bit value for every code point."""
    return mix(np.arange(1, MAX_CODE + 1, dtype=U64) * U64(0xD1342543DE82EF95))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_CHARS + 4096)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * BLOCK_CHARS:
            _powers[base] = have
    return have[:n]


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by a zero, and the start of each text (one more entry at the end)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    joined = "\0".join(texts) + "\0" if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i..j-1] times their powers; n + 1 entries."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, independent of where they stand."""
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` values."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, dtype=U64)
    return mix((prefix[size:] - prefix[:-size]) * powers(INVERSE, n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by minima from block ends in both directions."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def ranges(sizes: np.ndarray, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes are at most `limit` together; a larger entry stands alone."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
        yield a, b
        a = b


def text_blocks(column: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a column of texts without nulls of at most `limit` characters together, with their texts; only these
    are held as strings."""
    for a, b in ranges(pc.utf8_length(column).to_numpy(zero_copy_only=False), limit):
        yield a, b, column.slice(a, b - a).to_pylist()


class Words:
    """The words of a block of texts: longest runs of ASCII letters and digits of the lower-cased text.

    hashes: of all words in order; doc: the text of each word; first: the first word of each text (one more entry at
    the end); spelled(i, n): n words from the i-th on, joined by spaces.
    """

    _is_word = np.zeros(129, dtype=bool)
    _is_word[[*range(48, 58), *range(97, 123)]] = True

    def __init__(self, texts: Sequence[str]):
        self.codes, self.text_starts = code_points([t.lower() for t in texts])
        inside = self._is_word[np.minimum(self.codes, 128)]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        values = char_values()[self.codes]
        self.hashes = span_hash(prefix_hash(values), self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def spelled(self, i: int, n: int) -> str:
        return " ".join(self.codes[a:b].astype(np.uint8).tobytes().decode("ascii") for a, b in zip(self.starts[i : i + n], self.ends[i : i + n]))

    def windows(self, n: int) -> np.ndarray:
        """Indexes of the words at which n words of one text begin."""
        if len(self.hashes) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all sequences of n words within one text, and the text of each."""
        at = self.windows(n)
        h = np.zeros(len(at), dtype=U64)
        for k in range(n):
            h = mix(h * U64(BASE) + self.hashes[at + k])
        return h, self.doc[at]
