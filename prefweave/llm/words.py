"""Words of many texts at once, as numpy arrays.

A *word* is a longest run of letters or digits of any script, lower-cased character by
character. Everything here works on the code points of a whole block of texts; there is no
loop over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled at once; a longer text makes a block of its own.
BLOCK_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter or digit; the hash of its lower case."""
    points = np.arange(0x110000, dtype=np.uint32)
    alnum = np.strings.isalnum(points.view("<U1"))
    lower = points.astype(np.uint64)
    lower[alnum] = np.strings.lower(points[alnum].view("<U1")).astype("<U1").view(np.uint32)
    return alnum, mix(lower + np.uint64(0x51ED27)) | np.uint64(1)


@lru_cache(8)
def _powers(base: int, size: int) -> np.ndarray:
    p = np.full(size, np.uint64(base))
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Words(NamedTuple):
    """The words of a block of texts, in order."""

    text: np.ndarray  #: index of the text in the block
    hash: np.ndarray  #: 64-bit hash of the lower-cased word
    start: np.ndarray  #: first code point in the block's joined text
    end: np.ndarray  #: code point after the last
    offset: np.ndarray  #: of each text, its first code point in the joined text


def words(texts: list[str | None]) -> Words:
    """Words of ``texts``; a null text has none. A long text is read in parts, cut between words."""
    texts = [t or "" for t in texts]
    joined = "\n".join(texts)
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
    found = []
    a = 0
    while a < len(joined):
        b = min(a + 2 * BLOCK_CHARS, len(joined))
        if b < len(joined):
            back = next((i for i in range(b, a, -1) if not joined[i].isalnum()), None)
            b = back or next((i for i in range(b, len(joined)) if not joined[i].isalnum()), len(joined))
        found.append(_scan(joined[a:b], a))
        a = b
    h, start, end = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
    return Words(np.searchsorted(offset, start, side="right") - 1, h, start, end, offset)


def _scan(text: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    alnum, value = _tables()
    inside = alnum[points]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    size = 1 << max(12, (len(points) + 1).bit_length())
    terms = value[points]
    terms *= _powers(int(_BASE), size)[: len(points)]
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    h = mix((total[end] - total[start]) * _powers(int(_INVERSE), size)[start])
    return h, start + at, end + at


def blocks(sizes: np.ndarray, most: int, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of successive items whose sizes sum to about ``most``."""
    a, total = 0, 0
    for b, n in enumerate(sizes):
        if b > a and (total + n > most or b - a >= rows):
            yield a, b
            a, total = b, 0
        total += int(n)
    if a < len(sizes):
        yield a, len(sizes)


def runs(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` successive words of one text, and each run's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(w.text[:n] == w.text[k - 1 :])
    h = np.zeros(len(first), np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(3) + w.hash[first + i])
    return h, first


def chat_texts(column: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """Contents of all messages of a column of chats, and the row of each message."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return column.flatten().field("content").to_pylist(), np.repeat(np.arange(len(n)), n)
