"""Bloom filters of a bounded size, made by all tasks and added up in a tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prefweave.llm.words import mix
from prefweave.operators.tree import SHAPE, gathered, shipped


def bloom_size(n: int, most_bits: int) -> int:
    """Bits of a filter for ``n`` values: ten or more for each, up to 2 ** ``most_bits``."""
    return 1 << min(most_bits, max(13, math.ceil(math.log2(10 * n + 1))))


def bloom(df: DataFrame, size: int, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """A Bloom filter of ``size`` bits, packed, over the 64-bit hashes of each batch of ``df``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, bool)
        for batch in batches:
            for at in _places(hashes(batch), size):
                own[at] = True
        yield shipped(np.packbits(own))

    return gathered(df.mapInArrow(fill, SHAPE), size // 8, np.uint8, np.bitwise_or)


def _places(h: np.ndarray, size: int) -> list[np.ndarray]:
    h = h.view(np.uint64)
    return [(mix(h + np.uint64(i)) & np.uint64(size - 1)).astype(np.int64) for i in (1, 2, 3)]


def held(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter holds; it may hold others than were put in."""
    out = np.ones(len(h), bool)
    for at in _places(h, 8 * len(packed)):
        out &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out
