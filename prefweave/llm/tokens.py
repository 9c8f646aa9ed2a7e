"""Encoding of whole corpora with public tokenizers.

A text up to ``leaf`` characters is encoded as it stands. A longer one is halved until its
parts are that short; the parts are encoded apart, on different executors, and joined as a
tree. At a join only a window around it is encoded again, and it grows until both sides agree
exactly: until it reaches a place on each side at which the splitting pattern must split
whatever surrounds it, or, inside a long run without such places, until its first and last
tokens are those that the sides already have there (in byte-pair encoding a sequence whose
neighbours are all valid pairs is the encoding of its text).
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 8192


def _kind(c: str) -> int:
    """The pattern's classes: 0 white space, 1 letter, 2 number, 3 other; -1 not assigned here, perhaps a letter there."""
    if c.isalpha():
        return 1
    if c.isspace() and not "\x1c" <= c <= "\x1f":
        return 0
    if c.isnumeric():
        return 2
    return -1 if unicodedata.category(c) == "Cn" else 3


def must_split(text: str, i: int) -> bool:
    """Does the pattern split before character ``i`` whatever stands further away?"""
    a, b = _kind(text[i - 1]), _kind(text[i])
    return a != b and b >= 0 and (a in (1, 2) or (a == 3 and b == 0))


class Encoder:
    """A byte-level BPE vocabulary from a rank file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.base.encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def joined(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        """The ids of a + b from the ids of both."""
        if not a or not b:
            return left + right
        width = 16
        while True:
            i = self._split_in(a, max(0, len(a) - width), len(a))
            j = self._split_in(b, 1, min(width, len(b)))
            whole_left, whole_right = width >= len(a), width >= len(b)
            if (i is not None or whole_left) and (j is not None or whole_right):
                i, j = i or 0, len(b) if j is None else j
                keep = self._count(left, len(a[i:].encode()), True)
                drop = self._count(right, len(b[:j].encode()), False)
                return left[: len(left) - keep] + self.encode(a[i:] + b[:j]) + right[drop:]
            if i is None and j is None and not (whole_left or whole_right):
                run = a[-width:] + b[:width]
                kind = _kind(run[0])
                if kind > 0 and all(_kind(c) == kind for c in run) and (ids := self._agreed(left, right, len(a[-width:].encode()), len(b[:width].encode()))):
                    return ids
            width *= 2

    @staticmethod
    def _split_in(text: str, lo: int, hi: int) -> int | None:
        return next((i for i in range(max(1, lo), hi) if must_split(text, i)), None)

    def _count(self, ids: list[int], n_bytes: int, from_end: bool) -> int:
        """So many tokens at an end of ``ids`` make up ``n_bytes``."""
        n = k = 0
        for t in reversed(ids) if from_end else ids:
            if n >= n_bytes:
                break
            n += int(self.size[t])
            k += 1
        if n != n_bytes:
            raise AssertionError("a token spans a place where the pattern must split")
        return k

    def _agreed(self, left: list[int], right: list[int], before: int, after: int) -> list[int] | None:
        """Tokens within the window's bytes encoded again as one piece, if both ends agree."""
        n = k = 0
        for t in reversed(left):
            if n + self.size[t] > before:
                break
            n, k = n + int(self.size[t]), k + 1
        n = m = 0
        for t in right:
            if n + self.size[t] > after:
                break
            n, m = n + int(self.size[t]), m + 1
        if k < 2 or m < 2:
            return None
        piece = self.base.decode_bytes(left[-k:] + right[:m])
        ids = self.base._core_bpe.encode_single_piece(piece)
        if ids[0] == left[-k] and ids[-1] == right[m - 1]:
            return left[:-k] + ids + right[m:]
        return None

    def tree(self, texts: list[str], ids: list[list[int]]) -> list[int]:
        """The ids of the concatenated texts, joined pairwise as a tree."""
        while len(texts) > 1:
            pairs = range(0, len(texts) - 1, 2)
            joined = [self.joined(texts[i], ids[i], texts[i + 1], ids[i + 1]) for i in pairs]
            odd = len(texts) % 2
            texts, ids = [texts[i] + texts[i + 1] for i in pairs] + texts[-1:] * odd, joined + ids[-1:] * odd
        return ids[0] if ids else []

    def encode_long(self, text: str, leaf: int = LEAF) -> list[int]:
        """``encode`` for one text in one place, by halves."""
        texts = halves(text, leaf)
        return self.tree(texts, [self.encode(t) for t in texts])


def halves(text: str, leaf: int) -> list[str]:
    """Successive parts of equal length, a power of two of them, of at most ``leaf`` characters."""
    n = 1
    while n * leaf < len(text):
        n *= 2
    at = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


@lru_cache(4)
def encoder(name: str, folder: str = TOKENIZERS) -> Encoder:
    """The process's encoder of a rank file."""
    return Encoder(f"{folder}/{name}.tiktoken")


def id_lists(ids: list[list[int]]) -> pa.Array:
    """Lists of ids as one Arrow array of int lists."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, bounds[-1])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF) -> DataFrame:
    """(key, ids array<int>): one row for each row of ``df``, repeated keys included.

    No special tokens are added, and strings that look like them are ordinary text. A null
    or empty text has an empty array, also with a null key. The whole text is encoded,
    whatever its length. Columns other than ``key`` and ``text`` aren't read.
    """
    kind = df.schema[key].dataType.simpleString()
    shape = f"key {kind}, ids array<int>"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, folder)
        for batch in batches:
            ids = [e.encode(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), id_lists(ids)], ["key", "ids"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                parts = halves(t, leaf)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([i] * n)), batch.column("row").take(pa.array([i] * n)), pa.array(range(n), pa.int32()), pa.array(parts)], ["key", "row", "part", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, folder)
        for batch in batches:
            ids = [e.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, id_lists(ids)], [*batch.schema.names, "ids"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        ids = encoder(tokenizer, folder).tree(table["text"].to_pylist(), table["ids"].to_pylist())
        return pa.table({"key": table["key"][:1], "ids": id_lists([ids])})

    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    is_long = F.length("text") > leaf
    pieces = own.withColumn("row", F.monotonically_increasing_id()).where(is_long).mapInArrow(cut_up, f"key {kind}, row bigint, part int, text string")
    spread = pieces.repartition(F.col("row"), F.col("part"))
    whole = spread.mapInArrow(encode, f"key {kind}, row bigint, part int, text string, ids array<int>").groupBy("row").applyInArrow(join, shape)
    out = own.where(F.coalesce(~is_long, F.lit(True))).mapInArrow(short, shape).unionByName(whole)
    return out.select(F.col("key").alias(key), "ids")
