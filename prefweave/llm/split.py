"""Splitting of oversized texts at natural boundaries, by packing a structure tree.

A text's structure is a tree: sections under headings of levels 1 to 6 (of markdown or HTML),
blocks and paragraphs, lines, list items and table rows, those nested in them by indentation or by
nested lists and cells, lines of fenced code, sentences, words, characters. Only nodes
over the limit are taken apart, and the parts of such a node are merged again with their
siblings, from below, as far as they fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.llm.tokens import LEAF, TOKENIZERS, Encoder, encoder

LEVELS = ("", "heading 1", "heading 2", "heading 3", "heading 4", "heading 5", "heading 6", "paragraph", "line", "inner line", "inner line 2", "inner line 3", "sentence", "word", "character")
_PARAGRAPH, _LINE, _INNER, _, _DEEPEST, _SENTENCE, _WORD, _CHARACTER = range(7, 15)
_LINE_START = re.compile(r"(?:\r\n|[\n\r  ])(?:[ \t]*(?:\r\n|[\n\r  ]))*")
_INDENT = re.compile(r"[ \t]*")
_HEADING = re.compile(r"(#{1,6})[ \t]")
#: opening tags of markup that begin a part; lists are followed into each other
_TAG = re.compile(r"<(/?)(?:(h[1-6])|(ul|ol)|(p|div|section|article|header|footer|main|table|blockquote|pre|dl)|(li|tr|dt)|(td|th|dd))\b[^<>]*>", re.I)
_SENTENCE_END = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”]?")
_WORD_START = re.compile(r"\s+")


def _structure(text: str) -> tuple[list[int], list[int]]:
    """Places where a line, a tag's part or more begins, and the level of each."""
    found: dict[int, int] = {}
    fenced: list[tuple[int, int]] = []
    fence = 0 if text.startswith("```") else None
    indents: list[int] = []
    for m in _LINE_START.finditer(text):
        i = m.end()
        if i >= len(text):
            break
        blank = len(_LINE_START.match(m.group()).group().splitlines()) > 1
        if text.startswith("```", i):
            kind = _INNER if fence is not None else (_PARAGRAPH if blank else _LINE)
            if fence is None:
                fence = i
            else:
                fenced.append((fence, i))
                fence = None
        elif fence is not None:
            kind = _INNER
        elif h := _HEADING.match(text, i):
            kind = len(h.group(1))
        else:
            # an indented line lies within the nearest one above that is less indented
            white = _INDENT.match(text, i).group()
            columns = len(white.expandtabs(4))
            while indents and indents[-1] >= columns:
                indents.pop()
            depth = len(indents) if indents or columns == 0 else 1
            indents.append(columns)
            kind = _PARAGRAPH if blank and not columns else min(_LINE + depth, _DEEPEST)
        found[i] = kind
    if fence is not None:
        fenced.append((fence, len(text)))
    if "<" in text:
        _tags(text, fenced, found)
    return [list(x) for x in zip(*sorted(found.items()), strict=True)] if found else ([], [])


def _tags(text: str, fenced: list[tuple[int, int]], found: dict[int, int]) -> None:
    """Adds the places of tags outside fenced code; where a line begins too, the higher level holds."""
    lists, k = 0, 0
    for m in _TAG.finditer(text):
        i = m.start()
        while k < len(fenced) and fenced[k][1] < i:
            k += 1
        if k < len(fenced) and fenced[k][0] <= i:
            continue
        closing, heading, listed, block, item, cell = m.groups()
        if listed:
            lists = max(0, lists + (-1 if closing else 1))
        if closing or not i:
            continue
        if heading:
            kind = int(heading[1])
        elif block or (listed and lists == 1):
            kind = _PARAGRAPH
        elif cell:
            kind = _INNER
        else:
            kind = min(_LINE + max(0, lists - 1), _DEEPEST)
        found[i] = min(kind, found.get(i, kind))


def _finer(text: str, a: int, b: int, level: int) -> list[int]:
    """Places within text[a:b] where a sentence, a word, or else any character may begin."""
    if level == _SENTENCE:
        return [m.end() for m in _SENTENCE_END.finditer(text, a, b) if a < m.end() < b]
    if level == _WORD:
        return [m.end() for m in _WORD_START.finditer(text, a, b) if a < m.end() < b]
    joins = lambda i: unicodedata.category(text[i]) in ("Mn", "Mc", "Me", "Cf", "Sk") or text[i - 1] == "‍"
    return [i for i in range(a + 1, b) if not joins(i)] or list(range(a + 1, b))


class _Packer:
    def __init__(self, text: str, ids: list[int], e: Encoder) -> None:
        self.text = text
        if text.isascii():
            self.byte = np.arange(len(text) + 1)
        else:
            c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            self.byte = np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF).astype(np.int64))])
        self.start = np.cumsum(e.size[ids]) - e.size[ids]
        at = np.searchsorted(self.start, self.byte)
        cut = np.append(self.start, -1)[at] != self.byte
        self.before, self.before_whole = at.tolist(), (at - cut).tolist()
        self.at, self.level = (np.array(x, np.int64) for x in _structure(text))

    def tokens(self, a: int, b: int) -> int:
        """Tokens that begin in text[a:b], and one cut at its begin."""
        return self.before[b] - self.before_whole[a]

    def pack(self, a: int, b: int, limit: int, level: int = 0) -> list[tuple[int, int, int]]:
        """(begin, end, level of the cut before it) of pieces of text[a:b] within ``limit``."""
        if self.tokens(a, b) <= limit:
            return [(a, b, 0)]
        lo, hi = np.searchsorted(self.at, [a + 1, b])
        inside = self.level[lo:hi]
        inside = inside[inside > level]
        if len(inside):
            level = int(inside.min())
            cuts = self.at[lo:hi][self.level[lo:hi] == level].tolist()
        else:
            for level in range(max(level + 1, _SENTENCE), _CHARACTER + 1):  # noqa: B020
                if cuts := _finer(self.text, a, b, level):
                    break
            else:
                return [(a, b, 0)]  # one character
        parts: list[tuple[int, int, int]] = []
        for x, y in zip([a, *cuts], [*cuts, b], strict=True):
            if self.tokens(x, y) <= limit:
                parts.append((x, y, level))
            else:
                own = self.pack(x, y, limit, level)
                parts += [(x, own[0][1], level), *own[1:]]
        merged = [(a, parts[0][1], 0)]
        for x, y, cut in parts[1:]:
            if self.tokens(merged[-1][0], y) <= limit:
                merged[-1] = (merged[-1][0], y, merged[-1][2])
            else:
                merged.append((x, y, cut))
        return merged

    def back(self, a: int, overlap: int) -> int:
        """About ``overlap`` tokens before ``a``, at the begin of a word if one is near."""
        k = int(np.searchsorted(self.start, self.byte[a]))
        near = lambda d: int(np.searchsorted(self.byte, self.start[max(0, k - d)]))
        lo, i, hi = near(overlap + overlap // 8), near(overlap), near(overlap - overlap // 8)
        words = [m.end() for m in _WORD_START.finditer(self.text, lo, hi)]
        return min(words, key=lambda x: abs(x - i)) if words else min(i, a)


def pieces_of(text: str, e: Encoder, limit: int, overlap: int, leaf: int = LEAF) -> list[tuple[int, int, int, int, int]]:
    """(begin, own begin, end, tokens, level) of the pieces; none if the text is within ``limit``.

    text[begin:own begin] repeats the end of the piece before.
    """
    ids = e.encode_long(text, leaf)
    if len(ids) <= limit:
        return []
    packer = _Packer(text, ids, e)
    room = limit - overlap - overlap // 4
    out = []
    todo = [(*p, room) for p in reversed(packer.pack(0, len(text), room))]
    while todo:
        a, b, cut, size = todo.pop()
        begin = packer.back(a, overlap) if a else 0
        n = len(e.encode_long(text[begin:b], leaf))
        if n <= limit or b - a < 2:
            out.append((begin, a, b, n, cut))
        else:  # a piece on its own has other tokens at its ends than within the text
            again = packer.pack(a, b, size - max(8, n - limit))
            todo += [(*p, size - max(8, n - limit)) for p in reversed([(a, again[0][1], cut), *again[1:]])]
    return out


def split_texts(df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens.

    (key, piece, n_pieces, text, n_tokens, n_repeated, cut): ``piece`` counts from 0; ``n_tokens``
    is at most ``limit``; the first ``n_repeated`` characters repeat the end of the piece before,
    about ``overlap`` tokens; ``cut`` names the boundary before the piece. Without the
    repeated parts the pieces are the text, unchanged. Texts within the limit, null and
    empty ones give no rows, as does a null key's text: it gives pieces with a null key.
    A key that comes again is split again. Other columns aren't read.
    """
    if not 0 <= overlap * 2 < limit:
        raise ValueError("the overlap must be less than half the limit")
    kind = df.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, folder)
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                own = pieces_of(t, e, limit, overlap)
                rows += [(i, k, len(own), t[a:b], n, x - a, LEVELS[cut]) for k, (a, x, b, n, cut) in enumerate(own)]
            if rows:
                at, *rest = zip(*rows, strict=True)
                types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], ["key", "piece", "n_pieces", "text", "n_tokens", "n_repeated", "cut"])

    # a token has a byte or more, so shorter texts can't exceed the limit
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    out = own.mapInArrow(split, f"key {kind}, piece int, n_pieces int, text string, n_tokens int, n_repeated int, cut string")
    return out.withColumnRenamed("key", key)
