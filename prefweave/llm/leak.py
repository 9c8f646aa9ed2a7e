"""Passages of evaluation items inside a corpus, by a suffix automaton over words.

The items' words become one generalised suffix automaton. Each text is streamed through
it; at every word the automaton knows the longest run of words, ending there, that some item
holds. Only stretches of ``least`` or more successive words that occur in any item at all are
streamed, which the words' hashes tell beforehand.

The corpus is read once, however many items there are: a Bloom filter of the items' runs of ``least`` words, of bounded
size, tells which texts may leak at all. Only those go through the automata, each of a block of
items of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.llm.bloom import bloom, bloom_size, held
from prefweave.llm.words import BLOCK_CHARS, blocks, runs, words
from prefweave.session import cut

#: Bytes of item texts in one automaton, which takes about 120 times as much; more items are taken in several blocks.
BLOCK_BYTES = 1 << 20
#: The filter of the items' runs has 2 ** 27 bits at most, 16 MB; with more items than it holds well, more texts go through the automata.
FILTER_BITS = 27


class Automaton:
    """Suffix automaton of several sequences of integers, and the items of each state."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.items: list[set[int]] = [set() for _ in self.next]
        for i, s in enumerate(sequences):
            state = 0
            for c in s:
                state = self.next[state][c]
                at = state
                while at > 0 and i not in self.items[at]:
                    self.items[at].add(i)
                    at = self.link[at]

    def _state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's suffixes extended by c, made apart from longer ones."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new


class Items:
    """The words of evaluation items, their ids by hash, and their automaton."""

    def __init__(self, texts: tuple[str, ...], least: int) -> None:
        w = words(list(texts))
        self.vocabulary = np.unique(w.hash)
        ids = np.searchsorted(self.vocabulary, w.hash)
        self.size = np.bincount(w.text, minlength=len(texts))
        bounds = np.concatenate([[0], np.cumsum(self.size)])
        self.least = least
        self.automaton = Automaton([ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)])

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, set[int], int]]:
        """(text, first code point, code point after the last, items, words) of every match of ``least`` words or more; at each word, the longest that each item has."""
        if not len(self.vocabulary):
            return
        a, least = self.automaton, self.least
        for lo, hi in blocks(np.array([len(t or "") + 1 for t in texts], np.int64), BLOCK_CHARS):
            w = words(texts[lo:hi])
            if not len(w.hash):
                continue
            at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == w.hash
            # stretches of known words of one text
            edge = np.concatenate([[True], (w.text[1:] != w.text[:-1]) | (known[1:] != known[:-1])])
            begin = np.flatnonzero(edge)
            stop = np.append(begin[1:], len(at))
            for b, e in zip(begin, stop, strict=True):
                if e - b < least or not known[b]:
                    continue
                state = length = 0
                ids = at[b:e].tolist()
                for i, c in enumerate(ids):
                    while state and c not in a.next[state]:
                        state = a.link[state]
                        length = a.length[state]
                    if c in a.next[state]:
                        state, length = a.next[state][c], length + 1
                    if length >= least:
                        for v, n in self._chain(state, length):
                            j = b + i
                            yield lo + int(w.text[j]), int(w.start[j - n + 1] - w.offset[w.text[j]]), int(w.end[j] - w.offset[w.text[j]]), a.items[v], n

    def _chain(self, state: int, length: int) -> Iterator[tuple[int, int]]:
        """The state and its suffix states of ``least`` words or more, with the words matched."""
        a = self.automaton
        while state > 0 and length >= self.least:
            yield state, length
            state = a.link[state]
            length = a.length[state]


@lru_cache(1)
def _items(texts: tuple[str, ...], least: int) -> Items:
    return Items(texts, least)


def item_blocks(items: DataFrame, item: str, text: str, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """(item, text) rows in blocks of bounded size, whatever the number of items."""
    block, size = [], 0
    for r in items.select(item, text).where(F.col(item).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        n = len(r[1].encode())
        if block and size + n > most_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def _run_hashes(texts: list[str | None], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``least`` words, and the text of each."""
    h, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in blocks(np.array([len(t or "") + 1 for t in texts], np.int64), BLOCK_CHARS):
        w = words(texts[a:b])
        own, first = runs(w, least)
        h.append(own)
        of.append(w.text[first] + a)
    return np.concatenate(h), np.concatenate(of)


def suspects(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 12) -> DataFrame:
    """(row, doc, text) of the texts that may hold ``least`` successive words of an item, materialised; ``row`` numbers them."""
    known = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_text).alias("text"))
    n = known.agg(F.sum(F.length("text"))).first()[0] or 0  # a word has two characters or more, with the space
    bits = docs.sparkSession.sparkContext.broadcast(bloom(known, bloom_size(n // 2, FILTER_BITS), lambda batch: _run_hashes(batch.column("text").to_pylist(), least)[0]))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, of = _run_hashes(batch.column("text").to_pylist(), least)
            at = np.unique(of[held(bits.value, h)])
            if len(at):
                yield batch.take(pa.array(at))

    own = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    found = own.mapInArrow(sift, own.schema)
    return cut(found.select(F.monotonically_increasing_id().alias("row"), "doc", "text"))


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 12, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, item, longest, item_words, coverage): texts that hold ``least`` successive words of an item.

    ``longest``: words of the longest passage; ``coverage``: its share of the item's words.
    Whatever stands between words doesn't matter. Items of fewer words than ``least``, null
    and empty ones leak nowhere; null and empty texts hold nothing; one passage that two
    items share gives both. A doc or item that comes again gives each pair once, with its
    longest passage. Rows with a null id are left out.
    """
    kind, ikind = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"doc {kind}, item {ikind}, longest int, item_words int")
    own = suspects(docs.where(F.col(doc).isNotNull()), doc, text, items, item, item_text, least).select("doc", "text")
    for block in item_blocks(items, item, item_text, most_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = zip(*sent.value, strict=True)
                known = _items(texts, least)
                best: dict[tuple[int, int], int] = {}
                for t, _, _, found, n in known.scan(batch.column("text").to_pylist()):
                    for i in found:
                        best[t, i] = max(best.get((t, i), 0), n)
                if best:
                    at = list(best)
                    yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array([t for t, _ in at])), pa.array([ids[i] for _, i in at]), pa.array(best.values(), pa.int32()), pa.array([int(known.size[i]) for _, i in at], pa.int32())], ["doc", "item", "longest", "item_words"])

        out = out.unionByName(own.mapInArrow(scan, f"doc {kind}, item {ikind}, longest int, item_words int"))
    best = out.groupBy("doc", "item").agg(F.max(F.struct("longest", "item_words")).alias("m"))
    return best.select(F.col("doc").alias(doc), F.col("item").alias(item), F.col("m.longest").alias("longest"), F.col("m.item_words").alias("item_words"), (F.col("m.longest") / F.col("m.item_words")).alias("coverage"))


def without_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 12, least_coverage: float = 0.0, mark: str = " ", most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, text, spans): the texts that leak, with every leaking span replaced by ``mark``.

    A span goes if it has ``least`` words of an item and covers ``least_coverage`` of it; spans
    that touch go together. ``spans`` counts them. One row for each row that leaks, also
    for rows with a null or repeated id.
    """
    own = suspects(docs, doc, text, items, item, item_text, least)
    spans = docs.sparkSession.createDataFrame([], "row bigint, a int, b int")
    for block in item_blocks(items, item, item_text, most_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = _items(tuple(b[1] for b in sent.value), least)
                found = [(t, a, b) for t, a, b, hit, n in known.scan(batch.column("text").to_pylist()) if any(n >= least_coverage * known.size[i] for i in hit)]
                if found:
                    t, a, b = zip(*_merged(sorted(set(found))), strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(t)), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["row", "a", "b"])

        spans = spans.unionByName(own.select("row", "text").mapInArrow(scan, "row bigint, a int, b int"))
    # the spans of one text, merged within each block of items
    of_text = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], []
            for t, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                merged = _merged([(0, s["a"], s["b"]) for s in found])
                ends = [0, *(b for _, _, b in merged)]
                texts.append(mark.join([*(t[at:a] for at, (_, a, _) in zip(ends, merged, strict=False)), t[ends[-1] :]]))
                n.append(len(merged))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string()), pa.array(n, pa.int32())], ["doc", "text", "spans"])

    kind = docs.schema[doc].dataType.simpleString()
    return own.join(of_text, "row").select("doc", "text", "spans").mapInArrow(clean, f"doc {kind}, text string, spans int").select(F.col("doc").alias(doc), F.col("text").alias(text), "spans")


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Ordered (text, first, after the last) with those of one text that touch made one."""
    out: list[tuple[int, int, int]] = []
    for t, a, b in spans:
        if out and out[-1][0] == t and a <= out[-1][2]:
            out[-1] = (t, out[-1][1], max(out[-1][2], b))
        else:
            out.append((t, a, b))
    return out
