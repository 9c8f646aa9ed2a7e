"""Records that largely repeat another record, found by a prefix-tree join.

Every record is the set of its distinct runs of ``k`` successive words. Two records are
linked when their Jaccard similarity reaches a threshold. The join is exact, and takes the
same path at every size:

1. *Classes and order.* One pass gives each record the 128-bit digest of its set (equal sets
   are one class from then on) and a count sketch of all runs. The sketch, an array of fixed
   size that is added up in a tree, gives one global order of the runs, rare ones first. The
   order only steers the work.
2. *Entries.* The universe of runs is cut into ``slices`` by hash. If two sets have similarity t,
   their parts in at least one slice have t or more (the whole is a mediant of the parts); then
   the first run that these parts share lies in the prefix of both: so early in the order that
   enough may still follow. Each run of a prefix makes one entry: the run, the part's size, how
   many runs remain from there on, and the next ``PATH`` runs in short. Entries go to the bucket of
   their run. How many there are depends on the sets alone, not on the number of buckets or of
   rows. The entries of a very frequent run are split into a triangle of cells.
3. *Prefix tree.* A bucket's entries form a tree: the run, then the runs that follow it, then
   the sizes. Pairs of subtrees are walked from the top. A pair carries how many runs its two
   paths have in common so far and hands that on to all pairs below it; what remains below both nodes
   bounds the overlap, and a pair of subtrees that can't reach the threshold is left.
4. *Check.* Candidates whose signatures, counters of a set's runs by parts of the universe, differ
   by too much are left. The others meet their whole sets, and the exact similarity decides. Only
   records that are candidates are read again, by means of a Bloom filter whose size follows their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.llm.bloom import bloom, bloom_size, held
from prefweave.llm.words import BLOCK_CHARS, blocks, chat_texts, mix, runs, words
from prefweave.operators.order import joined_back
from prefweave.operators.tree import gathered, shipped
from prefweave.session import cut

_MASK48 = np.uint64((1 << 48) - 1)
_FP = np.int64((1 << 48) - 1)  #: bits of a digest that entries carry
_PAIRS = 1 << 19  #: pairs looked at together
_COUNTERS = 128  #: of a set's signature
_TASKS = 20_000  #: most tasks of the join of buckets
_FLUSH = 1 << 20  #: entries that a task gathers before it hands them on


@dataclass(frozen=True)
class Join:
    """Parameters of the join; only ``k`` and ``threshold`` change which rows are similar.

    ``entries``: entries that a bucket should hold; also the size from which on a run is split into cells.
    ``sketch_bits``: counters of the sketch. ``bloom_bits``: the filter's greatest size; with more
    candidates than it holds well, more records are read again, but none too few.
    """

    k: int = 5
    threshold: Fraction = Fraction(4, 5)
    slices: int = 6
    entries: int = 500_000
    sketch_bits: int = 22
    bloom_bits: int = 27

    def __post_init__(self) -> None:
        if self.k < 1 or not 0 < self.threshold <= 1 or not 1 <= self.slices <= 16 or self.entries < 1:
            raise ValueError("k and entries are 1 or more, the threshold is in (0, 1], and there are 1 to 16 slices")


class Sets:
    """Sets of a block of records: sorted 48-bit run hashes, and a 128-bit digest of each set."""

    def __init__(self, texts: list[str | None], row: np.ndarray, rows: int, k: int) -> None:
        w = words(texts)
        h, first = runs(w, k)
        key = np.sort((row[w.text[first]].astype(np.uint64) << np.uint64(48)) | (h & _MASK48))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        self.run = key & _MASK48
        self.row = (key >> np.uint64(48)).astype(np.int64)
        self.size = np.bincount(self.row, minlength=rows)
        self.bound = np.concatenate([[0], np.cumsum(self.size)])
        self.fp, self.fp2 = self._digest(np.uint64(0)), self._digest(np.uint64(0x5BF03635))

    def _digest(self, salt: np.uint64) -> np.ndarray:
        # the sum of independent mixes doesn't depend on order; sets of one size and sum are equal
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.run + salt), dtype=np.uint64)])
            return mix(total[self.bound[1:]] - total[self.bound[:-1]] + self.size.astype(np.uint64)).view(np.int64)

    def signature(self, at: np.ndarray) -> pa.Array:
        """How many runs of each set fall into each of ``_COUNTERS`` parts of the universe, up to 15, two parts to a byte."""
        part = (mix(self.run) >> np.uint64(20)) % np.uint64(_COUNTERS)
        n = np.bincount(self.row * _COUNTERS + part.astype(np.int64), minlength=len(self.size) * _COUNTERS)
        n = np.minimum(n, 15).astype(np.uint8).reshape(-1, _COUNTERS)[at]
        return pa.array([x.tobytes() for x in n[:, ::2] | n[:, 1::2] << 4], pa.binary())

    def cls(self, at: np.ndarray) -> pa.Array:
        """The digests of the sets ``at`` as binaries."""
        both = np.stack([self.fp[at], self.fp2[at]], 1)
        return pa.array([x.tobytes() for x in both], pa.binary())


def sets_of(columns: list[pa.Array], k: int) -> Iterator[tuple[int, int, Sets]]:
    """Sets of the rows of text or chat columns, in blocks of rows; runs stay within a message."""
    texts: list[str | None] = []
    row = np.zeros(0, np.int64)
    for c in columns:
        t, r = chat_texts(c) if pa.types.is_list(c.type) else (c.to_pylist(), np.arange(len(c)))
        texts, row = texts + t, np.concatenate([row, r])
    order = np.argsort(row, kind="stable")
    row = row[order]
    chars = np.bincount(row, [len(texts[i] or "") + 1 for i in order], minlength=len(columns[0]))
    for a, b in blocks(chars, BLOCK_CHARS):
        lo, hi = np.searchsorted(row, [a, b])
        yield a, b, Sets([texts[i] for i in order[lo:hi]], row[lo:hi] - a, b - a, k)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of counters of 32 bits that stop at their greatest value."""
    return np.minimum(a.astype(np.uint64) + b, 0xFFFFFFFF).astype(np.uint32)


# ---- the order of runs


class Order:
    """The global order of runs: by the logarithm of their counts in the sketch, then by hash."""

    def __init__(self, counts: np.ndarray, entries: int) -> None:
        self.width = len(counts)
        # 12 bits of a monotone scale are enough for an order
        self.scale = np.where(counts < 2048, counts, 2048 + np.minimum(2047, (np.log2(np.maximum(counts, 2048)) - 11) * 90)).astype(np.uint16)
        mass = np.cumsum(np.bincount(self.scale, counts, minlength=4096))
        mass = (mass / max(1.0, mass[-1]) * 254).astype(np.int64)
        #: where each step of the scale begins and how wide it is among 8-bit keys of equal mass
        self.base = np.concatenate([[0], mass[:-1]])
        self.wide = mass - self.base
        step = np.arange(4096)
        upper = np.where(step < 2048, step, np.exp2((step - 2047) / 90 + 11))
        # what other runs add to a counter
        noise = float(np.median(counts))
        #: into so many blocks the records of a run are split
        self.blocks = np.maximum(1, np.ceil((upper - noise) / entries)).astype(np.int64)


def _sketch(df: DataFrame, join: Join) -> Order:
    width = 1 << join.sketch_bits
    counts = gathered(df.where("block is not null").select("block", "part", "data"), width, np.uint32, _added)
    return Order(counts, join.entries)


def surveyed(df: DataFrame, key: str, text_columns: list[str], join: Join) -> DataFrame:
    """Rows (fp, cls, key, n, data) of each record with runs, data being its signature, and rows (block, part, data) of each task's sketch."""
    width, k = 1 << join.sketch_bits, join.k
    kind = df.schema[key].dataType.simpleString()

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, key_type = np.zeros(width, np.uint32), None
        for batch in batches:
            key_type = batch.column("key").type
            for a, b, s in sets_of([batch.column(f"t{i}") for i in range(len(text_columns))], k):
                at, n = np.unique((s.run & np.uint64(width - 1)).astype(np.int64), return_counts=True)
                counts[at] = _added(counts[at], n.astype(np.uint32))
                has = np.flatnonzero(s.size)
                none = pa.nulls(len(has), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(s.fp[has] & _FP), s.cls(has), batch.column("key").slice(a, b - a).take(pa.array(has)), pa.array(s.size[has]), none, none, s.signature(has)], _SURVEY)
        if key_type is not None:
            x = shipped(counts)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary()), pa.nulls(len(x), key_type), pa.nulls(len(x), pa.int64()), *x.columns], _SURVEY)

    own = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(text_columns)))
    return cut(own.mapInArrow(survey, f"fp bigint, cls binary, key {kind}, n bigint, block int, part int, data binary"))


_SURVEY = ["fp", "cls", "key", "n", "block", "part", "data"]

# ---- entries

PATH = 12  #: runs that follow an entry's own run in its path
#: the fields of an entry and the bytes that each takes; sizes take 1, 2 or 4, as a pack needs
ENTRY = (("fp", 6), ("run", 3), *((f"next{i}", 1) for i in range(PATH)), ("size", 0), ("rest", 0))


def entries_of(s: Sets, send: np.ndarray, order: Order, threshold: float, slices: int, buckets: int) -> dict[str, np.ndarray]:
    """The entries of the sets with ``send``, and their buckets."""
    use = send[s.row]
    run, row = s.run[use], s.row[use]
    step = order.scale[(run & np.uint64(order.width - 1)).astype(np.int64)]
    piece = (run >> np.uint64(24)) % np.uint64(slices)
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (piece << np.uint64(44)) | (step.astype(np.uint64) << np.uint64(32)) | (mix(run) >> np.uint64(32)))
    part, step, h = (key >> np.uint64(44)).astype(np.int64), ((key >> np.uint64(32)) & np.uint64(4095)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
    short = (order.base[step] + ((h * order.wide[step].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)).astype(np.uint8)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    length = np.diff(np.append(first, len(part)))
    size = np.repeat(length, length)
    rest = np.repeat(first + length, length) - np.arange(len(part))
    # a run of one record alone is shared with none
    at = np.flatnonzero((rest >= np.ceil(threshold * size - 1e-9)) & (step > 1))
    out = {"fp": s.fp[part[at] >> 4] & _FP, "run": h[at] & np.uint64(0xFFFFFF), "size": size[at], "rest": rest[at]}
    for i in range(PATH):
        after = np.minimum(at + i + 1, len(short) - 1)
        out[f"next{i}"] = np.where(rest[at] > i + 1, short[after], 255)
    home, split = mix(h[at] + np.uint64(0x2545F491)), order.blocks[step[at]]
    many = split > 1
    if many.any():
        # block i meets block j in the cell (i, j): each entry goes to the cells of its block
        keep, own = np.flatnonzero(~many), np.flatnonzero(many)
        o, j = _expand(split[own])
        o = own[o]
        i = (mix(out["fp"][o].astype(np.uint64)) % split[o].astype(np.uint64)).astype(np.int64)
        cell = np.minimum(i, j) * (1 << 31) + np.maximum(i, j) + 1
        home = np.concatenate([home[keep], mix(home[o] ^ cell.astype(np.uint64))])
        # two cells of one run in one bucket stay apart
        out["run"] = np.concatenate([out["run"][keep], mix(out["run"][o] + cell.astype(np.uint64)) & np.uint64(0xFFFFFF)])
        out = {c: v if c == "run" else np.concatenate([v[keep], v[o]]) for c, v in out.items()}
    out["bucket"] = (home % np.uint64(buckets)).astype(np.int64)
    return out


def _packed(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    """One row for each bucket: its entries, field by field, compressed; each run of a path as its distance from the one before."""
    e = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    for i in range(PATH - 1, 0, -1):
        e[f"next{i}"] = (e[f"next{i}"].astype(np.uint8) - e[f"next{i - 1}"].astype(np.uint8)).astype(np.uint8)
    o = np.lexsort((e["run"], e["bucket"]))
    bucket = e["bucket"][o]
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    fields = [(np.ascontiguousarray(e[c][o].astype(np.int64)).view(np.uint8).reshape(-1, 8), n) for c, n in ENTRY]
    most = np.maximum.reduceat(e["size"][o], begin)
    data = []
    for a, b, m in zip(begin, np.append(begin[1:], len(o)), most, strict=True):
        wide = 1 if m < 1 << 8 else 2 if m < 1 << 16 else 4
        plain = b"".join(f[a:b, : n or wide].tobytes() for f, n in fields)
        data.append(bytes([wide]) + len(plain).to_bytes(4, "little") + pa.compress(plain, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def _unpacked(data: memoryview) -> dict[str, np.ndarray]:
    """The entries of one row of ``_packed``."""
    wide, at, out = data[0], 0, {}
    data = memoryview(pa.decompress(data[5:], int.from_bytes(data[1:5], "little"), "zstd"))
    n = len(data) // sum(w or wide for _, w in ENTRY)
    for c, w in ENTRY:
        w = w or wide
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = np.frombuffer(data[at : at + n * w], np.uint8).reshape(n, w)
        out[c] = x.view(np.int64)[:, 0].astype(np.uint8) if c.startswith("next") else x.view(np.int64)[:, 0]
        at += n * w
    for i in range(1, PATH):
        out[f"next{i}"] = out[f"next{i - 1}"] + out[f"next{i}"]
    return out


def packed_entries(df: DataFrame, text_columns: list[str], join: Join, order: object, buckets: int) -> DataFrame:
    """Rows (bucket, data) of all records' entries."""
    k, threshold, slices = join.k, float(join.threshold), join.slices

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        parts, n = [], 0
        for batch in batches:
            for _, _, s in sets_of(batch.columns, k):
                # of equal sets, a task sends one
                send = np.zeros(len(s.fp), bool)
                send[np.unique(s.fp, return_index=True)[1]] = True
                send &= (s.size > 0) & ~np.isin(s.fp, seen)
                seen = np.union1d(seen, s.fp[send])
                if send.any():
                    parts.append(entries_of(s, send, order.value, threshold, slices, buckets))
                    n += len(parts[-1]["fp"])
                    if n >= _FLUSH:
                        yield _packed(parts)
                        parts, n = [], 0
        if n:
            yield _packed(parts)

    return df.select(*text_columns).mapInArrow(pack, "bucket int, data binary")


# ---- the prefix tree of a bucket


def _between(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of items with about ``most`` in all."""
    total = np.cumsum(counts)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield slice(a, b)
        a = b


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, its index so many times, and a running number within."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Tree:
    """Entries as a prefix tree, level by level, without pointers.

    Level 0 has the entries' runs; level 1 tells whether an entry lies in its part's shorter prefix, as one side of
    any similar pair does; the next ``PATH`` levels have the runs that follow, and the last one classes of sizes. Entries
    are in the order of the tree, so a node is a range of entries, and its children are a range of nodes.
    """

    def __init__(self, e: dict[str, np.ndarray], share: float) -> None:
        size, rest = e["size"].astype(np.int64), e["rest"].astype(np.int64)
        outer = rest < 2 * share * size - 1e-9
        wide = (4 * np.log2(size)).astype(np.uint64)
        low = wide << np.uint64(32) | size.astype(np.uint64)
        top = e["run"].astype(np.uint64) << np.uint64(1) | outer.astype(np.uint64)
        # the path's keys, eight to a number
        path = [sum(e[f"next{i}"].astype(np.uint64) << np.uint64(8 * (7 - i % 8)) for i in range(j, min(j + 8, PATH))) for j in range(0, PATH, 8)]
        o = np.lexsort((low, *path[::-1], top))
        self.fp, self.size, self.rest, self.outer = e["fp"][o], size[o].astype(np.int32), rest[o].astype(np.int32), outer[o]
        self.path = np.stack([e[f"next{i}"][o] for i in range(PATH)]).astype(np.int16)
        top = top[o]
        self.start: list[np.ndarray] = []
        self.child: list[np.ndarray] = []
        new = np.zeros(len(top), bool)
        for x in (top >> np.uint64(1), top, *self.path, low[o] >> np.uint64(32)):
            new = new | np.concatenate([[True], x[1:] != x[:-1]])
            self.start.append(np.flatnonzero(new))
            if len(self.start) > 1:
                # of each node above, its first child; the last bound ends the last node
                self.child.append(np.append((np.cumsum(new) - 1)[self.start[-2]], len(self.start[-1])))
        n = len(size)
        self.least, self.most, self.ahead = ([f.reduceat(x, s) for s in self.start] for f, x in ((np.minimum, self.size), (np.maximum, self.size), (np.maximum, self.rest)))
        self.end = [np.append(s[1:], n) for s in self.start]
        #: sizes ascend within the nodes of the last level
        self.leaf = np.repeat(np.arange(len(self.start[-1])), self.end[-1] - self.start[-1])
        self.place = (self.leaf << 32) | size[o]


def tree_join(e: dict[str, np.ndarray], threshold: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints (smaller, larger) of sets that may be similar, judged by the entries of one bucket.

    Every pair of sets of similarity ``threshold`` comes out in the bucket of their first common run.
    A block's pairs are distinct; others may come again. Memory is bounded by the entries.
    """
    if len(e["fp"]) < 2:
        return
    t, u = float(threshold), float(threshold / (1 + threshold))
    # a run that comes once has no pair
    order = np.argsort(e["run"], kind="stable")
    run = e["run"][order]
    same = np.flatnonzero(run[1:] == run[:-1])
    several = np.zeros(len(run), bool)
    several[same] = several[same + 1] = True
    if not len(same):
        return
    tree = Tree({c: v[order[several]] for c, v in e.items()}, u)

    def bounded(level: int, a: np.ndarray, b: np.ndarray, lost_a: np.ndarray, lost_b: np.ndarray) -> np.ndarray:
        """May anything below the two nodes be similar?"""
        least, most, ahead = tree.least[level], tree.most[level], tree.ahead[level]
        ok = np.minimum(ahead[a] - lost_a, ahead[b] - lost_b) >= u * (least[a] + least[b]) - 1e-9
        return ok & (most[a] >= t * least[b] - 1e-9) & (most[b] >= t * least[a] - 1e-9)

    def walk(level: int, a: np.ndarray, b: np.ndarray, common: np.ndarray, lost_a: np.ndarray, lost_b: np.ndarray) -> Iterator[np.ndarray]:
        if level == PATH + 2:
            yield from records(a, b, lost_a, lost_b)
            return
        first = tree.child[level]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        for p in _between(na * nb, _PAIRS):
            o, i = _expand((na * nb)[p])
            o += p.start
            u_, v_ = np.divmod(i.astype(np.int32), nb[o].astype(np.int32))
            x, y = first[a[o]] + u_, first[b[o]] + v_
            ok = (a[o] != b[o]) | (x <= y)
            # an entry alone in its node has no pair there
            ok &= (x != y) | (tree.end[level + 1][x] - tree.start[level + 1][x] > 1)
            o, x, y = o[ok], x[ok], y[ok]
            c, la, lb = common[o], lost_a[o], lost_b[o]
            if not level:
                outer = tree.outer[tree.start[1]]
                ok = ~(outer[x] & outer[y])
            elif level <= PATH:
                # the paths so far, and what they have in common with the new runs
                pa_, pb = tree.path[:level, tree.start[level + 1][x]], tree.path[:level, tree.start[level + 1][y]]
                ra, rb = pa_[-1], pb[-1]
                c += ra == rb
                end = np.minimum(ra, rb)
                la, lb = np.zeros(len(x), np.int16), np.zeros(len(x), np.int16)
                for j in range(level):
                    if j < level - 1:
                        c += pb[j] == ra
                        c += pa_[j] == rb
                    la += pa_[j] < end
                    lb += pb[j] < end
                # runs before the nearer end of both paths can't be met any more
                la, lb = np.maximum(la - c, 0), np.maximum(lb - c, 0)
                ok = np.ones(len(x), bool)
            else:
                ok = np.ones(len(x), bool)
            ok &= bounded(level + 1, x, y, la, lb)
            if ok.any():
                yield from walk(level + 1, x[ok], y[ok], c[ok], la[ok], lb[ok])

    def records(a: np.ndarray, b: np.ndarray, lost_a: np.ndarray, lost_b: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs of entries of two leaves: for each of the one, those of a range of sizes of the other."""
        begin, count = tree.start[-1][a], tree.end[-1][a] - tree.start[-1][a]
        for p in _between(count, _PAIRS):
            o, i = _expand(count[p])
            o += p.start
            x = begin[o] + i
            size, other = tree.size[x].astype(np.int64), b[o] << 32
            lo = np.searchsorted(tree.place, other | np.ceil(t * size - 1e-9).astype(np.int64))
            lo = np.where(a[o] == b[o], np.maximum(lo, x + 1), lo)
            most = np.floor((tree.rest[x] - lost_a[o]) / u - size + 1e-9).astype(np.int64)
            hi = np.where(most > 0, np.searchsorted(tree.place, other | np.clip(most, 0, (1 << 32) - 1), side="right"), 0)
            n = np.maximum(0, hi - lo)
            for q in _between(n, _PAIRS):
                w, j = _expand(n[q])
                w += q.start
                y = lo[w] + j
                ok = (tree.rest[y] - lost_b[o[w]] >= u * (size[w] + tree.size[y]) - 1e-9) & (size[w] >= t * tree.size[y] - 1e-9)
                fa, fb = tree.fp[x[w[ok]]], tree.fp[y[ok]]
                ok = fa != fb
                if ok.any():
                    yield np.unique(np.stack([np.minimum(fa[ok], fb[ok]), np.maximum(fa[ok], fb[ok])], 1), axis=0)

    roots = np.flatnonzero(tree.end[0] - tree.start[0] > 1)
    zero = np.zeros(len(roots), np.int16)
    for pairs in walk(0, roots, roots, zero, zero, zero):
        yield pairs[:, 0], pairs[:, 1]


def _candidates(threshold: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs from packed rows in order of their buckets; a task holds one bucket at a time."""

    def pairs(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b in tree_join({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp_a", "fp_b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []
        now = None
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                if parts and bucket != now:
                    yield from pairs(parts)
                    parts = []
                now = bucket
                parts.append(_unpacked(memoryview(data.as_buffer())))
        if parts:
            yield from pairs(parts)

    return joined


# ---- the check of candidates


def may_be_similar(a: list[bytes], b: list[bytes], size_a: np.ndarray, size_b: np.ndarray, share: float) -> np.ndarray:
    """By the signatures of two sets each: the runs that only one of them has are as many as their counters differ, or more."""
    apart = np.zeros(len(a), np.int64)
    x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), _COUNTERS // 2).astype(np.int16) for v in (a, b))
    for shift in (0, 4):
        apart += np.abs((x >> shift & 15) - (y >> shift & 15)).sum(1)
    both = size_a + size_b
    return both - apart >= 2 * share * both - 1e-9


def linked_sets(df: DataFrame, key: str, text_columns: list[str], join: Join | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs (cls_a, cls_b, similarity) of similar classes, and rows (cls, key) of all records.

    A class is the records of one set; links are between different classes only, each once. Both
    frames are materialised.

    A null key is left out. A key that comes again is one record: rows equal to its earlier
    ones add nothing, others make it a member of several classes. Null chats, messages and contents and
    texts of fewer than ``k`` words have no runs and are in no class. An empty table gives none.
    Other columns of ``df`` aren't read.
    """
    join = join or Join()
    spark = df.sparkSession
    survey = surveyed(df, key, text_columns, join)
    records = survey.where("block is null")
    members = cut(records.select("fp", "cls", "key").distinct())
    total = records.agg(F.sum(F.col("n") * (1 - float(join.threshold)) + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / join.entries))
    order = spark.sparkContext.broadcast(_sketch(survey, join))
    own = df.where(F.col(key).isNotNull())
    # a task has one bucket, or of very many buckets several in turn
    tasks = min(buckets, _TASKS)
    packed = packed_entries(own, text_columns, join, order, buckets).repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    found = packed.mapInArrow(_candidates(join.threshold), "fp_a bigint, fp_b bigint")

    share = float(join.threshold / (1 + join.threshold))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ok = may_be_similar(batch.column("data_a").to_pylist(), batch.column("data_b").to_pylist(), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), share)
                yield batch.filter(pa.array(ok)).select(["cls_a", "cls_b"])

    classes = records.groupBy("fp", "cls").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    end = lambda x: classes.select(*(F.col(c).alias(f"{c}_{x}") for c in classes.columns))
    candidates = cut(found.distinct().join(end("a"), "fp_a").join(end("b"), "fp_b").select("cls_a", "cls_b", "n_a", "n_b", "data_a", "data_b").mapInArrow(sift, "cls_a binary, cls_b binary"))

    # one record stands for each class that is a candidate
    ends = candidates.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    chosen = cut(members.join(ends, "cls", "left_semi").groupBy("cls").agg(F.min("key").alias("key")))
    chosen_keys = bloom(chosen.select(F.xxhash64("key").alias("h")), bloom_size(chosen.count(), join.bloom_bits), lambda batch: batch.column("h").to_numpy())
    sent = spark.sparkContext.broadcast(chosen_keys)
    k = join.k

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(held(sent.value, batch.column("h").to_numpy())))
            for _, _, s in sets_of([batch.column(f"t{i}") for i in range(len(text_columns))], k):
                yield pa.RecordBatch.from_arrays([s.cls(np.arange(len(s.fp))), pa.ListArray.from_arrays(pa.array(s.bound, pa.int32()), pa.array(s.run.view(np.int64)))], ["cls", "runs"])

    again = own.select(F.xxhash64(key).alias("h"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(text_columns))).mapInArrow(keep, "cls binary, runs array<bigint>")
    whole = cut(again.join(chosen.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))
    side = lambda x: whole.select(F.col("cls").alias(f"cls_{x}"), F.col("runs").alias(f"runs_{x}"))
    num, den = join.threshold.numerator, join.threshold.numerator + join.threshold.denominator
    links = (
        candidates.join(side("a"), "cls_a").join(side("b"), "cls_b")
        .select("cls_a", "cls_b", F.size("runs_a").alias("a"), F.size("runs_b").alias("b"), F.size(F.array_intersect("runs_a", "runs_b")).alias("both"))
        .where(F.col("both") * den >= num * (F.col("a") + F.col("b")))
        .select("cls_a", "cls_b", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("similarity"))
    )
    return cut(links), members.select("cls", "key")


# ---- results


def pairs_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (x, y), x < y, of the keys of one class or of linked classes; a pair may come again."""
    a = members.select(F.col("cls").alias("cls_a"), F.col("key").alias("x"))
    b = members.select(F.col("cls").alias("cls_b"), F.col("key").alias("y"))
    across = links.join(a, "cls_a").join(b, "cls_b").select("x", "y")
    within = a.join(b, F.col("cls_a") == F.col("cls_b")).where("x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def similar_pairs(df: DataFrame, key: str, text_columns: list[str], join: Join | None = None) -> DataFrame:
    """Every pair (key_a, key_b), key_a < key_b, of rows whose sets are similar, each once.

    Expanded from ``linked_sets``, whose rules for nulls and repeated keys hold; the result is
    quadratic in a class of equal sets. ``link_counts`` and ``spanning`` give numbers and groups without it.
    """
    pairs = pairs_of(*linked_sets(df, key, text_columns, join))
    return pairs.select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b")).distinct()


def spanning(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (x, y) with the components of all pairs: a star in each class, and one pair for each link."""
    least = members.groupBy("cls").agg(F.min("key").alias("x"), F.count(F.lit(1)).alias("n"))
    star = joined_back(members, least, ["cls"], "n").where("key <> x").select("x", F.col("key").alias("y"))
    least = least.drop("n")
    across = links.join(least.withColumnRenamed("cls", "cls_a"), "cls_a").join(least.select(F.col("cls").alias("cls_b"), F.col("x").alias("y")), "cls_b").select("x", "y")
    return star.unionByName(across)


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """(key, n_links): to how many other keys all pairs would link each, from the classes' sizes.

    A key in several classes counts once; only such keys are looked at one by one.
    """
    own = cut(members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n_classes")), "key"))
    single, several = own.where("n_classes = 1"), own.where("n_classes > 1")
    sizes = single.groupBy(F.col("cls").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    keys = several.select(F.col("cls").alias("other"), F.col("key").alias("k"))
    near = links.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(links.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))
    # a class that is linked with none and has one member links nothing
    alone = own.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls").unionByName(near.select("cls")).unionByName(several.select("cls")).distinct()
    near = cut(near.unionByName(alone.select("cls", F.col("cls").alias("other"))))

    def reached(by: str, to: DataFrame) -> DataFrame:
        n = to.join(sizes, "other").groupBy(by).agg(F.sum("n").alias("n"))
        return n.unionByName(to.join(keys, "other").groupBy(by).agg(F.count_distinct("k").alias("n"))).groupBy(by).agg((F.sum("n") - 1).alias("n_links"))

    # a class of very many members is joined to them by broadcast
    of_class = reached("cls", near).join(sizes.withColumnRenamed("other", "cls"), "cls")
    of_single = joined_back(single.select("cls", "key"), of_class, ["cls"], "n").select("key", "n_links")
    return of_single.unionByName(reached("key", several.join(near, "cls").select("key", "other").distinct())).where("n_links > 0")
