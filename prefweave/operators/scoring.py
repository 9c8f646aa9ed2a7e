"""Scores from outside models behind one interface, and what is computed from them.

A model is a function from an iterator of pandas batches to an iterator of pandas batches. It is
registered with the columns it gives, and run with ``mapInPandas``; batching, retries and
connections are its own affair. Nothing here needs a model to be installed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.functions.chat import append_system, clean_messages
from prefweave.schemas import SCORE_ROW

Batches = Iterator[pd.DataFrame]


@dataclass(frozen=True)
class Scorer:
    name: str
    run: Callable[[Batches], Batches]
    needs: tuple[str, ...]
    gives: str


_SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, run: Callable[[Batches], Batches], needs: tuple[str, ...], gives: str) -> Scorer:
    """Make a model known by name; ``gives`` is the schema of its result."""
    _SCORERS[name] = Scorer(name, run, needs, gives)
    return _SCORERS[name]


def scorer(name: str) -> Scorer:
    if name not in _SCORERS:
        raise KeyError(f"no scorer named {name}; registered: {sorted(_SCORERS)}")
    return _SCORERS[name]


def scored(df: DataFrame, name: str) -> DataFrame:
    """The registered scorer's result over the columns it needs, and no others."""
    s = scorer(name)
    return df.select(*s.needs).mapInPandas(s.run, s.gives)


def retried(call: Callable[..., object], attempts: int = 5, wait: float = 1.0, on: tuple[type[Exception], ...] = (OSError,)) -> Callable[..., object]:
    """``call`` with further attempts on passing errors; the last error is raised."""

    def run(*args: object, **kwargs: object) -> object:
        for i in range(attempts):
            try:
                return call(*args, **kwargs)
            except on:
                if i == attempts - 1:
                    raise
                time.sleep(wait)
        raise AssertionError

    return run


def called(call: Callable[[object], object], source: str, target: str, attempts: int = 5, wait: float = 1.0, on: tuple[type[Exception], ...] = (OSError,), accept: Callable[[object], bool] = lambda x: True, threads: int = 16) -> Callable[[Batches], Batches]:
    """A runner that adds the column ``target``: ``call`` of each value of ``source``, many at once.

    Passing errors (``on``) are waited out, answers that ``accept`` refuses asked again at once; after
    ``attempts`` the value is None. A null isn't asked about.
    """

    def one(x: object) -> object:
        for i in range(attempts if x is not None else 0):
            try:
                if accept(answer := call(x)):
                    return answer
            except on:
                if i < attempts - 1:
                    time.sleep(wait)
        return None

    def run(batches: Batches) -> Batches:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                yield pdf.assign(**{target: pd.Series(list(pool.map(one, pdf[source])), index=pdf.index, dtype=object)})

    return run


def halving(call: Callable[[list], list], items: list, on: tuple[type[Exception], ...] = (MemoryError,)) -> list:
    """``call`` of all items at once, or of halves of them where it fails for want of room; one item alone must fit."""
    try:
        return call(items)
    except on:
        if len(items) < 2:
            raise
    half = len(items) // 2
    return halving(call, items[:half], on) + halving(call, items[half:], on)


def in_order(choices: list[dict], expected: int) -> list[dict]:
    """A server's choices by their index; another number than expected is an error."""
    if len(choices) != expected:
        raise ValueError(f"expected {expected} choices, got {len(choices)}")
    return sorted(choices, key=lambda c: c["index"])


#: Fixed value: why a row can't be scored.
NO_TOKENS = "final assistant response has no scoreable tokens after truncation"


def rendered(messages: list[dict], ask: bool) -> str:
    """Messages between markers; ``ask`` opens an answer after them."""
    return "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages) + ("<|im_start|>assistant\n" if ask else "")


def scoring_input(messages: list[dict], encode: Callable[[str], list[int]], limit: int) -> tuple[list[int], int, int] | None:
    """(ids, start, length) of the last answer's tokens in the rendered chat of at most ``limit`` tokens; None if none are left."""
    if not len(messages) or messages[-1]["role"] != "assistant":
        raise ValueError("a chat to be scored ends in an answer")
    ids, start = encode(rendered(messages, False))[:limit], len(encode(rendered(messages[:-1], True))[:limit])
    return (ids, start, len(ids) - start) if len(ids) > start else None


def logprob_scorer(key: str, encode: Callable[[str], list[int]], logprobs: Callable[[list[list[int]]], list[list[float | None]]], limit: int) -> Callable[[Batches], Batches]:
    """A runner from rows (key, and the chats ``base_chosen``, ``base_rejected``, ``system_chosen``, ``system_rejected``) to score rows.

    ``logprobs`` gives every token's log-probability for a batch of id lists. A row of which any
    chat has no answer tokens left is skipped with its reason. The columns are those of ``SCORE_ROW``.
    """
    names = ("base_chosen", "base_rejected", "system_chosen", "system_rejected")

    def sums(inputs: list[tuple[list[int], int, int]]) -> Iterator[float]:
        for (ids, start, n), row in zip(inputs, logprobs([i for i, _, _ in inputs]) if inputs else [], strict=True):
            part = row[start : start + n]
            if len(row) != len(ids) or any(x is None for x in part):
                raise ValueError("the span isn't covered by log-probabilities")
            yield float(sum(part))

    def run(batches: Batches) -> Batches:
        for pdf in batches:
            found = [[scoring_input(row[n], encode, limit) for n in names] for row in pdf.to_dict("records")]
            total = sums([x for row in found if all(row) for x in row])
            out = []
            for k, row in zip(pdf[key], found, strict=True):
                if not all(row):
                    out.append({key: k, "skip": True, "skip_reason": NO_TOKENS})
                    continue
                a, b, c, d = (next(total) for _ in names)
                size = (row[0][2], row[1][2])
                out.append({key: k, "skip": False, **{f"{n}_logprob": v for n, v in zip(names, (a, b, c, d), strict=True)}, "chosen_len": size[0], "rejected_len": size[1], "base_diff": a - b, "system_diff": c - d, "raw_score": (c - d) - (a - b), "score": ((c - d) - (a - b)) / sum(size)})
            columns = [c.split()[0] for c in SCORE_ROW.split(", ")]
            full = pd.DataFrame(out, columns=[key, *columns[1:]], dtype=object)
            yield full.where(full.notna(), None)

    return run


def score_logprob(df: DataFrame, key: str, system: str, default: str, encode: Callable[[str], list[int]], logprobs: Callable[[list[list[int]]], list[list[float | None]]], limit: int = 16_384) -> DataFrame:
    """Score rows of pairs (key, chosen, rejected): how much a system prompt favours chosen over rejected, by token."""
    steered = lambda c: append_system(clean_messages(F.col(c)), system, default)
    chats = df.select(key, clean_messages(F.col("chosen")).alias("base_chosen"), clean_messages(F.col("rejected")).alias("base_rejected"), steered("chosen").alias("system_chosen"), steered("rejected").alias("system_rejected"))
    kind = df.schema[key].dataType.simpleString()
    return chats.mapInPandas(logprob_scorer(key, encode, logprobs, limit), f"{key} {kind}, " + SCORE_ROW.split(", ", 1)[1])


def span_sum(logprobs: Column, start: Column, length: Column) -> Column:
    """Sum over the answer's tokens; a span outside the array or a missing value in it is an error."""
    part = F.slice(logprobs, start + 1, length)
    bad = (length <= 0) | (start < 0) | (start + length > F.size(logprobs)) | F.exists(part, lambda x: x.isNull())
    return F.when(bad, F.raise_error(F.lit("the span isn't covered by log-probabilities"))).otherwise(F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")))


def with_lls(df: DataFrame) -> DataFrame:
    """base_diff, system_diff, raw_score and score from four log-probabilities and two lengths."""
    base = F.col("base_chosen_logprob") - F.col("base_rejected_logprob")
    system = F.col("system_chosen_logprob") - F.col("system_rejected_logprob")
    return df.withColumns({"base_diff": base, "system_diff": system, "raw_score": system - base, "score": F.try_divide(system - base, (F.col("chosen_len") + F.col("rejected_len")).cast("double"))})


def valid_scores(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("skip", F.lit(False)))


def cache_faults(scores: DataFrame, expected: int | None = None) -> DataFrame:
    """(fault, n) of what is wrong with a score log: gaps, repeats, skips without reason, missing scores."""
    skipped = F.coalesce(F.col("skip"), F.lit(False))
    n = F.lit(expected) if expected is not None else F.max("row_index") + 1
    counts = scores.agg(
        (F.coalesce(n, F.lit(0)) - F.count_distinct(F.when(F.col("row_index") < n if expected is not None else F.lit(True), F.col("row_index")))).alias("missing_rows"),
        (F.count("row_index") - F.count_distinct("row_index")).alias("repeated_rows"),
        F.count_if(skipped & F.col("skip_reason").isNull()).alias("skips_without_reason"),
        F.count_if(~skipped & (F.col("score").isNull() | F.isnan("score"))).alias("rows_without_score"),
    )
    return counts.select(F.stack(F.lit(4), *(x for c in counts.columns for x in (F.lit(c), F.col(c).cast("bigint")))).alias("fault", "n"))


def checked_scores(scores: DataFrame, expected: int | None = None) -> DataFrame:
    """``scores`` if its log has no fault, else an error."""
    bad = cache_faults(scores, expected).where("n > 0").collect()  # four rows
    if bad:
        raise ValueError(f"faulty score log: { {r['fault']: r['n'] for r in bad} }")
    return scores


def hashed_embedder(dimensions: int = 16) -> Callable[[Batches], Batches]:
    """A stand-in for an embedding model: (row_index, layer, diff) by hashing words. For tests."""
    import zlib

    def embed(text: str | None) -> list[float]:
        v = [0.0] * dimensions
        for w in (text or "").split():
            h = zlib.crc32(w.encode())
            v[h % dimensions] += 1.0 if h & 1024 else -1.0
        return v

    def run(batches: Batches) -> Batches:
        for pdf in batches:
            diff = [[a - b for a, b in zip(embed(c), embed(r), strict=True)] for c, r in zip(pdf["chosen"], pdf["rejected"], strict=True)]
            yield pd.DataFrame({"row_index": pdf["row_index"], "layer": 0, "diff": diff})

    return run
