"""Repetition inside single texts, with verdicts on the hosts they come from.

A *host* is whatever a text comes from: a domain, a site, or here a model with the kind of
prompt it answered. Texts are measured one by one; rule failures are added up by host; a
host's rate is shrunk with a beta prior fitted to all hosts, so that a host of few texts
isn't judged by chance; and the host's verdict is joined back to every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.llm.words import BLOCK_CHARS, blocks, mix, runs, words
from prefweave.session import cut

_SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？\n]+|[^.!?。！？\n]+$")


@dataclass(frozen=True)
class Limits:
    """A text fails a rule whose share is at or over the limit; a host whose shrunk rate is."""

    run_words: int = 6
    run_share: float = 0.3
    line_share: float = 0.3
    sentence_share: float = 0.3
    host_rate: float = 0.2


def repeated_words(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, its words, and those in a run of ``k`` words that began earlier too."""
    n_words = np.zeros(len(texts), np.int64)
    n_repeated = np.zeros(len(texts), np.int64)
    for a, b in blocks(np.array([len(t or "") + 1 for t in texts], np.int64), BLOCK_CHARS):
        w = words(texts[a:b])
        n_words[a:b] = np.bincount(w.text, minlength=b - a)
        h, first = runs(w, k)
        h = mix(h ^ mix(w.text[first].astype(np.uint64)))
        order = np.argsort(h, kind="stable")  # runs of equal hash stay in their order
        again = order[1:][h[order[1:]] == h[order[:-1]]]
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, first[again], 1)
        np.add.at(edge, first[again] + k, -1)
        inside = np.cumsum(edge[:-1]) > 0
        n_repeated[a:b] = np.bincount(w.text[inside], minlength=b - a)
    return n_words, n_repeated


def _repeated_share(parts: list[str]) -> float:
    """Share of the characters that lie in parts equal to an earlier one."""
    total = again = 0
    seen: set[str] = set()
    for p in parts:
        if p := p.strip():
            total += len(p)
            if p in seen:
                again += len(p)
            seen.add(p)
    return again / total if total else 0.0


def measure(df: DataFrame, key: str, sides: dict[str, str], hosts: list[str], version: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Rows (key, side, host, n_words, n_repeated, share, line_share, sentence_share, failed), one for each side.

    A key that comes again counts once, with its latest ``version`` (a null version is the
    earliest). A null or wordless text has share 0 and fails nothing. A null host value is a
    host of its own. Rows with a null key are left out.
    """
    k = limits.run_words

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, column in sides.items():
                texts = batch.column(column).to_pylist()
                n, r = repeated_words(texts, k)
                share = np.where(n > 0, r / np.maximum(n, 1), 0.0)
                lines = [_repeated_share(t.splitlines()) if t and "\n" in t else 0.0 for t in texts]
                sentences = [_repeated_share(_SENTENCE.findall(t)) if t else 0.0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key"), pa.array([name] * len(batch)), batch.column("_host"), batch.column("_version"), pa.array(n), pa.array(r), pa.array(share), pa.array(lines, pa.float64()), pa.array(sentences, pa.float64())],
                    ["key", "side", "host", "version", "n_words", "n_repeated", "share", "line_share", "sentence_share"],
                )

    host = F.concat_ws("/", *(F.coalesce(F.col(h).cast("string"), F.lit("-")) for h in hosts)) if hosts else F.lit("-")
    kind = df.schema[key].dataType.simpleString()
    vkind = df.schema[version].dataType.simpleString() if version else "int"
    own = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), host.alias("_host"), (F.col(version) if version else F.lit(0)).alias("_version"), *dict.fromkeys(sides.values()))
    rated = own.mapInArrow(rate, f"key {kind}, side string, host string, version {vkind}, n_words bigint, n_repeated bigint, share double, line_share double, sentence_share double")
    latest = rated.groupBy("key", "side").agg(F.max(F.struct("version", "n_words", "n_repeated", "share", "line_share", "sentence_share", "host")).alias("r"))
    r = lambda c: F.col(f"r.{c}")
    failed = (r("share") >= limits.run_share) | (r("line_share") >= limits.line_share) | (r("sentence_share") >= limits.sentence_share)
    return latest.select(F.col("key").alias(key), "side", F.concat_ws("/", F.col("side"), r("host")).alias("host"), r("n_words").alias("n_words"), r("n_repeated").alias("n_repeated"), r("share").alias("share"), r("line_share").alias("line_share"), r("sentence_share").alias("sentence_share"), failed.alias("failed"))


def host_verdicts(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, host_texts, host_failed, host_rate, host_verdict) by an empirical beta prior.

    The prior's mean and weight come from all hosts by the method of moments: the spread of
    the hosts' rates beyond what chance explains. It weighs one text at least. With one host, or hosts that differ by
    chance only, the prior is the overall rate with the weight of a host of average size.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("int")).alias("f"))
    p = F.col("f") / F.col("n")
    mean = (F.sum("f") / F.sum("n")).alias("mean")
    prior = hosts.agg(mean, F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.sum(F.col("n") * p * p).alias("sq"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    # between-host variance, by moments weighted with the hosts' sizes
    between = (F.col("sq") - F.col("total") * F.col("mean") * F.col("mean") - (F.col("m") - 1) * F.col("mean") * (1 - F.col("mean"))) / F.nullif(F.col("total") - F.col("nn") / F.col("total"), F.lit(0.0))
    weight = F.when(between > 0, F.greatest(F.col("mean") * (1 - F.col("mean")) / between - 1, F.lit(1.0))).otherwise(F.col("total") / F.col("m"))
    prior = prior.select("mean", F.coalesce(weight, F.col("total") / F.col("m")).alias("weight"))
    rate = (F.col("f") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    joined = hosts.crossJoin(F.broadcast(prior))  # one row
    return joined.select("host", F.col("n").alias("host_texts"), F.col("f").alias("host_failed"), rate.alias("host_rate"), F.when(rate >= limits.host_rate, "suspect").otherwise("sound").alias("host_verdict"))


def repetition(df: DataFrame, key: str, sides: dict[str, str], hosts: list[str], version: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """``measure`` with the host's verdict on every row.

    The hosts' table is joined as it is: Spark broadcasts it only where it has measured it
    to be small, and splits a host that holds many rows otherwise.
    """
    measured = cut(measure(df, key, sides, hosts, version, limits))
    return measured.join(host_verdicts(measured, limits), "host", "left")
