"""One ranking from several scores on different scales.

Each score is replaced by its standing: the share of items it exceeds plus half the share
that ties with it. The standings' correlation matrix, from one distributed pass, gives the
first principal component; its loadings take the signs of the declared directions; and items
are ordered by their projection on it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.functions.stats import corr
from prefweave.operators.order import joined_back, running_total, with_position
from prefweave.session import cut


@dataclass(frozen=True)
class Component:
    """Loadings by method, their rank correlations, the share of variance along the loadings.

    Every loading has the sign of its declared direction. ``opposed`` names methods whose
    sign in the eigenvector was the other one: they disagree with the rest, and the loadings
    are then no eigenvector; ``explained`` is the variance along the loadings as they are.
    """

    loadings: dict[str, float]
    correlations: np.ndarray
    explained: float
    opposed: tuple[str, ...]


def standings(df: DataFrame, key: str, scores: dict[str, int]) -> DataFrame:
    """(key, n, and for each score a bigint): twice the items it exceeds plus the items equal to it.

    ``scores``: direction of each column, 1 if higher ranks higher, else -1. Only items with all
    scores count; null and NaN are missing, infinities are scores. Each row is an item.
    The ranks come from a table of distinct values, so ties of any size are one row there; values
    of very many items are joined back by broadcast.
    """
    names = list(scores)
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") * float(scores[c]) + 0.0)
    whole = cut(df.select(F.col(key).alias("_key"), *(value(c).alias(f"_{i}") for i, c in enumerate(names))).dropna())
    long = whole.select("_key", F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col(f"_{i}").alias("v")) for i in range(len(names))))).alias("s")).select("_key", "s.m", "s.v")
    values = long.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n"))
    n = whole.count()
    before = running_total(values, [F.col("m"), F.col("v")], "n")
    # every method has n rows, so those of earlier methods are known
    rank = before.select("m", "v", (2 * (F.col("total_before") - F.col("m") * F.lit(n)) + F.col("n")).alias("r"), "n")
    ranked = joined_back(long, rank, ["m", "v"], "n").groupBy("_key").agg(*(F.max(F.when(F.col("m") == i, F.col("r"))).alias(c) for i, c in enumerate(names)))
    return ranked.select(F.col("_key").alias(key), F.lit(n).cast("bigint").alias("n_items"), *names)


def component(ranked: DataFrame, names: list[str]) -> Component:
    """The first principal component of standings, oriented to the declared directions.

    A method without variance has no correlation and counts as unrelated to the others.
    """
    m = len(names)
    pairs = [(i, j) for i in range(m) for j in range(i)]
    row = ranked.agg(*(corr(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs)).first() if pairs else None
    matrix = np.eye(m)
    for i, j in pairs:
        r = row[f"c{i}_{j}"]
        matrix[i, j] = matrix[j, i] = r if r is not None and math.isfinite(r) else 0.0
    first = np.linalg.eigh(matrix)[1][:, -1]
    first = first if first.sum() >= 0 else -first
    loading = np.abs(first)
    return Component(dict(zip(names, map(float, loading), strict=True)), matrix, float(loading @ matrix @ loading / m), tuple(n for n, x in zip(names, first, strict=True) if x < -1e-12))


def _placed(df: DataFrame, key: str, scores: dict[str, int]) -> tuple[DataFrame, Component]:
    """The standings with ``_total``, their projection, and ``position``."""
    ranked = cut(standings(df, key, scores))
    c = component(ranked, list(scores))
    total = sum((F.col(name).cast("double") * w for name, w in c.loadings.items()), F.lit(0.0))
    return with_position(ranked.withColumn("_total", total), [F.col("_total").desc(), F.col(key).asc()]), c


def ranking(df: DataFrame, key: str, scores: dict[str, int]) -> DataFrame:
    """(key, n_items, projection, position, and the standing of each score), by position from 0.

    Equal projections are ordered by key. A key that comes again is ranked again. Without
    an item that has all scores the result is empty. Other columns aren't read.
    """
    share = lambda x: x / (2 * F.col("n_items"))
    return _placed(df, key, scores)[0].select(key, "n_items", share(F.col("_total")).alias("projection"), "position", *(share(F.col(name)).alias(name) for name in scores))


def least_projection(total: float, loadings: list[float], most: float) -> float:
    """The least projection of an item whose standings, none over ``most``, add up to ``total`` or more."""
    out = 0.0
    for w in sorted(loadings):
        out += w * min(total, most)
        total -= min(total, most)
    return out


def leaders(df: DataFrame, key: str, scores: dict[str, int], part: int) -> DataFrame:
    """(key, position): the first n / ``part`` items by the mean of their standings, ties by key.

    The component's order is searched as far as they can lie: its first n / ``part`` items give a
    mean that all leaders reach, and that bounds a leader's projection from below. The means
    of the items above that bound decide. No items, or fewer than ``part``, give no rows.
    """
    placed, c = _placed(df, key, scores)
    placed = cut(placed.withColumn("_sum", sum((F.col(n) for n in scores), F.lit(0).cast("bigint"))))
    n = placed.count()
    k = n // part
    if not k:
        return placed.select(key, "position").where(F.lit(False))
    reached = placed.where(F.col("position") < k).agg(F.min("_sum")).first()[0]
    bound = least_projection(reached, list(c.loadings.values()), 2 * n) * (1 - 1e-9)
    near = placed.where(F.col("_total") >= bound).select(key, "_sum")
    return with_position(near, [F.col("_sum").desc(), F.col(key).asc()]).where(F.col("position") < k).select(key, "position")
