"""Rank correlation between scoring methods: Spearman, Kendall tau-b, p-values, matrices.

Ranks come from tables of distinct values. Kendall's discordant pairs are counted without
ever comparing all pairs: rows lie in a grid of blocks by x and buckets by y; a table of
cell counts settles pairs that differ in both; pairs within a block, and within a
bucket, are counted by sorting there; those within a cell would count twice and are
taken off. Rows that tie on one value need no counting along it, so a value of any weight is a
block of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from prefweave.functions.stats import corr
from prefweave.operators.order import joined_back, running_total
from prefweave.session import cut


def finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return ok


def aligned_scores(key: str, methods: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(key, and a column for each method): the methods' scores side by side, turned so that higher means the same.

    ``methods``: each one's rows (one for a key) and its aligned score, such as ``6 - rating``. Keys that
    some method lacks have a null there; null keys are left out. NaN and infinities stay as they are.
    """
    out = None
    for name, (df, score) in methods.items():
        own = df.where(F.col(key).isNotNull()).select(key, score.cast("double").alias(name))
        out = own if out is None else out.join(own, key, "full_outer")
    return out


def ranked(df: DataFrame, by: str, columns: list[str], suffix: str = "_below") -> DataFrame:
    """``df`` with, for each column, the rows of the same ``by`` below its value and (``_ties``) those equal to it."""
    for c in columns:
        values = df.groupBy(by, c).agg(F.count(F.lit(1)).alias(f"{c}_ties"))
        table = cut(running_total(values, [F.col(by), F.col(c)], f"{c}_ties", "_less"))
        first = table.groupBy(by).agg(F.min("_less").alias("_first"))
        table = table.join(F.broadcast(first), by).select(by, c, f"{c}_ties", (F.col("_less") - F.col("_first")).alias(f"{c}{suffix}"))  # a row for each pair of methods
        # both branches of the next join read it
        df = cut(joined_back(df, table, [by, c], f"{c}_ties"))
    return df


def discordant(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j], by bits of the values; equal values don't count."""
    y = np.asarray(y, np.int64)
    n, total = len(y), 0
    if n < 2:
        return 0
    order = np.arange(n)
    for bit in range(int(y.max()).bit_length()):
        # within each group of equal higher bits, in the original order: a 1 before a 0
        high, one = y[order] >> (bit + 1), (y[order] >> bit) & 1
        o = np.argsort(high, kind="stable")
        g, b = high[o], one[o]
        ones = np.cumsum(b)
        start = np.flatnonzero(np.diff(g, prepend=-1))
        base = np.repeat(ones[start] - b[start], np.diff(np.append(start, n)))
        total += int(((ones - base) * (1 - b)).sum())
    return total


def _local(grid: DataFrame, by: list[str], sign: int) -> DataFrame:
    """Discordant pairs within each group; light blocks have less than twice ``rows_per_block`` rows."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        # one pair's; equal x in order of y, so that they make no pairs
        y = np.unique(pdf.sort_values(["x", "y"])["y"].to_numpy(), return_inverse=True)[1]
        return pd.DataFrame({"pair": pdf["pair"][:1], "d": [sign * float(discordant(y))]})

    return grid.select(*by, "x", "y").groupBy(*by).applyInPandas(count, "pair int, d double")


@dataclass(frozen=True)
class Agreement:
    """Rank correlations of two columns over the rows where both are finite; None where undefined."""

    n: int
    spearman: float | None = None
    spearman_p: float | None = None
    kendall_tau: float | None = None
    kendall_p: float | None = None


def agreement(df: DataFrame, x: str, y: str, rows_per_block: int = 500_000) -> Agreement:
    """Spearman's rho by average ranks and Kendall's tau-b, each with a two-sided p."""
    return agreements(df, [(x, y)], rows_per_block)[0]


def agreements(df: DataFrame, pairs: list[tuple[str, str]], rows_per_block: int = 500_000) -> list[Agreement]:
    """The agreement of each pair of columns, over the rows where both are finite; all pairs in the same passes.

    A block has ``rows_per_block`` rows, or a thousandth of a pair's if that is more, so that the table
    of cells, which comes to the driver, has no more than some million rows for a pair.
    """
    own = [F.when(finite(a, b), F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))) for i, (a, b) in enumerate(pairs)]
    long = df.select(F.explode(F.filter(F.array(*own), lambda s: s.isNotNull())).alias("s")).select("s.*")
    ranks = ranked(long, "pair", ["x", "y"])
    sizes = {r["pair"]: r["n"] for r in long.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each pair
    n = F.coalesce(*(F.when(F.col("pair") == i, F.lit(v)) for i, v in sizes.items())) if sizes else F.lit(0)
    width = F.greatest(F.lit(rows_per_block), F.ceil(n / 1000)).cast("bigint")
    grid = cut(ranks.select("pair", F.col("x_below").alias("x"), F.col("y_below").alias("y"), "x_ties", "y_ties", _block("x", width).alias("bx"), _block("y", width).alias("by")))
    # every row knows its ties, so sums over values of t(t - 1) are sums over rows of t - 1
    t = {c: F.col(f"{c}_ties").cast("double") for c in "xy"}
    of_ties = [f(t[c]).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((lambda v: F.sum((v - 1) / 2), lambda v: F.sum((v - 1) * (v - 2)), lambda v: F.sum((v - 1) * (2 * v + 5))))]
    stats = {r["pair"]: r for r in grid.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), corr(F.col("x") + t["x"] / 2, F.col("y") + t["y"] / 2).alias("rho"), *of_ties).collect()}
    same = F.count(F.lit(1)).cast("double")
    both = {r["pair"]: r["t"] for r in grid.groupBy("pair", "x", "y").agg(same.alias("t")).groupBy("pair").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("t")).collect()}
    apart = _discordant_pairs(grid)
    return [_agreement(stats[i], both[i], apart.get(i, 0.0)) if i in stats else Agreement(0) for i in range(len(pairs))]


def _agreement(r: Row, both: float, apart: float) -> Agreement:
    """From a pair's sums over ties, its pairs that tie on both columns, and its discordant pairs."""
    total, rho, tx, x0, x1, ty, y0, y1 = r["n"], r["rho"], *(r[f"{c}{i}"] for c in "xy" for i in range(3))
    n, all_pairs = float(total), total * (total - 1) / 2
    if total < 2 or tx == all_pairs or ty == all_pairs:
        return Agreement(total)
    # concordant less discordant
    lead = all_pairs - tx - ty + both - 2 * apart
    tau = lead / math.sqrt(all_pairs - tx) / math.sqrt(all_pairs - ty)
    m2 = n * (n - 1)
    var = (m2 * (2 * n + 5) - x1 - y1) / 18 + 2 * tx * ty / m2 + (x0 * y0 / (9 * m2 * (n - 2)) if n > 2 else 0.0)
    p = math.erfc(abs(lead) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None
    return Agreement(total, rho, spearman_p(rho, total), max(-1.0, min(1.0, tau)), p)


def _discordant_pairs(grid: DataFrame) -> dict[int, float]:
    found: dict[int, float] = {}
    cells = grid.groupBy("pair", "bx", "by").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most one row for each cell of the grids of blocks
    for pair, cell in cells.groupby("pair"):
        xs, ys = (np.unique(cell[c], return_inverse=True) for c in ("bx", "by"))
        m = np.zeros((len(xs[0]), len(ys[0])))
        np.add.at(m, (xs[1], ys[1]), cell["n"].to_numpy())
        smaller = np.zeros_like(m)
        smaller[:, 1:] = np.cumsum(m, axis=1)[:, :-1]  # rows of smaller y in the same block
        later = np.zeros_like(m)
        later[:-1] = np.cumsum(smaller[::-1], axis=0)[::-1][1:]  # and in blocks of greater x
        found[pair] = float((m * later).sum())
    light_x, light_y = "bx % 2 = 0", "by % 2 = 0"
    parts = _local(grid.where(light_x), ["pair", "bx"], 1).unionByName(_local(grid.where(light_y), ["pair", "by"], 1)).unionByName(_local(grid.where(f"{light_x} and {light_y}"), ["pair", "bx", "by"], -1))
    for r in parts.groupBy("pair").agg(F.sum("d").alias("d")).collect():
        found[r["pair"]] = found.get(r["pair"], 0.0) + r["d"]
    return found


def _block(c: str, width: Column) -> Column:
    """A number that orders the blocks; odd for a single value of ``width`` rows or more.

    The value after such a one begins another block, as so many rows lie between.
    """
    below, ties = F.col(f"{c}_below"), F.col(f"{c}_ties")
    return F.when(ties >= width, below * 2 + 1).otherwise(F.floor(below / width) * width * 2)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation from Student's t with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - rho * rho)


def correlations(df: DataFrame, methods: list[str]) -> DataFrame:
    """One row for each unordered pair of methods, over the rows where both are finite."""
    df = cut(df.select(*methods))
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    found = agreements(df, pairs)
    for (a, b), g in zip(pairs, found, strict=True):
        if g.n < 2:
            raise ValueError(f"{a} and {b} have fewer than two rows in common")
    rows = [(*p, g.n, g.spearman, g.spearman_p, g.kendall_tau, g.kendall_p) for p, g in zip(pairs, found, strict=True)]
    return df.sparkSession.createDataFrame(rows, "method_a string, method_b string, n bigint, spearman double, spearman_p double, kendall_tau double, kendall_p double")


def matrix(pairs: DataFrame, methods: list[str], metric: str, by: list[str] | None = None) -> DataFrame:
    """The symmetric matrix of a metric, one row and one column for each method; one for each value of ``by``."""
    by = by or []
    both = pairs.select(*by, "method_a", "method_b", metric).union(pairs.select(*by, "method_b", "method_a", metric))
    each = pairs.select(*by).distinct() if by else pairs.sparkSession.range(1).select()
    unit = each.select(*by, F.explode(F.array(*map(F.lit, methods))).alias("m")).select(*by, "m", F.col("m").alias("n"), F.lit(1.0))
    return both.union(unit).groupBy(*by, F.col("method_a").alias("method")).pivot("method_b", methods).agg(F.first(metric, ignorenulls=True))
