"""Selection of rows by score: thresholds, exact percentiles, and both ends together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.operators.order import running_total
from prefweave.session import cut


def quantiles(df: DataFrame, column: str, percents: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation; None for each where there are no values.

    Nulls and NaN aren't values. Distinct values are sorted with their counts, so that ties of any
    number are one row; only the neighbours of the wanted places come to the driver.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(running_total(values, [F.col("v")], "n", "p"))
    n = placed.agg(F.sum("n")).first()[0]
    if not n:
        return [None] * len(percents)
    at = [p / 100 * (n - 1) for p in percents]
    wanted = sorted({k for x in at for k in (math.floor(x), min(math.floor(x) + 1, n - 1))})
    has = F.filter(F.array(*map(F.lit, wanted)), lambda k: (k >= F.col("p")) & (k < F.col("p") + F.col("n")))
    v = {r["k"]: r["v"] for r in placed.select("v", F.explode(has).alias("k")).collect()}  # the wanted places
    out = []
    for x in at:
        low, t = v[math.floor(x)], x - math.floor(x)
        high = v[min(math.floor(x) + 1, n - 1)]
        out.append(high - (high - low) * (1 - t) if t >= 0.5 else low + (high - low) * t)
    return out


def beyond(score: Column, threshold: float, direction: str) -> Column:
    """Inclusive; a null score is never beyond."""
    if direction not in ("above", "below"):
        raise ValueError(f"direction must be above or below, not {direction}")
    hit = score >= threshold if direction == "above" else score <= threshold
    return F.coalesce(hit & ~F.isnan(score.cast("double")), F.lit(False))


def selected(df: DataFrame, score: str, top_pct: float | None = None, bottom_pct: float | None = None, top_threshold: float | None = None, bottom_threshold: float | None = None, name: str = "selected") -> DataFrame:
    """``df`` with a flag: at the top or at the bottom end, each by a share or a threshold.

    Shares need scores: with none at all this raises ValueError, as do a share and a
    threshold for one end. Without any argument nothing is selected.
    """
    for pct, threshold in ((top_pct, top_threshold), (bottom_pct, bottom_threshold)):
        if pct is not None and threshold is not None:
            raise ValueError("a share and a threshold exclude each other at one end")
        if pct is not None and not 0 <= pct <= 100:
            raise ValueError("a share is between 0 and 100")
    wanted = [p for p in (None if top_pct is None else 100 - top_pct, bottom_pct) if p is not None]
    cuts = quantiles(df, score, wanted) if wanted else []
    if None in cuts:
        raise ValueError("there are no scores to select by")
    if top_pct is not None:
        top_threshold = cuts.pop(0)
    if bottom_pct is not None:
        bottom_threshold = cuts.pop(0)
    flag = F.lit(False)
    if top_threshold is not None:
        flag = flag | beyond(F.col(score), top_threshold, "above")
    if bottom_threshold is not None:
        flag = flag | beyond(F.col(score), bottom_threshold, "below")
    return df.withColumn(name, flag)
