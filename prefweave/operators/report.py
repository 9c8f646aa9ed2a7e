"""Reports on scores: histograms, standings, neighbours of percentiles, counts by rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefweave.operators.curate import shuffle_key
from prefweave.operators.order import first_rows, joined_back, running_total, with_position
from prefweave.operators.select import quantiles
from prefweave.session import cut

#: The percentiles reported.
PERCENTILES = (0, 2, 5, 10, 50, 90, 95, 98, 100)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n) for each of ``bins`` equal widths between least and greatest value.

    The last bin holds the greatest value. Empty bins are there with 0; nulls and NaN
    aren't counted; one distinct value gives a range of half a unit to each side; no values, no rows.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    place = F.least(F.width_bucket("v", "a", "b", F.lit(bins)), F.lit(bins)).cast("int")
    counts = v.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    grid = ends.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("b") - F.col("a")) / bins
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + width * (F.col("bin") - 1)).alias("low"), (F.col("a") + width * F.col("bin")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def standing(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``pct_below`` and ``pct_up_to``: percent of values below, and below or equal.

    Nulls and NaN have no standing and don't count. Ranks come from the table of distinct values.
    """
    own = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    df = df.withColumn("_v", own)
    values = df.where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = cut(running_total(values, [F.col("_v")], "_n", "_below"))
    n = ranked.agg(F.sum("_n").alias("_all"))
    share = ranked.crossJoin(F.broadcast(n)).select("_v", "_n", (F.col("_below") / F.col("_all") * 100).alias("pct_below"), ((F.col("_below") + F.col("_n")) / F.col("_all") * 100).alias("pct_up_to"))  # one row
    placed = joined_back(df.where("_v is not null"), share, ["_v"], "_n").drop("_v", "_n")
    return placed.unionByName(df.where("_v is null").drop("_v"), allowMissingColumns=True)


def percentile_examples(df: DataFrame, key: str, score: str, k: int, percents: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(percentile, cutoff, rank, key, score): for each percentile the ``k`` rows around its cutoff.

    Half come from each side, the upper including the cutoff; a short side is filled up from
    the other. Ties are in order of key. ``rank`` counts a percentile's rows by score and key.
    Only the keys are ranked; join the payload afterwards.
    """
    valid = df.select(key, F.col(score).cast("double").alias("_s")).where(F.col("_s").isNotNull() & ~F.isnan("_s"))
    up = cut(with_position(valid, [F.col("_s"), F.col(key)], "_p"))
    # on the lower side ties go by ascending key too, so that it has an order of its own
    down = cut(with_position(valid, [F.col("_s").desc(), F.col(key)], "_q"))
    n = up.count()
    if not n:
        return up.select(F.lit(0.0).alias("percentile"), F.lit(0.0).alias("cutoff"), F.lit(0).alias("rank"), key, F.col("_s").alias(score)).where(F.lit(False))
    cutoffs = quantiles(valid, "_s", list(percents))
    below = up.agg(*(F.count_if(F.col("_s") < c).alias(f"c{i}") for i, c in enumerate(cutoffs))).first()
    out = None
    for i, (p, c) in enumerate(zip(percents, cutoffs, strict=True)):
        low = below[f"c{i}"]
        high = n - low
        # as near to half as both sides allow
        take_high = min(high, max(k - low, k - k // 2))
        take_low = min(low, k - take_high)
        upper = up.where((F.col("_p") >= low) & (F.col("_p") < low + take_high)).select(key, "_s")
        lower = down.where((F.col("_q") >= n - low) & (F.col("_q") < n - low + take_low)).select(key, "_s")
        part = upper.unionByName(lower).select(F.lit(float(p)).alias("percentile"), F.lit(c).alias("cutoff"), key, F.col("_s").alias(score))
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("percentile").orderBy(score, key))  # k rows each
    return out.select("percentile", "cutoff", rank.alias("rank"), key, score)


def examples_with_payload(df: DataFrame, key: str, score: str, payload: DataFrame, k: int, percents: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``percentile_examples`` with each row's standing (``pct_below``, ``pct_up_to``) and the columns of ``payload``.

    The rows are few, so they go to the payload and not the payload to them; a row without one has nulls.
    """
    found = cut(percentile_examples(df, key, score, k, percents))
    placed = standing(df.select(score), score).distinct().withColumnRenamed(score, "_s")
    few = cut(found.join(placed, F.col(score).eqNullSafe(F.col("_s")), "left").drop("_s"))
    shown = payload.join(F.broadcast(few.select(key).distinct()), key, "left_semi")  # k rows for each percentile
    return few.join(shown, key, "left")


def text_table(df: DataFrame, shown: dict[str, Column], order: list[str]) -> DataFrame:
    """(line, text): the rows as lines of padded columns below a header and a rule, from line 0. For small tables."""
    cells = df.select(*order, *(F.coalesce(c.cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate(shown.values())))
    width = cells.agg(*(F.greatest(F.max(F.length(f"_{i}")), F.lit(len(h))).alias(f"w{i}") for i, h in enumerate(shown)))
    padded = lambda x, i: F.rpad(x, F.col(f"w{i}"), F.lit(" "))
    line = lambda *c: F.concat_ws("  ", *c)
    wide = width.select(*(F.coalesce(f"w{i}", F.lit(len(h))).alias(f"w{i}") for i, h in enumerate(shown)))
    head = wide.select(F.lit(0).cast("bigint").alias("line"), line(*(padded(F.lit(h), i) for i, h in enumerate(shown))).alias("text"))
    rule = wide.select(F.lit(1).cast("bigint").alias("line"), line(*(F.repeat(F.lit("-"), F.col(f"w{i}")) for i in range(len(shown)))).alias("text"))
    rows = with_position(cells, [F.col(c) for c in order], "_p").crossJoin(F.broadcast(wide))  # one row
    return head.unionByName(rule).unionByName(rows.select((F.col("_p") + 2).alias("line"), line(*(padded(F.col(f"_{i}"), i) for i in range(len(shown)))).alias("text")))


def rating_counts(df: DataFrame, column: str, domain: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """(rating, n) of every rating of the domain and of null, also where n is 0."""
    counts = df.groupBy(F.col(column).cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(r,) for r in (*domain, None)], "rating int")
    c = counts.select(F.col("rating").alias("_r"), "n")
    return every.join(c, F.col("rating").eqNullSafe(F.col("_r")), "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


def rating_examples(df: DataFrame, key: str, column: str, most: int = 3, seed: int = 42) -> DataFrame:
    """Up to ``most`` rows of each rating in a seeded order."""
    h = df.withColumn("_h", shuffle_key(seed, F.col(key)))
    return first_rows(h, [column], [F.col("_h"), F.col(key)], most).drop("_h")


def score_stats(df: DataFrame, score: str, skip: str | None = None) -> DataFrame:
    """Count, skipped, mean, population deviation, least and greatest of the scores that count."""
    off = F.coalesce(F.col(skip), F.lit(False)) if skip else F.lit(False)
    v = F.when(~off, F.col(score))
    return df.agg(F.count(v).alias("n"), F.count_if(off).alias("n_skipped"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest"))
