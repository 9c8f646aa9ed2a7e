"""Evaluation runs: protocol bootstraps, transitions between two runs, variation across checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.functions.text import protocol_name, score_bin
from prefweave.operators.order import first_rows, position_in_group, with_position
from prefweave.session import cut

BINS = ("<=-2", "-1", "0", "1", ">=2")


def signed_bias(score: Column, bias: Column, negative: tuple[str, ...] = ("negative",)) -> Column:
    """Scores of negative biases, turned so that higher means more bias."""
    return F.when(bias.isin(*negative), -score).otherwise(score)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once; must be empty."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_keys(runs: DataFrame, baseline: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """(run, keys) of the baseline that a run lacks; must be empty."""
    wanted = runs.select(run).distinct().join(baseline.select(*keys).distinct(), how="cross")  # runs are few
    return wanted.join(runs.select(run, *keys), [run, *keys], "left_anti")


def sample_scores(members: DataFrame, scorer: str = "graded_comparison_scorer") -> DataFrame:
    """(folder, bias_type, content_text, score) from the JSON of evaluation samples: rows (folder, member, text).

    Scores of negative biases are turned. A sample without metadata, scorer, bias, text or number is an
    error that names its member, and so is a field of another type.
    """
    v = F.try_parse_json("text")
    at = lambda *path: F.try_variant_get(v, ".".join(["$", *path]), "variant")
    kind = lambda *path: F.coalesce(F.schema_of_variant(at(*path)), F.lit("VOID"))
    judge = ("scores", scorer, "metadata")
    bias = F.try_variant_get(v, ".".join(["$", *judge, "bias_type"]), "string")
    number = kind(*judge, "sycophancy_score")
    good = F.coalesce((kind("metadata", "content_text") == "STRING") & bias.isin("positive", "negative") & (number.isin("BIGINT", "DOUBLE", "FLOAT") | number.startswith("DECIMAL")), F.lit(False))
    score = F.try_variant_get(v, ".".join(["$", *judge, "sycophancy_score"]), "double")
    checked = F.when(good, score).otherwise(F.raise_error(F.concat(F.lit("malformed sample "), F.col("member"))))
    rows = members.select("folder", bias.alias("bias_type"), F.try_variant_get(v, "$.metadata.content_text", "string").alias("content_text"), checked.alias("score"))
    return rows.withColumn("score", signed_bias(F.col("score"), F.col("bias_type")))


def protocol_bootstrap(members: DataFrame, baseline: str, aliases: dict[str, str] | None = None, prefix: str = "", resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(protocol, bias_type, n, mean, low, high) from the samples of evaluated models (``sample_scores``'s input).

    Every model's samples are compared with the baseline model's; a protocol's seeds are averaged
    sample by sample, and the samples are resampled.
    """
    runs = sample_scores(members).withColumnRenamed("folder", "model_name").withColumn("protocol", protocol_name(F.col("model_name"), aliases or {}, prefix))
    means = seed_means(deltas(runs, baseline))
    return bootstrap(means, ["protocol", "bias_type"], "delta", "content_text", resamples, seed=seed)


def transcript_scores(transcripts: DataFrame) -> DataFrame:
    """(instruction, checkpoint, score_name, score) from transcripts as ``read_transcripts`` gives them.

    Of several of one instruction and checkpoint the last by file name holds; scores that are null are left out.
    """
    judge = F.col("metadata.judge_output")
    own = transcripts.select(F.col("metadata.description").alias("instruction"), "checkpoint", "file_name", judge.getField("scores").alias("scores"))
    return last_written(own, ["instruction", "checkpoint"], "file_name").select("instruction", "checkpoint", F.explode("scores").alias("score_name", "score")).where("score is not null")


def deltas(runs: DataFrame, baseline_name: str, run: str = "model_name", keys: tuple[str, ...] = ("bias_type", "content_text")) -> DataFrame:
    """Runs joined with the baseline run on the sample keys: (run, keys, protocol, score, base, delta).

    A repeated key or a run that lacks one of the baseline's is an error; other keys are ignored.
    """
    runs = cut(runs)
    base = runs.where(F.col(run) == baseline_name)
    if duplicate_keys(runs, [run, *keys]).limit(1).count():
        raise ValueError("a run has a sample twice")
    if missing_keys(runs, base, run, list(keys)).limit(1).count():
        raise ValueError("a run lacks samples of the baseline")
    return runs.join(base.select(*keys, F.col("score").alias("base")), list(keys)).withColumn("delta", F.col("score") - F.col("base"))


def run_means(delta: DataFrame, run: str = "model_name", bias: str = "bias_type") -> DataFrame:
    return delta.groupBy(run, bias).agg(F.avg("delta").alias("mean_delta"), F.count(F.lit(1)).alias("n"))


def seed_means(delta: DataFrame, protocol: str = "protocol", keys: tuple[str, ...] = ("bias_type", "content_text")) -> DataFrame:
    """Each sample's mean delta over a protocol's seeds."""
    return delta.groupBy(protocol, *keys).agg(F.avg("delta").alias("delta"))


def bootstrap(df: DataFrame, by: list[str], value: str, key: str, resamples: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(by, n, mean, low, high): percentile bootstrap of the mean.

    Every row draws its weight in every resample from its key (Poisson with mean 1), so that
    rows stay where they are and only sums by group and resample move. Groups of one value,
    or of equal ones, have the mean as their interval.
    """
    own = df.where(F.col(value).isNotNull()).select(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in by)).alias("g"), F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit(15)), 16, 10).cast("bigint").alias("h"), F.col(value).cast("double").alias("v"))
    steps = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1), dtype=float)) for k in range(16)])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        r = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            for g, part in pdf.groupby("g", sort=False):
                total = sums.setdefault(g, np.zeros((2, resamples)))
                for a in range(0, len(part), 512):
                    h = part["h"].to_numpy()[a : a + 512].view(np.uint64)
                    x = h[:, None] + r[None, :]
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    x ^= x >> np.uint64(31)
                    w = np.searchsorted(steps, (x >> np.uint64(11)) / float(1 << 53), side="right")
                    total[0] += w.sum(axis=0)
                    total[1] += part["v"].to_numpy()[a : a + 512] @ w
        for g, t in sums.items():
            yield pd.DataFrame({"g": g, "resample": np.arange(resamples), "w": t[0], "s": t[1]})

    drawn = own.mapInPandas(draw, "g string, resample int, w double, s double").groupBy("g", "resample").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    half = (1 - level) / 2
    ends = drawn.groupBy("g").agg(F.percentile("m", half).alias("low"), F.percentile("m", 1 - half).alias("high"))  # as many values as resamples
    whole = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("a"), F.max(value).alias("b"))
    joined = whole.withColumn("g", F.concat_ws("\x1f", *(F.col(c).cast("string") for c in by))).join(ends, "g", "left")
    flat = (F.col("n") <= 1) | (F.col("b") - F.col("a") <= 1e-8 + 1e-5 * F.abs("a"))
    return joined.select(*by, "n", "mean", F.when(flat, F.col("mean")).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("mean")).otherwise(F.col("high")).alias("high"))


def protocol_order(name: Column, first: str = "full-dpo") -> list[Column]:
    return [F.when(name == first, 0).otherwise(1), name]


def matched(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Samples of both runs: (key, fields, score_a, score_b, delta); fields that differ are an error."""
    left = a.select(key, *fields, F.col("score").alias("score_a"))
    right = b.select(key, *(F.col(f).alias(f"_{f}") for f in fields), F.col("score").alias("score_b"))
    both = left.join(right, key)
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    checked = F.when(same, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("runs disagree on sample "), F.col(key).cast("string"))))
    return both.select(checked.alias(key), *fields, "score_a", "score_b", (F.col("score_b") - F.col("score_a")).alias("delta"))


def inconsistent(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Samples of both runs whose fields differ."""
    joined = a.alias("a").join(b.alias("b"), key)
    bad = F.lit(False)
    for f in fields:
        bad = bad | ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    return joined.where(bad).select(key)


def transition_summary(m: DataFrame) -> DataFrame:
    return m.agg(F.count(F.lit(1)).alias("n"), F.avg("score_a").alias("mean_a"), F.avg("score_b").alias("mean_b"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") < 0).alias("n_reduced"), F.count_if(F.col("delta") == 0).alias("n_equal"), F.count_if(F.col("delta") > 0).alias("n_increased"))


def bias_means(m: DataFrame, by: str = "bias_type") -> DataFrame:
    """Means of both runs and of their difference for each bias."""
    return m.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("score_a").alias("mean_a"), F.avg("score_b").alias("mean_b"), F.avg("delta").alias("mean_delta"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def transitions(m: DataFrame, key: str, top: int = 12) -> DataFrame:
    """The most common (score_a, score_b), ties by the first key; at most ``top`` rows."""
    counts = m.groupBy("score_a", "score_b").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))
    return counts.orderBy(F.col("n").desc(), "first_key").limit(top)


def bin_table(m: DataFrame) -> DataFrame:
    """5 x 5 counts of score bins with totals (``total``); scores outside the bins count nowhere."""
    inside = m.select(score_bin(F.col("score_a")).alias("bin_a"), score_bin(F.col("score_b")).alias("bin_b")).where(F.col("bin_a").isin(*BINS) & F.col("bin_b").isin(*BINS))
    cube = inside.cube("bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"))
    named = cube.select(F.coalesce("bin_a", F.lit("total")).alias("bin_a"), F.coalesce("bin_b", F.lit("total")).alias("bin_b"), "n")
    grid = [(a, b) for a in (*BINS, "total") for b in (*BINS, "total")]
    every = m.sparkSession.createDataFrame(grid, "bin_a string, bin_b string")
    return every.join(named, ["bin_a", "bin_b"], "left").select("bin_a", "bin_b", F.coalesce("n", F.lit(0)).alias("n"))


def top_deltas(m: DataFrame, key: str, which: str = "changed", top: int = 12) -> DataFrame:
    """The largest changes, reductions or increases; ties by key."""
    if which == "changed":
        return m.orderBy(F.abs("delta").desc(), "delta", key).limit(top)
    if which not in ("reduced", "increased"):
        raise ValueError("which must be changed, reduced or increased")
    down = which == "reduced"
    return m.where(F.col("delta") < 0 if down else F.col("delta") > 0).orderBy(F.col("delta").asc() if down else F.col("delta").desc(), key).limit(top)


def last_written(transcripts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the one that is last in ``order``."""
    return transcripts.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in transcripts.columns if c not in keys)), order).alias("r")).select(*keys, "r.*")


def variation(scores: DataFrame, instruction: str = "instruction", checkpoint: str = "checkpoint", least: int = 2) -> DataFrame:
    """(instruction, score_name, n, low, high, spread, values) from rows (instruction, checkpoint, score_name, score).

    Scores that fewer than ``least`` checkpoints have are left out; ``values`` is by checkpoint,
    with a null for checkpoints that lack the score.
    """
    given = scores.where("score is not null")
    points = given.select(checkpoint).distinct()
    stats = given.groupBy(instruction, "score_name").agg(F.count_distinct(checkpoint).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).where(F.col("n") >= least)
    grid = stats.select(instruction, "score_name").join(points, how="cross")  # checkpoints are few
    filled = grid.join(given, [instruction, "score_name", checkpoint], "left").groupBy(instruction, "score_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(checkpoint, "score")))).alias("values"))
    return stats.join(filled, [instruction, "score_name"]).select(instruction, "score_name", "n", "low", "high", (F.col("high") - F.col("low")).alias("spread"), "values")


def widest(v: DataFrame, order: list[str], instruction: str = "instruction") -> DataFrame:
    """(instruction, widest_score, spread): the score with the greatest spread, the first in ``order`` of equals; null where none varies."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("score_name")).cast("int"), F.lit(0))
    place = F.when(place == 0, len(order) + 1).otherwise(place)
    top = v.groupBy(instruction).agg(F.max("spread").alias("spread"), F.max_by("score_name", F.struct("spread", -place)).alias("_name"))
    return top.select(instruction, F.when(F.col("spread") > 0, F.col("_name")).alias("widest_score"), "spread")


def interesting(w: DataFrame, least: float = 2, instruction: str = "instruction") -> DataFrame:
    """Instructions that vary by ``least`` or more, widest first, with their place."""
    kept = w.where(F.col("spread") >= least)
    return with_position(kept, [F.col("spread").desc(), F.col(instruction)], "place")


def by_spread(w: DataFrame) -> DataFrame:
    """How many instructions vary by how much."""
    return w.groupBy("spread").agg(F.count(F.lit(1)).alias("n"))


def listed_by_spread(w: DataFrame, instruction: str = "instruction") -> DataFrame:
    """``w`` with each instruction's place among those that vary as much."""
    return position_in_group(w, ["spread"], [F.col(instruction)], "place")


def first_per_group(df: DataFrame, group: str, wanted: list[str], order: str, most: int | None = None) -> DataFrame:
    """Per wanted group its first rows in order, groups as wanted; a wanted group without rows is an error."""
    own = df.where(F.col(group).isin(*wanted))
    have = {r[0] for r in own.select(group).distinct().collect()}  # at most the wanted groups
    if lacking := [g for g in wanted if g not in have]:
        raise ValueError(f"no rows of {lacking}")
    if most is not None:
        own = first_rows(own, [group], [F.col(order)], most, "_r").drop("_r")
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col(group))
    return with_position(own.withColumn("_g", place), [F.col("_g"), F.col(order)], "place").drop("_g")
