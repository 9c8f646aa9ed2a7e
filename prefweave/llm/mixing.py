"""Mixing sources to target weights by hash-threshold histograms.

Every record has a hash. For each kind of record the sizes are added up by hash bucket; a
target's budget falls into one bucket; only that bucket is refined, by the next bits of the hash;
after a few levels the budget is met to the record, and records are drawn by comparing
their hash with the threshold. Nothing is sorted, and a larger budget over the same records
draws a superset of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefweave.session import cut

BITS = 12
LEVELS = 4


def _bucket(level: int) -> Column:
    return F.shiftright("hash", (LEVELS - 1 - level) * BITS).bitwiseAND((1 << BITS) - 1)


def _hash(seed: int, key: Column) -> Column:
    """The first bits of the md5 of seed and key, the same in every engine."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), F.lit(BITS * LEVELS // 4)), 16, 10).cast("bigint")


def hashed(records: DataFrame, key: str, group: list[str], size: Column | None = None, seed: int = 42) -> DataFrame:
    """(key, group, size, hash) of the records; a size that is null or not positive counts as 0."""
    s = F.lit(1) if size is None else F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))
    return records.select(F.col(key).alias("_key"), *group, s.cast("bigint").alias("size"), _hash(seed, F.col(key)).alias("hash"))


def histogram(records: DataFrame, group: list[str]) -> DataFrame:
    """(group, bucket, size): sizes by group and the first bits of the hash."""
    return records.groupBy(*group, _bucket(0).alias("bucket")).agg(F.sum("size").alias("size"))


def budgets(targets: DataFrame, coarse: DataFrame, group: list[str], share: str, factor: str, repeats: str) -> DataFrame:
    """Targets with available and wanted sizes, the whole copies to draw, and the rest to draw once more."""
    sums = coarse.groupBy(*group).agg(F.sum("size").alias("available"))
    total = sums.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total_size"))
    known = targets.crossJoin(F.broadcast(total)).join(sums, group, "left").withColumn("available", F.coalesce("available", F.lit(0)))  # total is one row
    known = known.withColumn("wanted", F.col(share) * F.col(factor) * F.col("total_size"))
    budget = F.least(F.round("wanted").cast("bigint"), F.col("available") * F.col(repeats))
    known = known.withColumn("budget", F.greatest(F.coalesce(budget, F.lit(0)), F.lit(0)))
    whole = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")
    known = known.withColumn("copies", whole).withColumn("rest", F.col("budget") - F.col("copies") * F.col("available"))
    return known.withColumn("met", F.coalesce(F.col("available") * F.col(repeats) >= F.col("wanted"), F.lit(True)))


def thresholds(records: DataFrame, targets: DataFrame, coarse: DataFrame, group: list[str], ids: list[str]) -> DataFrame:
    """``targets`` with ``threshold``: records of the group with a smaller hash are drawn once more."""
    state = cut(targets.withColumn("prefix", F.lit(0).cast("bigint")).withColumn("left", F.col("rest")))
    for level in range(LEVELS):
        if level == 0:
            counted = state.select(*ids, *group, "left").join(coarse, group)
        else:
            # only the records of boundary buckets are looked at again
            counted = records.join(state.select(*ids, *group, "prefix", "left"), group).where(F.shiftright("hash", (LEVELS - level) * BITS) == F.col("prefix")).groupBy(*ids, *group, "left", _bucket(level).alias("bucket")).agg(F.sum("size").alias("size"))
        through = F.sum("size").over(Window.partitionBy(*ids, *group).orderBy("bucket"))
        before = counted.withColumn("through", through)
        # the boundary is the first bucket that doesn't fit whole; where all fit, it lies after the last
        fit = before.groupBy(*ids, *group).agg(F.max(F.when(F.col("through") <= F.col("left"), F.col("through"))).alias("taken"), F.min(F.when(F.col("through") > F.col("left"), F.col("bucket"))).alias("at"))
        joined = state.join(fit, [*ids, *group], "left")
        at = F.coalesce("at", F.lit(1 << BITS) if level == 0 else F.lit(0))
        state = cut(joined.withColumn("prefix", F.col("prefix") * (1 << BITS) + at).withColumn("left", F.col("left") - F.coalesce("taken", F.lit(0))).drop("taken", "at"))
    return state.withColumnRenamed("prefix", "threshold")


def mixed(records: DataFrame, targets: DataFrame, key: str, group: list[str], ids: list[str], share: str, factor: str, repeats: str, size: Column | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(drawn, report) of every mix in ``targets``.

    ``targets`` has one row for each mix (``ids``) and ``group``; ``records`` one row for each
    record, with a group. A target wants ``share`` x ``factor`` x the size of all records, as a whole
    number, and at most ``repeats`` copies of each record; one that can't be met gets all it
    may. drawn: (ids, key, copies). report: the targets with ``wanted``, ``available``, ``drawn``,
    ``actual_share`` of the mix's drawn size, and ``met``. With sizes other than 1 a target is
    filled up to its budget by whole records. Records with a null group value are in no
    target; a group without records is drawn empty; targets that ask for nothing draw nothing;
    an empty ``records`` draws nothing and leaves every share 0.
    """
    own = cut(hashed(records, key, group, size, seed))
    coarse = cut(histogram(own, group))
    known = budgets(targets, coarse, group, share, factor, repeats)
    found = thresholds(own, known, coarse, group, ids)
    asked = found.where("budget > 0").select(*ids, *group, F.col("copies").alias("whole"), "threshold")
    drawn = own.join(asked, group).withColumn("copies", F.col("whole") + (F.col("hash") < F.col("threshold")).cast("int")).where("copies > 0")
    sums = drawn.groupBy(*ids, *group).agg(F.sum(F.col("copies") * F.col("size")).alias("drawn"))
    report = found.join(sums, [*ids, *group], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    of_mix = F.sum("drawn").over(Window.partitionBy(*ids))
    report = report.withColumn("actual_share", F.when(of_mix > 0, F.col("drawn") / of_mix).otherwise(0.0))
    return drawn.select(*ids, F.col("_key").alias(key), "copies"), report.drop("total_size", "budget", "copies", "rest", "threshold", "left")
