"""Global order without a single task: exact positions and running totals by range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefweave.session import cut

#: Spark numbers rows as (partition << 33) + row.
_ROW_BITS = 33


def with_position(df: DataFrame, order_by: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place in the order, from 0.

    ``order_by`` must decide between any two rows, else the order of equals is arbitrary. One
    range shuffle, a sort within partitions, and a table of one offset per partition.
    """
    placed = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_place", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_place", _ROW_BITS)).withColumn("_place", F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def position_in_group(df: DataFrame, by: list[str], order_by: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place among those of its group, from 0; groups of any size, nulls being a group."""
    placed = cut(with_position(df, [*(F.col(c) for c in by), *order_by], "_place_in_all"))
    first = placed.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by))).agg(F.min("_place_in_all").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    keyed = placed.withColumns({f"_k{i}": F.struct(F.col(c).alias("v")) for i, c in enumerate(by)})  # a struct is never null
    table = first.select(*(F.struct(F.col(f"_g{i}").alias("v")).alias(f"_k{i}") for i in range(len(by))), "_first", "_rows")
    joined = joined_back(keyed, table, [f"_k{i}" for i in range(len(by))], "_rows")
    return joined.withColumn(name, F.col("_place_in_all") - F.col("_first")).select(*df.columns, name)


def running_total(df: DataFrame, order_by: list[Column], value: str, name: str = "total_before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that come before in the order."""
    placed = cut(df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, inner).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def first_rows(df: DataFrame, by: list[str], order_by: list[Column], most: int, name: str = "rank", salts: int = 64) -> DataFrame:
    """The first ``most`` rows of each group, with their rank from 1.

    A group may hold any share of the rows: each of its ``salts`` parts, made by a hash of all
    plain columns, keeps its own first rows before they meet.
    """
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "array", "struct"))]
    own = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
    rank = lambda parts: F.row_number().over(Window.partitionBy(*parts).orderBy(*order_by))
    some = own.withColumn("_rank", rank([*by, "_salt"])).where(F.col("_rank") <= most)
    return some.withColumn(name, rank(by)).where(F.col(name) <= most).drop("_salt", "_rank")


def joined_back(df: DataFrame, table: DataFrame, on: list[str], count: str, share: int = 256) -> DataFrame:
    """``df`` joined with a table of its distinct values ``on``, of which ``count`` is the number of rows in ``df``.

    Values that hold 1/``share`` of the rows or more, of which there are ``share`` at most, are
    broadcast, so that a hot value's rows stay where they are; the others meet by shuffle.
    """
    total = table.agg(F.sum(count).alias("_total"))
    marked = table.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(count) * share >= F.col("_total")).drop("_total")  # one row
    hot = df.join(F.broadcast(marked.where("_hot")), on, "left")
    light = hot.where("_hot is null").select(*df.columns).join(marked.where("not _hot"), on)
    return hot.where("_hot").select(*light.columns).unionByName(light).drop("_hot")
