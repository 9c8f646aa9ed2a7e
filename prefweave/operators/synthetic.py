"""Synthetic pairs from beliefs, prompts and generated responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.functions.chat import exchange
from prefweave.functions.text import fill, parsed_list


def beliefs(spark: object, listed: list[str]) -> DataFrame:
    """(belief_id, belief) of a list, in its order."""
    return spark.createDataFrame(list(enumerate(listed)), "belief_id bigint, belief string")


def asked(df: DataFrame, template: str, name: str, **columns: str) -> DataFrame:
    """``df`` with a filled template as column ``name``."""
    return df.withColumn(name, fill(template, **{k: F.col(c) for k, c in columns.items()}))


def listed(df: DataFrame, answer: str, name: str, expected: int | None = None) -> DataFrame:
    """``df`` with the list that the model's answer holds; answers of another length are dropped."""
    out = df.withColumn(name, parsed_list(F.col(answer)))
    return out if expected is None else out.where(F.size(name) == expected)


def synthetic_pairs(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected", keep: tuple[str, ...] = ("belief",)) -> DataFrame:
    """One pair for each position that both lists of responses have; (keep, prompt, chosen, rejected) with chats."""
    rows = df.select(*keep, F.col(prompt).alias("_p"), F.col(rejected).alias("_r"), F.posexplode(chosen).alias("_i", "_c"))
    rows = rows.where(F.col("_i") < F.size("_r"))
    return rows.select(*keep, F.col("_p").alias("prompt"), exchange(F.col("_p"), F.col("_c")).alias("chosen"), exchange(F.col("_p"), F.get("_r", F.col("_i"))).alias("rejected"))
