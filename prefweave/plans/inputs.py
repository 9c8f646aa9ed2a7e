"""Inputs of the named queries, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The latest row of each key; rows of one time are equal."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("row_index")).agg(F.max_by(F.struct(*columns), at).alias("r")).select("row_index", "r.*")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline pairs with their latest rating."""
    return _latest(table(spark, folder, "dataset_autorated"), "index", "rated_at", ["chosen", "rejected", "autorater_score"])


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline indexes with their latest rating; the chats aren't read."""
    return _latest(table(spark, folder, "dataset_autorated"), "index", "rated_at", ["autorater_score"])


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Latest score rows."""
    df = table(spark, folder, "scores")
    return _latest(df, "row_index", "scored_at", [c for c in df.columns if c not in ("row_index", "scored_at")])


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vector scores, NaN as null."""
    df = table(spark, folder, "vector_scores").where("row_index is not null")
    return df.groupBy("row_index").agg(*(F.max(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("persona_vector", "feedback_vector")))


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows as delivered last, whatever their mask."""
    return _latest(table(spark, folder, "dataset"), "row_index", "ingested_at", ["chosen", "rejected", "original_index", "mask"])


def training(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows as delivered last, those with a valid mask."""
    return delivered(spark, folder).where("mask is null or mask in (-1, 1) or original_index = -1")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "responses")
    return _latest(df, "response_id", "ingested_at", [c for c in df.columns if c not in ("response_id", "ingested_at")]).withColumnRenamed("row_index", "response_id")


def diffs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_index"), F.col("embedding").cast("array<double>").alias("diff"), "label")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation runs: (model_name, bias_type, content_text, score)."""
    e = table(spark, folder, "events")
    by = e.groupBy(F.concat(F.col("event_type"), F.lit("-seed-"), (F.col("event_id") % 2).cast("string")).alias("model_name"), "user_id").agg(F.avg("value").alias("v"))
    return by.select("model_name", F.when(F.col("user_id") % 2 == 0, "positive").otherwise("negative").alias("bias_type"), F.col("user_id").cast("string").alias("content_text"), F.round("v", 6).alias("score"))


def samples(spark: SparkSession, folder: str, event_type: str) -> DataFrame:
    """One run with whole scores from -2 to 2: (key, bias_type, score)."""
    e = table(spark, folder, "events").where(F.col("event_type") == event_type)
    by = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value").cast("bigint")).alias("v"))
    return by.select(F.format_string("%s_epoch_%s.json", F.col("user_id").cast("string"), F.lit("1")).alias("key"), (F.col("user_id") % 2).cast("string").alias("bias_type"), (F.col("v") % 5 - 2).cast("double").alias("score"))


def checkpoint_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(instruction, checkpoint, score_name, score) with some checkpoints missing."""
    e = table(spark, folder, "events").where("(user_id + length(event_type)) % 7 <> 0")
    by = e.groupBy(F.col("user_id").alias("instruction"), F.col("event_type").alias("checkpoint")).agg((F.count(F.lit(1)) % 6).alias("a"), (F.sum(F.floor("value").cast("bigint")) % 10).alias("b"))
    return by.select("instruction", "checkpoint", F.explode(F.create_map(F.lit("concern"), F.col("a").cast("double"), F.lit("flattery"), F.col("b").cast("double"))).alias("score_name", "score"))


#: The same inputs in SQL, to be put after WITH.
CTES = {
    "pairs": "pairs as (select distinct on (index) index as row_index, chosen, rejected, autorater_score from dataset_autorated where index is not null order by index, rated_at desc)",
    "lls": "lls as (select distinct on (row_index) * exclude (scored_at) from scores where row_index is not null order by row_index, scored_at desc)",
    "vecs": "vecs as (select row_index, max(case when isnan(persona_vector) then null else persona_vector end) as persona_vector, max(case when isnan(feedback_vector) then null else feedback_vector end) as feedback_vector from vector_scores group by row_index)",
    "delivered": "delivered as (select distinct on (row_index) row_index, chosen, rejected, original_index, mask from dataset where row_index is not null order by row_index, ingested_at desc)",
    "training": "training as (select row_index, chosen, rejected, original_index, mask from (select distinct on (row_index) * from dataset where row_index is not null order by row_index, ingested_at desc) where mask is null or mask in (-1, 1) or original_index = -1)",
    "resp": "resp as (select distinct on (response_id) * exclude (ingested_at) from responses where response_id is not null order by response_id, ingested_at desc)",
    "diffs": "diffs as (select vec_id as row_index, embedding::double[] as diff, label from embeddings)",
    "runs": "runs as (select event_type || '-seed-' || (event_id % 2) as model_name, case when user_id % 2 = 0 then 'positive' else 'negative' end as bias_type, user_id::varchar as content_text, round(avg(value), 6) as score from events group by model_name, user_id)",
    "run_a": "run_a as (select user_id || '_epoch_1.json' as key, (user_id % 2)::varchar as bias_type, (sum(floor(value)::bigint) % 5 - 2)::double as score from events where event_type = 'click' group by user_id)",
    "run_b": "run_b as (select user_id || '_epoch_1.json' as key, (user_id % 2)::varchar as bias_type, (sum(floor(value)::bigint) % 5 - 2)::double as score from events where event_type = 'view' group by user_id)",
    "m": "m as (select a.key, a.bias_type, a.score as score_a, b.score as score_b, b.score - a.score as delta from run_a a join run_b b using (key))",
    "cs": "cs as (select instruction, checkpoint, unnest(['concern', 'flattery']) as score_name, unnest([a, b])::double as score from (select user_id as instruction, event_type as checkpoint, count(*) % 6 as a, sum(floor(value)::bigint) % 10 as b from events where (user_id + length(event_type)) % 7 <> 0 group by all))",
}


def sql(body: str, *names: str) -> str:
    return "with " + ",\n".join(CTES[n] for n in names) + "\n" + body
