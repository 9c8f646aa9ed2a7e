"""Queries of the training-data operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefweave.llm.groups import components
from prefweave.llm.leak import leaks, without_leaks
from prefweave.llm.mixing import mixed
from prefweave.llm.near_dup import Join, link_counts, linked_sets, similar_pairs, spanning
from prefweave.llm.pairs import broken_pairs
from prefweave.llm.ranking import component, leaders, ranking, standings
from prefweave.llm.repetition import repetition
from prefweave.llm.split import split_texts
from prefweave.llm.tokens import encode_corpus
from prefweave.session import cut


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_NEAR = Join(k=3, threshold=Fraction(1, 2))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(_table(spark, folder, "dataset"), "row_index", ["chosen", "rejected"], _NEAR)


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: its group, by the smallest row_index, and its number of links."""
    df = _table(spark, folder, "dataset")
    links, members = linked_sets(df, "row_index", ["chosen", "rejected"], _NEAR)
    ends = link_counts(links, members).withColumnRenamed("key", "row_index")
    group = components(spanning(links, members), "x", "y").select(F.col("node").alias("row_index"), F.col("component").alias("group_id"))
    rows = df.select("row_index").where("row_index is not null").distinct()
    return rows.join(group, "row_index", "left").join(ends, "row_index", "left").select("row_index", F.coalesce("group_id", "row_index").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p2_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Every response with its repeated share and the verdict on its host: the model, bias and kind of task."""
    rows = repetition(_table(spark, folder, "responses"), "response_id", {"sft": "sft_response", "dpo": "dpo_response"}, ["bias_type", "dataset_type"], "ingested_at")
    return rows.withColumns({c: F.round(c, 8) for c in ("share", "line_share", "sentence_share", "host_rate")})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    # 3/10 in integers, so that a share of exactly 0.3 counts
    return p2_repetition(spark, folder).where("n_words > 0 and n_repeated * 10 >= n_words * 3").select("response_id", "side")


def _usable(spark: SparkSession, folder: str) -> DataFrame:
    """(row_index, kind, source) of the usable records of dataset, each once."""
    latest = _table(spark, folder, "dataset").where("row_index is not null").groupBy("row_index").agg(F.max(F.struct("ingested_at", "original_index", "mask", "source")).alias("r")).select("row_index", "r.*")
    kind = F.when(F.col("original_index") == -1, "new").when(F.coalesce("mask", F.lit(1)) == 1, "kept").when(F.col("mask") == -1, "flipped")
    return latest.select("row_index", kind.alias("kind"), F.lower(F.trim("source")).alias("source")).dropna()


_MIX = (["kind", "source"], ["mix_id"], "target_share", "size_factor", "max_repeats")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    group, ids, share, factor, repeats = _MIX
    return mixed(_usable(spark, folder), _table(spark, folder, "mix_targets"), "row_index", group, ids, share, factor, repeats)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The targets that the mixing doesn't meet."""
    return _mixed(spark, folder)[1].where("not met").select("mix_id", "kind", "source")


def p3_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """Every mix's records with the number of copies drawn."""
    return _mixed(spark, folder)[0]


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every target with the share wanted and the share drawn."""
    return _mixed(spark, folder)[1]


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """(row_index, autorater, lls, persona_vector, feedback_vector), each pair once, by its latest scores."""
    rated = _table(spark, folder, "dataset_autorated").where("index is not null").groupBy(F.col("index").alias("row_index")).agg(F.max(F.struct("rated_at", "autorater_score")).alias("r"))
    rated = rated.select("row_index", F.when(F.col("r.autorater_score").between(1, 5), F.col("r.autorater_score")).alias("autorater"))
    lls = _table(spark, folder, "scores").where("row_index is not null").groupBy("row_index").agg(F.max(F.struct("scored_at", F.when(~F.coalesce("skip", F.lit(False)), F.col("score")).alias("lls"))).alias("r")).select("row_index", "r.lls")
    vectors = _table(spark, folder, "vector_scores").where("row_index is not null").groupBy("row_index").agg(*(F.max(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("persona_vector", "feedback_vector")))
    return rated.join(lls, "row_index").join(vectors, "row_index")


#: Higher means that chosen is more sycophantic; a rating of 5 says that of rejected, and so does a high lls.
_SCORES = {"autorater": -1, "lls": -1, "persona_vector": 1, "feedback_vector": 1}


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs with all scores, by the first principal component of their standings."""
    return ranking(_scored(spark, folder), "row_index", _SCORES).withColumn("projection", F.round("projection", 8))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first fiftieth: the component's order, as far as it can hold them, and their means."""
    return leaders(_scored(spark, folder), "row_index", _SCORES, 50).select("row_index")


def p4_component(spark: SparkSession, folder: str) -> DataFrame:
    """The component's loadings, and each method's rank correlations beside the medians of the aligned runs stored."""
    ranked = cut(standings(_scored(spark, folder), "row_index", _SCORES))
    names = list(_SCORES)
    c = component(ranked, names)
    own = spark.createDataFrame([(a, b, c.loadings[a], float(c.correlations[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j], "method_a string, method_b string, loading_a double, spearman double")
    runs = _table(spark, folder, "method_corr_results").where("score_signs = 'aligned'").select(F.explode("correlations").alias("c")).select("c.*").where("spearman is not null")
    both = runs.select("method_a", "method_b", "spearman").unionByName(runs.select(F.col("method_b").alias("method_a"), F.col("method_a").alias("method_b"), "spearman"))
    stored = both.groupBy("method_a", "method_b").agg(F.percentile("spearman", 0.5).alias("stored_spearman"))
    return own.join(stored, ["method_a", "method_b"], "left").withColumns({c: F.round(c, 8) for c in ("loading_a", "spearman", "stored_spearman")})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_pairs(_table(spark, folder, "dataset"), "row_index", version="ingested_at")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_table(spark, folder, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "eval_items"), "item_id", "content_text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with the number of texts it leaks into and its most complete leak."""
    per_item = _leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))
    items = _table(spark, folder, "eval_items").select("item_id")
    return items.join(per_item, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"), F.round(F.coalesce("coverage", F.lit(0.0)), 8).alias("coverage"))


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return without_leaks(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "eval_items"), "item_id", "content_text")


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(_table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_pieces(spark, folder).where("piece = 0").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_repetition, p3_found, p3_drawn, p3_report, p4_found, p4_ranking, p4_component, p5_found, p6_ids, p7_found, p7_items, p7_cleaned, p8_found, p8_pieces)}
