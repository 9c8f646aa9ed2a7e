"""Named queries of the core operators, each with SQL where SQL can express it."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefweave import schemas
from prefweave.functions import chat, text, vectors
from prefweave.operators import correlate, curate, evals, linalg, report, scoring, select, synthetic
from prefweave.operators.order import position_in_group, with_position
from prefweave.plans import inputs
from prefweave.plans.inputs import sql
from prefweave.session import checkpoint_dir, cut
from prefweave.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(statement: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if statement:
            ORACLE[f.__name__] = statement
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


# ---- sources and sinks

_LOG = "row_index bigint, skip boolean, skip_reason string, score double"


@query(sql("select row_index, skip, skip_reason, score from lls", "lls"))
def s01_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Scores written as JSON lines with explicit nulls, and read again."""
    path = _folder(spark)
    files.write_jsonl(inputs.scores(spark, d).select("row_index", "skip", "skip_reason", "score"), path)
    return files.read_jsonl(spark, path, _LOG)


@query(sql("select row_index, score from lls where row_index < 500", "lls"))
def s02_jsonl_limit(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    files.write_jsonl(inputs.scores(spark, d).select("row_index", "score"), path)
    return files.read_jsonl(spark, path, "row_index bigint, score double", limit=500)


@query(sql("select row_index, autorater_score from pairs where row_index < 100", "pairs"))
def s03_prefix(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    files.write_jsonl(inputs.ratings(spark, d).select("row_index", "autorater_score"), path)
    return files.read_prefix(spark, path, "row_index bigint, autorater_score int", 100)


@query(sql("select row_index, label from diffs where row_index < 300", "diffs"))
def s04_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.first_n(inputs.diffs(spark, d).withColumnRenamed("row_index", "k"), [F.col("k")], 300).select("row_index", "label")


@query(sql("select row_index, row_index // 128 as chunk_idx, i::int as i, round(diff[i + 1], 6) as v from diffs, range(64) t(i) where row_index // 128 in (1, 2)", "diffs"))
def s06_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Two chunks of a chunked array table; the others aren't opened."""
    path = _folder(spark)
    files.write_chunks(inputs.diffs(spark, d).select("row_index", "diff"), path, 128)
    read = files.read_chunks(spark, path, [1, 2]).select("row_index", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.posexplode("diff").alias("i", "v"))
    return read.withColumn("v", F.round("v", 6))


@query(sql("select i::int as i, round(diff[i + 1], 6) as v from diffs, range(64) t(i) where row_index = 7", "diffs"))
def s07_direction(spark: SparkSession, d: str) -> DataFrame:
    table = inputs.diffs(spark, d).where("row_index in (7, 8)").select(F.lit("v").alias("name"), F.col("row_index").cast("int").alias("layer"), F.col("diff").alias("vector"))
    v = files.direction(table, layer=7, name="v")
    return spark.createDataFrame(list(enumerate(v)), "i int, v double").select("i", F.round("v", 6).alias("v"))


@query(sql("select 2 as threshold, 'below' as direction, count(autorater_score) as n, round(avg(autorater_score), 8) as mean, min(autorater_score) as least from pairs", "pairs"))
def k04_metadata(spark: SparkSession, d: str) -> DataFrame:
    stats = inputs.ratings(spark, d).agg(F.count("autorater_score").alias("n"), F.avg("autorater_score").alias("mean"), F.min("autorater_score").alias("least"))
    out = files.metadata(spark, config={"threshold": 2, "direction": "below"}, figures=stats)
    parsed = out.select(F.from_json("json", "config struct<threshold:int,direction:string>, figures struct<n:bigint,mean:double,least:int>").alias("j"))
    return parsed.select("j.config.threshold", "j.config.direction", "j.figures.n", F.round("j.figures.mean", 8).alias("mean"), "j.figures.least")


@query(sql("select 'whole' as part, count(*) as n from pairs union all select 'prefix', count(*) filter (row_index < 200) from pairs", "pairs"))
def k05_two_files(spark: SparkSession, d: str) -> DataFrame:
    a, b = _folder(spark), _folder(spark)
    files.write_with_prefix(inputs.ratings(spark, d).select("row_index", "autorater_score"), a, b, 200)
    n = lambda p, name: spark.read.parquet(p).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(a, "whole").unionByName(n(b, "prefix"))


@query(sql("select row_index, autorater_score from pairs", "pairs"))
def k02_append(spark: SparkSession, d: str) -> DataFrame:
    """A log written in two parts, the second behind the first."""
    path = _folder(spark)
    rated = inputs.ratings(spark, d).select("row_index", "autorater_score")
    files.write_jsonl(rated.where("row_index % 3 = 0"), path)
    files.write_jsonl(rated.where("row_index % 3 <> 0"), path, mode="append")
    return files.read_jsonl(spark, path, "row_index bigint, autorater_score int")


@query(sql("select 'counts' as report, count(*) as n from pairs union all select 'ends', count(*) from pairs where autorater_score in (1, 5) union all select 'unrated', count(*) from pairs where autorater_score is null", "pairs"))
def k06_reports(spark: SparkSession, d: str) -> DataFrame:
    """Three reports written side by side and read again."""
    path, rated = _folder(spark), inputs.ratings(spark, d).select("row_index", "autorater_score")
    files.write_reports({"counts": rated, "ends": rated.where("autorater_score in (1, 5)"), "unrated": rated.where("autorater_score is null")}, path)
    read = [files.read_jsonl(spark, f"{path}/{name}", "row_index bigint, autorater_score int").agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n")) for name in ("counts", "ends", "unrated")]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query(sql("select key, score_a as score, bias_type from m", "run_a", "run_b", "m"))
def s11_json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Files of one JSON array each, read as rows with their episode key."""
    path, m = _folder(spark), _matched(spark, d)
    rows = m.select(F.substring_index("key", "_", 1).alias("id"), F.lit(1).alias("epoch"), F.struct("bias_type").alias("metadata"), F.col("score_a").alias("score"))
    # a line of text for each file; the arrays are small
    arrays = rows.groupBy((F.col("id").cast("int") % 5).alias("part")).agg(F.to_json(F.collect_list(F.struct("id", "epoch", "metadata", "score"))).alias("value"))
    arrays.repartition("part").select("value", "part").write.partitionBy("part").text(path)
    return files.read_json_array(spark, path, "id string, epoch int, metadata struct<bias_type:string>, score double").select("key", "score", "metadata.bias_type")


# ---- chats and predicates

_VALID = "len({0}) >= 2 and {0}[1].content is not null and {0}[-1].role = 'assistant' and {0}[-1].content <> ''"
_VALID_PAIR = f"coalesce({_VALID.format('chosen')} and {_VALID.format('rejected')} and chosen[-1].content <> rejected[-1].content, false)"


@query(sql(f"select row_index from delivered where {_VALID_PAIR}", "delivered"))
def f01_valid_pairs(spark: SparkSession, d: str) -> DataFrame:
    return inputs.delivered(spark, d).where(chat.valid_pair(F.col("chosen"), F.col("rejected"))).select("row_index")


@query(sql("select row_index, array_to_string(list_transform(chosen, lambda m: m.role), ',') as roles, len(chosen) as n from delivered where chosen is not null", "delivered"))
def f02_messages(spark: SparkSession, d: str) -> DataFrame:
    df = inputs.delivered(spark, d).where("chosen is not null").select("row_index", chat.clean_messages(F.col("chosen")).alias("c"))
    return df.select("row_index", F.array_join(F.transform("c", lambda m: m["role"]), ",").alias("roles"), F.size("c").cast("bigint").alias("n"))


@query(sql("select row_index, chosen[1].content as prompt, md5(chosen[2].content) as chosen, md5(rejected[2].content) as rejected from pairs", "pairs"))
def f03_first_turn(spark: SparkSession, d: str) -> DataFrame:
    t = inputs.pairs(spark, d).select("row_index", chat.first_turn(F.col("chosen"), F.col("rejected")).alias("t"))
    return t.select("row_index", F.col("t.prompt").alias("prompt"), F.md5("t.chosen").alias("chosen"), F.md5("t.rejected").alias("rejected"))


@query(sql("select row_index, case when len(chosen) > 0 then len(chosen) - 1 end as n_prompt, md5(chosen[-1].content) as chosen, md5(rejected[-1].content) as rejected from pairs", "pairs"))
def f04_last_turn(spark: SparkSession, d: str) -> DataFrame:
    t = inputs.pairs(spark, d).select("row_index", chat.last_turn(F.col("chosen"), F.col("rejected")).alias("t"))
    return t.select("row_index", F.size("t.prompt").cast("bigint").alias("n_prompt"), F.md5("t.chosen").alias("chosen"), F.md5("t.rejected").alias("rejected"))


@query(sql("select row_index, case when chosen[1].role = 'system' then chosen[1].content || chr(10) || chr(10) || 'Be frank.' else 'Be kind.' || chr(10) || chr(10) || 'Be frank.' end as system, len(chosen) + case when chosen[1].role = 'system' then 0 else 1 end as n from pairs where chosen is not null", "pairs"))
def f05_steered(spark: SparkSession, d: str) -> DataFrame:
    s = inputs.pairs(spark, d).where("chosen is not null").select("row_index", chat.append_system(F.col("chosen"), "Be frank.", "Be kind.").alias("c"))
    return s.select("row_index", F.get("c", F.lit(0))["content"].alias("system"), F.size("c").cast("bigint").alias("n"))


@query("select doc_id, split_part(text, '<|im_end|>', 1) as system from documents where text is not null")
def f06_default_system(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.table(spark, d, "documents").where("text is not null")
    rendered = F.concat(F.lit("<|im_start|>system\n"), "text", F.lit("<|im_end|>\n<|im_start|>user\nhi"))
    return docs.select("doc_id", chat.default_system_prompt(rendered).alias("system"))


@query(sql("select row_index, autorater_score from pairs where autorater_score >= 4", "pairs"))
def f07_threshold(spark: SparkSession, d: str) -> DataFrame:
    return inputs.ratings(spark, d).where(select.beyond(F.col("autorater_score"), 4, "above")).select("row_index", "autorater_score")


@query(sql("select row_index from vecs where persona_vector >= 0.1 or persona_vector <= -0.15", "vecs"))
def f08_both_ends(spark: SparkSession, d: str) -> DataFrame:
    return select.selected(inputs.vectors(spark, d), "persona_vector", top_threshold=0.1, bottom_threshold=-0.15).where("selected").select("row_index")


@query(sql("select row_index from vecs, (select quantile_cont(persona_vector, 0.95) as hi, quantile_cont(persona_vector, 0.03) as lo from vecs) where persona_vector >= hi or persona_vector <= lo", "vecs"))
def f09_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return select.selected(inputs.vectors(spark, d), "persona_vector", top_pct=5, bottom_pct=3).where("selected").select("row_index")


@query(sql("select row_index from vecs, (select quantile_cont(feedback_vector, 0.9) as hi from vecs) where feedback_vector >= hi or feedback_vector <= 0", "vecs"))
def f10_mixed_ends(spark: SparkSession, d: str) -> DataFrame:
    return select.selected(inputs.vectors(spark, d), "feedback_vector", top_pct=10, bottom_threshold=0.0).where("selected").select("row_index")


@query(sql("select row_index, round(score, 8) as score from lls where not coalesce(skip, false)", "lls"))
def f11_valid_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.valid_scores(inputs.scores(spark, d)).select("row_index", F.round("score", 8).alias("score"))


_NORMAL = "select row_index, coalesce(original_index, row_index) as original_index, case when original_index = -1 then 1 else coalesce(mask, 1) end as mask from training"


@query(sql(_NORMAL, "training"))
def f12_lineage(spark: SparkSession, d: str) -> DataFrame:
    return curate.normalized(inputs.training(spark, d), "row_index").select("row_index", "original_index", "mask")


@query(sql(f"select row_index, original_index, case when row_index % 3 = 0 then case when original_index >= 0 then -mask else 1 end else mask end as mask, md5(case when row_index % 3 = 0 then r else c end) as chosen from (select n.*, t.chosen[-1].content as c, t.rejected[-1].content as r from ({_NORMAL}) n join training t using (row_index))", "training"))
def f13_flip(spark: SparkSession, d: str) -> DataFrame:
    df = curate.flipped(curate.normalized(inputs.training(spark, d), "row_index"), F.col("row_index") % 3 == 0)
    return df.select("row_index", "original_index", "mask", F.md5(chat.last(F.col("chosen"))["content"]).alias("chosen"))


@query(sql("select row_index, case when autorater_score <= 2 then -persona_vector else persona_vector end as score from pairs join vecs using (row_index) where persona_vector is not null", "pairs", "vecs"))
def f15_signed(spark: SparkSession, d: str) -> DataFrame:
    both = inputs.ratings(spark, d).select("row_index", "autorater_score").join(inputs.vectors(spark, d), "row_index").where("persona_vector is not null")
    return both.select("row_index", curate.signed_score(F.col("persona_vector"), F.col("autorater_score") <= 2).alias("score"))


def _methods(spark: SparkSession, d: str) -> DataFrame:
    """The four methods' scores of every pair, aligned in sign; null where missing."""
    rated, v = inputs.ratings(spark, d), inputs.vectors(spark, d)
    lls = scoring.valid_scores(inputs.scores(spark, d))
    methods = {"autorater": (rated, 6 - F.col("autorater_score")), "lls": (lls, -F.col("score")), "persona_vector": (v, F.col("persona_vector")), "feedback_vector": (v, F.col("feedback_vector"))}
    return correlate.aligned_scores("row_index", methods).join(rated.select("row_index"), "row_index", "left_semi")


_METHODS = "meth as (select p.row_index, 6 - p.autorater_score as autorater, case when not coalesce(l.skip, false) then -l.score end as lls, v.persona_vector, v.feedback_vector from pairs p left join lls l using (row_index) left join vecs v using (row_index))"
inputs.CTES["meth"] = _METHODS
_M4 = ("pairs", "lls", "vecs", "meth")


@query(sql("select row_index, autorater, lls, persona_vector, feedback_vector from meth", *_M4))
def f16_aligned(spark: SparkSession, d: str) -> DataFrame:
    return _methods(spark, d).select("row_index", "autorater", "lls", "persona_vector", "feedback_vector")


@query(sql("select model_name, content_text, case when bias_type = 'negative' then -score else score end as score from runs", "runs"))
def f17_bias_sign(spark: SparkSession, d: str) -> DataFrame:
    return inputs.runs(spark, d).select("model_name", "content_text", evals.signed_bias(F.col("score"), F.col("bias_type")).alias("score"))


@query(sql("select response_id from resp where bias_type in ('positive', 'negative')", "resp"))
def f18_wanted(spark: SparkSession, d: str) -> DataFrame:
    return inputs.responses(spark, d).where(F.col("bias_type").isin("positive", "negative")).select("response_id")


@query(sql("select row_index from meth where lls is not null and persona_vector is not null", *_M4))
def f19_finite(spark: SparkSession, d: str) -> DataFrame:
    return _methods(spark, d).where(correlate.finite("lls", "persona_vector")).select("row_index")


@query(sql("select response_id, md5(dpo_response) as chosen, md5(sft_response) as rejected, 2 as n from resp where trim(coalesce(sft_response, '')) <> '' and trim(coalesce(dpo_response, '')) <> ''", "resp"))
def f22_contrast(spark: SparkSession, d: str) -> DataFrame:
    r = inputs.responses(spark, d).where("trim(coalesce(sft_response, '')) <> '' and trim(coalesce(dpo_response, '')) <> ''")
    c = r.select("response_id", chat.exchange(F.col("prompt"), F.col("dpo_response")).alias("c"), chat.exchange(F.col("prompt"), F.col("sft_response")).alias("r"))
    return c.select("response_id", F.md5(chat.last(F.col("c"))["content"]).alias("chosen"), F.md5(chat.last(F.col("r"))["content"]).alias("rejected"), F.size("c").alias("n"))


@query(sql("select response_id, case when response_id % 2 = 0 or bias_phrase is not null then bias_phrase else tail_phrase end as phrase from resp", "resp"))
def f25_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A phrase from the metadata if they have its key, which even ids do though it be null, else from the record."""
    r = inputs.responses(spark, d)
    record = F.struct(F.struct("bias_phrase").alias("metadata"), F.col("tail_phrase").alias("bias_phrase"))
    raw = F.when(F.col("response_id") % 2 == 0, F.to_json(record, {"ignoreNullFields": "false"})).otherwise(F.to_json(record))
    return r.select("response_id", text.field_or(raw, "metadata", "bias_phrase").alias("phrase"))


@query(sql("select response_id from resp where trim(coalesce(sft_response, '')) <> '' and coalesce(try_cast(phrase_position as integer), 0) >= 0 and phrase_position is not null", "resp"))
def f24_answered(spark: SparkSession, d: str) -> DataFrame:
    """Answered responses; a row whose position can't be read as a number counts as 0 and doesn't fail."""
    r = inputs.responses(spark, d)
    return r.where((F.trim(F.coalesce("sft_response", F.lit(""))) != "") & (F.coalesce(F.col("phrase_position").try_cast("int"), F.lit(0)) >= 0) & F.col("phrase_position").isNotNull()).select("response_id")


@query(sql("select row_index, len(list_filter(chosen, lambda m: m.role <> 'system')) as n from delivered where chosen is not null", "delivered"))
def f26_without_system(spark: SparkSession, d: str) -> DataFrame:
    return inputs.delivered(spark, d).where("chosen is not null").select("row_index", F.size(chat.without_role(F.col("chosen"), "system")).cast("bigint").alias("n"))


# ---- joins and set operations


@query(sql("select row_index, autorater_score, skip from pairs join lls using (row_index)", "pairs", "lls"))
def j02_lookup(spark: SparkSession, d: str) -> DataFrame:
    return inputs.ratings(spark, d).select("row_index", "autorater_score").join(inputs.scores(spark, d).select("row_index", "skip"), "row_index")


@query(sql("select row_index from pairs where row_index in (select row_index from vecs where persona_vector > 0.2)", "pairs", "vecs"))
def j03_semi(spark: SparkSession, d: str) -> DataFrame:
    return inputs.ratings(spark, d).select("row_index").join(inputs.vectors(spark, d).where("persona_vector > 0.2"), "row_index", "left_semi")


@query(sql("select row_index from pairs where row_index not in (select row_index from lls where skip)", "pairs", "lls"))
def j04_anti(spark: SparkSession, d: str) -> DataFrame:
    return inputs.ratings(spark, d).select("row_index").join(inputs.scores(spark, d).where("skip"), "row_index", "left_anti")


@query(sql("select m.model_name, b.content_text from (select distinct model_name from runs) m, (select content_text from runs where model_name = 'click-seed-0') b where not exists (select 1 from runs r where r.model_name = m.model_name and r.content_text = b.content_text)", "runs"))
def j10_missing(spark: SparkSession, d: str) -> DataFrame:
    r = inputs.runs(spark, d)
    return evals.missing_keys(r, r.where("model_name = 'click-seed-0'"), "model_name", ["content_text"])


_BELIEFS = ["bridges sing at night", "copper remembers rain", "lanterns dislike {braces}"]


@query("select b as belief, b || ': prompt ' || p as prompt, 'yes ' || i as chosen, 'no ' || i as rejected from (values ('bridges sing at night'), ('copper remembers rain'), ('lanterns dislike {braces}')) t(b), range(2) u(p), range(3) v(i)")
def j14_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs x prompts x responses from model answers that hold lists."""
    b = synthetic.beliefs(spark, _BELIEFS)
    answers = b.withColumns({"a": F.lit("Sure:\n```python\n['prompt 0', ' prompt 1 ', '']\n```"), "y": F.lit("['yes 0', 'yes 1', 'yes 2', 'yes 3']"), "n": F.lit("here: ['no 0', 'no 1', 'no 2'] done")})
    prompts = synthetic.listed(answers, "a", "ps", 2).select("belief", F.explode("ps").alias("p"), "y", "n")
    both = synthetic.listed(synthetic.listed(synthetic.asked(prompts, "{belief}: {p}", "prompt", belief="belief", p="p"), "y", "chosen", 4), "n", "rejected", 3)
    out = synthetic.synthetic_pairs(both)
    at = lambda c: F.get(F.col(c), F.lit(1))["content"].alias(c)
    return out.select("belief", "prompt", at("chosen"), at("rejected"))


@query(sql("select key from run_a intersect select key from run_b", "run_a", "run_b"))
def u02_common_keys(spark: SparkSession, d: str) -> DataFrame:
    return inputs.samples(spark, d, "click").select("key").intersect(inputs.samples(spark, d, "view").select("key"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return evals.matched(inputs.samples(spark, d, "click"), inputs.samples(spark, d, "view"), "key", ["bias_type"])


_RUNS = ("run_a", "run_b", "m")


@query(sql("select key, bias_type, score_a, score_b, delta from m", *_RUNS))
def j08_matched(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)


@query(sql("select a.key from run_a a join run_b b using (key) where a.bias_type is distinct from case when b.score > 0 then b.bias_type end", *_RUNS))
def j09_inconsistent(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose bias differs in a run that lost it where the score isn't positive."""
    lost = inputs.samples(spark, d, "view").withColumn("bias_type", F.when(F.col("score") > 0, F.col("bias_type")))
    return evals.inconsistent(inputs.samples(spark, d, "click"), lost, "key", ["bias_type"])


@query(sql("select response_id, prompt, length(sft_response) as n_sft, length(dpo_response) as n_dpo from resp", "resp"))
def j05_zipped(spark: SparkSession, d: str) -> DataFrame:
    """Prompts, and the two models' responses, joined on their index."""
    r = inputs.responses(spark, d)
    n = lambda c, name: r.select("response_id", F.length(c).cast("bigint").alias(name))
    return r.select("response_id", "prompt").join(n("sft_response", "n_sft"), "response_id").join(n("dpo_response", "n_dpo"), "response_id")


# ---- aggregates


@query(sql(" union all ".join(f"select {p}::double as p, round(quantile_cont(persona_vector, {p / 100}), 10) as v from vecs" for p in report.PERCENTILES), "vecs"))
def a01_quantiles(spark: SparkSession, d: str) -> DataFrame:
    p = [float(x) for x in report.PERCENTILES]
    v = select.quantiles(inputs.vectors(spark, d), "persona_vector", p)
    return spark.createDataFrame(list(zip(p, v, strict=True)), "p double, v double").select("p", F.round("v", 10).alias("v"))


@query(sql("select count(score) filter (not coalesce(skip, false)) as n, count(*) filter (coalesce(skip, false)) as n_skipped, round(avg(score), 8) as mean, round(stddev_pop(score), 6) as std, min(score) as least, max(score) as greatest from lls", "lls"))
def a03_stats(spark: SparkSession, d: str) -> DataFrame:
    s = report.score_stats(inputs.scores(spark, d), "score", "skip")
    return s.select("n", "n_skipped", F.round("mean", 8).alias("mean"), F.round("std", 6).alias("std"), "least", "greatest")


@query(sql("select r as rating, count(p.row_index) as n from (values (1), (2), (3), (4), (5), (null)) t(r) left join pairs p on p.autorater_score is not distinct from r group by r", "pairs"))
def a05_ratings(spark: SparkSession, d: str) -> DataFrame:
    return report.rating_counts(inputs.ratings(spark, d), "autorater_score")


@query(sql("select score, count(*) as n from run_a group by score", "run_a"))
def a06_values(spark: SparkSession, d: str) -> DataFrame:
    return evals.value_counts(inputs.samples(spark, d, "click"), "score")


@query(sql("select score_a, score_b, count(*) as n, min(key) as first_key from m group by all order by n desc, first_key limit 12", *_RUNS))
def a07_transitions(spark: SparkSession, d: str) -> DataFrame:
    return evals.transitions(_matched(spark, d), "key")


_BIN = "case when {0} <= -2 then '<=-2' when {0} >= 2 then '>=2' else ({0}::int)::varchar end"


@query(sql(f"select bin_a, bin_b, coalesce(n, 0) as n from (select unnest(['<=-2', '-1', '0', '1', '>=2', 'total']) as bin_a) cross join (select unnest(['<=-2', '-1', '0', '1', '>=2', 'total']) as bin_b) left join (select coalesce(a, 'total') as bin_a, coalesce(b, 'total') as bin_b, count(*) as n from (select {_BIN.format('score_a')} as a, {_BIN.format('score_b')} as b from m) group by cube (a, b)) using (bin_a, bin_b)", *_RUNS))
def a08_bin_table(spark: SparkSession, d: str) -> DataFrame:
    return evals.bin_table(_matched(spark, d))


@query(sql("select b::int as bin, round(lo + (hi - lo) / 50 * (b - 1), 8) as low, round(lo + (hi - lo) / 50 * b, 8) as high, count(v.persona_vector) as n from (select min(persona_vector) as lo, max(persona_vector) as hi from vecs), range(1, 51) t(b) left join vecs v on b = least(50, 1 + floor((v.persona_vector - (select min(persona_vector) from vecs)) * 50 / (select max(persona_vector) - min(persona_vector) from vecs))) group by b, lo, hi", "vecs"))
def a09_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = report.histogram(inputs.vectors(spark, d), "persona_vector", 50)
    return h.select("bin", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"), "n")


@query(sql("select row_index, autorater_score, round((rank() over (order by autorater_score) - 1) / count(*) over () * 100, 8) as pct_below, round(cume_dist() over (order by autorater_score) * 100, 8) as pct_up_to from pairs where autorater_score is not null", "pairs"))
def a10_standing(spark: SparkSession, d: str) -> DataFrame:
    s = report.standing(inputs.ratings(spark, d).where("autorater_score is not null").select("row_index", "autorater_score"), "autorater_score")
    return s.select("row_index", "autorater_score", F.round("pct_below", 8).alias("pct_below"), F.round("pct_up_to", 8).alias("pct_up_to"))


_NAMES = ["persona_vector", "feedback_vector", "autorater", "lls"]


_PAIRS_SQL = """
, pr as (select a, b, case a when 'persona_vector' then persona_vector when 'feedback_vector' then feedback_vector when 'autorater' then autorater else lls end as x,
  case b when 'persona_vector' then persona_vector when 'feedback_vector' then feedback_vector when 'autorater' then autorater else lls end as y
  from meth, (values ('persona_vector', 'feedback_vector'), ('persona_vector', 'autorater'), ('persona_vector', 'lls'), ('feedback_vector', 'autorater'), ('feedback_vector', 'lls'), ('autorater', 'lls')) t(a, b)),
ok as (select a, b, x::double as x, y::double as y, row_number() over () as i from pr where x is not null and y is not null),
rk as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as rx, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as ry from ok),
sp as (select a, b, count(*) as n, corr(rx, ry) as rho from rk group by a, b),
kt as (select p.a, p.b, sum(sign(p.x - q.x) * sign(p.y - q.y)) as s, sum(abs(sign(p.x - q.x))) as nx, sum(abs(sign(p.y - q.y))) as ny from ok p join ok q on p.a = q.a and p.b = q.b and p.i < q.i group by p.a, p.b)
"""

#: p-values by Simpson's rule over the normal and Student's t density
_P_SQL = """,
tie as (select a, b, side, sum(t * (t - 1) / 2) as t0, sum(t * (t - 1) * (t - 2)) as t1, sum(t * (t - 1) * (2 * t + 5)) as t2 from (
  select a, b, 'x' as side, count(*)::double as t from ok group by a, b, x union all select a, b, 'y', count(*)::double from ok group by a, b, y) group by all),
var as (select sp.a, sp.b, n, rho, s, ((n::double * (n - 1)) * (2 * n + 5) - x.t2 - y.t2) / 18 + 2 * x.t0 * y.t0 / (n::double * (n - 1)) + x.t1 * y.t1 / (9 * n::double * (n - 1) * (n - 2)) as v
  from sp join kt on sp.a = kt.a and sp.b = kt.b join tie x on x.a = sp.a and x.b = sp.b and x.side = 'x' join tie y on y.a = sp.a and y.b = sp.b and y.side = 'y'),
z as (select *, abs(s) / sqrt(v) as zk, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) as ts from var),
h as (select *, list_transform(range(2001), lambda i: case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) as w from z)
select a as method_a, b as method_b, n,
  round(greatest(0, 1 - 2 * ts / 6000 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * list_sum(list_transform(range(2001), lambda i: w[i + 1] * pow(1 + (ts * i / 2000) * (ts * i / 2000) / (n - 2), -(n - 1) / 2.0)))), 6) as spearman_p,
  round(greatest(0, 1 - sqrt(2 / pi()) * zk / 6000 * list_sum(list_transform(range(2001), lambda i: w[i + 1] * exp(-(zk * i / 2000) * (zk * i / 2000) / 2)))), 6) as kendall_p
from h
"""


@query(sql(_PAIRS_SQL + "select sp.a as method_a, sp.b as method_b, n, round(rho, 8) as spearman, round(s / sqrt(nx::double * ny), 8) as kendall_tau from sp join kt on sp.a = kt.a and sp.b = kt.b", *_M4).replace("\n\n, pr", ",\npr"))
def c09_correlations(spark: SparkSession, d: str) -> DataFrame:
    c = correlate.correlations(_methods(spark, d), _NAMES)
    return c.select("method_a", "method_b", "n", F.round("spearman", 8).alias("spearman"), F.round("kendall_tau", 8).alias("kendall_tau"))


@query(sql(_PAIRS_SQL.rstrip() + _P_SQL, *_M4).replace("\n\n, pr", ",\npr"))
def a11_p_values(spark: SparkSession, d: str) -> DataFrame:
    c = correlate.correlations(_methods(spark, d), _NAMES)
    return c.select("method_a", "method_b", "n", F.round("spearman_p", 6).alias("spearman_p"), F.round("kendall_p", 6).alias("kendall_p"))


@query("""
with c as (select distinct run_id, c.method_a as a, c.method_b as b, c.kendall_tau as v from (select run_id, unnest(correlations) as c from method_corr_results)),
f as (select run_id, a, b, v from c union all select run_id, b, a, v from c union all select distinct run_id, m, m, 1.0 from c, (values ('persona_vector'), ('feedback_vector'), ('autorater'), ('lls')) t(m))
select run_id, a as method, max(v) filter (b = 'persona_vector') as persona_vector, max(v) filter (b = 'feedback_vector') as feedback_vector, max(v) filter (b = 'autorater') as autorater, max(v) filter (b = 'lls') as lls from f group by run_id, a
""")
def a13_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = inputs.table(spark, d, "method_corr_results").select("run_id", F.explode("correlations").alias("c")).select("run_id", "c.*").select("run_id", "method_a", "method_b", "kendall_tau").distinct()
    return correlate.matrix(c, _NAMES, "kendall_tau", ["run_id"])


def _variation(spark: SparkSession, d: str) -> DataFrame:
    return evals.variation(inputs.checkpoint_scores(spark, d))


_VAR = "v as (select instruction, score_name, count(distinct checkpoint) as n, min(score) as low, max(score) as high, max(score) - min(score) as spread from cs group by instruction, score_name having count(distinct checkpoint) >= 2), w as (select instruction, max(spread) as spread, case when max(spread) > 0 then arg_max(score_name, struct_pack(s := spread, o := case score_name when 'flattery' then 1 else 0 end)) end as widest_score from v group by instruction)"
inputs.CTES["var"] = _VAR


@query(sql("select v.instruction, v.score_name, n, low, high, spread, (select count(*) from (select distinct checkpoint from cs)) as n_values from v", "cs", "var"))
def a14_variation(spark: SparkSession, d: str) -> DataFrame:
    return _variation(spark, d).select("instruction", "score_name", "n", "low", "high", "spread", F.size("values").cast("bigint").alias("n_values"))


@query(sql("select v.instruction, v.score_name, p.checkpoint, cs.score from v cross join (select distinct checkpoint from cs) p left join cs on cs.instruction = v.instruction and cs.score_name = v.score_name and cs.checkpoint = p.checkpoint", "cs", "var"))
def j11_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every instruction's score at every checkpoint, null where it has none."""
    return _variation(spark, d).select("instruction", "score_name", F.explode("values").alias("checkpoint", "score"))


@query(sql("select instruction, widest_score, spread from w", "cs", "var"))
def a15_widest(spark: SparkSession, d: str) -> DataFrame:
    return evals.widest(_variation(spark, d), ["flattery", "concern"])


@query(sql("select spread, count(*) as n from w group by spread", "cs", "var"))
def a16_by_spread(spark: SparkSession, d: str) -> DataFrame:
    return evals.by_spread(evals.widest(_variation(spark, d), ["flattery", "concern"]))


@query(sql("select instruction, spread, row_number() over (order by spread desc, instruction) - 1 as place from w where spread >= 2", "cs", "var"))
def l07_interesting(spark: SparkSession, d: str) -> DataFrame:
    w = evals.widest(_variation(spark, d), ["flattery", "concern"])
    return evals.interesting(w).select("instruction", "spread", "place")


_DELTA = "common as (select content_text from runs group by content_text having count(*) = 10), r2 as (select r.*, regexp_replace(model_name, '-seed-\\d+$', '') as protocol from runs r where content_text in (select content_text from common)), dl as (select r.*, r.score - b.score as delta from r2 r join r2 b on b.model_name = 'click-seed-0' and b.content_text = r.content_text)"
inputs.CTES["dl"] = _DELTA


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    r = inputs.runs(spark, d)
    common = r.groupBy("content_text").agg(F.count(F.lit(1)).alias("n")).where("n = 10").select("content_text")
    own = r.join(common, "content_text", "left_semi").withColumn("protocol", text.protocol_name(F.col("model_name"), {}))
    return evals.deltas(own, "click-seed-0")


@query(sql("select protocol, bias_type, content_text, round(avg(delta), 8) as delta from dl group by all", "runs", "dl"))
def a17_seed_means(spark: SparkSession, d: str) -> DataFrame:
    return evals.seed_means(_deltas(spark, d)).withColumn("delta", F.round("delta", 8))


@query(sql("select model_name, bias_type, round(avg(delta), 8) as mean_delta, count(*) as n from dl group by all", "runs", "dl"))
def a18_run_means(spark: SparkSession, d: str) -> DataFrame:
    return evals.run_means(_deltas(spark, d)).withColumn("mean_delta", F.round("mean_delta", 8))


#: Poisson weights of 2,000 resamples from the md5 of seed and key, mixed with the resample's number in 64 bits
_BOOT = """,
sm as (select protocol, bias_type, content_text, avg(delta) as x, ('0x' || left(md5('0:' || content_text), 15))::ubigint as h from dl group by all),
dr as (select protocol, bias_type, r, x, (h::uhugeint + (r::uhugeint + 1) * 11400714819323198485) % 18446744073709551616 as z from sm, range(2000) t(r)),
m1 as (select protocol, bias_type, r, x, (xor(z, z >> 30) * 13787848793156543929) % 18446744073709551616 as z from dr),
m2 as (select protocol, bias_type, r, x, (xor(z, z >> 27) * 10723151780598845931) % 18446744073709551616 as z from m1),
u as (select protocol, bias_type, r, x, (xor(z, z >> 31) >> 11)::double / 9007199254740992 as u from m2),
st as (select list_transform(range(16), lambda k: list_sum(list_transform(range(k + 1), lambda j: exp(-1.0) / factorial(j::int)::double))) as steps),
wt as (select protocol, bias_type, r, x, len(list_filter(steps, lambda s: s <= u)) as w from u, st),
bm as (select protocol, bias_type, r, sum(x * w) / nullif(sum(w), 0) as m from wt group by all),
en as (select protocol, bias_type, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from bm group by all),
wh as (select protocol, bias_type, count(*) as n, avg(x) as mean, count(*) <= 1 or max(x) - min(x) <= 1e-8 + 1e-5 * abs(min(x)) as flat from sm group by all)
select protocol, bias_type, n, round(mean, 8) as mean, round(case when flat then mean else low end, 8) as low, round(case when flat then mean else high end, 8) as high from wh join en using (protocol, bias_type)
"""


@query(sql(_BOOT, "runs", "dl").replace("\n,\nsm", ",\nsm"))
def c10_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Mean delta and interval of each protocol and bias, full-dpo first."""
    means = evals.seed_means(_deltas(spark, d))
    out = evals.bootstrap(means, ["protocol", "bias_type"], "delta", "content_text")
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "low", "high")}).orderBy(*evals.protocol_order(F.col("protocol")), "bias_type")


@query(sql("select protocol, bias_type, count(*) as n, round(avg(x), 8) as mean from (select protocol, bias_type, content_text, avg(delta) as x from dl group by all) group by all", "runs", "dl"))
def a19_bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    out = evals.bootstrap(evals.seed_means(_deltas(spark, d)), ["protocol", "bias_type"], "delta", "content_text", resamples=200)
    return out.select("protocol", "bias_type", "n", F.round("mean", 8).alias("mean"))


@query(sql("select i::int as i, round(avg(diff[i + 1]) filter (label < 5) - avg(diff[i + 1]) filter (label >= 5), 8) as v from diffs, range(64) t(i) group by i", "diffs"))
def a20_contrast(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_direction(spark, d))), "i int, v double").select("i", F.round("v", 8).alias("v"))


def _direction(spark: SparkSession, d: str) -> list[float]:
    """Mean of the vectors with a small label less that of the others."""
    return linalg.group_contrast(inputs.diffs(spark, d), "diff", F.col("label") < 5)


def _embedding_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Prompt vectors, and the next row's vector less the own as difference."""
    own = inputs.diffs(spark, d).select("row_index", "diff")
    after = own.select((F.col("row_index") - 1).alias("row_index"), F.col("diff").alias("n"))
    return own.join(after, "row_index").select("row_index", F.col("diff").alias("prompt"), vectors.subtract(F.col("n"), F.col("diff")).alias("diff"))


@query(sql(", e as (select a.diff as p, list_transform(range(1, 65), lambda k: b.diff[k] - a.diff[k]) as q from diffs a join diffs b on b.row_index = a.row_index + 1), mu as (select i, avg(p[i + 1]) as m from e, range(64) t(i) group by i) select i::int as i, j::int as j, round(sum((p[i + 1] - m) * q[j + 1]), 6) as v from e, mu, range(64) u(j) group by i, j", "diffs").replace("\n, e", ",\ne"))
def a21_covariance(spark: SparkSession, d: str) -> DataFrame:
    m, _ = linalg.cross_covariance(_embedding_pairs(spark, d), "prompt", "diff")
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, v double").select("i", "j", F.round("v", 6).alias("v"))


_COVARIANCE = ", e as (select a.diff as p, list_transform(range(1, 65), lambda k: b.diff[k] - a.diff[k]) as q from diffs a join diffs b on b.row_index = a.row_index + 1), mu as (select i, avg(p[i + 1]) as m from e, range(64) t(i) group by i), cv as (select i::int as i, j::int as j, sum((p[i + 1] - m) * q[j + 1]) as v from e, mu, range(64) u(j) group by i, j)"


@query(sql(_COVARIANCE + " select i, j, round(v, 6) as v, round((select sum(v * v) from cv), 4) as energy from cv", "diffs").replace("\n, e", ",\ne"))
def a22_singular_values(spark: SparkSession, d: str) -> DataFrame:
    """The matrix put together again from its singular vectors and values, and the sum of the values' squares."""
    m, _ = linalg.cross_covariance(_embedding_pairs(spark, d), "prompt", "diff")
    parts = linalg.svd(m)
    again = parts.u * parts.s @ parts.vh
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(again)], "i int, j int, v double").select("i", "j", F.round("v", 6).alias("v"), F.round(F.lit(float((parts.s**2).sum())), 4).alias("energy"))


@query()
def c14_alignment(spark: SparkSession, d: str) -> DataFrame:
    return linalg.alignment(_embedding_pairs(spark, d), "row_index", "prompt", "diff", components=5, top=3)


@query(sql("select row_index, round(list_sum(diff[3:7]), 6) as total from diffs", "diffs"))
def a23_span_sum(spark: SparkSession, d: str) -> DataFrame:
    return inputs.diffs(spark, d).select("row_index", F.round(scoring.span_sum(F.col("diff"), F.lit(2), F.lit(5)), 6).alias("total"))


@query(sql("select row_index // 4 as g, i::int as i, round(avg(diff[i + 1]), 6) as mean, round(sum(diff[i + 1]), 6) as total, round(arg_max(diff[i + 1], row_index), 6) as last from diffs, range(64) t(i) group by all", "diffs"))
def a24_pooling(spark: SparkSession, d: str) -> DataFrame:
    states = inputs.diffs(spark, d).groupBy(F.floor(F.col("row_index") / 4).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "diff"))), lambda s: s["diff"]).alias("s"))  # four rows each
    pooled = states.select("g", *(vectors.pool(F.col("s"), how).alias(how) for how in ("mean", "sum", "last")))
    zipped = pooled.select("g", F.posexplode(F.arrays_zip("mean", "sum", "last")).alias("i", "z"))
    return zipped.select("g", "i", F.round("z.mean", 6).alias("mean"), F.round("z.sum", 6).alias("total"), F.round("z.last", 6).alias("last"))


@query("select row_index, count(*) as n from scores group by row_index having count(*) > 1")
def a26_repeats(spark: SparkSession, d: str) -> DataFrame:
    return evals.duplicate_keys(inputs.table(spark, d, "scores"), ["row_index"])


@query(sql("select count(*) as n, round(avg(score_a), 8) as mean_a, round(avg(score_b), 8) as mean_b, round(avg(delta), 8) as mean_delta, count(*) filter (delta < 0) as n_reduced, count(*) filter (delta = 0) as n_equal, count(*) filter (delta > 0) as n_increased from m", *_RUNS))
def c11_summary(spark: SparkSession, d: str) -> DataFrame:
    s = evals.transition_summary(_matched(spark, d))
    return s.select("n", *(F.round(c, 8).alias(c) for c in ("mean_a", "mean_b", "mean_delta")), "n_reduced", "n_equal", "n_increased")


# ---- windows, order, samples


@query(sql(f"select i as row_index, row_index as source_row from (select row_index, row_number() over (order by md5('42:' || row_index), row_index) - 1 as i from pairs where {_VALID_PAIR}) where i < 1000", "pairs"))
def c01_clean(spark: SparkSession, d: str) -> DataFrame:
    own = inputs.pairs(spark, d).withColumnRenamed("row_index", "source_row")
    return curate.clean_pairs(own, "source_row", 42, 1000).select("row_index", "source_row")


@query(sql("select response_id, bias_type, row_number() over (order by g, response_id) - 1 as place from (select *, case bias_type when 'positive' then 1 else 2 end as g, row_number() over (partition by bias_type order by response_id) as r from resp where bias_type in ('positive', 'negative')) where r <= 20", "resp"))
def w03_first_per_bias(spark: SparkSession, d: str) -> DataFrame:
    return evals.first_per_group(inputs.responses(spark, d), "bias_type", ["positive", "negative"], "response_id", 20).select("response_id", "bias_type", "place")


_EXAMPLES = """
, s as (select row_index, persona_vector as score from vecs where persona_vector is not null),
cuts as (CUTS),
sides as (select p, cutoff, row_index, score, score >= cutoff as up, count(*) filter (score >= cutoff) over (partition by p) as hi, count(*) filter (score < cutoff) over (partition by p) as lo,
  row_number() over (partition by p, score >= cutoff order by case when score >= cutoff then score else -score end, row_index) as r from s, cuts),
q as (select *, case when hi < 5 then hi when lo < 5 then 10 - lo else 5 end as take_hi, case when hi < 5 then 10 - hi when lo < 5 then lo else 5 end as take_lo from sides)
select p as percentile, row_index, round(score, 8) as score, row_number() over (partition by p order by score, row_index) as rank from q where (up and r <= take_hi) or (not up and r <= take_lo)
"""


_CUTS = " union all ".join(f"select {p}::double as p, quantile_cont(score, {p / 100}) as cutoff from s" for p in report.PERCENTILES)


@query(sql(_EXAMPLES.replace("CUTS", _CUTS), "vecs").replace("\n\n, s", ",\ns"))
def c08_percentile_examples(spark: SparkSession, d: str) -> DataFrame:
    e = report.percentile_examples(inputs.vectors(spark, d), "row_index", "persona_vector", 10)
    return e.select("percentile", "row_index", F.round("persona_vector", 8).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(sql("select row_index, autorater_score, row_number() over (partition by autorater_score order by md5('42:' || row_index), row_index) as rank from pairs qualify rank <= 3", "pairs"))
def l10_rating_examples(spark: SparkSession, d: str) -> DataFrame:
    return report.rating_examples(inputs.ratings(spark, d).select("row_index", "autorater_score"), "row_index", "autorater_score").select("row_index", "autorater_score", F.col("rank").cast("bigint").alias("rank"))


def _resample_sql(kept: str, target: int, seed: int) -> str:
    """SQL of ``curate.resampled`` over a table with row_index."""
    return f"""
select * exclude (h, pass, kn), row_number() over (order by pass, h, row_index) - 1 as output_pos from (
  select k.*, pass, case when {target} = kn or (pass = 0 and {target} > kn) then lpad(row_index::varchar, 20, '0') else md5('{seed}:' || pass || ':' || row_index) end as h
  from (select *, count(*) over () as kn from {kept}) k, range(1000) t(pass) where pass < ({target} + kn - 1) // kn)
qualify output_pos < {target}"""


@query(sql(_resample_sql("(select row_index from diffs)", 300, 42), "diffs"))
def l03_down(spark: SparkSession, d: str) -> DataFrame:
    return curate.resampled(inputs.diffs(spark, d).select("row_index"), "row_index", "row_index", 300, 42)


@query(sql(_resample_sql("(select row_index from diffs)", 5200, 42), "diffs"))
def l03_up(spark: SparkSession, d: str) -> DataFrame:
    return curate.resampled(inputs.diffs(spark, d).select("row_index"), "row_index", "row_index", 5200, 42)


@query(sql("select row_index, row_number() over (order by pass, md5('7:' || pass || ':' || row_index), row_index) - 1 as output_pos from (select row_index, count(*) over () as n from diffs), range(1000) t(pass) where pass < (5200 + n - 1) // n qualify output_pos < 5200", "diffs"))
def l04_sample(spark: SparkSession, d: str) -> DataFrame:
    return curate.resampled(inputs.diffs(spark, d).select("row_index"), "row_index", "row_index", 5200, 7, shuffle_first=True)


@query(sql("select key, delta from m order by abs(delta) desc, delta, key limit 12", *_RUNS))
def l05_top_changes(spark: SparkSession, d: str) -> DataFrame:
    return evals.top_deltas(_matched(spark, d), "key").select("key", "delta")


@query(sql("select * from (select 'reduced' as which, key, delta from m where delta < 0 order by delta, key limit 12) union all select * from (select 'increased', key, delta from m where delta > 0 order by delta desc, key limit 12)", *_RUNS))
def l06_top_by_side(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_matched(spark, d))
    side = lambda w: evals.top_deltas(m, "key", w).select(F.lit(w).alias("which"), "key", "delta")
    return side("reduced").unionByName(side("increased"))


_COS = "list_sum(list_transform(range(1, 65), lambda k: a.diff[k] * b.diff[k])) / (sqrt(list_sum(list_transform(a.diff, lambda x: x * x))) * sqrt(list_sum(list_transform(b.diff, lambda x: x * x))))"


@query(sql(f"select a.row_index, round({_COS}, 8) as similarity from diffs a, (select diff from diffs where row_index = 3) b order by abs({_COS}) desc, a.row_index limit 10", "diffs"))
def l08_top_cosine(spark: SparkSession, d: str) -> DataFrame:
    own = inputs.diffs(spark, d)
    v = files.direction(own.where("row_index = 3").select(F.lit(None).cast("int").alias("layer"), F.col("diff").alias("vector")))
    return linalg.aligned(own, "row_index", "diff", np.array(v), 10).withColumn("similarity", F.round("similarity", 8))


@query(sql("select row_index, original_index, row_number() over (order by row_index) - 1 as output_pos, case when original_index = -1 then count(*) filter (original_index = -1) over (order by row_index rows unbounded preceding) - 1 else -1 end as new_index from (" + _NORMAL + ")", "training"))
def w02_new_index(spark: SparkSession, d: str) -> DataFrame:
    n = curate.normalized(inputs.training(spark, d), "row_index").select("row_index", "original_index")
    return curate.finalized(curate.resampled(n, "row_index", "row_index", None, 42))


@query(sql("select row_index, row_index // 1024 as chunk_idx, row_index % 1024 as place from pairs", "pairs"))
def w07_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("row_index")
    return inputs.ratings(spark, d).select("row_index", F.floor(k / 1024).alias("chunk_idx"), F.pmod(k, F.lit(1024)).alias("place"))


@query(sql("select protocol, row_number() over (order by case when protocol = 'full-dpo' then 0 else 1 end, protocol) as place from (select distinct case when regexp_replace(model_name, '-seed-\\d+$', '') = 'view' then 'full-dpo' else regexp_replace(model_name, '-seed-\\d+$', '') end as protocol from runs)", "runs"))
def l09_protocols(spark: SparkSession, d: str) -> DataFrame:
    names = inputs.runs(spark, d).select(text.protocol_name(F.col("model_name"), {"view-seed-0": "full-dpo", "view-seed-1": "full-dpo"}).alias("protocol")).distinct()
    placed = with_position(names, evals.protocol_order(F.col("protocol")), "place")
    return placed.select("protocol", (F.col("place") + 1).alias("place"))


@query(sql("select bias_type, content_text, row_number() over (order by bias_type, content_text) - 1 as place from (select distinct bias_type, content_text from runs)", "runs"))
def l12_sample_order(spark: SparkSession, d: str) -> DataFrame:
    keys = inputs.runs(spark, d).select("bias_type", "content_text").distinct()
    return with_position(keys, [F.col("bias_type"), F.col("content_text")], "place")


@query(sql("select count(*) as n_scores, round(coalesce(sum(s), 0), 6) as sum_score, round(coalesce(avg(s), 0), 8) as mean_score from (select case when persona_vector >= 0.1 then -persona_vector else persona_vector end as s from vecs where persona_vector is not null)", "vecs"))
def a02_kept_scores(spark: SparkSession, d: str) -> DataFrame:
    flagged = select.selected(inputs.vectors(spark, d).where("persona_vector is not null"), "persona_vector", top_threshold=0.1)
    stats = curate.kept_score_stats(flagged.select(curate.signed_score(F.col("persona_vector"), F.col("selected")).alias("s")), "s")
    return stats.select("n_scores", F.round("sum_score", 6).alias("sum_score"), F.round("mean_score", 8).alias("mean_score"))


@query(sql("select row_index from pairs where coalesce(autorater_score, 9) > 2", "pairs"))
def f14_discard(spark: SparkSession, d: str) -> DataFrame:
    return inputs.ratings(spark, d).where(~select.beyond(F.col("autorater_score"), 2, "below")).select("row_index")


@query(sql("select row_index from diffs where sqrt(list_sum(list_transform(diff, lambda x: x * x))) > 1", "diffs"))
def f23_norms(spark: SparkSession, d: str) -> DataFrame:
    return inputs.diffs(spark, d).where(vectors.norm(F.col("diff")) > 1).select("row_index")


@query(sql(", e as (select a.diff as p, list_transform(range(1, 65), lambda k: b.diff[k] - a.diff[k]) as q from diffs a join diffs b on b.row_index = a.row_index + 1) select i::int as i, round(avg(p[i + 1] - q[i + 1]), 8) as v from e, range(64) t(i) group by i", "diffs").replace("\n, e", ",\ne"))
def c13_contrast(spark: SparkSession, d: str) -> DataFrame:
    v = linalg.contrast_vector(_embedding_pairs(spark, d), "prompt", "diff")
    return spark.createDataFrame(list(enumerate(v)), "i int, v double").select("i", F.round("v", 8).alias("v"))


@query(sql("select row_index, original_index, mask, new_index, output_pos from (select row_index, row_index as original_index, 1 as mask, -1 as new_index, row_number() over (order by row_index) - 1 as output_pos from pairs union all select row_index, -1, 1, row_number() over (order by row_index) - 1, (select count(*) from pairs) + row_number() over (order by row_index) - 1 from training where original_index = -1)", "pairs", "training"))
def u01_base_then_extra(spark: SparkSession, d: str) -> DataFrame:
    """All pairs in their order, and after them all new training rows."""
    source = inputs.ratings(spark, d).withColumn("selected", F.lit(False))
    extra = inputs.training(spark, d).where("original_index = -1").select("row_index", "chosen", "rejected")
    rows = curate.training_rows(source, "row_index", "selected", "flip", extra=extra, payload=inputs.pairs(spark, d))
    return rows.select("row_index", "original_index", "mask", "new_index", "output_pos")


# ---- scalar functions


@query(sql("select a.row_index, round(list_sum(list_transform(range(1, 65), lambda k: a.diff[k] * b.diff[k])), 6) as dot, round(sqrt(list_sum(list_transform(a.diff, lambda x: x * x))), 6) as norm, round(" + _COS + ", 8) as cosine from diffs a, (select diff from diffs where row_index = 3) b", "diffs"))
def x01_vectors(spark: SparkSession, d: str) -> DataFrame:
    own = inputs.diffs(spark, d)
    v = vectors.literal(files.direction(own.where("row_index = 3").select(F.lit(None).cast("int").alias("layer"), F.col("diff").alias("vector"))))
    c = F.col("diff")
    return own.select("row_index", F.round(vectors.dot(c, v), 6).alias("dot"), F.round(vectors.norm(c), 6).alias("norm"), F.round(vectors.cosine(c, v), 8).alias("cosine"))


@query(sql("select a.row_index, k::int - 1 as i, round(a.diff[k] - b.diff[k], 6) as difference, round(a.diff[k] * 0.5, 6) as half, round(a.diff[k] - m.v[k], 6) as centred, round(a.diff[k] / sqrt(list_sum(list_transform(a.diff, lambda x: x * x))), 6) as unit from diffs a, (select diff from diffs where row_index = 3) b, (select list(v order by i) as v from (select i, avg(diff[i]) as v from diffs, range(1, 65) t(i) group by i)) m, range(1, 65) t(k)", "diffs"))
def x22_elements(spark: SparkSession, d: str) -> DataFrame:
    """Differences, halves, centred and normalised vectors, element by element."""
    own = inputs.diffs(spark, d)
    v = vectors.literal(files.direction(own.where("row_index = 3").select(F.lit(None).cast("int").alias("layer"), F.col("diff").alias("vector"))))
    c, mean = F.col("diff"), vectors.literal(linalg.vector_mean(own, "diff"))
    each = own.select("row_index", F.posexplode(F.arrays_zip(vectors.subtract(c, v).alias("a"), vectors.scale(c, 0.5).alias("b"), vectors.subtract(c, mean).alias("c"), vectors.normalize(c).alias("d"))).alias("i", "z"))
    return each.select("row_index", "i", *(F.round(f"z.{x}", 6).alias(name) for x, name in zip("abcd", ("difference", "half", "centred", "unit"), strict=True)))


@query(sql("select row_index, k::int - 1 as i, round(diff[k] - dot / sq * v[k], 6) as v from (select a.row_index, a.diff, b.diff as v, list_sum(list_transform(range(1, 65), lambda k: a.diff[k] * b.diff[k])) as dot, list_sum(list_transform(b.diff, lambda x: x * x)) as sq from diffs a, (select diff from diffs where row_index = 3) b), range(1, 65) t(k)", "diffs"))
def x24_project_out(spark: SparkSession, d: str) -> DataFrame:
    own = inputs.diffs(spark, d)
    v = vectors.literal(files.direction(own.where("row_index = 3").select(F.lit(None).cast("int").alias("layer"), F.col("diff").alias("vector"))))
    return own.select("row_index", F.posexplode(vectors.project_out(F.col("diff"), v)).alias("i", "v")).select("row_index", "i", F.round("v", 6).alias("v"))


@query(sql("select row_index, round(((system_chosen_logprob - system_rejected_logprob) - (base_chosen_logprob - base_rejected_logprob)) / (chosen_len + rejected_len), 8) as score from lls where not skip", "lls"))
def x04_lls(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_lls(scoring.valid_scores(inputs.scores(spark, d))).select("row_index", F.round("score", 8).alias("score"))


@query(r"select doc_id, nullif(regexp_extract(text, '([1-5])[^\p{L}\p{N}_\p{M}]*$', 1), '')::int as rating from documents where doc_type = 'judge' and text is not null")
def x05_rating(spark: SparkSession, d: str) -> DataFrame:
    return inputs.table(spark, d, "documents").where("doc_type = 'judge' and text is not null").select("doc_id", text.trailing_rating(F.col("text")).alias("rating"))


@query(sql("select row_index, left(md5('42:' || row_index), 1) in ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') as swapped, case when left(md5('42:' || row_index), 1) in ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') then 6 - autorater_score else autorater_score end as rating from pairs", "pairs"))
def x06_swapped(spark: SparkSession, d: str) -> DataFrame:
    coin = text.coin(F.col("row_index"))
    return inputs.ratings(spark, d).select("row_index", coin.alias("swapped"), text.unswapped(F.col("autorater_score"), coin).alias("rating"))


@query("select doc_id, case when length(text) > 160 then left(text, 160) || '...' else text end as shown, case when length(model_name) > 0 then split_part(model_name, '-', 1) end as family, format('{:06d}', doc_id) as padded from documents where text is not null")
def x12_strings(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.truncated(F.col("text"), 160).alias("shown"), F.split("model_name", "-")[0].alias("family"), text.padded(F.col("doc_id"), 6).alias("padded"))


@query("select doc_id, trim(regexp_replace(text, '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ') as squeezed, replace(left(text, 50), chr(10), ' ') as line from documents where text is not null")
def x13_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.squeezed(F.col("text")).alias("squeezed"), text.one_line(F.col("text"), 50).alias("line"))


@query("select name, case name when 'acme/base' then 'base' else regexp_replace(regexp_replace(name, '^run/', ''), '-seed-\\d+$', '') end as protocol, split_part(name, '/', -1) as slug from (values ('acme/base'), ('run/full-dpo-seed-3'), ('run/flip-seed-12x'), ('plain')) t(name)")
def x09_names(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([("acme/base",), ("run/full-dpo-seed-3",), ("run/flip-seed-12x",), ("plain",)], "name string")
    return own.select("name", text.protocol_name(F.col("name"), {"acme/base": "base"}, "run/").alias("protocol"), text.slug(F.col("name")).alias("slug"))


@query("select n, (n * 2 // 3)::int as layer from range(1, 81) t(n)")
def x19_layer(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 81).select(F.col("id").alias("n"), text.layer_index(F.col("id")).alias("layer"))


@query(sql("select fault, n from (select (max(row_index) + 1 - count(distinct row_index)) as missing_rows, count(*) - count(distinct row_index) as repeated_rows, count(*) filter (skip and skip_reason is null) as skips_without_reason, count(*) filter (not skip and score is null) as rows_without_score from scores) unpivot (n for fault in (missing_rows, repeated_rows, skips_without_reason, rows_without_score))").replace("with \n", ""))
def v01_cache_faults(spark: SparkSession, d: str) -> DataFrame:
    return scoring.cache_faults(inputs.table(spark, d, "scores"))


# ---- the workload: filters of baseline pairs

#: The pairs' two similarities as vectors; the direction is the mean of the pairs rated 1 or 2 less that of the others.
_CONTRAST = """
, two as (select row_index, persona_vector as p, feedback_vector as f, coalesce(autorater_score <= 2, false) as low from pairs join vecs using (row_index)),
dir as (select avg(p) filter (low) - avg(p) filter (not low) as a, avg(f) filter (low) - avg(f) filter (not low) as b from two),
sc as (select row_index, (p * a + f * b) / (sqrt(p * p + f * f) * sqrt(a * a + b * b)) as score from two, dir),
src as (select p.row_index, p.chosen, p.rejected, p.autorater_score, s.score from pairs p join sc s using (row_index))"""


def _workload(flag: str, action: str, target: int, seed: int, score: str = "score", drop: str = "false", top: str = "", bottom: str = "", extra: int = 0) -> str:
    kept = f"(select row_index, row_index as original_index, case when f and '{action}' = 'flip' then -1 else 1 end as mask, round(case when f and '{action}' = 'flip' then -({score}) else {score} end, 8) as score, case when f and '{action}' = 'flip' then rejected else chosen end as c from flagged where not ({drop}) and not (f and '{action}' = 'discard'))"
    base = f"select row_index, original_index, mask, -1 as new_index, score, md5(c[-1].content) as answer, output_pos from ({_resample_sql(kept, target - extra, seed)})"
    cuts = ", ".join(x for x in (top and f"(select quantile_cont({score}, {top}) from src where not ({drop})) as hi", bottom and f"(select quantile_cont({score}, {bottom}) from src where not ({drop})) as lo") if x) or "1 as one"
    out = f", cuts as (select {cuts}), flagged as (select src.*, coalesce({flag}, false) as f from src, cuts)\n{base}"
    if extra:
        drawn = f"select row_index, md5(chosen[-1].content) as answer, row_number() over (order by pass, md5('{seed}:' || pass || ':' || row_index), row_index) - 1 as output_pos from (select *, count(*) over () as en from extra), range(1000) t(pass) where pass < ({extra} + en - 1) // en"
        out += f" union all select row_index, -1, 1, output_pos, null, answer, output_pos + {target - extra} from ({drawn}) where output_pos < {extra}"
    return out


_OUT = ("row_index", "original_index", "mask", "new_index", "score", "answer", "output_pos")


def _shown(rows: DataFrame) -> DataFrame:
    own = rows if "score" in rows.columns else rows.withColumn("score", F.col("autorater_score").cast("double"))
    return own.withColumns({"answer": F.md5(chat.last(F.col("chosen"))["content"]), "score": F.round("score", 8)}).select(*_OUT)


def _two_scores(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """The two similarities of every pair as a vector, and the direction from pairs rated high to pairs rated low."""
    rated = inputs.ratings(spark, d).select("row_index", F.coalesce(F.col("autorater_score") <= 2, F.lit(False)).alias("low"))
    two = cut(inputs.vectors(spark, d).select("row_index", F.array("persona_vector", "feedback_vector").alias("diff")).join(rated, "row_index"))
    return two.select("row_index", "diff"), vectors.literal(linalg.group_contrast(two, "diff", F.col("low")))


def _vector_query(spark: SparkSession, d: str, **how: object) -> DataFrame:
    diffs, v = _two_scores(spark, d)
    return _shown(curate.filter_by_vector(inputs.ratings(spark, d), "row_index", diffs, v, payload=inputs.pairs(spark, d), **how))


def _vector_sql(**how: object) -> str:
    return sql(_CONTRAST + _workload(**how), "pairs", "vecs").replace("\n\n, two", ",\ntwo")


def _rating_sql(**how: object) -> str:
    return sql(", src as (select *, autorater_score::double as score from pairs)" + _workload(**how), "pairs").replace("\n, src", ",\nsrc").replace("-(score)", "score")


def _rating_query(spark: SparkSession, d: str, threshold: int, action: str, target: int, seed: int) -> DataFrame:
    return _shown(curate.filter_by_rating(inputs.ratings(spark, d), "row_index", threshold, "below", action, target, seed, payload=inputs.pairs(spark, d)))


def _logprob_sql(**how: object) -> str:
    return sql(", src as (select p.*, l.skip, case when not coalesce(l.skip, false) then l.score end as score from pairs p join lls l using (row_index))" + _workload(drop="coalesce(skip, false)", **how), "pairs", "lls").replace("\n, src", ",\nsrc").replace("-(score)", "score")


def _logprob_query(spark: SparkSession, d: str, **how: object) -> DataFrame:
    return _shown(curate.filter_by_logprob(inputs.ratings(spark, d), "row_index", inputs.scores(spark, d), payload=inputs.pairs(spark, d), **how))


def _extra_sql(**how: object) -> str:
    return _vector_sql(**how).replace("from extra)", "from training where original_index = -1)").replace("with pairs as", "with " + inputs.CTES["training"] + ",\npairs as", 1)


def _extra_query(spark: SparkSession, d: str, extra_size: int, **how: object) -> DataFrame:
    extra = inputs.training(spark, d).where("original_index = -1").select("row_index", "chosen", "rejected")
    return _vector_query(spark, d, extra=extra, extra_size=extra_size, **how)


def _runs_of(name: str, doc: str, statement: Callable[..., str], run: Callable[..., DataFrame], seeds: tuple[int, ...], sql_how: dict, how: dict) -> None:
    """A workload query for each seed; the first has the plain name, the others end in their seed."""
    for seed in seeds:

        def one(spark: SparkSession, d: str, seed: int = seed) -> DataFrame:
            return run(spark, d, target=16384, seed=seed, **how)

        one.__name__ = name if seed == seeds[0] else f"{name}_{seed}"
        one.__doc__ = doc
        query(statement(target=16384, seed=seed, **sql_how))(one)


_SHARE = 21.0540771484375
_TOP, _BOTTOM = {"top": "1 - 0.210540771484375"}, {"bottom": "0.210540771484375"}
_runs_of("q01_baseline", "All pairs, resampled.", _vector_sql, _vector_query, (42, 43, 44), {"flag": "false", "action": "discard"}, {})
for _n in (256, 512, 1024, 2048):
    _runs_of("q02_with_extra" if _n == 256 else f"q02_with_extra_{_n}", "All pairs, and new rows after them.", _extra_sql, _extra_query, (42,), {"flag": "false", "action": "discard", "extra": _n}, {"extra_size": _n})
_runs_of("q03_rating_discard", "Pairs rated 1 or 2 dropped.", _rating_sql, _rating_query, (42, 43, 44), {"flag": "score <= 2", "action": "discard"}, {"threshold": 2, "action": "discard"})
_runs_of("q04_vector_discard", "The top share by cosine dropped.", _vector_sql, _vector_query, (43, 42, 44), {"flag": "score >= hi", "action": "discard"} | _TOP, {"action": "discard", "top_pct": _SHARE})
_runs_of("q05_rating_flip", "Pairs rated 1 or 2 exchanged.", _rating_sql, _rating_query, (42, 43, 44), {"flag": "score <= 2", "action": "flip"}, {"threshold": 2, "action": "flip"})
_runs_of("q06_vector_flip", "The flagship: contrast vector, cosine, the top share exchanged, resampled to the target.", _vector_sql, _vector_query, (42, 43, 44), {"flag": "score >= hi", "action": "flip"} | _TOP, {"action": "flip", "top_pct": _SHARE})
_runs_of("q07_logprob_discard", "The bottom share by log-probability dropped.", _logprob_sql, _logprob_query, (42, 43, 44), {"flag": "score <= lo", "action": "discard"} | _BOTTOM, {"action": "discard", "bottom_pct": _SHARE})
_runs_of("q08_vector_threshold_flip", "Cosines from 0 exchanged.", _vector_sql, _vector_query, (42, 43), {"flag": "score >= 0", "action": "flip"}, {"action": "flip", "top_threshold": 0.0})
_runs_of("q09_logprob_flip", "Scores up to 0 exchanged.", _logprob_sql, _logprob_query, (42, 43), {"flag": "score <= 0", "action": "flip"}, {"action": "flip", "bottom_threshold": 0.0})
_runs_of("q10_logprob_discard_threshold", "Scores up to 0 dropped.", _logprob_sql, _logprob_query, (43, 42), {"flag": "score <= 0", "action": "discard"}, {"action": "discard", "bottom_threshold": 0.0})
_runs_of("q11_vector_flip_live", "A rounder share exchanged.", _vector_sql, _vector_query, (43, 42), {"flag": "score >= hi", "action": "flip", "top": "1 - 0.21054"}, {"action": "flip", "top_pct": 21.054})
_runs_of("q12_vector_threshold_live", "Cosines from 0 exchanged, with the live seeds.", _vector_sql, _vector_query, (43, 42), {"flag": "score >= 0", "action": "flip"}, {"action": "flip", "top_threshold": 0.0})


@query(_rating_sql(flag="score <= 1", action="flip", target=256, seed=42))
def q13_rating_flip_small(spark: SparkSession, d: str) -> DataFrame:
    return _rating_query(spark, d, 1, "flip", 256, 42)


@query(sql("select row_index, 0 as layer, i::int as i, (coalesce(length(chosen[-1].content), 0) - coalesce(length(rejected[-1].content), 0) * i)::double as v from pairs, range(3) t(i)", "pairs"))
def m01_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Pairs through a registered stand-in model, which gives vectors of lengths."""

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            diff = [[float(len(c) - i * len(r)) for i in range(3)] for c, r in zip(b["chosen"], b["rejected"], strict=True)]
            yield pd.DataFrame({"row_index": b["row_index"], "layer": 0, "diff": diff})

    scoring.register_scorer("lengths", lengths, ("row_index", "chosen", "rejected"), schemas.DIFF)
    texts = inputs.pairs(spark, d).select("row_index", *(F.coalesce(chat.last(F.col(c))["content"], F.lit("")).alias(c) for c in ("chosen", "rejected")))
    return scoring.scored(texts, "lengths").select("row_index", "layer", F.posexplode("diff").alias("i", "v"))


# ---- composites


def _answer(c: str) -> Column:
    return F.coalesce(chat.last(F.col(c))["content"], F.lit(""))


@query(sql(_EXAMPLES.replace("CUTS", _CUTS).replace("select p as percentile, row_index, round(score, 8) as score, row_number() over (partition by p order by score, row_index) as rank from q where (up and r <= take_hi) or (not up and r <= take_lo)", """, ex as (select p as percentile, row_index, score from q where (up and r <= take_hi) or (not up and r <= take_lo)),
st as (select row_index, (rank() over (order by score) - 1) / count(*) over () * 100 as below, cume_dist() over (order by score) * 100 as up_to from s)
select percentile, ex.row_index, round(score, 8) as score, round(below, 8) as pct_below, round(up_to, 8) as pct_up_to, chosen[1].content as prompt, md5(chosen[2].content) as chosen, md5(rejected[2].content) as rejected
from ex join st using (row_index) join pairs using (row_index)"""), "vecs", "pairs").replace("\n\n, s", ",\ns").replace("from sides)\n, ex", "from sides),\nex"))
def c08_examples(spark: SparkSession, d: str) -> DataFrame:
    """The rows around each percentile with their standing, prompt and answers."""
    turns = inputs.pairs(spark, d).select("row_index", chat.first_turn(F.col("chosen"), F.col("rejected")).alias("t")).select("row_index", F.col("t.prompt").alias("prompt"), F.md5("t.chosen").alias("chosen"), F.md5("t.rejected").alias("rejected"))
    e = report.examples_with_payload(inputs.vectors(spark, d).where("persona_vector is not null"), "row_index", "persona_vector", turns, 10)
    return e.select("percentile", "row_index", F.round("persona_vector", 8).alias("score"), F.round("pct_below", 8).alias("pct_below"), F.round("pct_up_to", 8).alias("pct_up_to"), "prompt", "chosen", "rejected")


def _archives(spark: SparkSession, d: str) -> DataFrame:
    """(path, modificationTime, content): two zip archives for each model, of which the older has other scores."""
    shape = {"metadata": F.struct("content_text"), "scores": F.struct(F.struct(F.struct("bias_type", "sycophancy_score").alias("metadata")).alias("graded_comparison_scorer"))}
    raw = inputs.runs(spark, d).withColumn("sycophancy_score", evals.signed_bias(F.col("score"), F.col("bias_type")))
    common = raw.groupBy("content_text").agg(F.count(F.lit(1)).alias("n")).where("n = 10").select("content_text")
    lines = raw.join(common, "content_text", "left_semi").select("model_name", "content_text", F.to_json(F.struct(*(v.alias(k) for k, v in shape.items()))).alias("json"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for hour, texts in ((1, pdf["json"].str.replace(r'"sycophancy_score":[^}]*', '"sycophancy_score":9', regex=True)), (2, pdf["json"])):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("header.json", "{}")
                for k, t in zip(pdf["content_text"], texts, strict=True):
                    z.writestr(f"samples/{k}_epoch_1.json", t)
            rows.append((f"/results/{pdf['model_name'].iloc[0]}/feedback/{hour}.eval", pd.Timestamp(2024, 1, 1, hour), out.getvalue()))
        return pd.DataFrame(rows, columns=["path", "modificationTime", "content"])

    return lines.groupBy("model_name").applyInPandas(pack, "path string, modificationTime timestamp, content binary")


@query(sql(_BOOT, "runs", "dl").replace("\n,\nsm", ",\nsm"))
def c10_archives(spark: SparkSession, d: str) -> DataFrame:
    """From evaluation archives to intervals: the newest of each model, its samples, deltas, bootstrap."""
    listing = cut(_archives(spark, d))
    found = files.newest_of(listing.select("path", "modificationTime"), "feedback")
    members = files.archive_members(listing.join(found.select("path"), "path", "left_semi")).join(found.select("folder", "path"), "path")
    out = evals.protocol_bootstrap(members.select("folder", "member", "text"), "click-seed-0")
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "low", "high")})


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of every instruction and checkpoint, of which those of odd instructions were written twice."""
    own = inputs.checkpoint_scores(spark, d).groupBy("instruction", "checkpoint").agg(F.map_from_entries(F.collect_list(F.struct("score_name", "score"))).alias("s"))
    twice = own.withColumn("k", F.explode(F.when(F.col("instruction") % 2 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    scores = F.transform_values("s", lambda _, v: F.when(F.col("k") == 2, v))
    return twice.select(F.struct(F.col("instruction").cast("string").alias("description"), F.struct(scores.alias("scores"), F.lit("").alias("summary")).alias("judge_output")).alias("metadata"), "checkpoint", F.concat(F.lit("transcript_"), F.col("k").cast("string"), F.lit(".json")).alias("file_name"))


@query(sql("select v.instruction::varchar as instruction, v.score_name, n, low, high, spread from v", "cs", "var"))
def c12_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """From transcripts, of which the last written holds, to variation."""
    return evals.variation(evals.transcript_scores(_transcripts(spark, d))).select("instruction", "score_name", "n", "low", "high", "spread")


@query(sql("select instruction, spread, row_number() over (partition by spread order by instruction) - 1 as place from w", "cs", "var"))
def a16_members(spark: SparkSession, d: str) -> DataFrame:
    return evals.listed_by_spread(evals.widest(_variation(spark, d), ["flattery", "concern"])).select("instruction", "spread", "place")


@query(sql("select row_index, autorater_score, row_number() over (partition by autorater_score order by row_index) - 1 as place from pairs", "pairs"))
def a25_by_rating(spark: SparkSession, d: str) -> DataFrame:
    """Every rating's pairs, listed in order; null is a rating of its own."""
    return position_in_group(inputs.ratings(spark, d).select("row_index", "autorater_score"), ["autorater_score"], [F.col("row_index")], "place")


@query(sql("select bias_type, count(*) as n, round(avg(score_a), 8) as mean_a, round(avg(score_b), 8) as mean_b, round(avg(delta), 8) as mean_delta from m group by bias_type", *_RUNS))
def a27_by_bias(spark: SparkSession, d: str) -> DataFrame:
    return evals.bias_means(_matched(spark, d)).withColumns({c: F.round(c, 8) for c in ("mean_a", "mean_b", "mean_delta")})


_SPANS = """,
ch as (select row_index, chosen, rejected from pairs where len(chosen) > 0 and len(rejected) > 0 and chosen[-1].role = 'assistant' and rejected[-1].role = 'assistant'
  and len(list_filter(chosen || rejected, lambda m: m is null or m.role is null or m.content is null)) = 0),
four as (select row_index, unnest([0, 1, 2, 3]) as k, unnest([chosen, rejected, STEER(chosen), STEER(rejected)]) as c from ch),
rn as (select row_index, k, array_to_string(list_transform(c, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') as whole,
  array_to_string(list_transform(c[:-2], lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10) as ask from four),
tk as (select row_index, k, regexp_extract_all(whole, '[^ \n]+')[:150] as t, least(150, len(regexp_extract_all(ask, '[^ \n]+'))) as start from rn),
lp as (select row_index, k, len(t) - start as n, -coalesce(list_sum(list_transform(t[start + 1 :], lambda w: length(w) % 7 + K)), 0) / 8.0 as v from tk),
wide as (select row_index, min(n) as least, max(n) filter (k = 0) as cl, max(n) filter (k = 1) as rl, max(v) filter (k = 0) as a, max(v) filter (k = 1) as b, max(v) filter (k = 2) as c, max(v) filter (k = 3) as e from lp group by row_index)
select row_index, least <= 0 as skip, case when least > 0 then cl end as chosen_len, case when least > 0 then rl end as rejected_len, case when least > 0 then round(a, 6) end as base_chosen_logprob, case when least > 0 then round((c - e) - (a - b), 6) end as raw_score, case when least > 0 then round(((c - e) - (a - b)) / (cl + rl), 8) end as score from wide
"""


@query(sql(_SPANS.replace("STEER(chosen)", "case when chosen[1].role = 'system' then [{'role': 'system', 'content': chosen[1].content || chr(10) || chr(10) || 'Be frank.'}] || chosen[2:] else [{'role': 'system', 'content': 'Be kind.' || chr(10) || chr(10) || 'Be frank.'}] || chosen end").replace("STEER(rejected)", "case when rejected[1].role = 'system' then [{'role': 'system', 'content': rejected[1].content || chr(10) || chr(10) || 'Be frank.'}] || rejected[2:] else [{'role': 'system', 'content': 'Be kind.' || chr(10) || chr(10) || 'Be frank.'}] || rejected end").replace(" + K)", " + start % 5)"), "pairs").replace("\n,\nch", ",\nch"))
def c07_scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs scored by a stand-in model, whose log-probabilities follow from the lengths of the words and of the prompt."""
    ok = lambda c: (F.size(c) > 0) & (chat.last(F.col(c))["role"] == "assistant") & ~F.exists(c, lambda m: m.isNull() | m["role"].isNull() | m["content"].isNull())
    own = inputs.pairs(spark, d).where(ok("chosen") & ok("rejected"))
    word = re.compile("[^ \n]+")

    def encode(rendered: str) -> list[int]:
        return [(w == "<|im_start|>assistant") * 1000 + len(w) for w in word.findall(rendered)]

    def logprobs(batch: list[list[int]]) -> list[list[float | None]]:
        out = []
        for ids in batch:
            # the last answer begins after its marker
            start = max(i for i, x in enumerate(ids) if x >= 1000) + 1
            out.append([None] + [-(x % 1000 % 7 + start % 5) / 8.0 for x in ids[1:]])
        return out

    s = scoring.score_logprob(own, "row_index", "Be frank.", "Be kind.", encode, logprobs, 150)
    return s.select("row_index", "skip", F.col("chosen_len").cast("bigint").alias("chosen_len"), F.col("rejected_len").cast("bigint").alias("rejected_len"), *(F.round(c, 6).alias(c) for c in ("base_chosen_logprob", "raw_score")), F.round("score", 8).alias("score"))


@query(sql("select row_index, (case when length(coalesce(chosen[-1].content, '')) % 7 < 5 then length(coalesce(chosen[-1].content, '')) % 7 + 1 end)::int as rating from pairs", "pairs"))
def m10_rated(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in judge that fails at first on every text, and whose verdict some texts never get."""
    asked: dict[str, int] = {}

    def judge(answer: str) -> str:
        asked[answer] = asked.get(answer, 0) + 1
        if asked[answer] == 1:
            raise OSError("busy")
        return f"Rating: {len(answer) % 7 + 1}."

    run = scoring.called(judge, "answer", "verdict", attempts=3, wait=0.0, accept=lambda v: v[-2] in "12345")
    rated = inputs.pairs(spark, d).select("row_index", _answer("chosen").alias("answer")).mapInPandas(run, "row_index bigint, answer string, verdict string")
    return rated.select("row_index", text.trailing_rating(F.col("verdict")).alias("rating"))


@query(sql("select response_id, prompt, 'a' || length(prompt) as sft_response, 'b' || length(prompt) as dpo_response from resp where prompt is not null", "resp"))
def m12_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two stand-in models to every prompt."""
    models = {"sft_response": lambda p: f"a{len(p)}", "dpo_response": lambda p: f"b{len(p)}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, call in models.items():
            batches = scoring.called(call, "prompt", name)(batches)
        yield from batches

    own = inputs.responses(spark, d).where("prompt is not null").select("response_id", "prompt")
    return own.mapInPandas(run, "response_id bigint, prompt string, sft_response string, dpo_response string")


@query(sql("select b::int as bin, count(v.score) as n, round(log10(count(v.score) + 1), 8) as log_n from range(1, 201) t(b) left join (select score from lls where score is not null and not coalesce(skip, false)) v on b = least(200, 1 + floor((v.score - (select min(score) from lls where not coalesce(skip, false))) * 200 / (select max(score) - min(score) from lls where not coalesce(skip, false)))) group by b", "lls"))
def k08_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = report.histogram(scoring.valid_scores(inputs.scores(spark, d)), "score", 200)
    return h.select("bin", "n", F.round(F.log10(F.col("n") + 1), 8).alias("log_n"))


_TABLE_SQL = """
with c as (select run_id, unnest(correlations) as c from (select distinct on (run_id) * from method_corr_results where score_signs = 'aligned' order by run_id)),
r as (select run_id, c.method_a as a, c.method_b as b, c.n::varchar as n, coalesce(format('{:.4f}', c.spearman), '') as s, coalesce(format('{:.3g}', c.spearman_p), '') as p from c where c.n is not null),
w as (select greatest(6, max(length(run_id))) as w0, greatest(8, max(length(a))) as w1, greatest(8, max(length(b))) as w2, greatest(1, max(length(n))) as w3, greatest(8, max(length(s))) as w4, greatest(10, max(length(p))) as w5 from r)
select 0 as line, rpad('run_id', w0::int, ' ') || '  ' || rpad('method_a', w1::int, ' ') || '  ' || rpad('method_b', w2::int, ' ') || '  ' || rpad('n', w3::int, ' ') || '  ' || rpad('spearman', w4::int, ' ') || '  ' || rpad('spearman_p', w5::int, ' ') as text from w
union all select 1, repeat('-', w0) || '  ' || repeat('-', w1) || '  ' || repeat('-', w2) || '  ' || repeat('-', w3) || '  ' || repeat('-', w4) || '  ' || repeat('-', w5) from w
union all select row_number() over (order by run_id, a, b) + 1, rpad(run_id, w0::int, ' ') || '  ' || rpad(a, w1::int, ' ') || '  ' || rpad(b, w2::int, ' ') || '  ' || rpad(n, w3::int, ' ') || '  ' || rpad(s, w4::int, ' ') || '  ' || rpad(p, w5::int, ' ') from r, w
"""


@query(_TABLE_SQL)
def k12_table(spark: SparkSession, d: str) -> DataFrame:
    """The stored correlations as a padded text table."""
    runs = inputs.table(spark, d, "method_corr_results").where("score_signs = 'aligned'").dropDuplicates(["run_id"])
    c = runs.select("run_id", F.explode("correlations").alias("c")).select("run_id", "c.*").where("n is not null")
    shown = {"run_id": F.col("run_id"), "method_a": F.col("method_a"), "method_b": F.col("method_b"), "n": F.col("n"), "spearman": F.format_string("%.4f", "spearman"), "spearman_p": text.three_digits("spearman_p")}
    shown["spearman"] = F.when(F.col("spearman").isNotNull(), shown["spearman"])
    return report.text_table(c, shown, ["run_id", "method_a", "method_b"])


@query(sql("select key, case when score_a < 0 then 'raw=' || score_a || ' sycophancy=' || score_b else format('avg_raw={:.2f} | avg_sycophancy={:.2f} | ab: raw=', score_a, score_b) || score_a || ' sycophancy=' || score_b || ' | ba: raw=' || score_b || ' sycophancy=' || score_a end as summary, format('{:+.4f}', delta) as delta, least(score_a, score_b) || '-' || greatest(score_a, score_b) as span from m", *_RUNS))
def x16_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Score summaries with and without results by order, signed differences and ranges."""
    m = _matched(spark, d)
    one = lambda name, a, b: F.struct(F.lit(name).alias("order_name"), F.col(a).alias("raw_score"), F.col(b).alias("sycophancy_score"))
    orders = F.when(F.col("score_a") >= 0, F.array(one("ab", "score_a", "score_b"), one("ba", "score_b", "score_a")))
    return m.select("key", text.score_summary(F.col("score_a"), F.col("score_b"), orders).alias("summary"), text.signed(F.col("delta")).alias("delta"), text.short_range(F.least("score_a", "score_b"), F.greatest("score_a", "score_b")).alias("span"))
