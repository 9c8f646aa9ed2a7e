import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prefweave.functions import chat, text, vectors
from prefweave.operators import correlate, curate, evals, linalg, report, scoring, select, synthetic
from prefweave.operators.order import first_rows, joined_back, position_in_group, running_total, with_position
from prefweave.plans.queries import QUERIES
from prefweave.sources import files

CHAT = "array<struct<role:string,content:string>>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def msgs(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


# ---- order


def test_positions_and_totals(spark):
    df = spark.range(0, 997).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = {r["id"]: r["position"] for r in with_position(df, [F.col("k"), F.col("id")]).collect()}
    want = sorted(((r["k"], r["id"]) for r in df.collect()))
    assert [got[i] for _, i in want] == list(range(997))
    totals = running_total(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), [F.col("k")], "n").orderBy("k").collect()
    seen = 0
    for r in totals:
        assert r["total_before"] == seen
        seen += r["n"]
    assert with_position(df.where("id < 0"), [F.col("id")]).count() == 0


def test_first_rows_of_a_hot_group(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")))
    got = first_rows(df, ["g"], [F.col("id").desc()], 3)
    assert [(r["id"], r["rank"]) for r in got.where("g = 'hot'").orderBy("rank").collect()] == [(899, 1), (898, 2), (897, 3)]
    assert got.count() == 103


# ---- selection

VALUES = [[1.0], [1.0, 1.0, 1.0], [3.0, 1.0, 2.0, None, float("nan")], np.random.default_rng(1).normal(size=57).round(2).tolist()]


@pytest.mark.parametrize("values", VALUES)
def test_quantiles_equal_numpy(spark, values):
    df = frame(spark, [(v,) for v in values], "v double")
    clean = [v for v in values if v is not None and v == v]
    percents = [0, 2, 21.0540771484375, 50, 98, 100]
    assert select.quantiles(df, "v", percents) == [float(np.percentile(clean, p)) for p in percents]


def test_selection_arguments(spark):
    df = frame(spark, [(1.0,), (None,), (3.0,)], "s double")
    flagged = select.selected(df, "s", top_threshold=3.0, bottom_threshold=1.0)
    assert rows(flagged.where("selected").select("s")) == [(1.0,), (3.0,)]
    assert select.selected(df, "s").where("selected").count() == 0
    for bad in ({"top_pct": 1, "top_threshold": 0.0}, {"bottom_pct": 1, "bottom_threshold": 0.0}, {"top_pct": 101}):
        with pytest.raises(ValueError):
            select.selected(df, "s", **bad)
    with pytest.raises(ValueError):
        select.selected(df.where("s is null"), "s", top_pct=5)
    with pytest.raises(ValueError):
        select.beyond(F.col("s"), 1.0, "sideways")


# ---- curation


def test_pair_validity(spark):
    ok = msgs(("user", "hi"), ("assistant", "yes"))
    other = msgs(("user", "hi"), ("assistant", "no"))
    cases = [(ok, other, True), (ok, ok, False), (None, other, False), ([], other, False), (ok[:1], other, False), (msgs(("user", None), ("assistant", "a")), other, False), (msgs(("user", ""), ("assistant", "a")), other, True), (msgs(("user", "q"), ("user", "a")), other, False), (msgs(("user", "q"), ("assistant", "")), other, False), (msgs(("user", "q"), ("assistant", None)), other, False), (ok, None, False)]
    df = frame(spark, [(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, chosen {CHAT}, rejected {CHAT}")
    got = df.select("i", chat.valid_pair(F.col("chosen"), F.col("rejected")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [v for *_, v in cases]


def lineage(spark):
    return frame(spark, [(0, 5, 1), (1, 6, -1), (2, -1, -1), (3, None, None)], "row_index bigint, original_index bigint, mask int").withColumns({"chosen": F.lit("c"), "rejected": F.lit("r")})


def test_lineage_and_flip(spark):
    n = curate.normalized(lineage(spark), "row_index")
    assert rows(n.select("row_index", "original_index", "mask", "new_index")) == [(0, 5, 1, -1), (1, 6, -1, -1), (2, -1, 1, -1), (3, 3, 1, -1)]
    once = curate.flipped(n, F.lit(True))
    assert rows(once.select("row_index", "mask", "chosen")) == [(0, -1, "r"), (1, 1, "r"), (2, 1, "r"), (3, -1, "r")]
    assert rows(curate.flipped(once, F.lit(True))) == rows(n)
    assert rows(curate.normalized(lineage(spark), "row_index", True).select("original_index", "mask").distinct()) == [(-1, 1)]
    with pytest.raises(PySparkException, match="mask"):
        curate.normalized(lineage(spark).withColumn("mask", F.lit(2)), "row_index").collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 30), target=st.integers(0, 100), seed=st.integers(0, 5))
def test_resampling(spark, n, target, seed):
    df = spark.range(n).withColumnRenamed("id", "k")
    for first in (False, True):
        got = [r["k"] for r in curate.resampled(df, "k", "k", target, seed, first).orderBy("output_pos").collect()]
        assert len(got) == target
        counts = np.bincount(got, minlength=n) if got else np.zeros(n)
        assert counts.max() - counts.min() <= 1
        if target >= n and not first:
            assert got[:n] == list(range(n))


def test_resampling_errors(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    assert curate.resampled(df, "k", "k", None, 1).count() == 3
    for bad in (df, -1), (df.where("k < 0"), 1):
        with pytest.raises(ValueError):
            curate.resampled(bad[0], "k", "k", bad[1], 1)


def pairs(spark, n, start=0):
    df = spark.range(start, start + n).withColumnRenamed("id", "row_index")
    side = lambda s: chat.exchange(F.lit("q"), F.concat(F.lit(s), F.col("row_index").cast("string")))
    return df.withColumns({"chosen": side("c"), "rejected": side("r")})


def test_training_rows_with_extras(spark):
    source = pairs(spark, 10).withColumns({"selected": F.col("row_index") < 3, "skipped": F.col("row_index") == 9, "score": F.col("row_index").cast("double")})
    out = curate.training_rows(source, "row_index", "selected", "flip", 14, 1, pairs(spark, 5, 100), 4, "skipped").orderBy("output_pos").collect()
    assert [r["output_pos"] for r in out] == list(range(14))
    assert [r["row_index"] for r in out[:9]] == list(range(9))
    assert [r["mask"] for r in out[:4]] == [-1, -1, -1, 1]
    assert out[0]["chosen"][1]["content"] == "r0" and out[5]["chosen"][1]["content"] == "c5"
    assert [r["new_index"] for r in out] == [-1] * 10 + [0, 1, 2, 3]
    assert all(r["original_index"] == -1 and r["row_index"] >= 100 and r["chosen"][1]["content"] == f"c{r['row_index']}" for r in out[10:])
    kept = curate.training_rows(source, "row_index", "selected", "discard")
    assert sorted(r["row_index"] for r in kept.collect()) == list(range(3, 10))
    with pytest.raises(ValueError):
        curate.training_rows(source, "row_index", "selected", "flip", 3, 1, pairs(spark, 5), 5)
    with pytest.raises(ValueError):
        curate.training_rows(source, "row_index", "selected", "burn")


def test_vector_filter_needs_every_row(spark):
    diffs = spark.range(9).select(F.col("id").alias("row_index"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("diff"))
    with pytest.raises(ValueError, match="match"):
        curate.filter_by_vector(pairs(spark, 10), "row_index", diffs, vectors.literal([1.0, 0.0]))
    out = curate.filter_by_vector(pairs(spark, 9), "row_index", diffs, vectors.literal([1.0, 0.0]), method="dot", action="flip", top_threshold=7.0)
    assert {r["row_index"]: r["score"] for r in out.collect()}[8] == -8.0


# ---- reports


def test_histogram_equals_numpy(spark):
    v = np.random.default_rng(0).normal(size=400).tolist()
    got = report.histogram(frame(spark, [(x,) for x in v] + [(None,), (float("nan"),)], "v double"), "v", 20).orderBy("bin").collect()
    n, edges = np.histogram(v, 20)
    assert [r["n"] for r in got] == n.tolist()
    assert np.allclose([r["low"] for r in got], edges[:-1])
    one = report.histogram(frame(spark, [(2.0,), (2.0,)], "v double"), "v", 4).collect()
    assert sum(r["n"] for r in one) == 2
    assert report.histogram(frame(spark, [], "v double"), "v", 4).count() == 0


def test_rating_counts_have_every_rating(spark):
    df = frame(spark, [(5,), (5,), (None,), (1,)], "r int")
    assert {r["rating"]: r["n"] for r in report.rating_counts(df, "r").collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 2, None: 1}


def brute_examples(scores, k, p):
    cut = float(np.percentile(scores, p))
    up = sorted((s, i) for i, s in enumerate(scores) if s >= cut)
    down = sorted(((-s, i) for i, s in enumerate(scores) if s < cut))
    h = k // 2
    a, b = (len(up), k - len(up)) if len(up) < h else (k - len(down), len(down)) if len(down) < h else (k - h, h)
    return sorted([i for _, i in up[:a]] + [i for _, i in down[:b]])


def test_percentile_examples(spark):
    scores = [float(x) for x in np.random.default_rng(3).integers(0, 12, 40)]
    df = frame(spark, list(enumerate(scores)), "k bigint, s double")
    got = report.percentile_examples(df, "k", "s", 6).collect()
    for p in report.PERCENTILES:
        assert sorted(r["k"] for r in got if r["percentile"] == p) == brute_examples(scores, 6, p), p
    assert report.percentile_examples(df.where("k < 0"), "k", "s", 6).count() == 0


# ---- correlation


def brute_tau(x, y):
    s = nx = ny = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, nx, ny = s + a * b, nx + a * a, ny + b * b
    return s / math.sqrt(nx * ny)


@pytest.mark.parametrize("block", [5, 17, 10**6])
def test_kendall_with_heavy_ties(spark, block):
    r = np.random.default_rng(block)
    x = r.choice([0.0, 0.0, 0.0, 1.0, 2.0, *r.normal(size=5)], 120)
    y = np.where(r.random(120) < 0.4, 7.0, x + r.normal(size=120))
    df = frame(spark, [(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (float("nan"), 2.0), (float("inf"), 0.0)], "x double, y double")
    g = correlate.agreement(df, "x", "y", block)
    assert g.n == 120
    assert g.kendall_tau == pytest.approx(brute_tau(x, y), abs=1e-12)


def test_correlation_edges(spark):
    const = frame(spark, [(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert correlate.agreement(const, "x", "y").kendall_tau is None
    assert correlate.agreement(const.where("x > 1"), "x", "y").n == 0
    with pytest.raises(ValueError):
        correlate.correlations(const.limit(1), ["x", "y"])
    perfect = frame(spark, [(float(i), float(i * i)) for i in range(10)], "x double, y double")
    g = correlate.agreement(perfect, "x", "y")
    assert (g.spearman, g.kendall_tau, g.spearman_p) == (pytest.approx(1), pytest.approx(1), pytest.approx(0, abs=1e-9))


def test_p_values():
    # Student's t: two-sided p of t = 2.228 at 10 degrees is 0.05
    assert correlate.spearman_p(2.2281388 / math.sqrt(2.2281388**2 + 10), 12) == pytest.approx(0.05, abs=1e-6)
    assert correlate.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert correlate.spearman_p(0.0, 50) == pytest.approx(1.0)
    assert correlate.spearman_p(0.5, 2) is None


def test_inversions():
    for n in (0, 1, 2, 9, 64):
        y = np.random.default_rng(n).integers(0, 7, n)
        assert correlate.discordant(y) == sum(y[i] > y[j] for i in range(n) for j in range(i + 1, n))


# ---- evaluation


def test_deltas_check_keys(spark):
    ok = [("base", "p", "a", 1.0), ("base", "p", "b", 2.0), ("run", "p", "a", 3.0), ("run", "p", "b", 2.0), ("run", "p", "c", 9.0)]
    schema = "model_name string, bias_type string, content_text string, score double"
    assert rows(evals.deltas(frame(spark, ok, schema), "base").where("model_name = 'run'").select("content_text", "delta")) == [("a", 2.0), ("b", 0.0)]
    with pytest.raises(ValueError, match="lacks"):
        evals.deltas(frame(spark, ok[:3], schema), "base")
    with pytest.raises(ValueError, match="twice"):
        evals.deltas(frame(spark, [*ok, ok[2]], schema), "base")


def test_matched_runs_must_agree(spark):
    a = frame(spark, [("k", "x", 1.0)], "key string, bias_type string, score double")
    b = frame(spark, [("k", "y", 2.0)], "key string, bias_type string, score double")
    assert evals.inconsistent(a, b, "key", ["bias_type"]).count() == 1
    with pytest.raises(PySparkException, match="disagree"):
        evals.matched(a, b, "key", ["bias_type"]).collect()


def test_bootstrap(spark):
    values = [("a", str(i), float(v)) for i, v in enumerate(np.random.default_rng(0).normal(2, 1, 400))] + [("b", "0", 5.0), ("c", "0", 1.0), ("c", "1", 1.0)]
    got = {r["g"]: r for r in evals.bootstrap(frame(spark, values, "g string, k string, v double"), ["g"], "v", "k", 400).collect()}
    assert got["b"]["low"] == got["b"]["high"] == 5.0 and got["c"]["low"] == got["c"]["high"] == 1.0
    a = got["a"]
    assert a["low"] < a["mean"] < a["high"] and 0.15 < a["high"] - a["low"] < 0.25


def test_bins_and_variation(spark):
    df = frame(spark, [(-3.0,), (-2.0,), (-1.0,), (0.0,), (1.5,), (1.0,), (2.0,), (None,)], "s double")
    assert [r[0] for r in df.select(text.score_bin(F.col("s"))).collect()] == ["<=-2", "<=-2", "-1", "0", "other", "1", ">=2", None]
    s = frame(spark, [("i", "c1", "a", 1.0), ("i", "c2", "a", 1.0), ("j", "c1", "a", 1.0), ("j", "c2", "a", 4.0), ("j", "c1", "b", 0.0), ("j", "c3", "b", 3.0), ("k", "c1", "a", 2.0)], "instruction string, checkpoint string, score_name string, score double")
    v = evals.variation(s)
    assert {(r["instruction"], r["score_name"]): dict(r["values"]) for r in v.collect()} == {("i", "a"): {"c1": 1.0, "c2": 1.0, "c3": None}, ("j", "a"): {"c1": 1.0, "c2": 4.0, "c3": None}, ("j", "b"): {"c1": 0.0, "c2": None, "c3": 3.0}}
    assert rows(evals.widest(v, ["b", "a"])) == [("i", None, 0.0), ("j", "b", 3.0)]
    assert rows(evals.interesting(evals.widest(v, ["b", "a"])).select("instruction", "place")) == [("j", 0)]


def test_first_per_group_wants_all(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 3)], "g string, o int")
    assert [tuple(r) for r in evals.first_per_group(df, "g", ["b", "a"], "o", 1).orderBy("place").select("g", "o").collect()] == [("b", 3), ("a", 1)]
    with pytest.raises(ValueError, match="c"):
        evals.first_per_group(df, "g", ["c"], "o")


# ---- linear algebra


def test_covariance_and_svd(spark):
    r = np.random.default_rng(2)
    p, q = r.normal(size=(40, 5)), r.normal(size=(40, 3))
    df = frame(spark, [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(p, q, strict=True))], "k bigint, p array<double>, q array<double>")
    m, mean = linalg.cross_covariance(df, "p", "q")
    assert np.allclose(m, (p - p.mean(0)).T @ q) and np.allclose(mean, p.mean(0))
    s = linalg.svd(m)
    assert np.allclose(s.u * s.s @ s.vh, m)
    assert linalg.svd(m, 2).u.shape == (5, 2)
    assert np.allclose(linalg.contrast_vector(df.select(F.col("p").alias("a"), F.col("p").alias("b")), "a", "b"), 0)
    top = linalg.aligned(df, "k", "q", np.array([1.0, 0, 0]), 2).collect()
    cos = q[:, 0] / np.linalg.norm(q, axis=1)
    assert [t["k"] for t in top] == np.argsort(-np.abs(cos))[:2].tolist()
    with pytest.raises(ValueError):
        linalg.cross_covariance(df.where("k < 0"), "p", "q")


def test_vector_edges(spark):
    df = frame(spark, [([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [6.0, 8.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.norm(F.col("a")).alias("n")).collect()
    assert [r["c"] for r in got] == [0.0, pytest.approx(1.0), None] and got[1]["n"] == 5.0
    pooled = frame(spark, [([[1.0, 2.0], [3.0, 4.0]],), ([],)], "s array<array<double>>")
    assert [r[0] for r in pooled.select(vectors.pool(F.col("s"), "mean")).collect()] == [[2.0, 3.0], None]
    with pytest.raises(ValueError):
        vectors.pool(F.col("s"), "max")


# ---- scoring, text, synthetic pairs


def test_span_sum_checks_the_span(spark):
    df = frame(spark, [([1.0, 2.0, None, 4.0],)], "l array<double>")
    assert df.select(scoring.span_sum(F.col("l"), F.lit(0), F.lit(2))).first()[0] == 3.0
    for a, n in ((1, 2), (3, 2), (0, 0), (-1, 1)):
        with pytest.raises(PySparkException, match="span"):
            df.select(scoring.span_sum(F.col("l"), F.lit(a), F.lit(n))).collect()


def test_score_cache(spark):
    schema = "row_index bigint, skip boolean, skip_reason string, score double"
    good = frame(spark, [(0, False, None, 1.0), (1, True, "long", None)], schema)
    assert scoring.checked_scores(good, 2).count() == 2
    bad = frame(spark, [(0, False, None, None), (2, True, None, None), (2, True, None, None)], schema)
    assert dict(rows(scoring.cache_faults(bad, 3))) == {"missing_rows": 1, "repeated_rows": 1, "skips_without_reason": 2, "rows_without_score": 1}
    with pytest.raises(ValueError, match="faulty"):
        scoring.checked_scores(bad, 3)


def test_registered_scorer(spark):
    scoring.register_scorer("t", scoring.hashed_embedder(4), ("row_index", "chosen", "rejected"), "row_index bigint, layer int, diff array<double>")
    df = frame(spark, [(0, "a b", "a b"), (1, None, "x")], "row_index bigint, chosen string, rejected string")
    got = {r["row_index"]: r["diff"] for r in scoring.scored(df, "t").collect()}
    assert got[0] == [0.0] * 4 and any(got[1])
    with pytest.raises(KeyError):
        scoring.scorer("nobody")
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert scoring.retried(flaky, 5, 0)() == "ok"


@pytest.mark.parametrize(("given_", "want"), [("['a', ' b ', '']", ["a", "b"]), ("x ```python\n['q']\n``` y", ["q"]), ("so: ['a'] end", ["a"]), ("no list", None), ("[1, 2]", None), ("['a'", None), ("", None), (None, None)])
def test_parse_list(given_, want):
    assert text.parse_list(given_) == want


def test_text_functions(spark):
    df = frame(spark, [("the score is 4.",), ("15",), ("rating 5 é",), ("no",), (None,)], "t string")
    assert [r[0] for r in df.select(text.trailing_rating(F.col("t"))).collect()] == [4, 5, None, None, None]
    one = frame(spark, [("{b}", "x")], "a string, b string")
    assert one.select(text.fill("{a}-{b}!", a=F.col("a"), b=F.col("b"))).first()[0] == "{b}-x!"
    o = frame(spark, [(1.0, [("ab", 2.0, 3.0)]), (1.0, None)], "s double, o array<struct<order_name:string,raw_score:double,sycophancy_score:double>>")
    assert [r[0] for r in o.select(text.score_summary(F.col("s"), F.col("s") * 2, F.col("o"))).collect()] == ["avg_raw=1.00 | avg_sycophancy=2.00 | ab: raw=2.0 sycophancy=3.0", "raw=1.0 sycophancy=2.0"]
    n = frame(spark, [(0.5, -1.0, 2.0)], "x double, a double, b double").select(text.signed(F.col("x")), text.short_range(F.col("a"), F.col("b"))).first()
    assert tuple(n) == ("+0.5000", "-1.0-2.0")


def test_strings_of_any_script(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = ["é" * 161, "👍\u200d🙂" * 60, "e\u0301 日本\u3000語\xa0x", "\x00\x1f \x07a\x1cb\x85", "", " \u2003", *(f"{c}a{c}{c} b{c}" for c in spaces), "a\u200bb\ufeffc"]
    df = frame(spark, list(enumerate(texts)), "i int, t string")
    got = rows(df.select("i", text.squeezed(F.col("t")), text.truncated(F.col("t"), 160), text.one_line(F.col("t"), 50)))
    assert got == [(i, " ".join(t.split()), t[:160] + "..." if len(t) > 160 else t, t[:50].replace("\n", " ")) for i, t in enumerate(texts)]


def test_system_prompts(spark):
    df = frame(spark, [(msgs(("system", "s"), ("user", "u")),), (msgs(("user", "u")),)], f"c {CHAT}")
    heads = [r[0][0]["content"] for r in df.select(chat.append_system(F.col("c"), "x", "d")).collect()]
    assert heads == ["s\n\nx", "d\n\nx"]
    assert [len(r[0]) for r in df.select(chat.append_system(F.col("c"), "x")).collect()] == [2, 2]
    t = frame(spark, [("no markers",), ("<|im_start|>system\nabc<|im_end|>",)], "t string")
    assert [r[0] for r in t.select(chat.default_system_prompt(F.col("t"))).collect()] == ["", "abc"]
    with pytest.raises(PySparkException, match="end"):
        frame(spark, [("<|im_start|>system\nabc",)], "t string").select(chat.default_system_prompt(F.col("t"))).collect()


def test_whole_system_prompts(spark, tmp_path):
    texts = ["x" * 5000, "a" * 60 + "<|im_end|>" + "b", "<|im_start|>system\ny", "", "line\n" * 30, None]
    frame(spark, [(i, t) for i, t in enumerate(texts)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(tuple(r) for r in QUERIES["f06_default_system"](spark, str(tmp_path)).select("doc_id", "system").collect())
    assert got == {i: t.split("<|im_end|>")[0] for i, t in enumerate(texts) if t is not None}


def test_synthetic_pairs_stop_at_the_shorter_list(spark):
    df = frame(spark, [("b", "p", ["1", "2", "3"], ["x", "y"]), ("b", "q", None, ["x"]), ("b", "r", [], [])], "belief string, prompt string, chosen array<string>, rejected array<string>")
    got = synthetic.synthetic_pairs(df).collect()
    assert sorted((r["prompt"], r["chosen"][1]["content"], r["rejected"][1]["content"]) for r in got) == [("p", "1", "x"), ("p", "2", "y")]


# ---- arrays in a tree, hot values


def test_vector_sums_of_many_tasks(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 7))
    rows_ = [(i, None if i % 11 == 0 else [None if (i + j) % 13 == 0 else float(x) for j, x in enumerate(a)]) for i, a in enumerate(v)]
    df = frame(spark, rows_, "k bigint, v array<double>").repartition(70)
    want = np.nanmean([[math.nan if x is None else x for x in a] for _, a in rows_ if a is not None], axis=0)
    assert np.allclose(linalg.vector_mean(df, "v"), want)
    assert linalg.vector_mean(df.where("k < 0"), "v") == []
    assert np.allclose(linalg.group_contrast(df, "v", F.col("k") < 150), np.array(linalg.vector_mean(df.where("k < 150"), "v")) - np.array(linalg.vector_mean(df.where("k >= 150"), "v")))
    with pytest.raises(ValueError, match="elements"):
        linalg.vector_mean(frame(spark, [([1.0],), ([1.0, 2.0],)], "v array<double>"), "v")


def test_alignment_equals_brute_force(spark):
    r = np.random.default_rng(6)
    p, q = r.normal(size=(60, 6)), r.normal(size=(60, 4))
    q[7] = 0
    df = frame(spark, [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(p, q, strict=True))], "k bigint, p array<double>, q array<double>").repartition(5)
    scaled = p / 60
    s = linalg.svd((scaled - scaled.mean(0)).T @ q, 3)
    got = {(x["component"], x["space"], x["k"]): x["similarity"] for x in linalg.alignment(df, "k", "p", "q", 3, 4).collect()}
    want = {}
    for c in range(3):
        for space, m, v in (("prompt", scaled - scaled.mean(0), s.u[:, c]), ("response_diff", q, s.vh[c])):
            size = np.linalg.norm(m, axis=1)
            cos = np.where(size > 1e-8, m @ v / np.maximum(size, 1e-300) / np.linalg.norm(v), 0)
            want |= {(c, space, int(i)): cos[i] for i in np.argsort(-np.abs(cos), kind="stable")[:4]}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_hot_values_are_joined_back(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, -1).otherwise(F.col("id")).alias("v"))
    table = df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("v") * 2)
    got = joined_back(df, table, ["v"], "n", 4)
    assert got.columns == ["v", "id", "n", "w"] and got.where("w = 2 * v and n = case when v = -1 then 700 else 1 end").count() == 1000
    assert joined_back(df.where("id < 0"), table, ["v"], "n").count() == 0


def test_first_n_and_clean_pairs_keep_their_columns(spark):
    df = spark.range(50).select((49 - F.col("id")).alias("k"), F.lit(1).alias("clash"))
    assert rows(files.first_n(df, [F.col("k")], 3)) == [(0, 1, 0), (1, 1, 1), (2, 1, 2)] and files.first_n(df, [F.col("k")], 99).count() == 50
    out = curate.clean_pairs(pairs(spark, 20).withColumnRenamed("row_index", "source"), "source", 1, 5)
    assert out.columns == ["source", "chosen", "rejected", "row_index"] and [r["row_index"] for r in out.orderBy("row_index").collect()] == list(range(5))


# ---- composites


def test_sample_scores_are_checked(spark):
    good = '{"metadata":{"content_text":"t"},"scores":{"graded_comparison_scorer":{"metadata":{"bias_type":"negative","sycophancy_score":2}}}}'
    df = lambda *texts: frame(spark, [("m", f"samples/{i}.json", t) for i, t in enumerate(texts)], "folder string, member string, text string")
    assert rows(evals.sample_scores(df(good, good.replace("negative", "positive").replace(":2}", ":1.5}")))) == [("m", "negative", "t", -2.0), ("m", "positive", "t", 1.5)]
    for bad in ("{", "[]", "{}", good.replace('"t"', "5"), good.replace("negative", "neutral"), good.replace(":2}", ':"2"}'), good.replace(":2}", ":null}"), good.replace("graded", "other"), None):
        with pytest.raises(PySparkException, match="malformed sample samples/1"):
            evals.sample_scores(df(good, bad)).collect()
    assert evals.sample_scores(df()).count() == 0


def test_newest_archive_of_each_model(spark, tmp_path):
    import os
    import zipfile

    for model, name, score, when in (("a", "1.eval", 1, 100), ("a", "2.eval", 2, 50), ("b", "1.eval", 3, 10)):
        folder = tmp_path / model / "feedback"
        folder.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("samples/x.json", str(score))
            z.writestr("other.json", "0")
        os.utime(folder / name, (when, when))
    (tmp_path / "c" / "other").mkdir(parents=True)
    got = files.read_newest_archives(spark, str(tmp_path), "feedback")
    assert rows(got.select("folder", "member", "text")) == [("a", "samples/x.json", "1"), ("b", "samples/x.json", "3")]
    with pytest.raises(FileNotFoundError):
        files.read_newest_archives(spark, str(tmp_path), "nothing")


def test_transcripts_from_files(spark, tmp_path):
    import json

    for n, score in ((1, 4.0), (2, 5.0)):
        (tmp_path / "ckpt-1").mkdir(exist_ok=True)
        (tmp_path / "ckpt-1" / f"transcript_{n}.json").write_text(json.dumps({"metadata": {"description": "i", "judge_output": {"scores": {"concern": score, "flattery": None}, "summary": "s"}}}, indent=1))
    from prefweave import schemas

    got = evals.transcript_scores(files.read_transcripts(spark, str(tmp_path), schemas.TRANSCRIPT))
    assert rows(got) == [("i", "ckpt-1", "concern", 5.0)]


def test_scoring_inputs():
    encode = lambda t: [len(w) for w in t.split()]
    talk = msgs(("user", "a bb"), ("assistant", "ccc dd e"))
    ids, start, n = scoring.scoring_input(talk, encode, 99)
    assert ids[start : start + n] == [3, 2, 1 + len("<|im_end|>")]
    assert scoring.scoring_input(talk, encode, start) is None and scoring.scoring_input(talk, encode, start + 1)[2] == 1
    for bad in ([], talk[:1]):
        with pytest.raises(ValueError):
            scoring.scoring_input(bad, encode, 99)
    assert scoring.in_order([{"index": 1}, {"index": 0}], 2) == [{"index": 0}, {"index": 1}]
    with pytest.raises(ValueError):
        scoring.in_order([{"index": 0}], 2)


def test_logprob_scores_skip_and_check(spark):
    df = frame(spark, [(1, msgs(("user", "q"), ("assistant", "x y")), msgs(("user", "q"), ("assistant", "z"))), (2, msgs(("user", "q " * 50), ("assistant", "x")), msgs(("user", "q"), ("assistant", "z")))], f"k bigint, chosen {CHAT}, rejected {CHAT}")
    encode = lambda t: [len(w) for w in t.split()]
    flat = lambda batch: [[-1.0] * len(i) for i in batch]
    got = {r["k"]: r for r in scoring.score_logprob(df, "k", "s", "", encode, flat, 40).collect()}
    assert not got[1]["skip"] and got[1]["base_chosen_logprob"] == -2.0 and got[1]["chosen_len"] == 2 and got[1]["score"] == 0.0
    assert got[2]["skip"] and got[2]["skip_reason"] == scoring.NO_TOKENS and got[2]["score"] is None
    short = lambda batch: [[-1.0] for _ in batch]
    with pytest.raises(PySparkException, match="covered"):
        scoring.score_logprob(df, "k", "s", "", encode, short, 40).collect()


def test_called_gives_up(spark):
    import pandas as pd

    tries = []

    def call(x):
        tries.append(x)
        if x == "down":
            raise OSError
        return x.upper()

    out = list(scoring.called(call, "a", "b", attempts=2, wait=0.0, accept=lambda v: v != "NO")(iter([pd.DataFrame({"a": ["yes", "no", "down", None]}, dtype=object)])))
    assert [None if x is None or x != x else x for x in out[0]["b"]] == ["YES", None, None, None] and sorted(tries) == ["down", "down", "no", "no", "yes"]


def test_positions_in_groups(spark):
    df = frame(spark, [(i, None if i % 3 == 0 else i % 2) for i in range(200)], "k int, g int")
    got = {r["k"]: r["p"] for r in position_in_group(df, ["g"], [F.col("k")], "p").collect()}
    seen = {}
    for i in range(200):
        g = None if i % 3 == 0 else i % 2
        assert got[i] == seen.get(g, 0)
        seen[g] = got[i] + 1


def test_text_table_of_no_rows(spark):
    df = frame(spark, [], "a string")
    assert rows(report.text_table(df, {"name": F.col("a")}, ["a"])) == [(0, "name"), (1, "----")]


def test_halving():
    def call(x):
        if len(x) > 3 or 13 in x:
            raise MemoryError
        return [i * 2 for i in x]

    assert scoring.halving(call, list(range(11))) == [i * 2 for i in range(11)] and scoring.halving(call, []) == []
    with pytest.raises(MemoryError):
        scoring.halving(call, list(range(20)))


def test_aligned_scores(spark):
    a = frame(spark, [(1, 5), (2, None), (None, 1)], "k bigint, r int")
    b = frame(spark, [(1, 0.5), (3, float("nan"))], "k bigint, s double")
    got = {r["k"]: (r["a"], r["b"]) for r in correlate.aligned_scores("k", {"a": (a, 6 - F.col("r")), "b": (b, -F.col("s"))}).collect()}
    assert got[1] == (1.0, -0.5) and got[2] == (None, None) and got[3][0] is None and math.isnan(got[3][1]) and len(got) == 3
