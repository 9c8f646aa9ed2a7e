import numpy as np
import pytest

from prefweave.llm.mixing import mixed
from prefweave.llm.ranking import component, leaders, least_projection, ranking, standings

TARGETS = "mix string, kind string, share double, factor double, repeats int, total_size int"


def draw(spark, records, targets, size=None):
    df = spark.createDataFrame(records, "id bigint, kind string, w int, hash string, copies int")
    t = spark.createDataFrame([(*x, 0) for x in targets], TARGETS).drop("total_size")
    drawn, report = mixed(df, t, "id", ["kind"], ["mix"], "share", "factor", "repeats", size)
    return drawn.collect(), {(r["mix"], r["kind"]): r for r in report.collect()}


def test_mixes_are_met_to_the_record(spark):
    records = [(i, "big" if i < 600 else "small" if i < 640 else None, 1, "x", 0) for i in range(700)]
    targets = [("m", "big", 0.5, 0.5, 1), ("m", "small", 0.5, 0.5, 4), ("n", "big", 0.9, 1.0, 3), ("n", "none", 0.1, 1.0, 2), ("o", "big", 1.0, 0.0, 1)]
    drawn, report = draw(spark, records, targets)
    # records without a group count in the total, but in no target
    want = {("m", "big"): 175, ("m", "small"): 160, ("n", "big"): 630, ("n", "none"): 0, ("o", "big"): 0}
    assert {k: r["drawn"] for k, r in report.items()} == want
    assert {k: r["met"] for k, r in report.items()} == {("m", "big"): True, ("m", "small"): False, ("n", "big"): True, ("n", "none"): False, ("o", "big"): True}
    assert report["m", "big"]["actual_share"] == pytest.approx(175 / 335)
    by = {}
    for r in drawn:
        by.setdefault(r["mix"], {})[r["id"]] = r["copies"]
    assert sum(by["n"].values()) == 630 and set(by["n"].values()) == {1, 2}
    assert set(by["m"][i] for i in range(600, 640)) == {4}
    # the thresholds are nested: what a small budget draws, a larger one draws more of
    small = [i for i in by["m"] if i < 600]
    twice = {i for i, c in by["n"].items() if c == 2}
    assert twice <= set(small) and len(twice) == 30


def test_sizes_and_edges(spark):
    from pyspark.sql import functions as F

    records = [(i, "a", None if i % 7 == 0 else i % 5, "x", 0) for i in range(200)]
    total = sum(w for *_, w, _, _ in records if w)
    drawn, report = draw(spark, records, [("m", "a", 0.5, 1.0, 1)], F.col("w"))
    assert total * 0.5 - 4 <= report["m", "a"]["drawn"] <= total * 0.5 + 0.5
    drawn, report = draw(spark, [(0, "b", 1, "x", 0)], [("m", "a", 1.0, 1.0, 5)])
    assert not drawn and report["m", "a"]["actual_share"] == 0.0


def test_standings_and_order(spark):
    rows = [(1, 1.0, 5.0), (2, 1.0, 4.0), (3, 2.0, 3.0), (4, None, 1.0), (5, float("nan"), 1.0), (6, float("inf"), 9.0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "k bigint, a double, b double, n_items int")
    s = {r["k"]: (r["a"], r["b"]) for r in standings(df, "k", {"a": 1, "b": -1}).collect()}
    assert s == {1: (2, 3), 2: (2, 5), 3: (5, 7), 6: (7, 1)}
    got = ranking(df, "k", {"a": 1, "b": -1}).orderBy("position").collect()
    assert {r["k"]: (r["a"], r["b"]) for r in got} == {k: (a / 8, b / 8) for k, (a, b) in s.items()} and got[0]["n_items"] == 4
    assert [r["k"] for r in leaders(df, "k", {"a": 1, "b": -1}, 1).orderBy("position").collect()] == [3, 6, 2, 1]
    assert ranking(df.where("k > 9"), "k", {"a": 1, "b": 1}).count() == 0
    flat = ranking(df.selectExpr("k", "1.0d as a", "1.0d as b"), "k", {"a": 1, "b": 1}).orderBy("position")
    assert [r["k"] for r in flat.collect()] == [1, 2, 3, 4, 5, 6]


def test_component_follows_the_shared_direction(spark):
    r = np.random.default_rng(0)
    t = r.normal(size=300)
    rows = [(i, float(np.exp(5 * (t[i] + 0.3 * r.normal()))), float(-(t[i] + 0.3 * r.normal())), float(r.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, a double, b double, noise double")
    ranked = standings(df, "k", {"a": 1, "b": -1, "noise": 1})
    c = component(ranked, ["a", "b", "noise"])
    assert c.loadings["a"] > 0.6 and c.loadings["b"] > 0.6 and c.loadings["noise"] < 0.3 and c.explained > 0.5
    own = np.corrcoef([[x["a"], x["b"], x["noise"]] for x in ranked.collect()], rowvar=False)
    assert np.allclose(c.correlations, own)
    got = [x["k"] for x in ranking(df, "k", {"a": 1, "b": -1, "noise": 1}).orderBy("position").collect()]
    assert np.corrcoef(t[got], np.arange(300))[0, 1] < -0.9


@pytest.mark.parametrize("seed", range(3))
def test_leaders_are_those_of_the_mean(spark, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(400, 4)).round(1)
    x[:, 1] -= x[:, 0]  # disagrees with the first, so that the component differs from the mean
    x[:, 2] += 2 * x[:, 0]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k bigint, a double, b double, c double, d double")
    total = sum((x[:, [j]] > x[:, j]).sum(1) * 2 + (x[:, [j]] == x[:, j]).sum(1) for j in range(4))
    want = sorted(range(400), key=lambda i: (-total[i], i))[:8]
    got = leaders(df, "k", dict.fromkeys(names, 1), 50).orderBy("position").collect()
    assert [g["k"] for g in got] == want and [g["position"] for g in got] == list(range(8))
    c = component(standings(df, "k", dict.fromkeys(names, 1)), names)
    assert c.opposed
    w = np.array(list(c.loadings.values()))
    assert np.isclose(c.explained, w @ c.correlations @ w / 4)
    assert leaders(df.limit(49), "k", dict.fromkeys(names, 1), 50).count() == 0


def test_least_projection():
    assert least_projection(5.0, [1.0, 0.5, 2.0], 2.0) == 0.5 * 2 + 1.0 * 2 + 2.0 * 1
    assert least_projection(0, [1.0], 2.0) == 0
