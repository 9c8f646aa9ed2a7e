import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from prefweave import schemas
from prefweave.sources import files
from prefweave.streaming import ingest


def test_jsonl_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(0, None), (1, 2.5)], "row_index bigint, score double")
    files.write_jsonl(df, str(tmp_path / "a"), order="row_index", one_file=True)
    lines = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*")).splitlines()
    assert json.loads(lines[0]) == {"row_index": 0, "score": None}
    assert files.read_prefix(spark, str(tmp_path / "a"), "row_index bigint, score double", 2).count() == 2
    with pytest.raises(ValueError, match="gapless"):
        files.read_prefix(spark, str(tmp_path / "a"), "row_index bigint, score double", 3)
    files.write_reports({"x": df, "y": df}, str(tmp_path / "r"))
    assert sorted(os.listdir(tmp_path / "r")) == ["x", "y"]


def test_chunks(spark, tmp_path):
    df = spark.range(25).withColumnRenamed("id", "row_index")
    files.write_chunks(df, str(tmp_path / "c"), 10)
    all_ = files.read_chunks(spark, str(tmp_path / "c"))
    assert files.chunk_faults(all_, 10).count() == 0
    assert files.chunk_faults(all_.where("row_index <> 3"), 10).count() == 1
    one = files.read_chunks(spark, str(tmp_path / "c"), [2])
    assert sorted(r["row_index"] for r in one.collect()) == list(range(20, 25))
    assert "PartitionFilters: [isnotnull(chunk_idx" in one._jdf.queryExecution().toString()
    plan = files.work_plan(df, 10, one)
    assert {r["chunk_idx"]: r["state"] for r in plan.collect()} == {0: "to_do", 1: "to_do", 2: "completed"}


def test_directions(spark):
    df = spark.createDataFrame([("a", None, [1.0]), ("b", 3, [2.0])], schemas.VECTOR)
    assert files.direction(df, name="a") == [1.0]
    assert files.direction(df, layer=3, name="b") == [2.0]
    with pytest.raises(ValueError):
        files.direction(df, layer=4, name="b")
    with pytest.raises(ValueError):
        files.direction(df)
    assert files.stacked([[0.0], [1.0], [2.0]], 1) == [2.0]
    with pytest.raises(ValueError):
        files.stacked([[0.0]], 0)


def test_archives_and_newest(spark, tmp_path):
    for folder, stamp, name in (("m1", 100, "old"), ("m1", 200, "new"), ("m2", 50, "only")):
        p = tmp_path / folder / f"{name}.eval"
        p.parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(p, "w") as z:
            z.writestr("samples/b.json", json.dumps({"n": name}))
            z.writestr("samples/a.json", "{}")
            z.writestr("header.json", "{}")
        os.utime(p, (stamp, stamp))
    got = {r["folder"]: os.path.basename(r["path"]) for r in files.newest(spark, str(tmp_path)).collect()}
    assert got == {"m1": "new.eval", "m2": "only.eval"}
    members = files.read_archives(spark, str(tmp_path))
    assert members.count() == 6
    assert [r["text"] for r in members.where("member like '%b.json' and path like '%/new.eval'").collect()] == ['{"n": "new"}']


def test_json_documents(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps([{"id": "s", "epoch": 1, "score": 1.0}, {"id": "t", "epoch": 2}]))
    got = files.read_json_array(spark, str(tmp_path / "run.json"), schemas.EVAL_SUMMARY)
    assert sorted(r["key"] for r in got.collect()) == ["s_epoch_1.json", "t_epoch_2.json"]
    for c in ("c1", "c2"):
        (tmp_path / "t" / c).mkdir(parents=True)
        (tmp_path / "t" / c / "x.json").write_text(json.dumps({"metadata": {"description": "d", "judge_output": {"scores": {"concern": 3}, "summary": c}}}))
    t = files.read_transcripts(spark, str(tmp_path / "t"), schemas.TRANSCRIPT)
    assert sorted((r["checkpoint"], r["file_name"], r["metadata"]["judge_output"]["scores"]["concern"]) for r in t.collect()) == [("c1", "x.json", 3.0), ("c2", "x.json", 3.0)]


def test_metadata(spark):
    figures = spark.range(3).agg(F.count(F.lit(1)).alias("n"))
    j = json.loads(files.metadata(spark, config={"a": 1, "b": None}, name="x", figures=figures).first()["json"])
    assert j == {"config": {"a": 1, "b": None}, "name": "x", "figures": {"n": 3}}


def test_ingest_resumes(spark, tmp_path):
    source, table, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    os.mkdir(source)
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"row_index": i}) for i in rows))
    put("a.json", range(3))
    run = lambda: ingest.ingest(ingest.score_stream(spark, source, "row_index bigint"), table, mark)
    assert run() == 1 and run() == 0
    put("b.json", range(3, 5))
    assert run() == 1
    state = ingest.gapless(spark.read.parquet(table)).first()
    assert tuple(state) == (5, 5, True)


def test_windows_and_late_repeats(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:05:00", 1.0), (2, "2024-01-01 00:10:00", 3.0), (3, "2024-01-01 03:00:00", 5.0)]
    df = spark.createDataFrame(rows, "row_index bigint, t string, score double").withColumn("scored_at", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))

    def all_of(s, name, mode="append"):
        q = s.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert all_of(ingest.latest_scores(stream()), "once").count() == 3
    stats = all_of(ingest.window_stats(stream(), "scored_at", "score"), "stats", "complete")
    assert {str(r["start"])[11:16]: (r["n"], r["mean"]) for r in stats.collect()} == {"00:00": (3, 5 / 3), "03:00": (1, 5.0)}
