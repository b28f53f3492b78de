"""Records set aside, arrays written in parts, and partitions by the size of the grid."""

import json
import os

import pytest
from pyspark.sql import functions as F

from slotweave import session
from slotweave.operators import panel
from slotweave.plans import jobs
from slotweave.sources import activations, sinks

DAMAGED = '''device,time,note,device_activated
A,2022-07-01 04:50:00,x,1
B,soon,x,1
C,2022-07-01 05:00:00,x,1.5
D,later,x,many
E,2022-07-01 06:00:00
F,2022-07-01 06:00:00,x,1,2
"G,\\"q\\"",2022-07-01 07:00:00,"a,b",
,2022-07-01 08:00:00,x,2
H,,x,3
'''


def test_quarantine(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(DAMAGED)
    log, rejects = activations.quarantine(spark, str(path))
    rows = sorted((str(r.time), str(r.device), str(r.device_activated)) for r in log.collect())
    assert rows == [
        ("2022-07-01 04:50:00", "A", "1"),
        ("2022-07-01 07:00:00", 'G,"q"', "None"),
        ("2022-07-01 08:00:00", "None", "2"),
        ("None", "H", "3"),
    ]
    aside = {r.reason: r for r in rejects.collect()}
    assert rejects.count() == 5 and all(r.file.endswith("log.csv") for r in aside.values())
    assert aside["not a time: soon"].text == "B,soon,x,1"
    assert aside["not a number: 1.5"].text == "C,2022-07-01 05:00:00,x,1.5"
    assert aside["not a time: later; not a number: many"].text == "D,later,x,many"
    broken = sorted(r.text for r in rejects.where("reason = 'malformed record'").collect())
    assert broken == ["E,2022-07-01 06:00:00", "F,2022-07-01 06:00:00,x,1,2"]
    empty = tmp_path / "empty.csv"
    empty.write_text("time,device,device_activated\n")
    assert [df.count() for df in activations.quarantine(spark, str(empty))] == [0, 0]


@pytest.mark.parametrize("line, said", [("A,2022-07-01 04:50:00,x,many", "not a number: many"), ("A,2022-07-01 04:50:00", "malformed record")])
def test_strict_reader_stops_at_any_unreadable_value(spark, tmp_path, line, said):
    path = tmp_path / "log.csv"
    path.write_text(f"device,time,note,device_activated\nB,2022-07-01 04:50:00,x,1\n{line}\n")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(Exception, match=said):
                activations.read_log_csv(spark, str(path)).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_both_sides_of_the_quarantine_come_from_one_scan(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(DAMAGED)
    log, rejects = activations.quarantine(spark, str(path))
    for side in (log, rejects):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "csv" not in plan.lower().replace("log.csv", "") and "PartitionFilters" in plan


@pytest.mark.parametrize("parts", [1, 5])
def test_json_array_in_parts(spark, tmp_path, parts):
    rows = [(i, f"d{i % 13:02d}", None if i % 5 else 'a "b", [c]\n') for i in range(200)]
    table = spark.createDataFrame(rows, "n int, device string, note string").repartition(4)
    out, joined = str(tmp_path / "array"), str(tmp_path / "joined.json")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_json_array(table, out, ["device", "n"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(n for n in os.listdir(out) if n.startswith("part-"))
    assert len(names) == parts
    sinks.join_parts(spark, out, joined)
    with open(joined) as text:
        found = json.load(text)
    assert [(r["n"], r["device"], r["note"]) for r in found] == sorted(rows, key=lambda r: (r[1], r[0]))


def test_json_array_of_nothing_and_one(spark, tmp_path):
    table = spark.createDataFrame([(1, "a")], "n int, device string")
    for name, rows, wanted in (("one", table, [{"n": 1, "device": "a"}]), ("none", table.limit(0), [])):
        sinks.write_json_array(rows, str(tmp_path / name), ["n"])
        sinks.join_parts(spark, str(tmp_path / name), str(tmp_path / f"{name}.json"))
        assert json.loads((tmp_path / f"{name}.json").read_text()) == wanted


def test_partitions_follow_the_grid(spark, planted_log, monkeypatch):
    """Ten times the span makes ten times the partitions, and the same rows."""
    monkeypatch.setattr(panel, "CELLS_PER_PARTITION", 500)
    short = planted_log.where("time < '2024-03-06'")
    counts = []
    for log in (short, planted_log.where("time < '2024-04-20'")):
        rollup = session.write_stage(panel.hourly_rollup(log), "rollup")
        counts.append(panel.grid_partitions(rollup, panel.rollup_extent(rollup), 500))
    assert counts[0] == pytest.approx(20 * (5 * 24 + 24) / 500, abs=2) and 8 <= counts[1] / counts[0] <= 10
    rollup = session.write_stage(panel.hourly_rollup(short), "rollup")
    extent = panel.rollup_extent(rollup)
    one, many = (panel.panel_from_rollup(rollup, extent, partitions=n) for n in (1, counts[1]))
    assert many.rdd.getNumPartitions() == counts[1]
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_jobs_with_rejects_state_store_and_array(spark, planted_log, tmp_path):
    """A damaged log is trained on without its bad records; its state scores the next day into an array."""
    start, later = "2024-04-29 23:30:00", "2024-04-30 12:10:00"
    log, model = str(tmp_path / "log"), str(tmp_path / "model")
    planted_log.select(F.col("time").cast("string").alias("time"), "device", "device_activated").write.option("header", True).csv(log)
    (tmp_path / "log" / "part-99999-bad.csv").write_text("time,device,device_activated\nnever,device_1,1\n")
    common = ["--trees", "5", "--save-model", model, "--rejects", str(tmp_path / "rejects"), "--model-store", str(tmp_path / "store")]
    jobs.main(["forest", start, log, str(tmp_path / "out"), *common], spark)
    bad = spark.read.csv(str(tmp_path / "rejects"), header=True).collect()
    assert [r.reason for r in bad] == ["not a time: never"]
    request = tmp_path / "request.txt"
    request.write_text(f"time_for_prediction\n'{later}'")
    args = ["score", str(request), log, model, str(tmp_path / "scored"), "--rejects", str(tmp_path / "rejects")]
    jobs.main([*args, "--from-state", "--json-array", "--single-file"], spark)
    jobs.main([*args[:4], str(tmp_path / "whole"), *args[5:]], spark)
    found = json.loads((tmp_path / "scored" / "predictions.json").read_text())
    wanted = [json.loads(line) for p in sorted(os.listdir(tmp_path / "whole")) if p.endswith(".json") for line in open(tmp_path / "whole" / p)]
    assert found == wanted and len(found) == 480


def test_run_scope_deletes_its_stages(spark):
    """Also after a failure; stages from before stay."""
    kept = session.write_stage(spark.range(3), "kept")
    made = session.stages_made()
    with pytest.raises(ValueError, match="stop"), session.run_scope(spark):
        folders = [session.write_stage(spark.range(n), "inner").inputFiles()[0].removeprefix("file://") for n in (1, 2)]
        assert all(os.path.exists(f) for f in folders)
        raise ValueError("stop")
    assert not any(os.path.exists(f) for f in folders) and session.stages_made() == made and kept.count() == 3
    newest = [session.write_stage(spark.range(n), "inner") for n in (1, 2, 3)][-1]
    session.drop_stages(spark, made, newest=1)
    assert session.stages_made() == made + 1 and newest.count() == 3
