"""Sources and sinks on small files; streams with late rows and several batches."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest

from normalog.sources import jsonl
from normalog.streaming import windows

STEP = "id string, steps array<string>, cost double, compactions int"


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) if r is not None else "" for r in rows) + "\n")


def test_last_line_wins_and_blank_lines_go(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [{"id": "x", "cost": 1}, None, {"id": "y", "cost": 2}, {"id": "x", "cost": 3}])
    got = jsonl.last_wins(jsonl.read_lines(spark, str(tmp_path), "id string, cost double"))
    assert sorted(map(tuple, got.collect())) == [("x", 3.0), ("y", 2.0)]


def test_gz_and_traced(spark, tmp_path):
    with gzip.open(tmp_path / "items.jsonl.gz", "wt") as f:
        f.write('{"id": "x", "seed": 1}\n\n{"id": "z", "seed": 2}\n')
    items = jsonl.read_items(spark, str(tmp_path), "id string, seed long")
    trace = spark.createDataFrame([("x",), ("x",)], "id string")
    assert [tuple(r) for r in jsonl.only_traced(items, trace).collect()] == [("x", 1)]
    assert jsonl.only_traced(items, trace.limit(0)).count() == 0


def test_supersede_and_append(spark, tmp_path):
    lines(tmp_path / "t.part", [{"id": "x", "steps": ["a"], "cost": 1, "compactions": 0}, {"id": "x", "steps": ["b", "c"], "cost": 2, "compactions": 1}, {"id": "y", "steps": ["d"], "cost": 4, "compactions": 0}])
    part = jsonl.append_steps(jsonl.read_lines(spark, str(tmp_path), STEP), ["id"])
    assert {r.id: (r.steps, r.cost, r.compactions) for r in part.collect()} == {"x": (["a", "b", "c"], 3.0, 1), "y": (["d"], 4.0, 0)}
    final = part.where("id = 'y'")
    assert {(r.id, r.partial) for r in jsonl.supersede(final, part).collect()} == {("y", False), ("x", True)}


def test_one_item(spark):
    items = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "id string, n int")
    assert jsonl.one_item(items, "x").first().n == 1
    for bad in ("y", "none"):
        with pytest.raises(Exception, match="rows found"):
            jsonl.one_item(items, bad).collect()


def test_blind_view_and_guard(spark):
    items = spark.createDataFrame([], "id string, seed long, goal string, sessions array<struct<index:int,turns:array<struct<kind:string,text:string,probe_id:string>>>>, probes array<struct<probe_id:string,session:int,options:array<string>,licensed:array<string>>>")
    with pytest.raises(ValueError):
        jsonl.refuse_labels(items)
    shown = jsonl.blind(items)
    assert jsonl.refuse_labels(shown) is shown and "kind" not in jsonl.field_names(shown.schema)
    with pytest.raises(ValueError):
        jsonl.refuse_labels(shown, "/d/full.jsonl")


def test_sinks(spark, tmp_path):
    graded = spark.range(3).withColumnRenamed("id", "probe")
    jsonl.write_graded(graded, graded.selectExpr("count(*) AS n"), f"{tmp_path}/graded")
    out = [r.value for r in spark.read.text(f"{tmp_path}/graded").select("value", "_metadata.file_name").orderBy("file_name").collect()]
    assert out[-1] == '{"__summary__":{"n":3}}' and len(out) == 4
    jsonl.write_episodes(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), f"{tmp_path}/eps")
    sums = jsonl.digests(spark, f"{tmp_path}/eps").collect()
    assert len(sums) == 2 and all(len(r.sha256) == 16 for r in sums)
    for i in range(2):
        jsonl.append_manifest(spark.createDataFrame([(i,)], "n int"), f"{tmp_path}/manifest")
    assert jsonl.read_items(spark, f"{tmp_path}/manifest", "n int").count() == 2


def test_seed_windows(spark):
    jobs, done = list(range(0, 200, 3)), [0, 19, 20, 57, 140, -1]
    got = jsonl.seeds_not_done(spark.createDataFrame([(s,) for s in jobs], "seed long"), spark.createDataFrame([(s,) for s in done], "seed long"))
    assert {r.seed for r in got.collect()} == {s for s in jobs if not any(s <= d < s + 20 for d in done)}


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    first = [(at(1), "a"), (at(1, 30), "a"), (at(9), "b")]
    late = [(at(2), "a"), (at(8, 30), "a"), (at(20), "b")]
    schema = "ts timestamp, event_type string"
    for i, rows in enumerate((first, late)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = windows.hourly(source).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.start.hour, r.event_type, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "a", 2), (8, "a", 1), (9, "b", 1)}


def test_shed_over_batches(spark, tmp_path):
    rows = [(1, t, 50 + 37 * t % 200) for t in range(12)]
    for t in range(0, 12, 4):
        spark.createDataFrame(rows[t : t + 4], "conv_id long, turn long, tokens long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("conv_id long, turn long, tokens long").parquet(f"{tmp_path}/in")
        q = windows.shed(source, 300).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    want, held = set(), []
    for _, t, n in rows:
        held.append((t, n))
        while held and sum(x for _, x in held) > 300:
            want.add((held.pop(0)[0], t))
    assert {(r.turn, r.left_at) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
