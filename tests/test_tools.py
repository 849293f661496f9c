import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import tools as T
from sparkloom.violations import ContractError


def test_tool_definitions(spark):
    raw = json.dumps([{"name": "a", "input_schema": {"x": 1}}, '{"function": {"name": "b", "parameters": "[1]"}}', {"description": "unnamed"}, 5, {"type": "function", "function": {"name": "c", "parameters": '{"z": 1, "y": 2}'}}])
    got = spark.createDataFrame([(raw,), (None,), ("{",)], "r string").select(T.tool_definitions(F.col("r")).alias("t")).collect()
    assert [(t.name, t.parameters) for t in got[0].t] == [("a", '{"x":1}'), ("b", '{"additionalProperties":true,"type":"object"}'), ("c", '{"y":2,"z":1}')]
    assert got[1].t == [] and got[2].t == []


def test_calls(spark):
    df = spark.createDataFrame([(1, 0, [("", "f", "{}"), ("k", "g", '{"a":1}')]), (1, 1, [("", " ", "{}")]), (2, 0, [("x", "f", "[1]")])], "conv int, turn int, calls array<struct<id:string,name:string,arguments:string>>")
    ids = [c.id for r in df.select(T.call_ids(F.col("calls"), F.col("conv"), F.col("turn")).alias("c")).collect() for c in r.c]
    assert ids[1] == "k" and ids[3] == "x" and len(set(ids)) == 4 and ids[0].startswith("call_")
    c = T.strict_calls(df)
    assert c.good.count() == 1 and sorted(r.violation for r in c.bad.collect()) == ["a call without a name", "arguments are no object"]


def test_lookup_and_dispatch(spark):
    catalogue = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, schema string")
    r = T.schemas_for(spark.createDataFrame([(["b", "zz", "a"],)], "names array<string>"), catalogue).first()
    assert [(t.name, t.schema) for t in r.tools] == [("b", "B"), ("a", "A")]
    routes = spark.createDataFrame([("a", "web")], "name string, executor string")
    c = T.dispatch(catalogue.select("name"), routes)
    assert [r.executor for r in c.good.collect()] == ["web"] and [r.name for r in c.bad.collect()] == ["b"]
    with pytest.raises(ContractError):
        T.dispatch(catalogue, routes.union(routes))


def test_records_and_evaluation(spark):
    rows = [(1, "hi", ["x.png"], None, ["v.mp4"], None), (2, " ", None, None, None, None)]
    got = T.records(spark.createDataFrame(rows, "id int, text string, image array<string>, audio array<string>, video array<string>, evaluation string")).orderBy("condition_id").collect()
    assert (got[0].modality, got[0].violation, got[1].violation) == ("image+video", None, "no text")
    assert json.loads(got[0].media_json) == [{"type": "image", "path": "x.png"}, {"type": "video", "path": "v.mp4"}]
    ok = spark.createDataFrame([('{"metric":"multiple_choice_accuracy","reference":" b"}',), (None,), ("null",)], "evaluation_json string")
    assert T.evaluation_contract(ok).where("metric is not null").first().reference == " b"
    for bad in ('{"metric":"bleu","reference":"x"}', '{"metric":"exact_match"}', '{"metric":"multiple_choice_accuracy","reference":"AB"}', '{"metric":"exact_match","reference":"x"}'):
        with pytest.raises(ContractError):
            T.evaluation_contract(ok.union(spark.createDataFrame([(bad,)], ok.schema)))


def test_workers_summary_and_files(spark):
    rows = [(b, r, r, 1, 1) for b in range(2) for r in range(2)]
    df = spark.createDataFrame(rows, "batch int, rank int, physical_device int, allocated_peak_bytes long, reserved_peak_bytes long")
    assert T.worker_identities(df, 2).collect() == []
    moved = df.withColumn("physical_device", F.when(F.col("batch") == 1, 1 - F.col("rank")).otherwise(F.col("rank")))
    assert [r.violation for r in T.worker_identities(moved, 2).collect()] == ["devices changed"]
    assert {r.violation for r in T.worker_identities(df, 3).collect()} == {"wrong number of workers"}
    s = T.run_summary(spark.createDataFrame([(10, 1.0), (30, 3.0)], "completion_tokens int, latency_seconds double"), 4.0).first()
    assert (s.samples, s.completion_tokens, s.tps, s.mean_latency) == (2, 40, 10.0, 2.0)
    paths = spark.createDataFrame([("a/b",), ("a",), (".git/x",), ("a/b/c",)], "p string")
    assert [r.p for r in T.listing(paths, "p", 2).collect()] == ["a", "a/b"]


def test_slices_of_files(spark, tmp_path):
    (tmp_path / "0.bin").write_bytes(b"hello world")
    store = spark.createDataFrame([(0, f"file:{tmp_path}/0.bin")], "segment int, path string")
    rows = [(0, 6, 5, hashlib.sha256(b"world").hexdigest()), (0, 0, 5, "bad"), (0, 8, 9, "x"), (7, 0, 1, "x")]
    index = spark.createDataFrame(rows, "segment int, offset long, nbytes long, sha256 string")
    got = {(r.segment, r.offset): (r.bytes and bytes(r.bytes), r.violation) for r in T.slices(store, index, ["segment"]).collect()}
    assert got == {(0, 6): (b"world", None), (0, 0): (None, "checksum"), (0, 8): (None, "short"), (7, 0): (None, "missing")}


def test_large_catalogues_are_joined(spark, monkeypatch):
    catalogue = spark.createDataFrame([(f"t{i}", f"S{i}") for i in range(30)] + [("none", None)], "name string, schema string")
    rows = [(1, ["t3", "zz", "t1", "t3"], "a"), (1, ["t3", "zz", "t1", "t3"], "a"), (2, [], "b"), (3, None, "c"), (4, ["none", "t29"], "d")]
    df = spark.createDataFrame(rows, "name int, names array<string>, schema string")
    want = sorted((r.name, [(t.name, t.schema) for t in r.tools or []]) for r in T.schemas_for(df, catalogue).collect())
    monkeypatch.setattr(T, "MAPPED", 5)
    got = T.schemas_for(df, catalogue)
    assert got.columns == ["name", "names", "schema", "tools"] and sorted((r.name, [(t.name, t.schema) for t in r.tools]) for r in got.collect()) == want


def test_wire_and_template_forms(spark):
    from sparkloom.operators import conditions as C

    raw = json.dumps([{"role": "user", "content": "é \"x\"", "_at": 5}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": '{"a": [1, "ü"]}'}}]}, {"role": "tool", "content": "y", "tool_call_id": "c"}])
    r = spark.createDataFrame([(raw,)], "raw string").select(C.cleaned_messages(F.col("raw")).alias("m")).select(T.wire_messages(F.col("m")).alias("w"), T.template_messages(F.col("m")).alias("t")).first()
    wire, template = json.loads(r.w), json.loads(r.t)
    assert wire[0] == {"role": "user", "content": "é \"x\"", } and wire[2] == {"role": "tool", "content": "y", "tool_call_id": "c"}
    assert wire[1]["tool_calls"] == [{"id": "c", "type": "function", "function": {"name": "f", "arguments": '{"a": [1, "ü"]}'}}]
    assert template[1]["tool_calls"][0]["function"]["arguments"] == {"a": [1, "ü"]} and template[0] == wire[0]
