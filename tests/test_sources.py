import pytest
from pyspark.sql import functions as F

from sparkloom.operators import reconcile
from sparkloom.operators.selection import belongs, in_range, select_rows
from sparkloom.sources import files
from sparkloom.streaming import ledger
from sparkloom.violations import ContractError, require_columns, split_by


def test_indexed_scan(spark, tmp_path):
    spark.createDataFrame([("b0", 1), ("b1", 1)], "id string, x int").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(f"c{i}", 1) for i in range(5)], "id string, x int").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    df = files.indexed(spark, f"{tmp_path}/in", ["id"])
    got = {r.id: (r.global_index, r.source_row) for r in df.collect()}
    assert got == {"b0": (0, 0), "b1": (1, 1), **{f"c{i}": (2 + i, i) for i in range(5)}}
    part = df.where(in_range(F.col("global_index"), 1, 6) & belongs(F.col("global_index"), 1, 2))
    assert sorted(r.global_index for r in part.collect()) == [1, 3, 5]
    shards = [df.where(belongs(F.col("global_index"), k, 3)) for k in range(3)]
    assert sum(s.count() for s in shards) == 7
    with pytest.raises(ContractError):
        files.indexed(spark, f"{tmp_path}/in", ["id", "nope"])
    with pytest.raises(ContractError):
        belongs(F.col("x"), 3, 3)


def test_select_rows(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b")], "id string, input_kind string")
    assert select_rows(df, "1").count() == 1 and select_rows(df, kinds=["b"]).count() == 2
    for bad in ("2", "9"):
        with pytest.raises(ContractError):
            select_rows(df, bad)


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n  \n{"id": "b"}\n')
    assert sorted((r.id, r.n) for r in files.json_lines(spark, str(p), "id string, n int").collect()) == [("a", 1), ("b", None)]
    p.write_text('{"id": "a"}\n[1]\n')
    with pytest.raises(ContractError):
        files.json_lines(spark, str(p), "id string")
    p.write_bytes(b"one\ntwo\ntorn")
    torn = files.whole_lines(spark.read.format("binaryFile").load(str(p)))
    assert [r.line for r in torn.orderBy("line_no").collect()] == ["one", "two"]


def test_prompts(spark):
    rows = [(0, "a", None, None, "p"), (1, None, "s", ["m"], "ignored"), (2, None, None, None, "q")]
    df = spark.createDataFrame(rows, "line_no int, id string, sample_id string, messages array<string>, prompt string")
    assert [(r.id, r.messages, r.prompt) for r in files.prompts(df).collect()] == [("a", None, "p"), ("s", ["m"], None), ("2", None, "q")]
    assert files.prompts(df, 2).count() == 2
    with pytest.raises(ContractError):
        files.prompts(spark.createDataFrame([(0, "a", None, None, None)], df.schema))


METRICS = """# HELP x
vllm:spec_decode_num_drafts_total{engine="0"} 10
vllm:spec_decode_num_drafts_total{engine="1"} 5.0
vllm:spec_decode_num_draft_tokens_total 1.05e2
vllm:spec_decode_num_accepted_tokens_total{a="b",c="d"} 60
other_total 9
"""


def test_counters(spark):
    df = spark.createDataFrame([("full", METRICS), ("part", "vllm:spec_decode_num_drafts_total 1"), ("none", "x 1"), ("big", METRICS.replace(" 60", " 1e999"))], "run string, text string")
    got = {(r.run, r.counter): (r.value, r.violation) for r in files.counters(df, "text", ["run"]).collect()}
    assert [got["full", c][0] for c in ("num_drafts", "num_draft_tokens", "num_accepted_tokens")] == [15.0, 105.0, 60.0]
    assert got["part", "num_drafts"][1] == "incomplete" and got["big", "num_accepted_tokens"][1] == "not finite"
    assert not any(r == "none" for r, _ in got)


def test_manifest(spark, tmp_path):
    df = spark.range(100).withColumn("t", F.lit("x"))
    m = files.write_dataset(df, f"{tmp_path}/d", "id")
    files.verify_dataset(spark, m, "id")
    with pytest.raises(ContractError):
        files.verify_dataset(spark, m | {"rows": 99}, "id")
    assert all(len(r.sha256) == 64 for r in files.file_digests(spark, f"{tmp_path}/d").collect())
    a, b = (reconcile.tree_digest(x, "id").first().digest for x in (df, df.repartition(7)))
    assert a == b != reconcile.tree_digest(spark.range(99), "id").first().digest


def test_shard_markers(spark):
    shards = spark.range(4).withColumnRenamed("id", "shard_id")
    done = spark.createDataFrame([(1, "f"), (2, "f")], "shard_id long, fingerprint string")
    assert sorted(r.shard_id for r in files.pending_shards(shards, done, "f").collect()) == [0, 3]
    with pytest.raises(ContractError):
        files.pending_shards(shards, done, "g")


def test_reconcile_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert sorted((r.k, r.matches) for r in reconcile.compare_runs(a, b, "k", "v").collect()) == [(1, True), (2, False)]
    with pytest.raises(ContractError):
        reconcile.compare_runs(a, b.where("k = 1"), "k", "v")
    with pytest.raises(ContractError):
        reconcile.speedup(reconcile.compare_runs(a, b, "k", "v"), 1.0, 2.0, exact=True)
    with pytest.raises(ContractError):
        reconcile.lookup(a, b.where("k = 1"), "k")
    with pytest.raises(ContractError):
        reconcile.unique_or_raise(a.union(a), "k")
    assert reconcile.digest(a.where("k > 9"), "k").first().digest == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    d = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    assert set(d.select(reconcile.drift(F.col("x"), F.col("y")).alias("d")).first().d) == {"b", "c"}


def test_violations(spark):
    c = split_by(spark.range(3), F.when(F.col("id") == 1, "one"))
    assert c.good.count() == 2 and c.bad.first().violation == "one"
    with pytest.raises(ContractError, match="odd: 1"):
        c.strict("id", "odd")
    with pytest.raises(ContractError):
        require_columns(spark.range(1), ["id", "x"])


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.createDataFrame([(1, 1, "error"), (2, 2, "error"), (1, 3, "resolved")], "id int, seq int, status string").write.parquet(src)
    stream = spark.readStream.schema("id int, seq int, status string").parquet(src)
    ledger.commit_by_batch(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    ledger.commit_by_batch(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    q = ledger.last_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, r.status) for r in spark.table("states").collect()) == [(1, "resolved"), (2, "error")]
    done = spark.createDataFrame([(1,)], "id int")
    q = ledger.without_done(stream, done, "id").writeStream.format("memory").queryName("rest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.table("rest").collect()] == [2]


def test_running_sum_over_skewed_groups(spark):
    import random

    from sparkloom.operators.selection import running_sum

    rng = random.Random(4)
    rows = [(None if i % 11 == 0 else ("hot" if i % 3 else f"k{i % 7}"), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = {r.i: r.s for r in running_sum(df, F.col("v"), ["i"], "s", ["g"]).collect()}
    sums, want = {}, {}
    for g, i, v in rows:
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + v
    assert got == want
