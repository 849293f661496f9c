"""Gates, bundles and isolation on literal fixtures."""

import hashlib
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import hashing as H
from sparkloom.functions import text as T
from sparkloom.operators import contracts as K
from sparkloom.operators import packed, reconcile, sequence
from sparkloom.sources import files
from sparkloom.violations import ContractError


def test_manifest_checks(spark):
    f = spark.createDataFrame([("m", 5, "ab"), ("two", 1, "x"), ("two", 1, "x")], "name string, bytes long, sha256 string")
    rows = [("m", "frozen", 0, 5, "ab"), ("m", "open", 0, 5, "ab"), ("m", "frozen", 1, 5, "ab"), ("m", "frozen", None, 6, "ab"), ("m", "frozen", 0, None, "cd"), ("m", None, 0, None, None), ("none", "partial", 0, 1, None), ("two", "frozen", 0, 1, "x")]
    wrong = [[], ["status"], ["unresolved_errors"], ["bytes"], ["sha256"], ["status"], ["bytes", "status"], ["bytes", "sha256"]]
    for row, bad in zip(rows, wrong, strict=True):
        c = K.manifest_checks(spark.createDataFrame([row], "name string, status string, unresolved_errors long, bytes long, sha256 string"), f, "name", ["frozen"])
        assert c.count() == 4 and sorted(r.check for r in c.where("not passed").collect()) == bad
        if bad:
            with pytest.raises(ContractError, match=bad[0]):
                K.require_checks(c, "name")
        else:
            K.require_checks(c, "name")


def test_attestation_says_what_is_not_verified(spark):
    runtime = {"engine": "e", "device": "d", "ranks": 2}
    good = {"schema": "s1", "model": "m", "dtype": "bfloat16", "runtime": runtime}
    claims = [good, good | {"schema": "s2"}, good | {"model": "n"}, good | {"dtype": None}, good | {"runtime": None}, good | {"runtime": runtime | {"ranks": 0}}, good | {"runtime": runtime | {"ranks": 1.5}}, good | {"runtime": runtime | {"device": ""}}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(claims)] + [(99, "no json"), (100, None)], "i int, claim string")
    c = K.attestation_checks(df, "i", "claim", {"schema": "s1", "model": "m", "dtype": "bfloat16"}, ["runtime.engine", "runtime.device"], ["runtime.ranks"])
    wrong = {}
    for r in c.where("not passed").collect():
        wrong.setdefault(r.i, set()).add(r.check)
    assert wrong.pop(99) == wrong.pop(100) == {"schema", "model", "dtype", "runtime.engine", "runtime.device", "runtime.ranks"}
    assert wrong == {1: {"schema"}, 2: {"model"}, 3: {"dtype"}, 4: {"runtime.engine", "runtime.device", "runtime.ranks"}, 5: {"runtime.ranks"}, 6: {"runtime.ranks"}, 7: {"runtime.device"}}
    one = K.attested(df, c, "i", "claim").collect()
    assert [(r.i, r.sha256, r.verified) for r in one] == [(0, hashlib.sha256(json.dumps(good, sort_keys=True, separators=(",", ":")).encode()).hexdigest(), False)]


def test_bindings(spark):
    f = spark.createDataFrame([("a", b"x"), ("b", b"y")], "name string, content binary")
    now = K.bindings(f)
    assert now["a"] == hashlib.sha256(b"x").hexdigest() and K.bound(dict(now), now) == now
    with pytest.raises(ContractError, match="b"):
        K.bound(now | {"b": "0"}, now)
    with pytest.raises(ContractError):
        K.bound(now, now, passed=False)
    with pytest.raises(ContractError):
        K.same_run({"a": 1, "b": 2}, {"a": 1, "b": 3}, ("a", "b"))
    K.same_run({"a": 1, "b": 2}, {"a": 1, "b": 3}, ("a",))


def test_fingerprints_do_not_depend_on_order(spark):
    assert K.config_fingerprint({"a": 1, "b": [2]}) == K.config_fingerprint({"b": [2], "a": 1}) != K.config_fingerprint({"a": 1}, {"b": [2]})
    rows = [(i, f"t{i}") for i in range(20)]
    one = K.fixture_fingerprint(spark.createDataFrame(rows, "i long, t string").repartition(4), "i", ["t", "i"]).first()
    two = K.fixture_fingerprint(spark.createDataFrame(rows[::-1], "i long, t string"), "i", ["i", "t"]).first()
    assert one == two and one.fingerprint == hashlib.sha256(json.dumps([{"i": i, "t": t} for i, t in rows], separators=(",", ":")).encode()).hexdigest()


def test_bundle_is_whole_or_absent(spark, tmp_path):
    a = spark.range(3)
    path = f"{tmp_path}/out/bundle"
    with pytest.raises(Exception):
        K.publish_whole(spark, {"good": a, "bad": a.select(F.raise_error(F.lit("no")).alias("x"))}, path, {"v": 1})
    assert not (tmp_path / "out" / "bundle").exists()
    marker = K.publish_whole(spark, {"a": a, "b": a.limit(1)}, path, {"v": 1})
    assert marker["rows"] == {"a": 3, "b": 1} and spark.read.parquet(f"{path}/b").count() == 1
    with pytest.raises(ContractError):
        K.publish_whole(spark, {"a": a}, path, {"v": 2})
    K.put_json(spark, {"b": 1, "a": "é"}, f"{tmp_path}/x.json")
    K.put_json(spark, {"b": 2, "a": "é"}, f"{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_text(encoding="utf-8") == '{"a":"é","b":2}\n' and not (tmp_path / "x.json.tmp").exists()


def test_failures_stay_with_their_rows(spark):
    def work(part):
        if (part.x == 3).any():
            raise KeyError("three")
        return part.assign(y=part.x * 2)

    got = {r.x: (r.y, r.error) for r in K.isolated(spark.range(8).select(F.col("id").alias("x")).repartition(2), work, "x long, y double", batch_rows=4).collect()}
    assert got[3][1] == "KeyError: 'three'" and all(got[i] == (2 * i, None) for i in range(8) if i != 3)


def test_few_calls_and_frames_for_failing_rows(spark, tmp_path):
    """A batch is halved, not taken apart: a failing row of 64 costs 13 calls, and its batch comes back in two frames."""
    calls = spark.sparkContext.accumulator(0)

    def work(part):
        calls.add(1)
        if (part.x % 64 == 7).any():
            raise ValueError(f"bad {part.x.iloc[0]}")
        return part.assign(y=part.x * 2)

    rows = spark.range(0, 640, 1, 1).select(F.col("id").alias("x"))
    got = {r.x: (r.y, r.error) for r in K.isolated(rows, work, "x long, y double").collect()}
    assert got == {i: (None, f"ValueError: bad {i}") if i % 64 == 7 else (2 * i, None) for i in range(640)}
    assert calls.value == 10 * 13


def test_rows_of_a_hot_id_stay_where_they_are(monkeypatch, spark):
    monkeypatch.setattr(packed, "HOT", 10, raising=False)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        i = F.col("id")
        ids = F.when(i % 2 == 0, "hot").when(i < 10, F.concat(F.lit("twice"), (i % 4).cast("string"))).when(i == 39, None).otherwise(i.cast("string"))
        one = lambda v: F.array(F.lit(v))
        df = spark.range(0, 40, 1, 4).select(ids.alias("sample_id"), i.alias("source_index"), one(1).alias("input_ids"), one(1).alias("loss_mask"), F.array_repeat(F.lit(1.0), 2).alias("aux"), one(1.0).alias("final"))
        c = packed.checked_samples(df, 2, 1)
        bad = c.bad.select("source_index", "sample_id", "violation", F.spark_partition_id().alias("p")).collect()
        assert sorted(r.source_index for r in bad) == sorted([*range(0, 40, 2), 1, 3, 5, 7, 9]) and {r.violation for r in bad} == {"duplicate id"}
        assert sorted(r.source_index for r in c.good.collect()) == list(range(11, 40, 2))
        assert len({r.p for r in bad if r.sample_id == "hot"}) == 4
    finally:
        spark.conf.set(key, before)


def test_verified_counts(spark):
    assert packed.verified_count({"status": "PASS", "conditions": 4}, spark.range(4)) == 4
    for marker in ({"status": "PASS", "conditions": 5}, {"status": "FAIL", "conditions": 4}, {}):
        with pytest.raises(ContractError):
            packed.verified_count(marker, spark.range(4))


def test_condition_seed_is_the_row_s_own(spark):
    ids = ["a", "b", "ü"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.s for r in df.select("id", H.condition_seed("creative", 7, F.col("id"), "generation-v1").alias("s")).collect()}
    for i in ids:
        raw = "\x1f".join(json.dumps(x, ensure_ascii=False) for x in ("generation-v1", "creative", 7, i)).encode()
        assert got[i] == int(hashlib.blake2b(raw, digest_size=8).hexdigest(), 16) % (2**63 - 1)


def test_tree_digest_is_the_set_s(spark):
    ids = [str(i) for i in range(500)]
    d = lambda x: reconcile.tree_digest(spark.createDataFrame([(i,) for i in x], "k string"), "k", 1).first()
    assert d(ids) == d(ids[::-1]) and d(ids).n == 500 and d(ids[1:]).digest != d(ids).digest and d(ids + ["1"]).digest != d(ids).digest
    assert d([]).digest == hashlib.sha256(b"").hexdigest() and d([]).n == 0


def test_segments_stream_a_long_group(spark):
    rng = random.Random(1)
    rows = [("a", i, rng.randint(0, 40)) for i in range(3000)] + [("b", 5, 200), ("b", 6, 1), (None, 1, None), (None, 2, 3)]
    got = sequence.segments(spark.createDataFrame(rows, "g string, i long, n long").repartition(5), "n", "i", 100, ["g"]).collect()
    want, used, seg = {}, {}, {}
    for g, i, n in rows:
        n = n or 0
        u = used.get(g, 0)
        if u and u + n > 100:
            seg[g], u = seg.get(g, 0) + 1, 0
        want[g, i] = seg.get(g, 0), u
        used[g] = u + n
    assert {(r.g, r.i): (r.segment, r.offset) for r in got} == want


def test_public_hosts_as_the_address_library_has_them(spark):
    rng = random.Random(2)
    hosts = [".".join(str(rng.choice([0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 8, 51, 18, 113, 254, 168, rng.randint(0, 255)])) for _ in range(4)) for _ in range(3000)]
    hosts += ["192.0.0.9", "192.0.0.10", "192.0.0.11", "255.255.255.255", "224.0.0.1", "100.63.255.255", "100.127.0.1"]
    got = {r.h: r.p for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", T.public_host(F.concat(F.lit("http://"), "h")).alias("p")).collect()}
    assert {h: p for h, p in got.items() if p != ipaddress.ip_address(h).is_global} == {}
    odd = {"http://Example.COM.": True, "http://LOCALHOST./x": False, "ftp://example.org": False, "http://u@10.0.0.1:80/": False, "http://[fe80::1]/": False, "http://[nonsense]/": False, "https://010.1.1.1": True, "http://": False, None: False, "example.org": False}
    got = {r.u: r.p for r in spark.createDataFrame([(u,) for u in odd], "u string").select("u", T.public_host(F.col("u")).alias("p")).collect()}
    assert got == odd


def test_html_blocks_and_lines(spark):
    pages = ["<pre>b</pre><pre>c</pre>x", "<div>a</div><div>b</div>", "a<br>b<BR/>c", "<h4>t</h4><h5>u</h5>v", "<title>T</title><svg><p>no</p></svg>yes", "a  b\rc d\x0be", "x   y"]
    got = [r.t for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").repartition(1).sortWithinPartitions("i").select(T.html_text(F.col("p")).alias("t")).collect()]
    assert got == ["b\nc\nx", "ab", "a\nb\nc", "t\nuv", "T\nyes", "a b\nc\nd\ne", "x   y"]


def test_condition_files_and_columns(spark, tmp_path):
    cols = files.CONDITION_COLUMNS
    row = lambda i: tuple(f"{c}{i}" for c in cols)
    spark.createDataFrame([row(i) for i in range(10)], ", ".join(f"{c} string" for c in cols)).coalesce(1).write.parquet(f"{tmp_path}/a")
    got = files.conditions(spark, f"{tmp_path}/a", 3)
    assert [r.condition_id for r in got.collect()] == ["condition_id0", "condition_id1", "condition_id2"] and got.columns == [*cols, "evaluation_json"]
    assert files.conditions(spark, f"{tmp_path}/a").count() == 10
    spark.createDataFrame([(1, None), (2, None)], "x int, y string").coalesce(1).write.parquet(f"{tmp_path}/b/one")
    spark.createDataFrame([(1,)], "x int").coalesce(1).write.parquet(f"{tmp_path}/b/two")
    found = files.files_without(spark, f"{tmp_path}/b", ["x", "y"])
    assert len(found) == 1 and "/two/" in found[0][0] and found[0][1] == ["y"]
    with pytest.raises(ContractError):
        files.conditions(spark, f"{tmp_path}/b/one")
    one, two = files.content_fingerprint(spark, f"{tmp_path}/b").first(), files.content_fingerprint(spark, f"{tmp_path}/b").first()
    assert one == two and one["files"] == 2 and files.content_fingerprint(spark, f"{tmp_path}/a").first().fingerprint != one.fingerprint


def test_json_lines_name_the_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n[3]\n')
    with pytest.raises(ContractError, match="line 4"):
        files.json_lines(spark, f"{tmp_path}/x.jsonl", "a long")
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n \n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in files.json_lines(spark, f"{tmp_path}/y.jsonl", "a long").collect()) == [1, 2]


def test_shards_are_read_and_what_lies_beside_them_is_not(spark, tmp_path):
    for k in range(3):
        spark.range(k + 1).coalesce(1).write.parquet(f"{tmp_path}/processed/en/s{k}")
    (tmp_path / "processed" / "en" / "s0" / "manifest.json").write_text("{}")
    spark.range(100).write.parquet(f"{tmp_path}/cache")
    assert files.scan_shards(spark, str(tmp_path)).count() == 6


def test_stable_ids_against_the_hash_library(spark):
    rows = [("s1", "a\u00e9"), ("s2", 'q"\n'), ("", "")]
    got = spark.createDataFrame(rows, "s string, t string").select("s", "t", H.stable_hex(F.col("s"), F.col("t")).alias("h"), H.stable_int(F.col("s"), F.col("t")).alias("n")).collect()
    for r in got:
        raw = "\x1f".join(json.dumps(x, ensure_ascii=False) for x in (r.s, r.t)).encode()
        assert r.h == hashlib.blake2b(raw, digest_size=32).hexdigest() and r.n == int(hashlib.blake2b(raw, digest_size=8).hexdigest(), 16) % (2**63 - 1)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from sparkloom import session

    jsc = N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False, isEmpty=lambda: True)))
    cluster = N(conf=N(get=lambda k, d: d), sparkContext=N(master="spark://host:7077", _jsc=jsc))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(cluster)
