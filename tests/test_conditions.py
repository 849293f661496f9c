import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import conditions as C
from sparkloom.operators import packed as P
from sparkloom.violations import ContractError


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("types,batch,profile,label", [([], "text", "text", "text"), (["image"], "image", "image", "image"), (["image", "image"], "multi_image", "multi_image", "image"), (["audio", "audio"], "other", "audio", "audio"), (["video", "audio"], "other", "other", "audio+video"), (["pdf"], "other", "text", "pdf")])
def test_kinds(spark, types, batch, profile, label):
    raw = json.dumps([{"type": t.upper()} for t in types])
    t = C.media_types(F.col("m"))
    r = spark.createDataFrame([(raw,)], "m string").select(C.batch_kind(t).alias("b"), C.profile_kind(t).alias("p"), C.modality(t).alias("l")).first()
    assert (r.b, r.p, r.l) == (batch, profile, label)


def test_conditions(spark):
    rows = [([("human", " Ｈi "), ("user", "debug it")], None, None, "English", "ok"), ([("user", "q"), ("gpt", "a")], "[]", "[]", "de", None)]
    df = spark.createDataFrame(rows, "messages array<struct<role:string,content:string>>, tools_json string, media_json string, language string, reference string")
    a, b = C.conditions(df, 7).orderBy("total_characters", ascending=False).collect()
    assert (a.messages[0].content, a.task, a.language, a.modality, a.total_characters, a.violation) == ("Hi\n\ndebug it", "code", "en", "text", 12, None)
    assert b.violation and a.condition_id != b.condition_id and a.reference_json == '{"assistant":"ok"}'
    again = C.conditions(df.repartition(3), 7).where("violation is null").first()
    assert again.condition_id == a.condition_id and again.selection_priority == a.selection_priority


def test_media_goes_to_the_last_user(spark):
    df = spark.createDataFrame([([("user", "a"), ("assistant", "b"), ("user", "c")], [("IMAGE", "x.png")])], "m array<struct<role:string,content:string>>, f array<struct<type:string,path:string>>")
    out = df.select(C.with_media(F.col("m"), F.col("f")).alias("o")).first().o
    assert [[(p.type, p.value) for p in m.parts] for m in out] == [[("text", "a")], [("text", "b")], [("image", "x.png"), ("text", "c")]]
    inv = C.inventory(spark.createDataFrame([(1, '[{"type":"image","path":"s3://b/x"},{"type":"audio","path":"/a"}]')], "id int, media string"), "id", "media")
    assert sorted((r.path, r.remote) for r in inv.collect()) == [("/a", False), ("s3://b/x", True)]


def test_completions(spark):
    df = spark.createDataFrame([([1], [2, 9], "x", "stop"), ([1], [2], "x", None), ([], [2], "x", "stop"), ([1], [2], " ", "stop")], "p array<int>, r array<int>, t string, f string")
    got = df.select(*C.completion(F.col("p"), F.col("r"), F.col("t"), F.col("f"), 9)).collect()
    assert [(g.finish_reason, g.violation) for g in got] == [("eos", None), ("unknown", None), ("stop", "empty prompt"), ("stop", "empty completion")]
    s = df.select(*C.sequences(F.col("p"), F.col("r"), 2)).collect()
    assert s[0].violation == "too long" and s[1].input_ids == [1, 2] and s[1].loss_mask == [0, 1] and s[2].violation == "empty"
    ids = spark.createDataFrame([(None, [1, None], [3])], "a array<int>, b array<int>, c array<int>")
    assert ids.select(C.token_ids(F.col("a"), F.col("b"), F.col("c")).alias("v")).first().v == [3]


def test_json_and_web_fields(spark):
    r = one(spark, C.split_array(F.col("x")), x='Use [{"b":1,"a":2}] now')
    assert r.array_json == '[{"a":2,"b":1}]' and r.rest.split() == ["Use", "now"]
    assert one(spark, C.split_array(F.col("x")), x="[broken").array_json is None
    assert [one(spark, C.tool_arguments(F.col("x")), x=x) for x in ('{"a":1}', "[1]", "plain", "", "null")] == ['{"a":1}', '{"raw_arguments":[1]}', '{"raw_arguments":"plain"}', "{}", "{}"]
    assert one(spark, C.forbidden_keys(F.col("x"), ("answer", "patch")), x='{"answer":1,"b":2}') == ["answer"]
    assert [one(spark, C.page_url(F.col("x")), x=x) for x in ("example.com/a", "http://u:p@h/", "https://h/#f", "ftp://h", " ")] == ["https://example.com/a", None, None, "https://ftp://h", None]
    df = spark.createDataFrame([([("t" * 600, "ftp://x", "s", "o"), ("b", "http://y", None, "o"), ("c", "https://z", "s", "o")],)], "i array<struct<title:string,link:string,snippet:string,source:string>>")
    got = df.select(C.search_results(F.col("i"), 1).alias("v")).first().v
    assert [(x.rank, x.link, x.snippet) for x in got] == [(2, "http://y", "")]
    assert one(spark, C.search_request(F.col("q"), F.lit(3), F.lit("en")), q=" ") == "empty query" and one(spark, C.search_request(F.col("q"), F.lit(11), F.lit("en")), q="a") == "top_k"
    used = C.components_used(spark.createDataFrame([("text",), ("video",)], "k string"), "k").first()
    assert used.vision and used.audio and used.any


def samples(spark, rows):
    return spark.createDataFrame(rows, "shard int, sample_id string, source_index long, input_ids array<long>, loss_mask array<int>, aux array<double>, final array<double>")


def test_packed_store(spark):
    good = [(0, f"s{i}", i, [1, 2, 3][: 1 + i % 3], [1] * (1 + i % 3), [0.5] * (4 * (1 + i % 3)), [0.1] * (2 * (1 + i % 3))) for i in range(9)]
    bad = [(0, "x", 20, [], [], [], []), (0, "y", 21, [1], [1, 1], [0.0] * 4, [0.0] * 2), (0, "z", 22, [1], [1], [float("nan")] * 4, [0.0] * 2), (0, "w", 23, [1], [1], [0.0], [0.0] * 2)]
    c = P.checked_samples(samples(spark, good + bad), 2, 2)
    assert {r.sample_id: r.violation for r in c.bad.collect()} == {"x": "no tokens", "y": "mask length", "z": "not finite", "w": "aux shape"}
    idx = P.index(c.good, 70, 2, 2).cache()
    rows = sorted(idx.collect(), key=lambda r: r.source_index)
    seg, used, want = 0, 0, []
    for r in rows:
        n = sum(r.nbytes.values())
        if used and used + n > 70:
            seg, used = seg + 1, 0
        want.append(seg)
        used += n
    assert [r.segment for r in rows] == want
    for a, b in zip(rows, rows[1:]):
        if a.segment == b.segment:
            assert all(a.offsets[k] + a.nbytes[k] == b.offsets[k] for k in a.offsets)
    m = P.manifest(idx).first()
    assert (m.samples, m.total_tokens) == (9, 18)
    sealed = P.seal(idx)
    P.verify(idx, sealed)
    with pytest.raises(ContractError):
        P.verify(idx.where("sample_id <> 's8'"), sealed)
    kept, torn = P.recovered(samples(spark, good + [(0, "torn", 99, [1], [1], [0.0] * 4, [0.0] * 2)]), idx)
    assert kept.count() == 9 and [r.sample_id for r in torn.collect()] == ["torn"]
    with pytest.raises(ContractError):
        P.recovered(samples(spark, good[:3]), idx)


def test_shards_and_manifests(spark):
    df = spark.createDataFrame([(i // 2, "f", "r", f"c{i}", 3) for i in range(4)], "shard_id int, fingerprint string, runtime string, condition_id string, tokens int")
    assert P.verified_shards(df, 2, 4)["status"] == "PASS"
    for bad in (df.union(df.limit(1)), df.where("shard_id = 0"), df.withColumn("fingerprint", F.col("condition_id"))):
        with pytest.raises(ContractError):
            P.verified_shards(bad, 2, 4)
    with pytest.raises(ContractError):
        P.compatible({"a": 1}, {"a": 2}, ("a",))
    rows = spark.createDataFrame([(True, [1], [1], "m"), (False, [1], [1], "m"), (True, [1], [], "m"), (True, [1], [1], "n")], "stage_a_complete boolean, input_ids array<int>, loss_mask array<int>, mask_semantics string")
    assert P.frozen_rows(rows, "m").good.count() == 1
    s = P.low_rank_scores(spark.createDataFrame([(1, 2)], "prev int, next int"), spark.createDataFrame([(1, [1.0, 2.0])], "id int, vector array<double>"), spark.createDataFrame([(2, [3.0, 4.0])], "id int, vector array<double>"))
    assert s.first().score == 11.0
    t = P.two_tap(spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "b int, i int, v double"), ["b"], "i", "v", (0.5, 1.0))
    assert [r.mixed for r in t.orderBy("i").collect()] == [1.0, 2.5]
