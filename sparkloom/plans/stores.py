"""Stores, gates, run records, streams in batch form and vector objectives over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import contracts as K
from ..operators import metrics as G
from ..operators import packed, reconcile, selection, tools
from ..operators import sequence as S
from ..sources import files
from ..streaming import ledger
from .registry import query


def _samples(t):
    """Orders as samples: as many ids as the key modulo 5, a mask that is short for some, one repeated id."""
    n = F.col("o_orderkey") % 5
    ids = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
    mask = F.array_repeat(F.lit(1), F.when(F.col("o_orderkey") % 7 == 0, n + 1).otherwise(n).cast("int"))
    bad = F.when(F.col("o_orderkey") % 11 == 0, float("nan")).otherwise(1.0)
    return t.orders.select(F.when(F.col("o_orderkey") % 13 == 0, 0).otherwise(F.col("o_orderkey")).cast("string").alias("sample_id"), F.col("o_orderkey").alias("source_index"), ids.alias("input_ids"), mask.alias("loss_mask"), F.array_repeat(bad, (n * 2).cast("int")).alias("aux"), F.array_repeat(F.lit(1.0), n.cast("int")).alias("final"))


@query("""SELECT o_orderkey AS source_index, CASE WHEN o_orderkey % 5 = 0 THEN 'no tokens' WHEN o_orderkey % 7 = 0 THEN 'mask length' WHEN o_orderkey % 11 = 0 THEN 'not finite' WHEN o_orderkey % 13 = 0 THEN 'duplicate id' END AS violation FROM orders""")
def n5_checked_samples(t):
    c = packed.checked_samples(_samples(t), 2, 1)
    return c.good.withColumn("violation", F.lit(None).cast("string")).unionByName(c.bad).select("source_index", "violation")


@query("""SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) AS bad FROM orders""")
def n4_cache_report(t):
    return packed.cache_report(_samples(t), 2, 1).select("rows", "bad")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, doc_id, i, n_chars, 0::BIGINT AS part, 0::BIGINT AS before, n_chars * 4 AS used FROM d WHERE i = 1
 UNION ALL SELECT d.source, d.doc_id, d.i, d.n_chars, CASE WHEN f.used > 0 AND f.used + 4 * d.n_chars > 60000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.used > 0 AND f.used + 4 * d.n_chars > 60000 THEN 0 ELSE f.before + f.n_chars END,
  CASE WHEN f.used > 0 AND f.used + 4 * d.n_chars > 60000 THEN 4 * d.n_chars ELSE f.used + 4 * d.n_chars END FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1)
SELECT source, doc_id, part, before::BIGINT AS start, (before + n_chars)::BIGINT AS "end" FROM f""")
def b12_shard_index(t):
    d = t.documents.select("source", "doc_id", F.col("n_chars").alias("tokens"), (F.col("n_chars") * 4).alias("nbytes"))
    return packed.shard_index(d, "nbytes", "doc_id", 60000, "source").select("source", "doc_id", "part", "start", "end")


@query("""SELECT c_nationkey AS shard, c_custkey % 3 AS part, count(*) AS conditions, sum(c_custkey)::BIGINT AS tokens, sum(4 * c_custkey)::BIGINT AS nbytes, 'train-' || lpad(c_nationkey::VARCHAR, 5, '0') || '-' || lpad((c_custkey % 3)::VARCHAR, 3, '0') AS name FROM customer GROUP BY ALL""")
def b12_shard_files(t):
    idx = t.customer.select(F.col("c_nationkey").alias("shard"), (F.col("c_custkey") % 3).alias("part"), F.col("c_custkey").alias("tokens"), (F.col("c_custkey") * 4).alias("nbytes"))
    return packed.shard_files(idx, "shard", "nbytes")


def _index(t):
    d = t.documents.select("source", F.col("doc_id").cast("string").alias("sample_id"), F.col("doc_id").alias("source_index"), F.col("n_chars").alias("tokens"), F.sha2("text", 256).alias("sha"))
    at = S.offsets(d, "tokens", "source_index", ["source"])
    one = lambda c: F.create_map(F.lit("ids"), c)
    return at.select(F.col("source").alias("shard"), F.lit(0).alias("segment"), "sample_id", "source_index", "tokens", one(F.col("offset")).alias("offsets"), one(F.col("tokens")).alias("nbytes"), one(F.col("sha")).alias("sha256"))


@query("""SELECT source AS shard, 'ids' AS stream, sum(n_chars)::BIGINT AS bytes, count(*) AS rows, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY source""")
def b8_seal(t):
    s = packed.seal(_index(t))
    return s.select("shard", "stream", F.col("bytes").cast("long"), "rows", "digest")


@query("""SELECT doc_id::VARCHAR AS sample_id, lang <> 'es' AS kept FROM documents""")
def b7_recovered(t):
    payload = t.documents.select(F.col("doc_id").cast("string").alias("sample_id"))
    kept, torn = packed.recovered(payload, _index(t).join(t.documents.where("lang <> 'es'").select(F.col("doc_id").alias("source_index")), "source_index", "left_semi"))
    return kept.withColumn("kept", F.lit(True)).unionByName(torn.withColumn("kept", F.lit(False)))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'not complete' WHEN 2 THEN 'lengths differ' WHEN 3 THEN 'mask semantics' WHEN 4 THEN 'no tokens' END AS violation FROM documents""")
def c21_frozen_rows(t):
    k = F.col("doc_id") % 6
    ids = F.when(k == 4, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2)))
    mask = F.when(k == 2, F.array(F.lit(1))).when(k == 4, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(1)))
    d = t.documents.select("doc_id", (k != 1).alias("stage_a_complete"), ids.alias("input_ids"), mask.alias("loss_mask"), F.when(k == 3, "other").otherwise("own").alias("mask_semantics"))
    c = packed.frozen_rows(d, "own")
    return c.good.withColumn("violation", F.lit(None).cast("string")).unionByName(c.bad).select("doc_id", "violation")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'other token ids' ELSE NULL END AS violation, CASE WHEN doc_id % 4 <> 3 THEN 2 END AS aux, CASE doc_id % 4 WHEN 0 THEN 9.0 WHEN 1 THEN 9.0 WHEN 2 THEN 1.0 END::DOUBLE AS last FROM documents""")
def n22_unpacked(t):
    k = F.col("doc_id") % 4
    three = F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0))  # two layers and the raw last one, of width 1
    two = F.array(F.lit(1.0), F.lit(2.0))
    d = t.documents.select("doc_id", F.array(F.lit(7)).alias("token_ids"), F.array(F.when(k == 3, 8).otherwise(7)).alias("expected_ids"), F.when(k == 2, three).otherwise(two).alias("hidden"), F.when(k != 2, F.array(F.lit(9.0))).alias("final"))
    c = packed.unpacked(d, 2, 1)
    good = c.good.select("doc_id", F.lit(None).cast("string").alias("violation"), F.size("aux").alias("aux"), F.round(F.get("final_vectors", F.lit(0)), 3).alias("last"))
    return good.unionByName(c.bad.select("doc_id", "violation", F.lit(None).cast("int").alias("aux"), F.lit(None).cast("double").alias("last")))


@query("SELECT count(*) AS shards, sum(n_nationkey)::BIGINT AS conditions FROM nation")
def g7_completed(t):
    return packed.completed(t.nation.select(F.col("n_nationkey").alias("conditions")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' WHEN o_orderkey % 9 = 1 THEN 'repeated' END AS reason FROM orders WHERE o_orderkey % 9 IN (0, 1) UNION ALL SELECT -1, 'unexpected'""")
def f6_partition_law(t):
    o = t.orders.select("o_orderkey")
    shards = [o.where(selection.belongs(F.col("o_orderkey"), k, 9)) for k in range(1, 9)]
    shards += [o.where(F.col("o_orderkey") % 9 == 1), t._spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"))]
    return reconcile.partition_law(o, shards, "o_orderkey")


@query("SELECT user_id, bool_or(event_type = 'error') AS any, bool_and(event_type = 'error') AS all FROM events GROUP BY user_id")
def g27_any_and_all(t):
    e = t.events.select("user_id", F.when(F.col("event_type") != "click", F.col("event_type") == "error").alias("failed"))
    return reconcile.any_and_all(e, ["user_id"], "failed")


@query("""WITH a AS (SELECT user_id, pos FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) WHERE event_type = 'signup')
SELECT user_id, pos::INTEGER AS anchor, count(*) AS visible FROM (SELECT user_id, pos, unnest(range(0, pos)) AS p FROM a) GROUP BY ALL""")
def e16_visible_context(t):
    from pyspark.sql import Window

    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("pos")
    c = t.events.select("user_id", "event_type", pos)
    a = c.where("event_type = 'signup'").select("user_id", F.col("pos").alias("anchor"))
    return S.visible_context(a, c, "user_id").groupBy("user_id", "anchor").agg(F.count("*").alias("visible"))


@query("""WITH e AS (SELECT user_id, event_id % 7 AS block, event_id AS depth, event_type IN ('click', 'view') AS b, event_type = 'click' AS s FROM events WHERE event_type <> 'error'),
r AS (SELECT *, bool_and(b) OVER w AS rb, bool_and(s) OVER w AS rs FROM e WINDOW w AS (PARTITION BY user_id, block ORDER BY depth))
SELECT user_id, count(*) AS valid_tokens, count(DISTINCT block) AS valid_blocks, count(*) FILTER (b) AS base_correct, count(*) FILTER (s) AS selected_correct, round(count(*) FILTER (b) / count(*), 9) AS base_accuracy, round(count(*) FILTER (s) / count(*), 9) AS selected_accuracy,
 count(*) FILTER (rb) + count(DISTINCT block) AS base_accept_total, count(*) FILTER (rs) + count(DISTINCT block) AS selected_accept_total FROM r GROUP BY user_id""")
def n23_step_metrics(t):
    kind = F.col("event_type")
    e = t.events.select("user_id", (F.col("event_id") % 7).alias("block"), F.col("event_id").alias("depth"), F.lit(1).alias("target"), F.when(kind.isin("click", "view"), 1).otherwise(0).alias("base"), F.when(kind == "click", 1).otherwise(0).alias("selected"), (kind != "error").alias("valid"))
    m = S.step_metrics(e, ["user_id"])
    return m.withColumn("base_accuracy", F.round("base_accuracy", 9)).withColumn("selected_accuracy", F.round("selected_accuracy", 9))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), h AS (SELECT label AS item, i, max(x) AS x FROM e GROUP BY label, i)
SELECT vec_id, item, round(sum(e.x * h.x), 6) AS score FROM e JOIN h ON e.i = h.i GROUP BY vec_id, item""")
def n24_dense_scores(t):
    """Each vector against a head of one row a label, the largest values of its vectors."""
    most = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.max("x").alias("x"))
    head = most.groupBy(F.col("label").alias("item")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("embedding"))
    return G.dense_scores(t.embeddings, head, "vec_id", "item", "embedding").withColumn("score", F.round("score", 6))


@query("""WITH x AS (SELECT event_type AS name, event_id, value AS v, value + CASE WHEN event_type = 'click' THEN 0.5 WHEN event_type = 'view' THEN 0.01 ELSE 0 END AS w FROM events)
SELECT name, (name = 'error')::BIGINT AS unmatched, round(max(abs(v - w)) FILTER (name <> 'error' OR event_id <> (SELECT max(event_id) FROM events WHERE event_type = 'error')), 6) AS max_abs, name NOT IN ('click', 'error') AS passed FROM x GROUP BY name""")
def e11_named_errors(t):
    kind = F.col("event_type")
    a = t.events.select(kind.alias("name"), "event_id", "value")
    b = t.events.select(kind.alias("name"), "event_id", (F.col("value") + F.when(kind == "click", 0.5).when(kind == "view", 0.01).otherwise(0.0)).alias("value"))
    last = t.events.where(kind == "error").agg(F.max("event_id")).first()[0]
    r = G.named_errors(a, b.where(F.col("event_id") != last), "name", "event_id", "value", exact=("purchase", "signup"), tolerance=0.1)
    return r.select("name", "unmatched", F.round("max_abs", 6).alias("max_abs"), "passed")


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, list_sum(list_transform(v, lambda x: exp(x))) AS z, v[1] AS a, v[2] AS b FROM s)
SELECT vec_id, round(exp(a) / z, 9) AS first, round(ln(exp(a) + exp(b)), 9) AS both FROM x""")
def j1_softmax(t):
    v = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select("vec_id", F.round(F.get(V.softmax(F.col("v")), F.lit(0)), 9).alias("first"), F.round(V.log_add_exp(F.get("v", F.lit(0)), F.get("v", F.lit(1))), 9).alias("both"))


@query("SELECT vec_id, vec_id % 3 <> 1 AS close FROM embeddings")
def j9_allclose(t):
    off = F.when(F.col("vec_id") % 3 == 1, 0.1).otherwise(1e-9)
    return t.embeddings.select("vec_id", V.allclose(F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: x.cast("double") + off)).alias("close"))


@query("""WITH e AS (SELECT user_id, value / 100 AS p, event_id % 8 AS depth, (event_type <> 'error')::INT AS m FROM events),
r AS (SELECT user_id, m * exp(-depth / 4.0) AS w, -ln(greatest(p, 1e-12)) AS ce, abs(p - 0.5) AS tv FROM e),
c AS (SELECT *, greatest(0.3, 0) - 0.3 * least(greatest(1 - tv, 0), 1) + ln(1 + exp(-0.3)) AS conf FROM r)
SELECT user_id, round(sum(ce * w) / greatest(sum(w), 1), 6) AS ce, round(sum(tv * w) / greatest(sum(w), 1), 6) AS tv, round(sum(conf * w) / greatest(sum(w), 1), 6) AS conf, round(0.1 * sum(ce * w) / greatest(sum(w), 1) + 0.9 * sum(tv * w) / greatest(sum(w), 1) + sum(conf * w) / greatest(sum(w), 1), 6) AS loss FROM c GROUP BY user_id""")
def g21_distribution_objective(t):
    p = F.col("value") / 100
    e = t.events.select("user_id", F.array(p, 1 - p).alias("draft"), F.array(F.lit(0.5), F.lit(0.5)).alias("teacher"), F.lit(0).alias("target"), F.lit(0.3).alias("logit"), (F.col("event_type") != "error").cast("int").alias("mask"), (F.col("event_id") % 8).alias("depth"))
    r = G.distribution_objective(e, ["user_id"], 4.0)
    return r.select("user_id", *[F.round(c, 6).alias(c) for c in ("ce", "tv", "conf", "loss")])


@query("""SELECT event_type AS batch, CASE event_type WHEN 'click' THEN 'wrong number of workers' WHEN 'view' THEN 'devices changed' ELSE 'negative bytes' END AS violation FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('click', 'view', 'purchase')""")
def n20_worker_identities(t):
    kind = F.col("event_type")
    rows = t.events.select(kind.alias("batch")).distinct().crossJoin(t._spark.range(3).withColumnRenamed("id", "rank"))  # five batches of three workers
    rows = rows.where((F.col("batch") != "click") | (F.col("rank") < 2))
    # names order the batches: "click" is the first, in which each rank's device is set
    device = F.when((F.col("batch") == "view"), (F.col("rank") + 1) % 3).otherwise(F.col("rank"))
    rows = rows.select("batch", "rank", device.alias("physical_device"), F.when(F.col("batch") == "purchase", -1).otherwise(1).alias("allocated_peak_bytes"), F.lit(1).alias("reserved_peak_bytes"))
    return tools.worker_identities(rows, 3)


@query("SELECT count(*) AS samples, sum(event_id % 50)::BIGINT AS completion_tokens, 8.0::DOUBLE AS wall_seconds, sum(event_id % 50) / 8.0 AS tps, round(avg(value), 9) AS mean_latency FROM events")
def g17_run_summary(t):
    s = tools.run_summary(t.events.select((F.col("event_id") % 50).alias("completion_tokens"), F.col("value").alias("latency_seconds")), 8.0)
    return s.withColumn("mean_latency", F.round("mean_latency", 9))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'exact_match' END AS metric, CASE WHEN doc_id % 2 = 1 THEN source END AS reference FROM documents""")
def n18_evaluations(t):
    raw = F.when(F.col("doc_id") % 2 == 1, F.to_json(F.struct(F.lit("exact_match").alias("metric"), F.col("source").alias("reference")))).when(F.col("doc_id") % 4 == 0, "null")
    return tools.evaluation_contract(t.documents.select("doc_id", raw.alias("evaluation_json"))).select("doc_id", "metric", "reference")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'image' WHEN doc_id % 3 = 1 THEN 'audio+image' ELSE 'text' END AS modality, CASE WHEN doc_id % 5 = 0 THEN 'no text' END AS violation FROM documents""")
def c18_records(t):
    k, none = F.col("doc_id") % 3, F.array().cast("array<string>")
    d = t.documents.select("doc_id", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("source")).alias("text"), F.when(k < 2, F.array(F.lit("/p"))).otherwise(none).alias("image"), F.when(k == 1, F.array(F.lit("/a"))).alias("audio"), none.alias("video"), F.lit(None).cast("string").alias("evaluation"))
    return tools.records(d).select(F.col("condition_id").cast("long").alias("doc_id"), "modality", "violation")


@query("""SELECT user_id, c.counter, CASE c.counter WHEN 'num_drafts' THEN 2.0 * user_id WHEN 'num_draft_tokens' THEN 5 ELSE 150 END::DOUBLE AS value, CASE WHEN user_id % 3 = 0 THEN 'incomplete' END AS violation
FROM (SELECT DISTINCT user_id FROM events), (VALUES ('num_drafts'), ('num_draft_tokens'), ('num_accepted_tokens')) c(counter) WHERE user_id % 3 <> 0 OR c.counter <> 'num_draft_tokens'""")
def a14_counters(t):
    names = list(files.COUNTERS)
    line = F.concat(F.lit(f"# HELP x\n{names[0]}{{a=\"1\"}} "), "user_id", F.lit(f"\n{names[0]}{{a=\"2\"}} "), "user_id", F.lit(f"\nother 3\n{names[2]} 1.5e2\r\n"), F.when(F.col("user_id") % 3 != 0, F.lit(f"{names[1]} 5")).otherwise(""))
    d = t.events.select("user_id").distinct().select("user_id", line.alias("text"))
    return files.counters(d, "text", ["user_id"])


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def k7_windowed_counts(t):
    """The streaming aggregate, run over the table as one batch."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ledger.windowed_counts(e, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, count(*) AS events FROM events GROUP BY user_id")
def k3_last_states(t):
    return ledger.last_states(t.events, "user_id", "event_id", "event_type")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def k1_without_done(t):
    done = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return ledger.without_done(t.events.select("event_id", "user_id"), done, "user_id").select("event_id")


@query("""WITH r AS (SELECT event_type, list(event_id % 100 ORDER BY event_id) AS p, count(*) AS n, sum(event_id % 100)::BIGINT AS prompts, sum(event_id % 50)::BIGINT AS completions FROM events GROUP BY event_type)
SELECT event_type, n AS requests, prompts AS prompt_tokens, completions AS completion_tokens, round(n / 2.0, 6) AS requests_per_second, round((prompts + completions) / 2.0, 6) AS total_tokens_per_second FROM r""")
def g12_flat_throughput(t):
    r = t.events.groupBy("event_type").agg(F.collect_list(F.col("event_id") % 100).alias("p"), F.collect_list(F.col("event_id") % 50).alias("c"))
    x = G.flat_throughput(F.col("p"), F.col("c"), F.array(F.lit(0.5), F.lit(1.5)))
    return r.select("event_type", x.alias("x")).select("event_type", "x.requests", "x.prompt_tokens", "x.completion_tokens", F.round("x.requests_per_second", 6).alias("requests_per_second"), F.round("x.total_tokens_per_second", 6).alias("total_tokens_per_second"))


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 4 = 1 THEN 'bytes' ELSE 'sha256' END AS reason FROM documents WHERE doc_id % 4 < 3""")
def n10_verified_files(t):
    k = F.col("doc_id") % 4
    now = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"), k.alias("k"))
    then = now.select("path", F.when(F.col("k") == 1, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("k") == 2, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return K.verified_files(then, now.where("k <> 0"))


@query("""SELECT sha256('[' || string_agg('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']') AS fingerprint, count(*) AS n FROM nation""")
def n12_fixture_fingerprint(t):
    return K.fixture_fingerprint(t.nation, "n_nationkey", ["n_nationkey", "n_name"])
