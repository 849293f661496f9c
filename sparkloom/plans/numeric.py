"""Profiles, objectives, rankings and vector comparisons over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import vectors as V
from ..operators import metrics as G
from .registry import query


@query("""SELECT event_type, count(*) AS observed, 0::BIGINT AS missing, round(avg(value * 1000), 6) AS mean_ms, round(quantile_cont((value * 1000)::DOUBLE, 0.5), 6) AS p50_ms, round(quantile_cont((value * 1000)::DOUBLE, 0.95), 6) AS p95_ms,
 round(quantile_cont((value * 1000)::DOUBLE, 0.99), 6) AS p99_ms, round(max(value * 1000), 6) AS max_ms FROM events GROUP BY event_type""")
def g13_latency(t):
    return t.events.groupBy("event_type").agg(*G.latency_ms(F.col("value")))


@query("""WITH r AS (SELECT CASE WHEN grouping(event_type) = 1 THEN 'overall' ELSE event_type END AS scope, count(*) AS requests, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(event_id % 50 + 1)::BIGINT AS completion_tokens FROM events GROUP BY GROUPING SETS ((event_type), ())),
b AS (SELECT event_type, user_id, count(*) AS requests, (1 + user_id % 3) * 0.5 AS e, (1 + user_id % 3) * 0.75 AS o FROM events GROUP BY event_type, user_id),
s AS (SELECT CASE WHEN grouping(event_type) = 1 THEN 'overall' ELSE event_type END AS scope, count(*) AS batches, sum(requests) AS ib, sum(e)::DOUBLE AS e, sum(o)::DOUBLE AS o FROM b GROUP BY GROUPING SETS ((event_type), ()))
SELECT scope, requests, batches, prompt_tokens, completion_tokens, requests = ib AS aligned, round(requests / e, 6) AS engine_requests_per_second, round(completion_tokens / e, 6) AS engine_completion_tokens_per_second, round((prompt_tokens + completion_tokens) / e, 6) AS engine_total_tokens_per_second,
 round(requests / o, 6) AS end_to_end_requests_per_second, round(completion_tokens / o, 6) AS end_to_end_completion_tokens_per_second, round((prompt_tokens + completion_tokens) / o, 6) AS end_to_end_total_tokens_per_second FROM r JOIN s USING (scope)""")
def g11_throughput(t):
    r = t.events.select("event_type", (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 50 + 1).alias("completion_tokens"))
    b = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("requests")).withColumn("engine_seconds", (1 + F.col("user_id") % 3) * 0.5).withColumn("end_to_end_seconds", (1 + F.col("user_id") % 3) * 0.75)
    return G.throughput(r, b, "event_type")


@query("""WITH x AS (SELECT lang, CASE WHEN quality IS NOT NULL THEN quality = 1 END AS ok FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS scope, count(ok) AS evaluated, count(*) FILTER (ok IS NULL) AS skipped, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / nullif(count(ok), 0), 6) AS accuracy FROM x GROUP BY GROUPING SETS ((lang), ())""")
def g14_accuracy(t):
    return G.accuracy(t.documents.join(t.labels, "doc_id", "left").select("lang", (F.col("quality") == 1).alias("ok")), "lang", "ok")


@query("""WITH m AS (SELECT event_id // 20 AS batch, user_id AS rank, max((value * 100)::BIGINT) AS cur, sum((value * 100)::BIGINT)::BIGINT AS peak FROM events GROUP BY ALL),
r AS (SELECT rank, max(cur) AS c, max(peak) AS p, max_by(cur, batch) AS l FROM m GROUP BY rank), b AS (SELECT sum(peak) AS s FROM m GROUP BY batch)
SELECT max(c) AS max_current, max(p) AS max_peak, max(l) AS max_last, (SELECT max(s)::BIGINT FROM b) AS max_batch_peak FROM r""")
def g15_memory_peaks(t):
    cents = F.rint(F.col("value") * 100).cast("long")
    m = t.events.groupBy(F.floor(F.col("event_id") / 20).alias("batch"), F.col("user_id").alias("rank")).agg(F.max(cents).alias("cur"), F.sum(cents).alias("peak"))
    return G.memory_peaks(m, "batch", "rank", "cur", "peak")


@query("""WITH c AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS cut FROM events), b AS (SELECT event_type, count(*) AS v FROM events, c WHERE epoch_us(ts) < cut GROUP BY 1), a AS (SELECT event_type, count(*) AS v FROM events GROUP BY 1)
SELECT event_type, a.v - b.v AS delta, a.v < b.v AS bad FROM a JOIN b USING (event_type)""")
def g16_counter_delta(t):
    """Counters at the middle of the time span and at its end."""
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("v"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = t.events.agg(F.floor((F.min(micros) + F.max(micros)) / 2)).first()[0]
    return G.counter_delta(count(t.events.where(micros < cut)), count(t.events), "event_type", "v")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def g6_histogram(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS samples, sum(n_chars)::BIGINT AS total_tokens, string_agg(DISTINCT source, ',' ORDER BY source) AS segments FROM documents")
def g5_manifest(t):
    from ..operators import packed

    m = packed.manifest(t.documents.select(F.col("n_chars").alias("tokens"), F.col("source").alias("segment")))
    return m.withColumn("segments", F.array_join("segments", ","))


@query("SELECT user_id, round(coalesce(sum((value * 100)::BIGINT)::DOUBLE / nullif(sum(event_id % 7), 0), 0.0), 6) AS ratio FROM events GROUP BY user_id")
def g24_ratio_of_sums(t):
    e = t.events.select("user_id", F.rint(F.col("value") * 100).cast("long").alias("a"), (F.col("event_id") % 7).alias("b"))
    return G.ratio_of_sums(e, ["user_id"], "a", "b").withColumn("ratio", F.round("ratio", 6))


@query("""WITH e AS (SELECT user_id, value, (event_type <> 'error')::INT AS m, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 8 AS depth FROM events)
SELECT user_id, round(sum(value * m * exp(-depth / 4.0)) / greatest(sum(m * exp(-depth / 4.0)), 1.0), 6) AS objective FROM e GROUP BY user_id""")
def g19_depth_weighted(t):
    from pyspark.sql import Window

    depth = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) % 8
    e = t.events.select("user_id", "value", (F.col("event_type") != "error").alias("m"), depth.alias("depth")).withColumn("m", F.col("m").cast("int"))
    return G.depth_weighted(e, ["user_id"], "value", "m", "depth", 4.0).select("user_id", F.round("objective", 6).alias("objective"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i, label FROM embeddings), m AS (SELECT vec_id, max(v) AS m FROM e GROUP BY vec_id)
SELECT e.vec_id, round(any_value(m)::DOUBLE + ln(sum(exp(v::DOUBLE - m::DOUBLE))) - max(v::DOUBLE) FILTER (i = e.vec_id % 64), 6) AS nll FROM e JOIN m USING (vec_id) GROUP BY e.vec_id""")
def g22_nll(t):
    s = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"), (F.col("vec_id") % 64).alias("target")).withColumn("v", F.col("v").cast("double"))
    return G.nll(s, "vec_id", "i", "v", "target").withColumn("nll", F.round("nll", 6))


@query("SELECT vec_id, i::BIGINT AS i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rank FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings) QUALIFY rank <= 4")
def h14_top_k(t):
    s = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return G.top_k(s, ["vec_id"], "v", "i", 4).select("vec_id", F.col("i").cast("long"), "rank")


@query("SELECT vec_id, i::BIGINT AS i FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) = 1")
def h15_argmax(t):
    s = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return G.argmax(s, ["vec_id"], "v", "i").select("vec_id", F.col("i").cast("long"))


@query("""WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), p AS (SELECT label, x, x + ((vec_id + i) % 5 - 2) * 0.01 AS y FROM e)
SELECT label, round(greatest(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 0), 6) AS one_minus_cosine, round(max(abs(x - y)), 6) AS max_abs, round(avg(abs(x - y)), 6) AS mean_abs FROM p GROUP BY label""")
def g25_stream_errors(t):
    e = t.embeddings.select("label", "vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double")).withColumn("k", F.col("vec_id") * 64 + F.col("i"))
    other = e.withColumn("v", F.col("v") + ((F.col("vec_id") + F.col("i")) % 5 - 2) * 0.01)
    r = G.stream_errors(e, other, ["label"], "k", "v")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("one_minus_cosine", "max_abs", "mean_abs")])


@query("""WITH m AS (SELECT n_regionkey AS r, abs(n_nationkey - 10) * 0.5 AS v FROM nation), b AS (SELECT r, greatest(0.25, 2 * max(v))::DOUBLE AS bound FROM m WHERE r < 4 GROUP BY r)
SELECT m.r, m.v::DOUBLE AS v, bound, coalesce(m.v <= bound, false) AS passed FROM m LEFT JOIN b USING (r)""")
def g26_gate(t):
    m = t.nation.select(F.col("n_regionkey").alias("r"), (F.abs(F.col("n_nationkey") - 10) * 0.5).alias("v"))
    return G.gate(m, G.calibrated_bounds(m.where("r < 4"), ["r"], "v", 0.25), ["r"], "v")


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def j4_cosine(t):
    a = t.embeddings.select("vec_id", "embedding")
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / 64 + 0.000001)))), 6) AS mass FROM embeddings""")
def j2_rms_norm(t):
    n = V.rms_norm(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("mass"))


@query("SELECT vec_id, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite FROM embeddings")
def j8_finite(t):
    return t.embeddings.select("vec_id", V.finite(F.col("embedding")).alias("finite"))


@query("""SELECT i AS step, round(CASE WHEN i < 10 THEN (i + 1) / 10.0 ELSE 0.5 * (1 + cos(pi() * least(greatest((i - 10) / 90.0, 0), 1))) END, 6) AS rate FROM range(0, 120) r(i)""")
def j7_cosine_schedule(t):
    return t._spark.range(120).select(F.col("id").alias("step"), F.round(V.cosine_schedule(F.col("id"), 10, 100), 6).alias("rate"))


@query("SELECT event_id, CASE WHEN s > 0 AND e > 0 AND e >= s THEN round(e - s, 6) END AS seconds FROM (SELECT event_id, value - 20 AS s, 60 - value / 2 AS e FROM events)")
def j3_interval(t):
    return t.events.select("event_id", F.round(V.interval(F.col("value") - 20, 60 - F.col("value") / 2), 6).alias("seconds"))


@query("SELECT n_nationkey, (7 + 1000003 * n_regionkey + 10000019 * n_nationkey)::BIGINT AS seed FROM nation")
def j11_seed(t):
    return t.nation.select("n_nationkey", H.rank_epoch_seed(F.lit(7).cast("long"), F.col("n_regionkey"), F.col("n_nationkey")).alias("seed"))


@query("SELECT doc_id, ('0x' || left(sha256(text), 16))::UBIGINT::VARCHAR AS seed FROM documents")
def d5_seed(t):
    return t.documents.select("doc_id", H.seed_big(F.col("text")).cast("string").alias("seed"))


@query()
def d4_stable_ids(t):
    return t.documents.select("doc_id", H.stable_hex(F.col("source"), F.col("text")).alias("id"), H.stable_int(F.col("source"), F.col("text")).alias("number"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT label, min(vec_id) AS vec_id FROM e GROUP BY label)
SELECT p.label AS prev, n.label AS next, round(list_dot_product(a.v, b.v), 6) AS score FROM l p JOIN l n ON n.label = (p.label + 1) % 8 JOIN e a ON a.vec_id = p.vec_id JOIN e b ON b.vec_id = n.vec_id""")
def j5_low_rank_scores(t):
    from ..operators import packed

    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").alias("id"), "vector")
    pairs = first.select(F.col("id").alias("prev"), ((F.col("id") + 1) % 8).alias("next"))
    return packed.low_rank_scores(pairs, first, first).withColumn("score", F.round("score", 6))


@query("""SELECT user_id, event_id, round(coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) * 0.25 + value * 0.75, 6) AS mixed FROM events""")
def j6_two_tap(t):
    from ..operators import packed

    e = packed.two_tap(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", (0.25, 0.75))
    return e.select("user_id", "event_id", F.round("mixed", 6).alias("mixed"))


@query("""WITH x AS (SELECT event_id % 64 AS g, value, (event_type <> 'error')::INT AS m, event_id % 8 AS d, event_id % 3 AS t FROM events),
r AS (SELECT g, m * exp(-d / 4.0) AS w, value, m, CASE WHEN t < 2 THEN ln(exp(1.0) + exp(0.5)) - CASE t WHEN 0 THEN 1.0 ELSE 0.5 END END AS ce FROM x)
SELECT g, round(sum(value * w) / greatest(sum(w), 1), 6) AS base_loss, round(coalesce(sum(CASE WHEN m = 1 THEN ce * w END), 0) / (coalesce(sum(CASE WHEN m = 1 AND ce IS NOT NULL THEN w END), 0) + 0.000001), 6) AS selector_loss,
 round((sum(value * w) + coalesce(sum(CASE WHEN m = 1 THEN ce * w END), 0)) / greatest(sum(w), 1), 6) AS loss, count(*) FILTER (m = 1 AND ce IS NOT NULL) AS hits, sum(m)::BIGINT AS total FROM r GROUP BY g""")
def g20_selector_objective(t):
    e = t.events.select((F.col("event_id") % 64).alias("g"), F.col("value").alias("nll"), (F.col("event_type") != "error").cast("int").alias("mask"), (F.col("event_id") % 8).alias("depth"), (F.col("event_id") % 3).cast("int").alias("target"))
    e = e.withColumn("candidates", F.array(F.lit(0), F.lit(1))).withColumn("scores", F.array(F.lit(1.0), F.lit(0.5)))
    r = G.selector_objective(e, ["g"], 4.0)
    return r.select("g", *[F.round(c, 6).alias(c) for c in ("base_loss", "selector_loss", "loss")], "hits", "total")
