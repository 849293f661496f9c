"""Profiling aggregates, objectives and rankings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import checkpointed
from ..violations import ContractError, require_empty
from .selection import ordered_index


def malformed_json(c: Column) -> Column:
    """True for a text that is no JSON object; null and the empty text are none at all."""
    whole = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(c)), F.lit("OBJECT")), F.lit(False))
    return F.coalesce(c, F.lit("")).cast("string").isNotNull() & (F.coalesce(c, F.lit("")) != "") & ~whole


def audit(df: DataFrame, key: str, text: str, json: str | None = None) -> DataFrame:
    """One row: rows, distinct keys, later occurrences of a key, empty keys and texts; with json, its malformed values."""
    blank = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", "") == "", F.lit(True))
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), (F.count(key) - F.countDistinct(key)).alias("n_duplicates"), count(blank(key)).alias("n_empty_keys"), count(blank(text)).alias("n_empty_texts"), *([count(malformed_json(F.col(json))).alias("n_malformed")] if json else []))


def quota(df: DataFrame, group: str, targets: DataFrame) -> DataFrame:
    """Rows against the target of each group; targets: group, target."""
    have = df.groupBy(group).agg(F.count("*").alias("n"))
    return targets.join(have, group, "full").select(group, F.coalesce("n", F.lit(0)).alias("n"), "target", (F.coalesce("n", F.lit(0)) - F.coalesce("target", F.lit(0))).alias("over"))


def latency_ms(seconds: Column, approximate: bool = False) -> list[Column]:
    """mean, p50, p95, p99, max in ms (linear interpolation) and how many values there are.

    Exact percentiles keep a group's distinct values; approximate ones (an
    observed value, rank error 1e-4) keep a sketch, for groups of any size.
    """
    ms = seconds * 1000
    percentile = (lambda c, p: F.percentile_approx(c, p, 10_000)) if approximate else (lambda c, p: F.percentile(c, F.lit(p)))
    r = lambda c: F.round(c, 6)
    return [F.count(seconds).alias("observed"), F.sum(seconds.isNull().cast("long")).alias("missing"), r(F.avg(ms)).alias("mean_ms"), r(percentile(ms, 0.5)).alias("p50_ms"), r(percentile(ms, 0.95)).alias("p95_ms"), r(percentile(ms, 0.99)).alias("p99_ms"), r(F.max(ms)).alias("max_ms")]


def throughput(requests: DataFrame, batches: DataFrame, kind: str = "modality") -> DataFrame:
    """Ratios of sums for each kind and for all ("overall"), on engine and outer time.

    requests: kind, prompt_tokens, completion_tokens; batches: kind, requests,
    engine_seconds, end_to_end_seconds. aligned tells whether the counts agree.
    """
    name = F.when(F.grouping(kind) == 1, "overall").otherwise(F.col(kind)).alias("scope")
    r = requests.groupingSets([[kind], []], kind).agg(name, F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")).drop(kind)
    b = batches.groupingSets([[kind], []], kind).agg(name, F.count("*").alias("batches"), F.sum("requests").alias("in_batches"), F.sum("engine_seconds").alias("engine_seconds"), F.sum("end_to_end_seconds").alias("end_to_end_seconds")).drop(kind)
    j = r.join(b, "scope")
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    rates = [F.round(top / F.nullif(F.col(f"{s}_seconds"), F.lit(0.0)), 6).alias(f"{s}_{n}_per_second") for s in ("engine", "end_to_end") for n, top in (("requests", F.col("requests")), ("completion_tokens", F.col("completion_tokens")), ("total_tokens", total))]
    return j.select("scope", "requests", "batches", "prompt_tokens", "completion_tokens", (F.col("requests") == F.col("in_batches")).alias("aligned"), *rates)


def flat_throughput(prompt: Column, completion: Column, batch_seconds: Column) -> Column:
    """struct of totals and rates from arrays: token counts of each request, seconds of each batch; null without
    requests, with counts that do not align, batches that took no time or no completion tokens."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x.cast("double"))
    p, c, t = total(prompt), total(completion), total(batch_seconds)
    n = F.size(prompt)
    whole = (n > 0) & (F.size(completion) == n) & (F.size(batch_seconds) > 0) & F.forall(batch_seconds, lambda x: x > 0) & (c > 0)
    rate = lambda x: x / F.nullif(t, F.lit(0.0))
    return F.when(whole, F.struct(n.cast("long").alias("requests"), p.cast("long").alias("prompt_tokens"), c.cast("long").alias("completion_tokens"), t.alias("measured_seconds"), rate(n).alias("requests_per_second"), rate(c).alias("completion_tokens_per_second"), rate(p + c).alias("total_tokens_per_second")))


def accuracy(df: DataFrame, kind: str, correct: str) -> DataFrame:
    """Evaluated, skipped (null) and correct rows and their share for each kind and overall."""
    name = F.when(F.grouping(kind) == 1, "overall").otherwise(F.col(kind)).alias("scope")
    hit = F.sum(F.col(correct).cast("long"))
    return df.groupingSets([[kind], []], kind).agg(name, F.count(correct).alias("evaluated"), F.sum(F.col(correct).isNull().cast("long")).alias("skipped"), F.coalesce(hit, F.lit(0)).alias("correct"), F.round(hit / F.nullif(F.count(correct), F.lit(0)), 6).alias("accuracy")).drop(kind)


def memory_peaks(df: DataFrame, batch: str, rank: str, current: str, peak: str) -> DataFrame:
    """One row: largest current and peak of a rank, and the largest sum over ranks of one batch."""
    per_rank = df.groupBy(rank).agg(F.max(current).alias("c"), F.max(peak).alias("p"), F.max_by(current, batch).alias("last"))
    a = per_rank.agg(F.max("c").alias("max_current"), F.max("p").alias("max_peak"), F.max("last").alias("max_last"))
    b = df.groupBy(batch).agg(F.sum(peak).alias("s")).agg(F.max("s").alias("max_batch_peak"))
    return a.crossJoin(b)  # one row each


def counter_delta(before: DataFrame, after: DataFrame, name: str, value: str) -> DataFrame:
    """after - before for each counter; negative ones are flagged."""
    x = before.select(name, F.col(value).alias("b")).join(after.select(name, F.col(value).alias("a")), name, "full")
    return x.select(name, (F.col("a") - F.col("b")).alias("delta"), F.coalesce(F.col("a") < F.col("b"), F.lit(True)).alias("bad"))


def acceptance_summary(drafts: Column, drafted: Column, accepted: Column) -> list[Column]:
    return [(1 + accepted / drafts).alias("mean_length"), (accepted / drafted).alias("rate")]


def ratio_of_sums(df: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """Sums first, then one division; 0.0 without a denominator."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(num) / F.nullif(F.sum(den), F.lit(0)), F.lit(0.0)).alias("ratio"))


def depth_weighted(df: DataFrame, by: list[str], loss: str, mask: str, depth: str, gamma: float) -> DataFrame:
    """Sum of l*m*w over max(sum of m*w, 1), w = exp(-depth / gamma)."""
    w = F.col(mask).cast("double") * V.depth_weight(F.col(depth), gamma)
    num, den = F.sum(F.col(loss) * w), F.sum(w)
    return df.groupBy(*by).agg((num / F.greatest(den, F.lit(1.0))).alias("objective"), num.alias("numerator"), den.alias("denominator"))


def selector_objective(df: DataFrame, by: list[str], gamma: float, weight: float = 1.0) -> DataFrame:
    """Base and selector terms over one denominator.

    df: nll, mask, depth, target, candidates (array) and scores (array). The
    slot is the target's first place among the candidates; a miss adds nothing.
    """
    w = F.col("mask").cast("double") * V.depth_weight(F.col("depth"), gamma)
    slot = F.array_position("candidates", F.col("target"))
    hit = (slot > 0) & (F.col("mask").cast("int") == 1)
    ce = F.when(hit, V.log_sum_exp(F.col("scores")) - F.get("scores", (slot - 1).cast("int")))
    rows = df.select(*by, w.alias("w"), (F.col("nll") * w).alias("base"), F.when(hit, w).otherwise(0.0).alias("sw"), F.coalesce(ce * w, F.lit(0.0)).alias("sel"), hit.cast("long").alias("hit"), F.col("mask").cast("long").alias("valid"))
    den = F.greatest(F.sum("w"), F.lit(1.0))
    return rows.groupBy(*by).agg((F.sum("base") / den).alias("base_loss"), (F.sum("sel") / (F.sum("sw") + 1e-6)).alias("selector_loss"), ((F.sum("base") + weight * F.sum("sel")) / den).alias("loss"), F.sum("hit").alias("hits"), F.sum("valid").alias("total"))


def distribution_objective(df: DataFrame, by: list[str], gamma: float, weights=(0.1, 0.9, 1.0)) -> DataFrame:
    """Weighted cross entropy, total variation and confidence terms.

    df: draft and teacher probabilities (arrays), target index, confidence
    logit, mask and depth.
    """
    tv = 0.5 * F.aggregate(F.zip_with("draft", "teacher", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda a, x: a + x)
    ce = -F.ln(F.greatest(F.get("draft", F.col("target")), F.lit(1e-12)))
    conf = V.bce_with_logits(F.col("logit"), F.least(F.greatest(1 - tv, F.lit(0.0)), F.lit(1.0)))
    rows = df.select(*by, "mask", "depth", ce.alias("ce"), tv.alias("tv"), conf.alias("conf"))
    w = F.col("mask").cast("double") * V.depth_weight(F.col("depth"), gamma)
    den = F.greatest(F.sum(w), F.lit(1.0))
    parts = [(F.sum(F.col(c) * w) / den) for c in ("ce", "tv", "conf")]
    total = sum((p * k for p, k in zip(parts, weights, strict=True)), F.lit(0.0))
    return rows.groupBy(*by).agg(*[p.alias(n) for p, n in zip(parts, ("ce", "tv", "conf"), strict=True)], total.alias("loss"))


def nll(scores: DataFrame, row: str, item: str, value: str, target: str) -> DataFrame:
    """log-sum-exp minus the target's score, as partial and final aggregates over a long table."""
    top = scores.groupBy(row).agg(F.max(value).alias("_top"))
    j = scores.join(top, row)
    return j.groupBy(row).agg((F.first("_top") + F.ln(F.sum(F.exp(F.col(value) - F.col("_top")))) - F.max(F.when(F.col(item) == F.col(target), F.col(value)))).alias("nll"))


def top_k(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k largest of each group with their rank; ties by the smaller id."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def argmax(df: DataFrame, by: list[str], value: str, item: str) -> DataFrame:
    """The item of the largest value; the smallest item among equals."""
    return df.groupBy(*by).agg((-F.max(F.struct(F.col(value).alias("v"), (-F.col(item)).alias("i")))["i"]).alias(item))


def stream_errors(a: DataFrame, b: DataFrame, by: list[str], index: str, value: str) -> DataFrame:
    """1 - cosine (not below 0), largest and mean absolute difference of two long tables."""
    j = a.select(*by, index, F.col(value).alias("x")).join(b.select(*by, index, F.col(value).alias("y")), [*by, index])
    cos = F.sum(F.col("x") * F.col("y")) / F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))), F.lit(0.0))
    d = F.abs(F.col("x") - F.col("y"))
    return j.groupBy(*by).agg(F.greatest(1 - cos, F.lit(0.0)).alias("one_minus_cosine"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))


def named_errors(a: DataFrame, b: DataFrame, name: str, index: str, value: str, exact: tuple[str, ...] = (), tolerance: float = 0.0) -> DataFrame:
    """name, errors and passed for each name of either table: the names in exact need equal values, the others
    a largest difference within the tolerance; an element that one table lacks fails."""
    j = a.select(name, index, F.col(value).alias("x"), F.lit(1).alias("_a")).join(b.select(name, index, F.col(value).alias("y"), F.lit(1).alias("_b")), [name, index], "full")
    d = F.abs(F.col("x").cast("double") - F.col("y").cast("double"))
    g = j.groupBy(name).agg(F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("long")).alias("unmatched"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))
    within = F.when(F.col(name).isin(*exact), F.col("max_abs") == 0) if exact else F.when(F.lit(False), F.lit(True))
    return g.withColumn("passed", (F.col("unmatched") == 0) & F.coalesce(within.otherwise(F.col("max_abs") <= tolerance), F.lit(False)))


#: Rows of a block of the matrix product, on either side.
BLOCK = 1024


def _blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """block, keys and matrix (float64, row by row, zeros behind short vectors) of the rows, BLOCK at most in each."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = [np.asarray(v if v is not None else [], np.float64) for v in part.column(2).to_pylist()]
                width = max(map(len, rows), default=0)
                m = np.zeros((len(rows), width))
                for i, r in enumerate(rows):
                    m[i, : len(r)] = r
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([part.column(1).to_pylist()], pa.list_(part.column(1).type)), pa.array([width], pa.int64()), pa.array([m.tobytes()])], names=["block", "keys", "width", "matrix"])

    rows = df.select(F.monotonically_increasing_id().alias("block"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), T.StructField("width", T.LongType()), T.StructField("matrix", T.BinaryType())]))


def dense_scores(left: DataFrame, right: DataFrame, row: str, item: str, vector: str) -> DataFrame:
    """row, item and score: the dot product of each vector of left with each of right, all of them, as asked.

    A blocked matrix product: both sides are packed to matrices of BLOCK
    rows, the blocks of left are dealt to those of right by an equi-join, and
    a task multiplies two blocks at a time. Shuffled are rows x blocks of the
    other side, not rows x rows. A shorter vector has zeros behind; a null one
    is all zeros.
    """
    a = checkpointed(_blocks(left, row, vector))
    b = checkpointed(_blocks(right, item, vector))
    # the blocks of right get numbers by range, so that each of left can name all of them
    numbers = ordered_index(b.select("block"), "block", "n")
    n = numbers.count()
    b = b.join(numbers, "block").select("n", F.col("keys").alias("items"), F.col("width").alias("w2"), F.col("matrix").alias("m2"))
    every = F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("n")
    pairs = a.select("keys", "width", "matrix", every).join(b, "n").select("keys", "items", "width", "matrix", "w2", "m2")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, items = batch.column(0)[i].values, batch.column(1)[i].values
                w1, m1, w2, m2 = (batch.column(k)[i].as_py() for k in range(2, 6))
                x, y = np.frombuffer(m1).reshape(len(keys), w1), np.frombuffer(m2).reshape(len(items), w2)
                w = min(w1, w2)
                s = x[:, :w] @ y[:, :w].T
                for r in range(0, len(keys), 64):
                    part = s[r : r + 64]
                    left_at = np.repeat(np.arange(r, r + len(part)), len(items))
                    right_at = np.tile(np.arange(len(items)), len(part))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(left_at)), items.take(pa.array(right_at)), pa.array(part.reshape(-1))], names=["row", "item", "score"])

    kind = lambda c: pairs.schema[c].dataType.elementType
    schema = T.StructType([T.StructField(row, kind("keys")), T.StructField(item, kind("items")), T.StructField("score", T.DoubleType())])
    return pairs.mapInArrow(run, schema)


def calibrated_bounds(pairs: DataFrame, by: list[str], metric: str, floor: float, factor: float = 2.0) -> DataFrame:
    return pairs.groupBy(*by).agg(F.greatest(F.lit(floor), factor * F.max(metric)).alias("bound"))


# The metrics of a capture gate.
GATE_METRICS = ("one_minus_cosine", "max_abs", "mean_abs")


def gate_calibration(captures: DataFrame, runs: list[str], controls: list[str], floors: dict[str, float], run: str = "run", stream: str = "stream", index: str = "index", value: str = "value") -> DataFrame:
    """stream, metric, worst, bound, least_control and separates of a gate calibrated on three runs.

    captures: one row a run, stream and index. worst is the largest error
    between two of the runs; the bound, max(floor, 2 * worst), has to lie
    below the error of every control against the first run (separates). The
    errors of all pairs come from one join of the captures with themselves on
    (stream, index), restricted to the pairs asked for. An element that one
    of the captures lacks, runs that are not three, or a missing floor raise.
    """
    if len(runs) != 3 or len({*runs, *controls}) != 3 + len(controls) or not controls:
        raise ContractError("a gate is calibrated on three runs and controls of other names")
    if set(floors) != set(GATE_METRICS) or min(floors.values()) < 0:
        raise ContractError("each metric needs a floor that is not negative")
    wanted = [(runs[i], runs[j], "run") for i in range(3) for j in range(i + 1, 3)] + [(runs[0], c, "control") for c in controls]
    c = captures.where(F.col(run).isin(runs + controls)).select(F.col(run).alias("run"), F.col(stream).alias("stream"), F.col(index).alias("index"), F.col(value).cast("double").alias("x"))
    per = c.groupBy("stream", "index").agg(F.count("*").alias("n"), F.countDistinct("run").alias("r"))
    _none(per.where((F.col("n") != 3 + len(controls)) | (F.col("r") != 3 + len(controls))), "stream", "captures of different shape")
    to = F.create_map(*[F.lit(x) for a in {w[0] for w in wanted} for x in (a, F.array(*[F.struct(F.lit(b).alias("other"), F.lit(k).alias("kind")) for o, b, k in wanted if o == a]))])
    left = c.select("run", "stream", "index", F.col("x"), F.explode(F.try_element_at(to, F.col("run"))).alias("to")).select("run", "stream", "index", "x", "to.other", "to.kind")
    both = left.join(c.select(F.col("run").alias("other"), "stream", "index", F.col("x").alias("y")), ["other", "stream", "index"])
    cos = F.sum(F.col("x") * F.col("y")) / F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))), F.lit(0.0))
    d = F.abs(F.col("x") - F.col("y"))
    errors = both.groupBy("stream", "run", "other", "kind").agg(F.greatest(1 - cos, F.lit(0.0)).alias("one_minus_cosine"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))
    long = errors.select("stream", "kind", F.explode(F.create_map(*[x for m in GATE_METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "error"))
    worst = F.max(F.when(F.col("kind") == "run", F.col("error")))
    found = long.groupBy("stream", "metric").agg(worst.alias("worst"), F.min(F.when(F.col("kind") == "control", F.col("error"))).alias("least_control"))
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), F.col("metric"))
    bound = F.greatest(floor, 2 * F.col("worst"))
    return found.select("stream", "metric", "worst", bound.alias("bound"), "least_control", (bound < F.col("least_control")).alias("separates"))


def _none(bad: DataFrame, key: str, what: str) -> None:
    require_empty(bad.select(key).distinct(), key, what)


def calibrated_gate(calibration: DataFrame) -> DataFrame:
    """The bounds of a calibration; one that a control could pass raises."""
    _none(calibration.where("not separates"), "stream", "a bound is not below every control's error")
    return calibration.select("stream", "metric", "bound")


def gate_report(reference: DataFrame, candidate: DataFrame, bounds: DataFrame, logits: str, stream: str = "stream", index: str = "index", value: str = "value", position: str = "position") -> DataFrame:
    """stream, metric, error, bound and passed of a candidate; the metric "top1" of the stream of logits counts the
    positions whose largest value (the first of equal ones) lies elsewhere, and none may.

    reference and candidate: stream, position, index in it, value. What one of them lacks, or a stream or metric without a bound, fails.
    """
    cols = [F.col(stream).alias("stream"), F.col(position).alias("position"), F.col(index).alias("index")]
    a, b = reference.select(*cols, F.col(value).cast("double").alias("x")), candidate.select(*cols, F.col(value).cast("double").alias("y"))
    j = a.join(b, ["stream", "position", "index"], "full")
    d = F.abs(F.col("x") - F.col("y"))
    lacking = F.max(F.col("x").isNull() | F.col("y").isNull())
    cos = F.sum(F.col("x") * F.col("y")) / F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))), F.lit(0.0))
    e = j.groupBy("stream").agg(F.greatest(1 - cos, F.lit(0.0)).alias("one_minus_cosine"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), lacking.alias("lacking"))
    long = e.select("stream", "lacking", F.explode(F.create_map(*[x for m in GATE_METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "error"))
    passed = ~F.col("lacking") & (F.col("error") <= F.col("bound"))
    rows = long.join(bounds, ["stream", "metric"], "full").select("stream", "metric", "error", "bound", F.coalesce(passed, F.lit(False)).alias("passed"))
    tops = j.where(F.col("stream") == logits).groupBy("stream", "position").agg(F.max(F.struct(F.col("x").alias("v"), (-F.col("index")).alias("i")))["i"].alias("p"), F.max(F.struct(F.col("y").alias("v"), (-F.col("index")).alias("i")))["i"].alias("q"))
    off = tops.groupBy("stream").agg(F.count_if(~F.col("p").eqNullSafe(F.col("q"))).cast("double").alias("error"))
    return rows.unionByName(off.select("stream", F.lit("top1").alias("metric"), "error", F.lit(0.0).alias("bound"), (F.col("error") == 0).alias("passed")))


def gate(measured: DataFrame, bounds: DataFrame, by: list[str], metric: str) -> DataFrame:
    return measured.join(bounds, by, "left").select(*by, metric, "bound", F.coalesce(F.col(metric) <= F.col("bound"), F.lit(False)).alias("passed"))


def run_pairs(runs: DataFrame, run: str) -> DataFrame:
    """Each unordered pair of runs once; runs are few (a table of names)."""
    names = runs.select(run).distinct()
    return names.select(F.col(run).alias("left")).join(names.select(F.col(run).alias("right")), F.col("left") < F.col("right"))
