import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import metrics as G
from sparkloom.operators import sequence as S
from sparkloom.violations import ContractError


def next_fit(rows, cap):
    want, used, seg = {}, {}, {}
    for g, i, n in rows:
        n, u = n or 0, used.get(g, 0)
        if u and u + n > cap:
            seg[g], u = seg.get(g, 0) + 1, 0
        want[g, i] = seg.get(g, 0), u
        used[g] = u + n
    return want


@pytest.mark.parametrize("cap, most, seed", [(100, 40, 1), (1, 3, 2), (10**6, 50, 3), (50, 200, 4)])
def test_one_shard_in_many_tasks(spark, cap, most, seed):
    """A group that is nearly all rows lies in many ranges; zeros, rows beyond the cap and gaps of any kind occur."""
    rng = random.Random(seed)
    rows = [("hot", i, rng.choice([None, 0, rng.randint(0, most), rng.randint(0, most)])) for i in range(4000)] + [("b", i, rng.randint(0, most)) for i in range(7)] + [(None, 1, 5), (None, 2, cap)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "kept") for r in rows], "g string, i long, n long, part string").repartition(5)
        got = S.segments(df, "n", "i", cap, ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert {(r.g, r.i): (r.segment, r.offset) for r in got} == next_fit(rows, cap) and {r.part for r in got} == {"kept"}


def test_what_a_range_does_to_the_open_segment():
    rng = random.Random(6)
    for _ in range(300):
        cap, sizes = rng.randint(1, 30), [rng.choice([0, 0, rng.randint(0, 40)]) for _ in range(rng.randint(1, 30))]
        at, end, leaves, opened = S._opened(np.array(sizes, np.int64), cap)
        for used in range(0, 60):
            u, n = used, 0
            for s in sizes:
                if u and u + s > cap:
                    u, n = 0, n + 1
                u += s
            first = max(np.searchsorted(end, cap - used, side="right"), np.searchsorted(at, -used, side="right"))
            assert (u, n) == ((leaves[first], opened[first]) if first < len(at) else (used + sum(sizes), 0))


def test_visible_intervals_expand_to_the_mask(spark):
    rng = random.Random(2)
    block, context, anchors, want = 4, [], [], {}
    for sample in ("a", "b", None, "empty"):
        n = 0 if sample == "empty" else rng.randint(1, 60)
        mask = [rng.random() < 0.7 for _ in range(n)]
        context += [(sample, i, m) for i, m in enumerate(mask)]
        places = sorted(rng.sample(range(0, n + 3), min(n + 3, 6)))
        for q, a in enumerate(places):
            keep = rng.random() < 0.8
            anchors.append((sample, a, keep))
            want[sample, a] = {i for i in range(min(a, n)) if mask[i]} if keep and sample is not None else set(), range(n + q * block, n + (q + 1) * block)
    got = S.visible_intervals(spark.createDataFrame(anchors, "s string, anchor int, keep boolean"), spark.createDataFrame(context, "s string, pos int, mask boolean"), "s", block).collect()
    assert len(got) == len(anchors)
    for r in got:
        if r.s is not None:
            assert {i for b, e in r.context for i in range(b, e)} == want[r.s, r.anchor][0] and range(r.own.begin, r.own.end) == want[r.s, r.anchor][1]
            assert all(x.end < y.begin for x, y in zip(r.context, r.context[1:], strict=False))


def test_dense_scores_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 7)
    rng = np.random.default_rng(1)
    left = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(40, None), (41, [1.0])]
    right = [(f"k{i}", rng.normal(size=5).tolist()) for i in range(23)]
    a, b = spark.createDataFrame(left, "r long, v array<double>").repartition(3), spark.createDataFrame(right, "k string, v array<double>").repartition(2)
    got = {(r.r, r.k): r.score for r in G.dense_scores(a, b, "r", "k", "v").collect()}
    assert len(got) == 42 * 23
    for i, v in left:
        for k, w in right:
            x = np.zeros(5)
            x[: len(v or [])] = v or []
            assert abs(got[i, k] - x @ np.array(w)) < 1e-9
    assert G.dense_scores(a, b.limit(0), "r", "k", "v").collect() == []


def captures(spark, runs):
    rng = np.random.default_rng(3)
    base = {s: rng.normal(size=30) for s in ("hidden", "logits")}
    return spark.createDataFrame([(r, s, i, float(x + off)) for r, off in runs.items() for s, v in base.items() for i, x in enumerate(v)], "run string, stream string, index long, value double")


def test_gate_calibration(spark):
    floors = {"one_minus_cosine": 1e-8, "max_abs": 1e-4, "mean_abs": 1e-4}
    df = captures(spark, {"r0": 0.0, "r1": 0.001, "r2": -0.002, "shifted": 0.5, "plain": -0.4})
    c = G.gate_calibration(df, ["r0", "r1", "r2"], ["shifted", "plain"], floors)
    rows = {(r.stream, r.metric): r for r in c.collect()}
    assert len(rows) == 6 and all(r.separates for r in rows.values())
    assert abs(rows["hidden", "max_abs"].bound - 0.006) < 1e-9 and abs(rows["hidden", "max_abs"].least_control - 0.4) < 1e-9
    bounds = G.calibrated_gate(c)
    close = captures(spark, {"r0": 0.0, "r1": 0.001, "r2": -0.002, "near": 0.004})
    with pytest.raises(ContractError, match="not below every control"):
        G.calibrated_gate(G.gate_calibration(close, ["r0", "r1", "r2"], ["near"], floors))
    with pytest.raises(ContractError, match="different shape"):
        G.gate_calibration(df.where("run <> 'r1' or index < 29"), ["r0", "r1", "r2"], ["shifted"], floors).collect()
    for runs, controls, bad in ((["r0", "r1"], ["plain"], floors), (["r0", "r1", "r2"], [], floors), (["r0", "r1", "r2"], ["plain"], {"max_abs": 1.0})):
        with pytest.raises(ContractError):
            G.gate_calibration(df, runs, controls, bad)
    placed = lambda d: d.select("stream", (F.col("index") / 10).cast("int").alias("position"), (F.col("index") % 10).alias("index"), "value")
    reference = placed(df.where("run = 'r0'"))
    assert all(r.passed for r in G.gate_report(reference, placed(df.where("run = 'r1'")), bounds, "logits").collect())
    moved = reference.withColumn("value", F.when((F.col("stream") == "logits") & (F.col("position") == 1), -F.col("value")).otherwise(F.col("value")))
    report = {(r.stream, r.metric): r for r in G.gate_report(reference, moved, bounds, "logits").collect()}
    assert report["logits", "top1"].error == 1.0 and not report["logits", "top1"].passed and not report["logits", "max_abs"].passed and report["hidden", "max_abs"].passed
    short = {(r.stream, r.metric): r.passed for r in G.gate_report(reference, reference.where("position < 2"), bounds, "logits").collect()}
    assert not any(short.values())
