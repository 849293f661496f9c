import math
import random

import numpy as np
import pytest

from sparkloom.llm import norm_search as m

from .texts import held_to_sql

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, low=80, high=100, positives=5, negatives=5):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (a, x, c) in enumerate(kept):
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=False)), i, d) for k, (i, y, d) in enumerate(kept) if k != n]
        for s, i, _ in sorted(t for t in scored if t[2] == c)[:positives]:
            far = sorted(t for t in scored if t[2] != c and low * -s <= 100 * -t[0] <= high * -s)[:negatives]
            out += [(a, i, r, j, -s, -t) for r, (t, j, _) in enumerate(far, 1)]
    return sorted(out)


def vectors(seed=1, n=600, dims=8, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * math.exp(rng.gauss(0, spread)) for _ in range(dims)], rng.randrange(4)) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(40)] + [(100, rows[100][1], rows[100][2]), (200, rows[7][1], 2)] * 2
    return rows + [(None, rows[0][1], 1), (5000, None, 1), (5100, [1.0] * dims, None), (5200, [float("nan")] * dims, 1), (5300, [float("inf")] + [0.0] * (dims - 1), 1), (5400, [1.0, None] + [0.0] * (dims - 2), 1), (5500, [0.0] * dims, 2), (5600, [], 2), (5700, [1.0, 2.0], 3), (5800, [9e4] * dims, 0)]


@pytest.mark.parametrize("bucket, buckets, block", [(1024, 16, 512), (16, 3, 2)])
def test_matches_brute_force(spark, monkeypatch, bucket, buckets, block):
    for k, v in (("BUCKET", bucket), ("BUCKETS", buckets), ("BLOCK", block)):
        monkeypatch.setattr(m, k, v)
    rows = vectors()
    got = m.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows) and len(got) > 100


def test_other_numbers(spark):
    rows = vectors(2, 300)
    got = m.hard_negatives(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", score int, rows string"), every=50, positives=2, negatives=3, low=50, high=90).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 50, 50, 90, 2, 3)
    with pytest.raises(ValueError):
        m.hard_negatives(spark.createDataFrame(rows, SCHEMA), low=100, high=90)


def test_query_matches_its_sql(spark, tmp_path):
    rows = [r for r in vectors(3, 500, 12) if r[1] is None or len(r[1]) == 12]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    held_to_sql(m.op13_norm_search(spark, str(tmp_path)), m.ORACLE["op13_norm_search"], tmp_path, ["embeddings"])


def test_no_rows(spark):
    assert m.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert m.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)).collect() == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 + i), float(i), -3.5], i % 2) for i in range(120)]
    assert sorted(tuple(r) for r in m.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
    with pytest.raises(Exception, match="long integers|integer scores"):
        m.hard_negatives(spark.createDataFrame([(100, [1e30], 1), (1, [1e30], 1)], SCHEMA)).collect()


def bucket_of(vectors, first):
    ints = vectors.astype(np.int64)
    norms = np.sqrt((ints.astype(float) ** 2).sum(axis=1))
    ids = np.arange(first, first + len(ints))
    return {"n": len(ints), "kind": 8, "top": norms.max(), "rows": ids.tobytes(), "ids": ids.tobytes(), "norms": norms.tobytes(), "vectors": ints.tobytes(), "lows": b"", "highs": b""}


def test_short_buckets_are_pruned(monkeypatch):
    """Buckets below the window's lower limit, or below the k-th score, are not multiplied."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    buckets = [bucket_of(rng.normal(0, 1000 / 2**i, (50, 4)), 50 * i + 10) for i in range(12)]
    anchor = bucket_of(np.array([[500, 0, 0, 0]]), 0) | {"lows": np.array([[1 - m._FAR]]).tobytes(), "highs": np.array([[m._FAR]]).tobytes()}
    window = anchor | {"lows": np.array([[100_000]]).tobytes(), "highs": np.array([[120_000]]).tobytes()}
    plain = m.scores
    for block, most in ((anchor, 3), (window, 9)):
        seen = []
        monkeypatch.setattr(m, "scores", lambda a, b: seen.append(1) or plain(a, b))
        tile = [dict(block, block=0, shard=0, seq=-1, label=0, width=4)] + [dict(b, block=0, shard=0, seq=i, label=1, width=4) for i, b in enumerate(buckets)]
        out = list(m._searched(False, 5)([pa.RecordBatch.from_pylist(tile)]))
        assert 0 < len(seen) <= most
        every = np.concatenate([np.frombuffer(b["vectors"], np.int64).reshape(-1, 4)[:, 0] * 500 for b in buckets])
        lo, hi = np.frombuffer(block["lows"], np.int64)[0], np.frombuffer(block["highs"], np.int64)[0]
        assert sorted(out[0].column(4).to_pylist(), reverse=True) == sorted((int(x) for x in every if lo <= x <= hi), reverse=True)[:5]
