import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import simhash_vptree as m

from .texts import corpus, frame, near_copy, prose


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, reach=2):
    fps = [fingerprint(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(repr((d, f"{fps[i]:016x}", least[find(i)])) for i, (d, _) in enumerate(rows))


def docs(seed=3):
    rng = random.Random(seed)
    base = prose(rng, 400)
    rows = corpus()
    return rows + [(1000 + i, near_copy(rng, base, 0.002 * (i % 12))) for i in range(60)] + [(2000, "A b C"), (2001, "a  B\tc"), (2002, "a b"), (None, "a b")]


@pytest.mark.parametrize("shard, leaf", [(1 << 15, 192), (24, 8)])
def test_matches_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(m, "SHARD", shard)
    monkeypatch.setattr(m, "LEAF", leaf)
    got = m.near_groups(frame(spark, docs(), more=True)).collect()
    want = brute(docs())
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got})


def test_query_and_empty_tables(spark, tmp_path):
    frame(spark, docs(5)).write.parquet(f"{tmp_path}/documents.parquet")
    got = m.op11_simhash_vptree(spark, str(tmp_path)).collect()
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == brute(docs(5))
    assert m.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = m.near_groups(spark.createDataFrame([(None, ""), (None, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in only] == [(None, "0" * 16, None)] * 2


def test_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "`the.id` long, `the.text` string")
    assert {r.component_id for r in m.near_groups(df, "the.id", "the.text").collect()} == {1}


def test_hash_is_that_of_the_session(spark):
    words = ["a b c", "ta n do", "é ü ß", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] % (1 << 64) for r in got] == [xxhash.xxh64_intdigest(w.encode(), m.SEED) for w in words] == [m.fingerprint(w.encode()) if len(w.split()) <= 3 else 0 for w in words]


def clustered(n, seed):
    """Distinct points around few centers, many pairs within reach."""
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    out = centers[rng.integers(0, 5, n)]
    for _ in range(4):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(np.concatenate([out, rng.integers(0, 1 << 63, n, dtype=np.uint64)]))


def all_pairs(points, reach):
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= reach)
    return {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}


@pytest.mark.parametrize("reach", [0, 2, 5])
def test_trees_lose_no_pair(monkeypatch, reach):
    monkeypatch.setattr(m, "SHARD", 100)
    monkeypatch.setattr(m, "LEAF", 16)
    points = clustered(1500, 1)
    np.random.default_rng(2).shuffle(points)
    want = all_pairs(points, reach)
    assert {(min(a, b), max(a, b)) for i, j in m.near_pairs(points, reach) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want
    tree = m.upper_tree(points[::7], len(points), reach)
    assert len(tree) > 4
    met, held = set(), 0
    for _, at in m.shards_of(points, tree, reach):
        held += len(at)
        met |= {tuple(sorted((int(at[a]), int(at[b])))) for a, b in all_pairs(points[at], reach)}
    assert met == want and held < 30 * len(points)


def test_a_part_that_cannot_be_split_is_compared_in_pieces(monkeypatch):
    monkeypatch.setattr(m, "split", lambda points, reach: None)
    monkeypatch.setattr(m, "AREA", 5000)
    points = clustered(900, 3)
    got = [{(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} for i, j in m.near_pairs(points, 2)]
    assert len(got) > 50 and set().union(*got) == all_pairs(points, 2)


def test_branches_are_pruned(monkeypatch):
    """Random points: the tree compares a small part of all pairs."""
    points = np.unique(np.random.default_rng(4).integers(0, 1 << 63, 30000, dtype=np.uint64))
    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(m.np, "bitwise_count", lambda x: seen.append(x.size) or count(x))
    list(m.near_pairs(points, 2))
    assert sum(seen) < len(points) ** 2 / 10
