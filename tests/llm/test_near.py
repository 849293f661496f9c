import random
import re
from pathlib import Path

import numpy as np
import pytest

from sparkloom.llm import bbit_minhash as m
from sparkloom.llm import common

from .texts import corpus, frame, held_to_sql, near_copy, prose


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    named = [i for i in range(len(rows)) if rows[i][0] is not None and sets[i]]
    for i in named:
        for j in named:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                top[b] = a
    return sorted((repr((d, len(s), None if d is None else find(d), d is None or find(d) == d)) for (d, _), s in zip(rows, sets, strict=True)))


@pytest.mark.parametrize("k", [2, 5])
def test_matches_brute_force(spark, k):
    rows = corpus()
    got = m.near_groups(frame(spark, rows, more=True), k=k).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == brute(rows, k)


def test_loose_family(spark):
    """Copies around the threshold: links run through chains, not to one center."""
    rng = random.Random(5)
    base = prose(rng, 150)
    rows = [(i, near_copy(rng, base, rng.random() * 0.15)) for i in range(250)]
    step = base
    for i in range(250, 290):
        step = near_copy(rng, step, 0.04)
        rows.append((i, step))
    got = m.near_groups(frame(spark, rows), k=2).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == brute(rows, 2)


def test_texts_of_one_id(spark):
    """One id has two texts of one set size; the copies of either are linked with it."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(4000)]
    x, y = (" ".join(rng.sample(words, 200)) for _ in range(2))
    close = lambda t: " ".join(t.split()[:-3] + ["p", "q", "r"])
    rows = [(1, x), (1, y), (2, close(x)), (3, close(y))]
    for order in (rows, rows[::-1]):
        got = m.near_groups(frame(spark, order), k=2).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_sets_are_dealt_once(spark):
    rows = spark.createDataFrame([(i, f"a b {i}") for i in range(50)], "doc_id long, text string").repartition(3)
    df = m._sets(rows, spark.range(50).withColumnRenamed("id", "node"), 2).repartition(4, "node").dropDuplicates(["node", "lo", "hi"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("MapInArrow")[0].count("Exchange") == 1


def test_empty_table(spark):
    assert m.near_groups(frame(spark, [(1, "")])).collect()[0].kept
    assert m.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_is_near_the_truth(spark):
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
    _, bits = m.signatures_of([x, y])
    row = [(bits[0].view(np.int64).tolist(), bits[1].view(np.int64).tolist())]
    est = spark.createDataFrame(row, "a array<long>, b array<long>").select(m.similarity("a", "b")).first()[0]
    assert abs(est - 0.8) < 0.1


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 3), (20, 21), (21, 22), (5, 5), (22, 23), (30, 40), (40, 35)]
    got = {r.node: r.component for r in m.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20, 23: 20, 30: 30, 40: 30, 35: 30}
    assert m.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("kept", [common._KEPT, 0])
def test_word_hashes_agree_with_split(monkeypatch, kept):
    monkeypatch.setattr(common, "_KEPT", kept)
    texts = ["a b  c", "", " x\ty\n", "éa b", "b" * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, s, e, at = common.word_hashes(offs, data)
    words = [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)]
    assert words == [w for t in texts for w in t.split()] and at.tolist() == [0, 3, 3, 5, 7, 8]
    # the hash as it is defined: a polynomial of the bytes, mixed with the length
    raw = [sum(int(common._BYTE[b]) * pow(common._BASE, i, 1 << 64) for i, b in enumerate(w.encode())) + len(w.encode()) * 0xD6E8FEB86659FD93 for w in words]
    assert h.tolist() == common._mix(np.array([x % (1 << 64) for x in raw], np.uint64)).tolist()
    assert h[1] == h[6] and len(set(h.tolist())) == len(set(words))


@pytest.mark.parametrize("block, visitors, indexed", [(16, 1 << 20, 2_000_000), (16, 16, 300), (8192, 8, 500)])
def test_tiles_of_any_size_find_all(spark, monkeypatch, block, visitors, indexed):
    for name, v in (("BLOCK", block), ("VISITORS", visitors), ("INDEXED", indexed)):
        monkeypatch.setattr(m, name, v)
    rng = random.Random(9)
    base = prose(rng, 120)
    rows = [(i, near_copy(rng, base, rng.random() * 0.3)) for i in range(150)]
    got = m.near_groups(frame(spark, rows), k=2).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == brute(rows, 2)


def test_half_similar_pages_do_not_meet_with_their_sets(spark, monkeypatch):
    """Pages of one template, no two linked: they are candidates by band, and the estimate alone parts them."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    shell = " ".join(rng.choice(words) for _ in range(120))
    rows = [(i, shell + " " + " ".join(rng.choice(words) for _ in range(60))) for i in range(1500)]
    met, written = {}, common.Scratch.written

    def spy(self, df, name):
        out = written(self, df, name)
        if name in ("tiles", "shared"):
            met[name] = out.count()
        return out

    monkeypatch.setattr(common.Scratch, "written", spy)
    got = m.near_groups(frame(spark, rows), k=2).collect()
    assert all(r.kept for r in got) and met["shared"] > 1500 and met["tiles"] <= 15


def test_stage_keeps_one_row_of_each_group(spark):
    a, b, c = (prose(random.Random(i), 80) for i in range(3))
    rows = [(5, a, "x"), (1, a, "x"), (5, b, "y"), (7, c, "z"), (7, c, "z"), (None, a, "n"), (None, None, "e"), (None, None, "e"), (9, "", "e"), (None, "only " + b, "q")]
    docs = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, row int, component int")
    got = m.dedup_stage(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    assert sorted(repr(tuple(r)[:3]) for r in got.collect()) == sorted(repr(r) for r in [(1, a, "x"), (5, b, "y"), (7, c, "z"), (None, None, "e"), (None, None, "e"), (9, "", "e")])
    assert m.dedup_stage(spark, docs.limit(0), "").collect() == []


def test_query_matches_its_sql(spark, tmp_path):
    rows = {d: t for d, t in corpus() if d is not None}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held_to_sql(m.op5_bbit_minhash(spark, str(tmp_path)), m.ORACLE["op5_bbit_minhash"], tmp_path, ["documents"])


def test_intermediate_tables_go(spark):
    m.near_groups(frame(spark, corpus()), k=2).collect()
    made = [Path(p.replace("file:", "")) for p in common._made]
    assert any(p.exists() for p in made)
    common.clean(spark)
    assert not any(p.exists() for p in made) and not common._made
