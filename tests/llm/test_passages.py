import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import fm_decontam as fm
from sparkloom.llm import line_templates as lt
from sparkloom.llm import suffix_dedup as sd

from .texts import corpus, frame, held_to_sql, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    out = []
    for d, t in rows:
        w, hit, found = fold(t), set(), set()
        for item, text in items:
            x = fold(text)
            n = min(10, len(x))
            wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x and item is not None else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out.append(repr((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(found))))
    return sorted(out)


def test_fm_index_finds_all():
    rng = np.random.default_rng(3)
    t = rng.integers(1, 6, 400)
    index = fm.FMIndex(t, 7)
    for n in (1, 2, 5):
        p = np.array([t[i : i + n] for i in rng.integers(0, 390, 20)] + [np.full(n, 6)])
        which, lo, hi = index.search(p)
        got = {k: [] for k in range(len(p))}
        for k, a, b in zip(which, lo, hi, strict=True):
            got[int(k)] = sorted(index.locate(np.arange(a, b)).tolist())
        for k in range(len(p)):
            assert got[k] == [i for i in range(len(t) - n + 1) if (t[i : i + n] == p[k]).all()]


@pytest.mark.parametrize("block, few", [(fm.BLOCK_LINKS, 10), (40, 10**6), (40, 0)])
def test_decontamination_matches_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(fm, "BROADCAST_HITS", few)
    rows = corpus()
    long = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(i, " ".join(long[i].upper().split()[5 : 5 + 12 + i])) for i in range(8)] + [(20, "tando révein"), (21, None), (22, "..."), (None, "tando"), (23, long[0]), (23, "sondo mindo")]
    docs = frame(spark, rows, more=True)
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, kept string")
    found = fm.search(docs, bench, ["doc_id"], block_links=block)
    got = [repr((r.kept.doc_id, r.n_words, sum(e - s for s, e in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans))) for r in found.collect()]
    assert sorted(got) == brute_hits(rows, items)


def test_window_of_many_items_in_many_places(spark, monkeypatch):
    monkeypatch.setattr(fm, "ITEMS_AT_ONCE", 100)
    monkeypatch.setattr(fm, "SHARD_WORDS", 500)
    bench = spark.createDataFrame([(i, "yes no" if i < 300 else f"yes no maybe {i}") for i in range(310)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "yes no " * 400 + "yes no maybe 305"), (2, "no yes"), (3, "maybe yes no")], "doc_id long, text string")
    got = {r.kept.doc_id: r for r in fm.search(docs, bench, ["doc_id"]).collect()}
    assert [tuple(x) for x in got[1].spans] == [(0, 804)] and got[1]["items"] == sorted([str(i) for i in range(300)] + ["305"])
    assert got[2].spans == [] and [tuple(x) for x in got[3].spans] == [(1, 3)] and len(got[3]["items"]) == 300


def test_decontamination_query_matches_its_sql(spark, tmp_path):
    rows = {d: t for d, t in corpus() if d is not None}
    long = [t for t in rows.values() if t and len(t.split()) > 60]
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, long[i][10:200]) for i in range(5)] + [(9, "TANDO")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held_to_sql(fm.op4_fm_decontam(spark, str(tmp_path)), fm.ORACLE["op4_fm_decontam"], tmp_path, ["documents", "benchmark"])


def test_decontamination_stage_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "x a b c d e f g h i j k y", 3, 5), (1, "x a b c d e f g h i j k y", 3, 5), (None, "A b c d e f g h i j k.", 3, 5), (None, None, 3, None), (2, "", 3, 5), (3, "clean", 3, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, n_chars long")
    got = fm.remove_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [(1, "x  y", 3, 4), (1, "x  y", 3, 4), (None, None, 3, None), (2, "", 3, 5), (3, "clean", 3, 5)]))
    assert fm.remove_stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_cut_takes_whole_spans():
    assert fm.cut("Aé, b c-d  e!", [(1, 3), (2, 4)]) == "Aé,   e!"
    assert fm.cut("a b", [(0, 2)]) == ""


def test_decontamination_without_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = fm.search(frame(spark, [(1, "a b"), (2, None)]), none, ["doc_id"]).collect()
    assert sorted((r.kept.doc_id, r.n_words, r.spans, r["items"]) for r in rows) == [(1, 2, [], []), (2, 0, [], [])]
    assert fm.search(spark.createDataFrame([], "doc_id long, text string"), none, ["doc_id"]).collect() == []


def brute_repeats(rows, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((k, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + window))
    return sorted(repr((d, len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g))) for (d, _), w, g in zip(rows, words, gone, strict=True))


@pytest.mark.parametrize("group", [sd.GROUP, 1, 3])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)
    rows = corpus()
    got = sd.without_repeats(frame(spark, rows, more=True)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == brute_repeats(rows, 35)


def brute_nodes(rows, window):
    """Runs of windows whose places (the first in each text) are those of the window in front, moved by one."""
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    places = {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), {}).setdefault(k, i)
    out, names = [], {}
    for k, (w, (d, t)) in enumerate(zip(words, rows, strict=True)):
        runs, before = [], None
        for i in range(len(w) - window + 1):
            own = places[tuple(w[i : i + window])]
            now = own if len(own) > 1 and own[k] == i else None
            if now and before and {x: y + 1 for x, y in before.items()} == now:
                runs[-1][1] = i + window
            elif now:
                runs.append([i, i + window, len(now), frozenset(now.items())])
            before = now
        out.append((repr(d), t, [(s, e, n, names.setdefault(p, len(names))) for s, e, n, p in runs]))
    return out


@pytest.mark.parametrize("group, screened", [(sd.GROUP, sd.SCREENED), (1, sd.SCREENED), (3, sd.SCREENED), (sd.GROUP, 0), (3, 0)])
def test_repeats_are_the_nodes_of_the_tree(spark, monkeypatch, group, screened):
    monkeypatch.setattr(sd, "BROADCAST_ROWS", 10**6 if group == 1 else 0)
    monkeypatch.setattr(sd, "GROUP", group)
    monkeypatch.setattr(sd, "SCREENED", screened)
    rng = random.Random(12)
    rows = [(d, t) for d, t in dict(corpus()).items() if d is not None]
    inner = prose(rng, 45)
    outer = prose(rng, 40) + " " + inner + " " + prose(rng, 40)
    other = prose(rng, 38)
    rows += [(500, "one " + outer + " " + other + " end"), (501, outer + " two"), (502, "three " + inner + " four"), (503, "five " + other)]
    got = sd.without_repeats(frame(spark, rows)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == brute_repeats(rows, 35)
    by, names = {r.doc_id: r for r in got}, {}
    for d, _, runs in brute_nodes(rows, 35):
        own = by[eval(d)].repeats
        assert [(x.start, x.end, x.places) for x in own] == [r[:3] for r in runs]
        for x, (*_, name) in zip(own, runs, strict=True):
            assert names.setdefault(name, x.node) == x.node
    assert len(set(names.values())) == len(names) and len(by[500].repeats) == 4


@pytest.mark.parametrize("group", [1, 4096])
def test_names_of_repeated_rows(spark, monkeypatch, group):
    """Two unrelated texts, each twice under one id, and a copy of each: their names differ and are none."""
    monkeypatch.setattr(sd, "GROUP", group)
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 70)
    got = sd.without_repeats(frame(spark, [(1, a), (1, a), (2, b), (2, b), (3, a), (4, b)])).collect()
    nodes = {r.doc_id: {(x.node, x.places) for x in r.repeats} for r in got}
    assert nodes[1] == nodes[3] and nodes[2] == nodes[4] and nodes[1] != nodes[2] and not any(x == 0 for v in nodes.values() for x, _ in v)
    assert {p for v in nodes.values() for _, p in v} == {3} and all(len(v) == 1 for v in nodes.values())


def test_maximal_repeats_match_their_sql(spark, tmp_path):
    rng = random.Random(21)
    inner = prose(rng, 45)
    outer = prose(rng, 40) + " " + inner + " " + prose(rng, 40)
    rows = {d: t for d, t in corpus() if d is not None} | {500: "one " + outer + " end", 501: outer + " two " + inner, 502: "three " + inner + " four", 503: inner + " " + inner}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sd.suffix_repeats(spark, str(tmp_path))
    held_to_sql(got, sd.ORACLE["suffix_repeats"], tmp_path, ["documents"])
    assert got.where("end - start > 60").count() > 1 and sd.maximal_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_query_matches_its_sql(spark, tmp_path):
    rows = {d: t for d, t in corpus() if d is not None}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held_to_sql(sd.op8_suffix_dedup(spark, str(tmp_path)), sd.ORACLE["op8_suffix_dedup"], tmp_path, ["documents"])


def test_suffix_dedup_empty(spark):
    assert sd.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_lines(rows, min_docs):
    """Without the library's fingerprints: word pairs as sets, near copies by their true similarity."""
    texts, uses = {}, {}
    for _, t in rows:
        lines = [re.findall("[^\x20\x09-\x0d]+", x) for x in (t or "").split("\n")]
        flat = tuple(w for x in lines for w in x)
        texts[flat] = set(zip(flat, flat[1:]))
        for x in lines:
            if x:
                x = tuple("<*>" if len(x) >= lt.MIN_WORDS and re.search("[0-9]", w) else w for w in x)
                uses.setdefault((len(x), x[: lt.LEAD]), {}).setdefault(x, set()).add(flat)
    gone = set()
    for lines in uses.values():
        support, shapes = {}, {}
        for x, v in lines.items():
            for i, w in enumerate(x):
                support[i, w] = support.get((i, w), 0) + len(v)
        for x, v in lines.items():
            shape = tuple(w if w != "<*>" and support[i, w] >= min_docs else None for i, w in enumerate(x))
            if len(x) < lt.MIN_WORDS or 2 * sum(w is not None for w in shape) < len(x):
                shape = ("line", x)
            shapes.setdefault(shape, []).append((x, v))
        for group in shapes.values():
            left, classes = {p for _, v in group for p in v}, 0
            while left and classes < min_docs:
                one = min(left)
                left = {p for p in left if p != one and 2 * len(texts[p] & texts[one]) < len(texts[p] | texts[one])}
                classes += 1
            if classes >= min_docs:
                gone.update(x for x, _ in group)
    out = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        drop = []
        for x in lines:
            w = re.findall("[^\x20\x09-\x0d]+", x)
            drop.append(tuple("<*>" if len(w) >= lt.MIN_WORDS and re.search("[0-9]", v) else v for v in w) in gone)
        out.append(repr((d, len(lines), sum(drop), None if t is None else "\n".join(x for x, y in zip(lines, drop, strict=True) if not y))))
    return sorted(out)


def clear_cut(rows, first):
    """Without the loose family: near half of the word pairs in common, an estimate may differ from the truth."""
    return [(d, t) for d, t in rows if d is None or not first <= d < first + 40]


@pytest.mark.parametrize("few", [lt.BROADCAST_LINES, 0])
def test_line_templates_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(lt, "BROADCAST_LINES", few)
    rng = random.Random(8)
    rows = clear_cut(corpus(), 60)
    for i in range(200, 230):
        lines = prose(rng, 80).split("\n") + [f"Copyright {1990 + i} by the {rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}{i % 9 * 'x'} project authors", "All rights reserved worldwide.", "The end"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    copies = prose(rng, 90) + "\nonly this family says so\n" + prose(rng, 30)
    rows += [(300 + i, copies + f"\nrow {i}") for i in range(20)]
    got = lt.drop_lines(frame(spark, rows, more=True)).collect()
    assert sorted(repr((r.kept.doc_id, r.n_lines, r.n_dropped, r.kept.text)) for r in got) == brute_lines(rows, lt.MIN_DOCS)
    by = {r.kept.doc_id: r for r in got}
    assert all(by[i].n_dropped == 3 for i in range(200, 230))
    assert all("only this family" in by[300 + i].kept.text for i in range(20))
    assert got[0].kept.asDict().keys() == {"doc_id", "text", "n_words", "spans", "row", "kept"}


def test_line_query_and_stage(spark, tmp_path):
    rng = random.Random(14)
    rows = clear_cut(corpus(n=20), 20) + [(400 + i, prose(rng, 40) + "\nRead more at our site") for i in range(7)] + [(410, "Read more at our site"), (410, "Read more at our site")]
    docs = frame(spark, rows, more=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [eval(x) for x in brute_lines(rows, lt.MIN_DOCS)]
    got = lt.op1_line_templates(spark, str(tmp_path)).collect()
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256)) for r in got) == sorted(repr((d, n, k, hashlib.sha256((t or "").encode()).hexdigest())) for d, n, k, t in want)
    stage = lt.dedup_stage(spark, docs, "")
    assert stage.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in stage.collect()) == sorted(repr((d, t)) for d, _, k, t in want if not k or re.search("[^\x20\x09-\x0d]", t))
    assert lt.dedup_stage(spark, docs.limit(0), "").collect() == []


@pytest.mark.parametrize("n", [4, 5, 100, 1500])
def test_a_line_in_many_unrelated_texts_recurs(spark, n):
    rng = random.Random(n)
    rows = [(i, prose(rng, 60 if n < 1000 else 1500 if i < 40 else 30) + f"\nLicensed under the terms of version {i}") for i in range(n)]
    got = lt.drop_lines(frame(spark, rows)).where("n_dropped > 0").count()
    assert got == (n if n >= 5 else 0)


def test_recurrence_at_scale(spark):
    """Signatures as unrelated texts have them, 100,000 to a template, and of copies of four texts."""
    wide = F.expr("xxhash64(id, 1)"), F.expr("xxhash64(id, 2)")
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("template"), F.col("id").alias("print"), wide[0].alias("signs_0"), wide[1].alias("signs_1"))
    same = [F.xxhash64(F.col("id") % 4, F.lit(k)) for k in (1, 2)]
    four = spark.range(100_000).select(F.lit(2).cast("long").alias("template"), F.col("id").alias("print"), same[0].alias("signs_0"), same[1].alias("signs_1"))
    assert [r.template for r in lt._of_different_texts(many.unionByName(four), 5).collect()] == [1]


def test_line_templates_empty(spark):
    assert lt.drop_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("block", [fm.BLOCK_LINKS, 2])
def test_cut_out_takes_hits_of_all_blocks(spark, block):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words[5:17])), (2, " ".join(words[30:41]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "clean text"), (3, None)], "doc_id long, text string")
    got = {r.kept.doc_id: (r.text, r.n_words) for r in fm.search(docs, bench, ["doc_id"], block_links=block, cut_out=True).collect()}
    assert got[1][0].split() == words[:5] + words[17:30] + words[41:] and got[1][1] == 60
    assert got[2] == ("clean text", 2) and got[3] == (None, 0)


def test_lines_recur_beside_shared_parts_and_copies(spark):
    rng = random.Random(4)
    licence = prose(rng, 60).replace("\n", " ")
    rows = [(i, prose(rng, 60).replace("\n", " ") + "\n" + licence + "\nSold by the river company only") for i in range(40)]
    page = prose(rng, 200).replace("\n", " ")
    rows += [(100 + i, f"{page}\nSold by the river company only\nNobody else says this line\n{prose(rng, 2)}") for i in range(300)]
    got = {r.kept.doc_id: r.kept.text for r in lt.drop_lines(frame(spark, rows)).collect()}
    assert all(got[i] == rows[i][1].split("\n")[0] for i in range(40))
    assert all("river company" not in t for t in got.values())
    assert all(got[100 + i].startswith(page + "\nNobody else says this line") for i in range(300))


def test_short_lines_recur(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60).replace("\n", " ") + f"\nRead more\nLes.\nPage {i}\n{i}" + ("\n7 of" if i < 5 else "\n8 of" if i < 9 else "")) for i in range(20)]
    want = {i: [f"Page {i}", f"{i}"] + (["8 of"] if 5 <= i < 9 else []) for i in range(20)}
    got = lt.drop_lines(frame(spark, rows)).collect()
    assert {r.kept.doc_id: r.kept.text.split("\n")[1:] for r in got} == want
    monkeypatch.setattr(lt, "BROADCAST_LINES", 0)
    got = lt.drop_lines(frame(spark, rows)).collect()
    assert {r.kept.doc_id: r.kept.text.split("\n")[1:] for r in got} == want
