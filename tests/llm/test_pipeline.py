import random
from pathlib import Path

import corpus_pipeline
from sparkloom.llm import common

from .texts import near_copy, prose


def test_pipeline_decisions(spark, tmp_path):
    rng = random.Random(2)
    clean = [(i, "\n".join(prose(rng, 40).replace("\n", " ") for _ in range(3))) for i in range(30)]
    base = prose(rng, 150)
    copies = [(100 + i, base if i < 3 else near_copy(rng, base, 0.01)) for i in range(6)]
    junk = [(200, "SHOUT LOUD " * 20), (201, "x### y$$$ z*** " * 10), (202, "tiny"), (203, None)]
    item = prose(rng, 20)
    leaked = [(300, clean[0][1].split("\n")[0][::-1] + " " + item + " " + prose(rng, 60))]
    framed = [(400 + i, f"Posted on day {i} by staff\n" + prose(rng, 70)) for i in range(8)]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in clean + copies + junk + leaked + framed]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sf = common.table(spark, str(tmp_path), "documents"), str(tmp_path)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r for r in docs.collect()}
    kept = {d for d, _ in clean + leaked + framed} | {100}
    assert seen["quality_rules"].keys() == {d for d, _ in clean + copies + leaked + framed}
    assert seen["line_dedup"].keys() == seen["quality_rules"].keys() and all("Posted on" not in seen["line_dedup"][400 + i].text for i in range(8))
    assert seen["near_dedup"].keys() == kept
    assert item not in seen["decontamination"][300].text and len(seen["decontamination"][300].text) == seen["decontamination"][300].n_chars
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == kept
    for d in kept:
        own = sorted((r.start, r.length) for r in out if r.doc_id == d)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) == out[[r.doc_id for r in out].index(d)].doc_tokens


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing column names and empty tables pass every stage."""
    rng = random.Random(3)
    base = prose(rng, 120).replace("\n", " ")
    texts = [(1, base), (1, base), (None, base), (2, None), (None, None), (3, ""), (4, prose(rng, 80)), (4, prose(rng, 90)), (None, prose(rng, 70)), (5, "word " * 5), (6, " ".join(prose(rng, 3000).split()))]
    rows = [(d, t, "en", "s", None if t is None else len(t), 1, 2.0, "k", 3) for d, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, kept double, spans string, n_words int"
    spark.createDataFrame([(1, "nothing of this sort is in there at all or so it seems")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, data in (("full", rows), ("empty", [])):
        docs = spark.createDataFrame(data, schema).repartition(3)
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = common.written(f(spark, docs, str(tmp_path)), f"{name}-{stage}")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept = sorted(repr((r.doc_id, r.text)) for r in docs.collect())
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        if name == "empty":
            assert kept == [] and pieces == []
            continue
        # one of the three equal texts stays, the others with ten words or more stay whole
        assert kept == sorted(repr((d, t)) for d, t in {(1, base), *texts[6:9], texts[10]})
        assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0) and all(len(p.ids) == 4 * p.length for p in pieces)


def test_stages_are_removed_once_they_are_read(spark, tmp_path):
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + texts[:3])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words in any of the texts at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    common.clean(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    there = [p for p in common._made if Path(p.replace("file:", "")).exists()]
    assert len(common._made) == len(there) == 1 and "/packing-" in there[0] and out.count() > 0
    assert len(list(Path(there[0].replace("file:", "")).parent.iterdir())) == 1
