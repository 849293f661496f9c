import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import packing, token_matrix, token_rollup, tokenizing
from sparkloom.llm.tokenizing import VOCABULARY

from .texts import corpus, frame

TOKENIZER = Tokenizer.from_file(VOCABULARY)  # as loaded, no switch set


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_the_tokenizer(text):
    assert tokenizing.encoder().encode(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encoder_on_odd_texts():
    enc = tokenizing.encoder()
    for text in ("<|endoftext|> a", " " * 30000 + "x", "\n\t " * 3000, "x" * 20000, "1" * 5000, "e\u0301\u200d\u00a0\u2028 z"):
        assert enc.encode(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 3, 2047, 2048, 2049, 7000])
def test_cuts(n):
    at = 0
    for start, length in packing.cuts(n):
        assert start == at and length & (length - 1) == 0 and 0 < length <= 2048
        at += length
    assert at == n


def test_packing_round_trip(spark, tmp_path):
    rows = corpus()
    frame(spark, rows, more=True).write.parquet(f"{tmp_path}/documents.parquet")
    p = packing.decompose(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert len({r.sequence_id for r in p}) == len(p)
    by = defaultdict(list)
    for r in p:
        assert len(r.ids) == 4 * r.length and r.length == 1 << r.bucket and r.offset == 0
        by[r.doc_id].append(r)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for d, ts in texts.items():
        got = sorted((r.start, r.length, bytes(r.ids), r.doc_tokens) for r in by[d])
        want = sorted((s, n, struct.pack(f"<{n}I", *ids[s : s + n]), len(ids)) for t in ts for ids in [ids_of(t)] for s, n in packing.cuts(len(ids)))
        assert got == want
    digest = packing.op2_pack_pow2(spark, str(tmp_path)).collect()
    assert sorted((r.start, r.ids_crc32) for r in digest) == sorted((r.start, zlib.crc32(r.ids)) for r in p)
    packing.write_buckets(packing.decompose(frame(spark, rows)), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(p)


def test_best_fit_decreasing_is_tight():
    sizes = [7, 5, 5, 3, 3, 2, 8, 1, 6]
    bins = token_matrix.best_fit_decreasing(sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 10 for b in bins) and len(bins) == 4
    tree = token_matrix.RoomTree(10)
    for room in (3, 7, 9):
        tree.put(room, room)
    assert [tree.best(k) for k in (1, 3, 4, 8, 10)] == [3, 3, 7, 9, -1]


def test_matrix_round_trip(spark):
    rows = corpus()
    got = defaultdict(list)
    for r in token_matrix.pack_matrix(frame(spark, rows, more=True), seq_len=256, block_tokens=4096).collect():
        ids, pos = struct.unpack("<256I", r.input_ids), struct.unpack("<256i", r.position_ids)
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and len(r.cu_seqlens) == r.n_segments + 1
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            got[d].append((s, ids[a:b]))
            assert pos[a:b] == tuple(range(b - a))
        assert set(ids[r.n_tokens :]) <= {0}
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for d, ts in texts.items():
        assert sorted(got[d]) == sorted((s, tuple(ids[s : s + 256])) for t in ts for ids in [ids_of(t)] for s in range(0, len(ids), 256))


def test_rollup(spark, tmp_path):
    rows = [(1, "a b", "s", "en"), (2, "c", "s", "en"), (3, None, None, "de"), (4, "long " * 3000, "s", "de"), (4, "long " * 3000, "s", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    counts = token_rollup.token_counts(docs)
    r = token_rollup.Rollup(spark, f"{tmp_path}/r")
    assert r.commit("b1", token_rollup.inserts(counts)) and not r.commit("b1", token_rollup.inserts(counts))

    def totals():
        return {(x.source, x.lang): (x.n_docs, x.n_tokens, x.n_chars) for x in r.totals().collect()}

    n = len(ids_of("long " * 3000)) - 1
    assert totals() == {("s", "en"): (2, len(ids_of("a b")) + len(ids_of("c")) - 2, 4), (None, "de"): (1, 0, 0), ("s", "de"): (2, 2 * n, 30000)}
    revised = token_rollup.token_counts(spark.createDataFrame([(2, "c d e", "s", "en")], docs.schema))
    r.commit("b2", token_rollup.changes(counts.where("doc_id = 2"), revised))
    r.commit("b3", token_rollup.deletes(counts.where("doc_id in (3, 4)")))
    assert totals() == {("s", "en"): (2, len(ids_of("a b")) + len(ids_of("c d e")) - 2, 8)}
    with pytest.raises(ValueError):
        r.commit("../x", token_rollup.inserts(counts))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert packing.decompose(empty).collect() == [] and token_matrix.pack_matrix(empty).collect() == [] and token_rollup.token_counts(empty).collect() == []


def test_added_tokens_as_the_file_has_them(spark):
    loaded = Tokenizer.from_file(VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "plain text " * 50, "", "e\u0301 <|endoftext|>" + " " * 30000 + "x"]
    for text in texts:
        assert tokenizing.encoder().encode(text) == loaded.encode(text, add_special_tokens=False).ids
    assert tokenizing.encoder().encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    n = {i: len(loaded.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.doc_tokens for r in packing.decompose(docs).collect()} == {i: k + 1 for i, k in n.items()}
    assert sum(r.n_tokens for r in token_matrix.pack_matrix(docs, seq_len=256, block_tokens=4096).collect()) == sum(n.values()) + len(n)
    assert {r.doc_id: r.n_tokens for r in token_rollup.token_counts(docs).collect()} == n


def test_rollup_counts_whole_commits_once(spark, tmp_path):
    counts = token_rollup.token_counts(spark.createDataFrame([(1, "a b", "s", "en")], "doc_id long, text string, source string, lang string"))
    r = token_rollup.Rollup(spark, f"{tmp_path}/r")
    assert r.totals().collect() == []
    r.stage(token_rollup.inserts(counts))  # a writer that broke before its commit
    assert r.totals().collect() == [] and not r.committed("b1")
    one, two = r.stage(token_rollup.inserts(counts)), r.stage(token_rollup.inserts(counts))  # two writers of one id
    assert [r.publish("b1", one), r.publish("b1", two)] == [True, False]
    assert [(x.n_docs, x.n_chars) for x in r.totals().collect()] == [(1, 3)]
    assert r.commit("b2", token_rollup.deletes(counts)) and r.totals().collect() == []


def test_rollup_compaction(spark, tmp_path):
    """Totals stay, ids stay committed, broken and racing compactions change nothing."""
    counts = token_rollup.token_counts(spark.createDataFrame([(i, "a b " * i, "st"[i % 2], "en") for i in range(1, 9)], "doc_id long, text string, source string, lang string"))
    r = token_rollup.Rollup(spark, f"{tmp_path}/r")
    for i in range(1, 5):
        r.commit(f"b{i}", token_rollup.inserts(counts.where(f"doc_id = {i}")))
    want = sorted(map(tuple, r.totals().collect()))
    kept = r._folder
    r._folder = lambda b: f"{tmp_path}/elsewhere/{b}"  # it breaks before the folders are removed
    assert r.compact()
    r._folder = kept
    assert len(r._named(r.path, "batch_id=")) == 4 and sorted(map(tuple, r.totals().collect())) == want
    assert not r.commit("b2", token_rollup.inserts(counts)) and r.commit("b5", token_rollup.deletes(counts.where("doc_id = 1")))
    assert r.compact() and r._named(r.path, "batch_id=") == [] and r._base() == 2
    assert not r.commit("b5", token_rollup.deletes(counts.where("doc_id = 1"))) and not r.commit("b1", token_rollup.inserts(counts))
    after = sorted(map(tuple, r.totals().collect()))
    assert sum(x[3] for x in after) == sum(x[3] for x in want) - 1
    other = token_rollup.Rollup(spark, f"{tmp_path}/r")
    first = other._renamed
    other._renamed = lambda a, b: (r.compact() if r._base() == 2 else None, first(a, b))[1]
    assert other.compact() is False and sorted(map(tuple, other.totals().collect())) == after
    r.stage(token_rollup.inserts(counts))
    r.sweep()
    assert r._named(f"{r.path}/_bases", "base=") == ["3"] and sorted(map(tuple, r.totals().collect())) == after


def test_rollup_query(spark, tmp_path):
    rows = [(d, t, f"s{i % 3}" if i % 7 else None, "en" if i % 2 else "de", 5, "x", 7) for i, (d, t) in enumerate(corpus())]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int, text_md5 string, n_docs long").write.parquet(f"{tmp_path}/documents.parquet")
    first, want = {}, {}
    for d, t, source, lang, *_ in rows:
        n = len(ids_of(t))
        key = (d is None, d or 0, source is not None, source or "", lang)
        first[t or ""] = min(first.get(t or "", (key, source, lang, n)), (key, source, lang, n), key=lambda x: x[0])
    for t, (_, source, lang, n) in first.items():
        a, b, c = want.get((source, lang), (0, 0, 0))
        want[source, lang] = a + 1, b + n, c + len(t)
    got = token_rollup.op9_token_rollup(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_chars) for r in got} == want and {r.tokenizer_version for r in got} == {"byte_bpe_50k"}


def brute_best_fit(sizes, width):
    rooms, out = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - sizes[i])
        else:
            rooms.append(width - sizes[i])
        out.append(sorted(rooms))
    return out[-1] if out else []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_equals_brute_force(sizes):
    bins = token_matrix.best_fit_decreasing(sizes, 64)
    assert sorted(64 - sum(sizes[i] for i in b) for b in bins) == brute_best_fit(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))


def test_matrix_query(spark, tmp_path):
    rows = corpus()
    frame(spark, rows, more=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = token_matrix.op6_token_matrix(spark, str(tmp_path)).collect()
    pieces = []
    for r in got:
        ids, pos = struct.unpack("<2048I", r.input_ids), struct.unpack("<2048i", r.position_ids)
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.append(repr((d, s, ids[a:b])))
            assert pos[a:b] == tuple(range(b - a))
        assert (r.ids_crc32, r.positions_crc32) == (zlib.crc32(r.input_ids), zlib.crc32(r.position_ids)) and set(ids[r.n_tokens :]) <= {0}
    assert len({r.sequence_id for r in got}) == len(got)
    want = [repr((d, s, tuple(ids[s : s + 2048]))) for d, t in rows for ids in [ids_of(t)] for s in range(0, len(ids), 2048)]
    assert sorted(pieces) == sorted(want)
