"""Benchmark decontamination through an FM-index of each training shard.

A shard is what one Arrow batch of documents holds. Its words are coded by
the benchmark's vocabulary; a run of such words shorter than the shortest
window cannot hold one and is left out, which loses nothing. Over the rest
stand a suffix array, its Burrows-Wheeler transform in a wavelet tree and
sampled suffix positions. All windows of a block of the benchmark are
searched backwards together, located, and merged to spans of document words.

Windows are cut and told apart on the executors. A block is BLOCK_LINKS
windows with their items in flat arrays, about 40 MB; the driver and a worker
hold one block at a time, however large the benchmark is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Windows (once for each of their items) that are sent to the workers at once; more are searched in blocks.
BLOCK_LINKS = 500_000
#: Words in one index; a batch with more of them has several.
SHARD_WORDS = 1 << 20
SAMPLE = 16
#: Items of windows that are looked at together.
ITEMS_AT_ONCE = 1_000_000
#: Hit texts of a benchmark of several blocks that may be broadcast, counted first.
BROADCAST_HITS = 100_000
#: x30-x39, x61-x7A and all non-ASCII bytes stay, A-Z become a-z, the rest separates.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_BETWEEN = np.frombuffer(_FOLD, np.uint8) == 0x20
_WORD = re.compile(rb"[^ ]+")
_SPANS = "array<struct<start:int,end:int>>"
_SPANS_TYPE, _ITEMS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())


def word_prints(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the folded words of several texts, and each text's first."""
    h, _, _, at = common.word_hashes(offs, data, lower=True, between=_BETWEEN)
    return h, at


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """n, words (n fingerprints) and item, once each: the windows of all items, cut on the executors."""

    def run(batches):
        for batch in batches:
            for at, n, offs, data in common.text_slices(batch):
                h, first = word_prints(offs, data)
                item = batch.column(0).slice(at, n)
                size = np.minimum(np.diff(first), window)
                count = np.where(size > 0, np.diff(first) - size + 1, 0)
                owner = np.repeat(np.arange(n), count)
                place = first[owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                words = [h[p : p + k].tobytes() for p, k in zip(place.tolist(), size[owner].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(size[owner], pa.int32()), pa.array(words, pa.binary()), item.take(pa.array(owner))], names=["n", "words", "item"])

    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("item is not null and text is not null")
    return rows.mapInArrow(run, "n int, words binary, item string").distinct()


@dataclass
class Phrases:
    """Distinct windows by length over a vocabulary, and the items that have each."""

    vocabulary: np.ndarray  # sorted fingerprints; codes from 2: 0 ends a shard, 1 separates runs
    by_length: dict[int, np.ndarray]  # (windows, length)
    first: dict[int, int]  # number of a length's first window
    item_offsets: np.ndarray  # of each window in item_list
    item_list: np.ndarray
    items: np.ndarray  # sorted

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)

    @staticmethod
    def of(n: np.ndarray, words: list[bytes], item: np.ndarray) -> Phrases:
        """Rows of benchmark_windows."""
        items, number = np.unique(item, return_inverse=True) if len(item) else (item, np.zeros(0, np.int64))
        vocabulary = np.unique(np.frombuffer(b"".join(words), np.uint64))
        by_length, first, at, window = {}, {}, 0, np.zeros(len(n), np.int64)
        for k in np.unique(n).tolist():
            rows = np.flatnonzero(n == k)
            flat = np.frombuffer(b"".join(words[i] for i in rows), np.uint64)
            _, one, back = np.unique(flat.view(f"V{8 * k}"), return_index=True, return_inverse=True)
            by_length[k] = (np.searchsorted(vocabulary, flat.reshape(-1, k)[one]) + 2).astype(np.int32)
            first[k], window[rows] = at, at + back
            at += len(one)
        order = np.lexsort((number, window))
        return Phrases(vocabulary, by_length, first, np.searchsorted(window[order], np.arange(at + 1)), number[order].astype(np.int32), items)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The code of each word, 0 for those the benchmark lacks."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 2, 0)

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The items of any of the windows, sorted; windows are looked at a part at a time."""
        found = np.zeros(0, np.int32)
        count = self.item_offsets[windows + 1] - self.item_offsets[windows]
        parts = np.cumsum(count) // ITEMS_AT_ONCE
        for cut in np.split(np.arange(len(windows)), np.flatnonzero(np.diff(parts)) + 1):
            c = count[cut]
            spots = np.repeat(self.item_offsets[windows[cut]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            found = np.union1d(found, self.item_list[spots])
        return self.items[found].tolist()


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By doubling: each round sorts by twice as many symbols, until all suffixes differ."""
    n = len(t)
    sa = np.argsort(t, kind="stable")
    rank = np.empty(n, np.int64)
    step = np.empty(n, np.int64)
    step[0] = 0
    np.cumsum(t[sa][1:] != t[sa][:-1], out=step[1:])
    rank[sa] = step
    k = 1
    while step[-1] < n - 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        sa = np.argsort(key)
        s = key[sa]
        np.cumsum(s[1:] != s[:-1], out=step[1:])
        rank[sa] = step
        k *= 2
    return sa


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            ones = (seq >> b) & 1
            counts = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            zeros = len(seq) - int(counts[-1])
            self.levels.append((b, counts, zeros))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] in front of position i[k]."""
        lo, i = np.zeros_like(i), i.copy()
        for b, counts, zeros in self.levels:
            one = ((c >> b) & 1).astype(bool)
            r_lo, r_i = counts[lo], counts[i]
            lo = np.where(one, zeros + r_lo, lo - r_lo)
            i = np.where(one, zeros + r_i, i - r_i)
        return i - lo

    def symbol_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i[k] and its occurrences in front of i[k]."""
        lo, i, c = np.zeros_like(i), i.copy(), np.zeros_like(i)
        for b, counts, zeros in self.levels:
            r_lo, r_i = counts[lo].astype(np.int64), counts[i].astype(np.int64)
            one = counts[i + 1] > r_i
            c |= one.astype(np.int64) << b
            lo = np.where(one, zeros + r_lo, lo - r_lo)
            i = np.where(one, zeros + r_i, i - r_i)
        return c, i - lo


class FMIndex:
    """t: symbols from 1; a 0 is put at its end."""

    def __init__(self, t: np.ndarray, n_symbols: int):
        t = np.append(t, 0).astype(np.int64)
        sa = suffix_array(t)
        self.n = len(t)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n_symbols))]).astype(np.int64)
        self.tree = WaveletTree(t[sa - 1], max(1, int(n_symbols - 1).bit_length()))
        self.marked = sa % SAMPLE == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = sa[self.marked]

    def search(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p: (patterns, length). The patterns that occur, and their rows [from, to)."""
        which = np.arange(len(p))
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), self.n, np.int64)
        for j in range(p.shape[1] - 1, -1, -1):
            c = p[which, j]
            lo = self.before[c] + self.tree.rank(c, lo)
            hi = self.before[c] + self.tree.rank(c, hi)
            there = lo < hi
            which, lo, hi = which[there], lo[there], hi[there]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in t: walk back to the next sampled suffix."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        at = np.arange(len(rows))
        while len(at):
            hit = self.marked[rows]
            out[at[hit]] = self.samples[self.mark_rank[rows[hit]]] + steps
            at, rows = at[~hit], rows[~hit]
            if len(at):
                c, r = self.tree.symbol_rank(rows)
                rows = self.before[c] + r
            steps += 1
        return out


def occurrences(codes: np.ndarray, at: np.ndarray, phrases: Phrases) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
    """Of each text with some: the words that windows cover, as merged spans, and the items.

    codes: of all words of the texts; at: each text's first word. Occurrences
    are merged before items are looked up, so a window that many items share
    is no product of both.
    """
    least, found = phrases.shortest, []
    known = codes > 0
    edge = np.zeros(len(codes) + 1, bool)  # a run ends with its text
    edge[at] = True
    begins = np.flatnonzero(known & (edge[:-1] | ~np.append(False, known[:-1]))) if len(codes) else np.zeros(0, np.int64)
    ends = np.flatnonzero(known & (edge[1:] | ~np.append(known[1:], False))) + 1 if len(codes) else begins
    wide = ends - begins >= least if least else np.zeros(len(begins), bool)
    begins, ends = begins[wide], ends[wide]
    # several indexes if there are more words than one holds
    for part in np.split(np.arange(len(begins)), np.flatnonzero(np.diff(np.cumsum(ends - begins + 1) // SHARD_WORDS)) + 1):
        if not len(part):
            continue
        a, size = begins[part], ends[part] - begins[part]
        starts = np.cumsum(size + 1) - (size + 1)  # of each run in the index
        text = np.ones(int((size + 1).sum()), np.int64)
        spots = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[spots] = codes[np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        index = FMIndex(text, len(phrases.vocabulary) + 2)
        for n, patterns in phrases.by_length.items():
            which, lo, hi = index.search(patterns)
            if not len(which):
                continue
            count = hi - lo
            place = index.locate(np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum()))
            run = np.searchsorted(starts, place, side="right") - 1
            word = a[run] + place - starts[run]
            found.append(np.stack([word, word + n, np.repeat(which + phrases.first[n], count)]))
    if not found:
        return {}
    start, end, window = np.concatenate(found, axis=1)
    order = np.lexsort((end, start))
    start, end, window = start[order], end[order], window[order]
    doc = np.searchsorted(at, start, side="right") - 1
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    a = np.flatnonzero(new)
    spans = np.stack([doc[a], start[a] - at[doc[a]], reach[np.append(a[1:], len(start)) - 1] - at[doc[a]]])
    pairs = np.unique(np.stack([doc, window]), axis=1)
    out = {}
    for d in np.unique(doc).tolist():
        lo, hi = np.searchsorted(spans[0], [d, d + 1])
        p, q = np.searchsorted(pairs[0], [d, d + 1])
        out[d] = [tuple(x) for x in spans[1:, lo:hi].T.tolist()], phrases.items_of(pairs[1, p:q])
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_links: int):
    """Phrases of block after block; each is built when it is asked for."""
    links = common.written(benchmark_windows(benchmark, item_col, text_col, window), "benchmark-windows")
    n = max(1, -(-links.count() // block_links))
    for k in range(n):
        part = links if n == 1 else links.where(F.pmod(F.xxhash64("words", "item"), F.lit(n)) == k)
        t = part.toArrow()
        yield n, Phrases.of(t.column("n").to_numpy(), t.column("words").to_pylist(), np.array(t.column("item").to_pylist(), dtype=object))


def _batches(batches, phrases):
    """(batch, first row, words of each text, finds) of slices of about SHARD_WORDS words; rows: ..., text in column 1."""
    for batch in batches:
        h, at, begin = [], [np.zeros(1, np.int64)], 0
        for row, n, offs, data in common.text_slices(batch):
            prints, first = word_prints(offs, data)
            h.append(phrases.codes(prints))
            at.append(first[1:] + (at[-1][-1] if len(at) else 0))
            if at[-1][-1] >= SHARD_WORDS or row + n == batch.num_rows:
                ends = np.concatenate(at)
                yield batch.slice(begin, row + n - begin), np.diff(ends), occurrences(np.concatenate(h), ends[:-1], phrases)
                h, at, begin = [], [np.zeros(1, np.int64)], row + n


def _search(rows: DataFrame, phrases, cut_out: bool) -> DataFrame:
    """n_words, spans and items of each row; rows: kept, text. cut_out takes the spans out of the text."""
    schema = rows.select("kept", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items")).schema

    def run(batches):
        for batch, n_words, finds in _batches(batches, phrases.value):
            texts = batch.column(1)
            if cut_out and finds:
                texts = pa.array([cut(t.as_py(), finds[i][0]) if i in finds else t.as_py() for i, t in enumerate(texts)], texts.type)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(n_words, pa.int64()), *_found(batch.num_rows, finds)], names=["kept", "text", "n_words", "spans", "items"])

    return rows.mapInArrow(run, schema)


def _found(n: int, finds: dict) -> list[pa.Array]:
    none = ([], [])
    spans = pa.array([[{"start": s, "end": e} for s, e in finds.get(i, none)[0]] for i in range(n)], _SPANS_TYPE)
    return [spans, pa.array([finds.get(i, none)[1] for i in range(n)], _ITEMS_TYPE)]


def _hits_of_block(rows: DataFrame, phrases) -> DataFrame:
    """key, spans and items of the texts with a find, once each; rows: key, text."""

    def run(batches):
        for batch, _, finds in _batches(batches, phrases.value):
            k = sorted(finds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), *_found(len(k), {i: finds[d] for i, d in enumerate(k)})], names=["key", "spans", "items"])

    return rows.mapInArrow(run, f"key string, spans {_SPANS}, items array<string>").dropDuplicates(["key"])


def _joined_hits(rows: DataFrame, hits: DataFrame, cut_out: bool) -> DataFrame:
    """The finds of several blocks put to the rows by text; copies of one text share a row of hits."""
    few = hits.count() <= BROADCAST_HITS
    met = rows.withColumn("key", F.md5(F.coalesce("text", F.lit("")))).join(F.broadcast(hits) if few else hits, "key", "left").select("kept", "text", "spans", "items")
    schema = rows.select("kept", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items")).schema

    def run(batches):
        for batch in batches:
            texts, finds, n_words = batch.column(1), {}, []
            for _, n, offs, data in common.text_slices(batch):
                n_words.append(np.diff(word_prints(offs, data)[1]))
            for i, (spans, items) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if spans:
                    finds[i] = merged([(x["start"], x["end"]) for x in spans]), sorted(set(items))
            if cut_out and finds:
                texts = pa.array([cut(t.as_py(), finds[i][0]) if i in finds else t.as_py() for i, t in enumerate(texts)], texts.type)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), *_found(batch.num_rows, finds)], names=["kept", "text", "n_words", "spans", "items"])

    return met.mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def search(docs: DataFrame, benchmark: DataFrame, kept: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_links: int = BLOCK_LINKS, cut_out: bool = False) -> DataFrame:
    """kept (a struct of those columns), text, n_words, spans and items of each row of docs.

    spans: the words [start, end) that windows cover, merged; items: the ids
    (as strings, sorted) whose windows occur. cut_out returns the texts
    without their spans (n_words, spans and items are those of the input).

    A benchmark of one block travels to the documents, which are not
    shuffled. One of several blocks is searched block after block, each pass
    keeping only the hit texts' finds; at the end those are joined to the rows.

    A null text has no words. Repeated rows and null ids are judged row by
    row; very long texts whole. Benchmark rows without an id or words have no
    windows; rows of one id are one item. Without windows nothing is hit; an
    empty documents table gives no rows. Clashing column names do no harm:
    docs' columns stay inside the struct.
    """
    common.bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hits = None
    for n, phrases in _blocks(benchmark, item_col, item_text_col, window, block_links):
        sent = sc.broadcast(phrases)
        del phrases
        if n == 1:
            return _search(rows, sent, cut_out)
        texts = rows.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text")
        found = common.written(_hits_of_block(texts, sent), "block-hits")
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    all_of = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  one row for each block
    return _joined_hits(rows, common.written(hits.groupBy("key").agg(all_of("spans"), all_of("items")), "hits"), cut_out)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, end = [], 0
    for s, e in sorted(spans):
        a, b = at[s][0], at[e - 1][1]
        if a > end:
            out.append(raw[end:a])
        end = max(end, b)
    return b"".join([*out, raw[end:]]).decode()


def remove_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the columns of docs; benchmark passages are cut out of the texts.

    A document that holds nothing else than benchmark words goes. n_chars,
    where there is one, is that of the text that stays. Rows with a null
    text or id and repeated rows are judged each, an empty table stays empty.
    """
    cols = docs.columns
    others = [c for c in cols if c != "text"]
    rows = search(docs, common.table(spark, sf_dir, "benchmark"), others, cut_out=True)
    clean = F.size("spans") == 0
    done = rows.where(clean | F.regexp_like("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]|[A-Z]")))
    value = {c: F.col(f"kept.`{c}`") for c in others} | {"text": F.col("text")}
    if "n_chars" in cols:
        value["n_chars"] = F.when(clean, value["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[value[c].alias(c) for c in cols])


def op4_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select(F.col("kept.doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES = {"op4_fm_decontam": op4_fm_decontam}
ORACLE = {
    "op4_fm_decontam": r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, lens WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON p.g = win.g AND p.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
