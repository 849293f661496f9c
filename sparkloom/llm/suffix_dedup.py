"""Substring dedup through prefix-partitioned suffix trees.

A suffix matters only if its first WINDOW words start elsewhere too. Such a
window has an anchor, its least GRAM-word fingerprint, and equal windows have
equal anchors: suffixes whose anchor occurs once in the corpus are left out,
which loses nothing. The rest are partitioned by a prefix of variable length:
the anchor where its suffixes fit into memory, all WINDOW words where they do
not. Each partition's suffixes are sorted; the common prefixes of neighbours
make the suffix tree, whose nodes at depth WINDOW with two leaves are what
repeats. A prefix as long as the window is a deep node already: its leaves
are counted, not gathered.

A node's leaves are its places. Going on by one word, a node either keeps all
its places (each moved by one), and then both belong to one repeat, or it
gains or loses some, and a repeat ends. So a repeat is a run of words of which
every window has the same places as the whole, and it has one name in all
texts, a print of its places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 35
GRAM = 16
#: Anchors of more suffix starts than this get the longer prefix.
GROUP = 4096
#: Suffixes sorted at once in a task.
CHUNK = 100_000
#: Bits for each kept fingerprint, and the most bits of a screen (32 MB); a full screen passes more, never less.
SCREEN_BITS, SCREEN_MOST = 16, 1 << 28
#: More recurring anchors than a screen has room for are joined by a shuffle.
SCREENED = SCREEN_MOST // SCREEN_BITS
_PART_BITS = 1 << 19
#: Texts with spans and spans in all (40 bytes each) that may be broadcast, counted
#: first; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_SPANS = 300_000, 1_000_000


def anchors(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The place of each window's anchor: its least gram, the first of equal ones."""
    wide = window - GRAM + 1
    if len(grams) < wide:
        return np.zeros(0, np.int64)
    out = np.empty(len(grams) - wide + 1, np.int64)
    for at in range(0, len(out), 1 << 17):
        part = grams[at : at + (1 << 17) + wide - 1]
        low = np.lib.stride_tricks.sliding_window_view(part, wide)
        out[at : at + len(low)] = low.argmin(axis=1) + np.arange(at, at + len(low))
    return out


def _slices(batches, window: int):
    """(batch, first row, rows, word hashes, word offsets) of each slice; hashes are of unchanged words."""
    for batch in batches:
        for at, n, offs, data in common.text_slices(batch):
            h, _, _, w = common.word_hashes(offs, data)
            yield batch, at, n, h, w


def anchor_counts(rows: DataFrame, window: int) -> DataFrame:
    """anchor and its number of places, for those with two or more."""

    def run(batches):
        for _, _, _, h, w in _slices(batches, window):
            grams, found = common.rolled(h, GRAM), []
            for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True):
                if b - a >= window:
                    g = grams[a : b - GRAM + 1]
                    found.append(g[np.unique(anchors(g, window))])
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["anchor", "places"])

    return rows.mapInArrow(run, "anchor long, places long").groupBy("anchor").agg(F.sum("places").alias("places")).where("places > 1")


class Screen:
    """A bitmap over fingerprints; says no only to what was not put in."""

    def __init__(self, raw: dict[int, bytes], bits: int):
        self.bits = bits
        self.map = np.zeros(bits // 8, np.uint8)
        for part, b in raw.items():
            self.map[part * _PART_BITS // 8 :][: len(b)] = np.frombuffer(b, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for turn in (0, 1):
            p = _spot(h, turn, self.bits)
            out &= (self.map[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _spot(h: np.ndarray, turn: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common._mix(h * np.uint64(2) + np.uint64(turn)) & np.uint64(bits - 1)


def screen(prints: DataFrame, column: str, count: int) -> Screen:
    """Built in parts by the executors; the driver receives a bitmap of at most SCREEN_MOST bits."""
    bits = _PART_BITS
    while bits < min(SCREEN_MOST, SCREEN_BITS * count):
        bits <<= 1

    def spots(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            p = np.concatenate([_spot(h, t, bits) for t in (0, 1)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p // _PART_BITS, pa.int32()), pa.array(p % _PART_BITS, pa.int32())], names=["part", "bit"])

    def build(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(part).tolist():
                b = bit[part == k]
                np.bitwise_or.at(parts.setdefault(k, np.zeros(_PART_BITS // 8, np.uint8)), b >> 3, np.left_shift(1, b & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([v.tobytes() for v in parts.values()], pa.binary())], names=["part", "raw"])

    n = bits // _PART_BITS
    built = prints.select(column).mapInArrow(spots, "part int, bit int").repartition(min(n, 64), "part").mapInArrow(build, "part int, raw binary")
    return Screen({r.part: bytes(r.raw) for r in built.collect()}, bits)


def _runs(places: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Spans covered by windows at the sorted places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > width)
    return list(zip(places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + width).tolist(), strict=True))


_SUFFIX = "row long, start int, code long, whole boolean, words binary, prints binary, here long, next long"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_REPEATS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("places", pa.int64()), ("node", pa.int64())]))
_SPAN = "row long, start int, end int, places long, first long, last long"


def _place(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A print of a place in a text."""
    with np.errstate(over="ignore"):
        return common._mix(row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.int64).view(np.uint64))


def _summed(c: str) -> Column:
    """The sum modulo 2**64: equal places, as those of repeated rows, do not cancel each other."""
    low, high = F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(c, 32))
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def text_anchors(rows: DataFrame, window: int) -> DataFrame:
    """row and anchor, once a text."""

    def run(batches):
        for batch, at, n, h, w in _slices(batches, window):
            grams, keys = common.rolled(h, GRAM), batch.column(0).slice(at, n).to_numpy()
            owner, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for key, a, b in zip(keys, w[:-1].tolist(), w[1:].tolist(), strict=True):
                if b - a >= window:
                    g = grams[a : b - GRAM + 1]
                    found.append(np.unique(g[np.unique(anchors(g, window))]))
                    owner.append(np.full(len(found[-1]), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owner)), pa.array(np.concatenate(found).view(np.int64))], names=["row", "anchor"])

    return rows.mapInArrow(run, "row long, anchor long")


def _with_anchors(rows: DataFrame, counts: DataFrame, window: int, scratch: common.Scratch) -> DataFrame:
    """rows with their recurring anchors and those of them with the longer prefix, by a shuffle on the anchor."""
    pairs = scratch.written(text_anchors(rows, window), "anchors")
    total = counts.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    known = common.join_counted(pairs, counts, "anchor", "places", total)
    big = F.col("places") > GROUP
    own = known.groupBy("row").agg(F.collect_set("anchor").alias("small"), F.collect_set(F.when(big, F.col("anchor"))).alias("big"))
    # equal rows have one key and one list
    return rows.join(own, "row")


def suffixes(rows: DataFrame, recurring, large, window: int) -> DataFrame:
    """Suffix records of the windows whose anchor recurs; rows: row, text.

    recurring and large say which anchors recur and which have the longer
    prefix: broadcast screens, or None where rows bring lists of their own
    (small, big).

    Neighbouring windows of one anchor share a record (start, the words of
    all, a 64-bit print of each). Of equal windows in one text the first
    stands for all; the others are repeats already and come as spans with
    neither words nor prints (code is the end). A window with the longer
    prefix comes alone, with the prints of its place and the next one.
    """

    def run(batches):
        for batch, at, n, h, w in _slices(batches, window):
            grams, whole = common.rolled(h, GRAM), common.rolled(h, window)
            short = (h >> np.uint64(32)).astype(np.uint32)
            keys = batch.column(0).slice(at, n).to_numpy()
            lists = None if recurring is not None else [batch.column(c).slice(at, n) for c in (2, 3)]
            cols: list[list] = [[] for _ in range(8)]

            def put(*values):
                for c, v in zip(cols, values, strict=True):
                    c.append(v)

            for i, (key, a, b) in enumerate(zip(keys.tolist(), w[:-1].tolist(), w[1:].tolist(), strict=True)):
                if b - a < window:
                    continue
                g = grams[a : b - GRAM + 1]
                place = anchors(g, window)
                spots, back = np.unique(place, return_inverse=True)
                codes = g[spots]
                if lists is None:
                    small, big = recurring.value.has(codes), large.value.has(codes)
                else:
                    small, big = (np.isin(codes, np.array(x[i].as_py(), np.int64).view(np.uint64)) for x in lists)
                at_window = np.flatnonzero(small[back])
                if not len(at_window):
                    continue
                prints = whole[a : b - window + 1]
                _, first, times = np.unique(prints[at_window], return_index=True, return_counts=True)
                if len(first) < len(at_window):
                    twice = np.isin(prints[at_window], prints[at_window[first[times > 1]]])
                    for s, e in _runs(at_window[twice], window):
                        put(key, s, e, False, None, None, None, None)
                    at_window = at_window[np.sort(first)]
                is_big = big[back[at_window]]
                s = at_window[is_big]
                here, then = (_place(np.full(len(s), key, np.int64), s + k).view(np.int64).tolist() for k in (0, 1))
                for c, v in zip(cols, ([key] * len(s), s.tolist(), prints[s].view(np.int64).tolist(), [True] * len(s), [None] * len(s), [None] * len(s), here, then), strict=True):
                    c += v
                s = at_window[~is_big]
                if len(s):
                    new = np.flatnonzero((np.diff(s) != 1) | (np.diff(back[s]) != 0)) + 1
                    for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(s)], strict=True):
                        f, t = int(s[lo]), int(s[hi - 1])
                        put(key, f, int(codes[back[f]].view(np.int64)), False, short[a + f : a + t + window].tobytes(), prints[f : t + 1].tobytes(), None, None)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row", "start", "code", "whole", "words", "prints", "here", "next"])

    return rows.mapInArrow(run, _SUFFIX)


def nodes_of(group: np.ndarray, words: np.ndarray, at: np.ndarray, prints: np.ndarray, row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix's node at depth window: its leaves, and prints of their places and of the next ones.

    group: prefix of each suffix; at: its first word in words. Sorting gives
    the leaves in the tree's order; a node is a run of neighbours whose
    common prefix is as deep.
    """
    n = len(at)
    letters = np.empty((n, window + 2), ">u4")
    letters[:, :2] = group.astype(">u8").view(">u4").reshape(n, 2)
    letters[:, 2:] = words[at[:, None] + np.arange(window)]
    order = np.argsort(letters.view(f"V{4 * (window + 2)}")[:, 0], kind="stable")
    leaves = letters[order]
    same = leaves[1:] == leaves[:-1]
    depth = np.where(same.all(axis=1), window + 2, same.argmin(axis=1))
    p = prints[order]
    new = np.ones(n, bool)
    new[1:] = (depth < window + 2) | (p[1:] != p[:-1])
    begins = np.flatnonzero(new)
    node = np.empty(n, np.int64)
    node[order] = np.cumsum(new) - 1
    with np.errstate(over="ignore"):
        here, then = (np.add.reduceat(_place(row[order], start[order] + k), begins) for k in (0, 1))
    return np.diff(np.append(begins, n))[node], here[node], then[node]


def _trees(window: int):
    def run(batches):
        held: list = []  # (row, start, code, words, prints) in order of code
        size = 0

        def grow(part):
            count = np.array([len(p) for *_, p in part])
            begins = np.cumsum(count) - count  # first suffix of each record
            spread = lambda x, t: np.repeat(np.array(x, t), count)
            place = np.arange(count.sum()) - np.repeat(begins, count)
            row, start = spread([r for r, *_ in part], np.int64), spread([s for _, s, *_ in part], np.int64) + place
            words = np.concatenate([w for *_, w, _ in part])
            first = np.concatenate([[0], np.cumsum([len(w) for *_, w, _ in part])[:-1]])
            leaves, here, then = nodes_of(spread([c for _, _, c, _, _ in part], np.int64).view(np.uint64), words, np.repeat(first, count) + place, np.concatenate([p for *_, p in part]), row, start, window)
            goes_on = np.zeros(len(row), bool)  # the repeat of the suffix in front
            goes_on[1:] = (place[1:] > 0) & (leaves[1:] == leaves[:-1]) & (here[1:] == then[:-1])
            a = np.flatnonzero((leaves > 1) & ~goes_on)
            ends = np.flatnonzero((leaves > 1) & ~np.append(goes_on[1:], False))
            return pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(start[a], pa.int32()), pa.array(start[ends] + window, pa.int32()), pa.array(leaves[a]), pa.array(here[a].view(np.int64)), pa.array(then[ends].view(np.int64))], names=["row", "start", "end", "places", "first", "last"])

        for batch in batches:
            for row, start, code, words, prints in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if size >= CHUNK and held[-1][2] != code:
                    yield grow(held)
                    held, size = [], 0
                p = np.frombuffer(prints.as_buffer(), np.uint64)
                held.append((row, start, code, np.frombuffer(words.as_buffer(), np.uint32), p))
                size += len(p)
        if held:
            yield grow(held)

    return run


def repeats(rows: DataFrame, window: int = WINDOW, named: bool = True) -> DataFrame:
    """row, spans [start, end) of words to remove, and (if named) repeats of each text with some; rows: row, text."""
    spark = rows.sparkSession
    sc, scratch = spark.sparkContext, common.Scratch(spark)
    # what names a repeat is made and moved only where it is asked for
    names, drop = (["places", "first", "last"], []) if named else ([], ["here", "next"])
    counts = common.checkpointed(anchor_counts(rows, window))
    n, n_large = counts.agg(F.count("*"), F.coalesce(F.sum((F.col("places") > GROUP).cast("long")), F.lit(0))).first()
    if n <= SCREENED:
        recurring = sc.broadcast(screen(counts, "anchor", n))
        large = sc.broadcast(screen(counts.where(F.col("places") > GROUP), "anchor", n_large))
        found = scratch.written(suffixes(rows, recurring, large, window).drop(*drop), "suffixes")
    else:
        found = scratch.written(suffixes(_with_anchors(rows, counts, window, scratch), None, None, window).drop(*drop), "suffixes")
        scratch.remove("anchors")
    common.release(spark)
    known = found.where("not whole and words is null").select("row", "start", F.col("code").cast("int").alias("end"), F.lit(0).cast("long").alias("places"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    tree = found.where("words is not null").select("row", "start", "code", "words", "prints")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_tree = tree.repartition(parts, "code").sortWithinPartitions("code").mapInArrow(_trees(window), _SPAN)
    long_prefix = found.where("whole")
    prints = [_summed("here").alias("first"), _summed("next").alias("last")] if named else []
    deep = long_prefix.groupBy("code").agg(F.count("*").alias("places"), *prints).where("places > 1")
    deep = common.checkpointed(deep)
    leaves = deep.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    by_count = common.join_counted(long_prefix.select("row", "start", "code"), deep, "code", "places", leaves)
    by_count = by_count.withColumn("end", F.col("start") + window)
    cols = ["row", "start", "end", *names]
    spans = known.select(*cols).unionByName(by_tree.select(*cols)).unionByName(by_count.select(*cols))
    parts = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end", *names))).alias("parts"))

    def whole(batches):
        for batch in batches:
            parts = batch.column(1).to_pylist()
            found = [[{k: x[k] for k in ("start", "end", "places", "node")} for x in whole_repeats(p, window)] if named else None for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"start": s, "end": e} for s, e in covered(p)] for p in parts], _SPANS), pa.array(found, _REPEATS)], names=["row", "spans", "repeats"])

    out = common.written(parts.mapInArrow(whole, "row long, spans array<struct<start:int,end:int>>, repeats array<struct<start:int,end:int,places:bigint,node:bigint>>"), "spans")
    scratch.remove("suffixes")
    common.release(spark)
    return out


def covered(parts) -> list[tuple[int, int]]:
    """Overlapping and touching parts as one span; parts are in order."""
    out: list[list[int]] = []
    for x in parts:
        if out and x["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["end"])
        else:
            out.append([x["start"], x["end"]])
    return [tuple(x) for x in out]


def whole_repeats(parts, window: int) -> list[dict]:
    """Parts of one repeat as one: start, end, places and node (the print of its places)."""
    out: list[dict] = []
    for x in parts:
        if not x["places"]:
            continue
        last = out[-1] if out else None
        if last and x["start"] == last["end"] - window + 1 and x["places"] == last["places"] and x["first"] == last["last"]:
            last["end"], last["last"] = x["end"], x["last"]
        else:
            out.append({"start": x["start"], "end": x["end"], "places": x["places"], "node": x["first"], "last": x["last"]})
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of one id and text have one key; their spans are equal."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), text).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))


_OUT = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start:int,end:int,places:bigint,node:bigint>>"


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words joined by one space, or
    its SHA-256 with digest) and repeats.

    A word goes if any window of ``window`` words around it starts anywhere
    else too, in the same text or another; all occurrences go.

    repeats (null with digest) are the runs of words [start, end) of which
    every window has the same places; places counts them, within one text
    the first one only, and node is one name for the run in all texts.

    A null or empty text has no words: nothing is removed. Repeated rows are
    repeats of each other; null ids are kept as they are. An empty table
    gives no rows; other columns are not read.
    """
    common.bounded_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    found = repeats(rows.select("row", "text"), window, named=not digest)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(3)]
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().translate(_BLANK).split()
                kept, at = [], 0
                for x in spans or ():
                    kept += words[at : x["start"]]
                    at = x["end"]
                kept += words[at:]
                flat = b" ".join(kept)
                for c, v in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(flat).hexdigest() if digest else flat.decode()), strict=True):
                    c.append(v)
            # a text without repeats has an empty list; with digest nobody asked
            listed = batch.column(3) if digest else pa.array([r or [] for r in batch.column(3).to_pylist()], _REPEATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), listed], names=["doc_id", "n_words", "n_removed", "kept", "repeats"])

    texts, total = found.agg(F.count("*"), F.coalesce(F.sum(F.size("spans") + F.greatest(F.size("repeats"), F.lit(0))), F.lit(0))).first()
    cols = ["doc_id", "text", "spans", "repeats"]
    if texts <= BROADCAST_ROWS and total <= BROADCAST_SPANS:
        return rows.join(F.broadcast(found), "row", "left").select(*cols).mapInArrow(run, _OUT)
    # only texts with spans (and few others, by the screen's errors) are moved
    likely = rows.sparkSession.sparkContext.broadcast(screen(found, "row", texts))

    def those(moved: bool):
        def run(batches):
            for batch in batches:
                there = likely.value.has(batch.column(0).to_numpy().view(np.uint64))
                yield batch.filter(pa.array(there if moved else ~there))

        return rows.mapInArrow(run, rows.schema)

    none = found.limit(0).select("spans", "repeats").schema
    moved = those(True).join(found, "row", "left").select(*cols)
    stay = those(False).select("doc_id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in none])
    return moved.unionByName(stay).mapInArrow(run, _OUT)


_BLANK = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(common.table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, start, end, places, first_id and first_start of the runs of words [start, end) that other texts have too.

    Each is a path of the tree from depth window on along which no place is
    gained or lost, as deep as it goes: end - start is the common prefix of
    its places, window at least. places counts the texts' first places;
    first_id and first_start, the least of them, name the run in all texts.
    A run within one text alone is none. Texts without words have none;
    repeated rows are places of their own and have the same runs; rows
    without an id count as places, but are not listed. Other columns are not read.
    """
    common.bounded_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    found = repeats(rows.select("row", "text"), window).where(F.size("repeats") > 0).select("row", F.explode("repeats").alias("r")).select("row", "r.*")
    known = common.written(found.join(rows.select("row", "doc_id").distinct(), "row").where("doc_id is not null").select("doc_id", "start", "end", "places", "node"), "runs")
    first = known.groupBy("node").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("c"))
    total = known.count()
    named = common.join_counted(known, first, "node", "c", total)
    return named.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "places", F.col("first.doc_id").alias("first_id"), F.col("first.start").cast("long").alias("first_start"))


def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup, "suffix_repeats": suffix_repeats}
ORACLE = {
    "suffix_repeats": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS MATERIALIZED (SELECT doc_id, g, min(i) AS i FROM (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)) GROUP BY doc_id, g),
n AS MATERIALIZED (SELECT g, count(*) AS n, min(doc_id) AS first_id, arg_min(i, doc_id) - 1 AS first_start FROM f GROUP BY g HAVING count(*) > 1),
p AS MATERIALIZED (SELECT doc_id, i, g, n, first_id, first_start FROM f JOIN n USING (g)),
m AS (SELECT a.g AS g, b.g AS g2 FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.i = a.i + 1 GROUP BY a.g, b.g HAVING count(*) = any_value(a.n) AND count(*) = any_value(b.n)),
s AS (SELECT p.*, lag(i) OVER v AS i0, lag(g) OVER v AS g0 FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT s.*, CASE WHEN i0 = i - 1 AND m.g IS NOT NULL THEN 0 ELSE 1 END AS new FROM s LEFT JOIN m ON m.g = s.g0 AND m.g2 = s.g),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b)
SELECT doc_id, min(i) - 1 AS start, max(i) + 34 AS "end", arg_min(n, i) AS places, arg_min(first_id, i) AS first_id, arg_min(first_start, i) AS first_start FROM r GROUP BY doc_id, k""",
    "op8_suffix_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
rep AS MATERIALIZED (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 35)) AS k FROM rep)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
}
