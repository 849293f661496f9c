"""Near-duplicate documents by b-bit MinHash.

Texts become sets of word-shingle fingerprints; equal sets are one class from
then on. Each class keeps the low bits of HASHES minima, packed, and a key
for each band of the first minima. Classes that share a band key are
candidates; XOR and bit counts of the packed signatures estimate their
similarity, corrected for chance collisions, and drop what cannot be a link.
What remains is confirmed on the full sets.

Candidates are not all pairs of a bucket. Each member is first held against
the bucket's smallest one; confirmed links give components. A bucket whose
members are of several components is still open: there the members outside
its main component visit the others in tiles of bounded size. A tile holds
packed signatures, estimates its pairs by bit counts and lets only those go
on that have a candidate; these meet again with their full sets, and only
links leave the task. So no link is lost, a large group never becomes rows of
pairs, and sets travel in proportion to the candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 1e-7.
ROWS, BANDS = 5, 40
HASHES = 384
LOW_BITS = 2
#: The estimate's standard deviation at 0.8 is 0.024; pairs more than five of them below are dropped.
SLACK = 0.135
SIMILARITY = 0.8
#: Ids that may be broadcast (8 bytes each, counted first); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket that a tile holds, visitors that come to it, and shingles that are indexed at once.
BLOCK, VISITORS, INDEXED = 8192, 1 << 20, 2_000_000
#: Pairs with one full set that meet it in one task.
SALTED = 1024
_WORDS = HASHES // 64
with np.errstate(over="ignore"):
    _MULTIPLIERS = common._mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(offs: np.ndarray, data: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct k-word shingles of each text, sorted; fewer words are one shingle, none are none."""
    h, _, _, at = common.word_hashes(offs, data, lower=True)
    out = []
    grams = common.rolled(h, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(common.rolled(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set."""
    with np.errstate(over="ignore"):
        lo = np.array([common._mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
        hi = np.array([common._mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return lo, hi


def signatures_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts, BANDS) and packed low bits (texts, LOW_BITS * _WORDS) of non-empty sets."""
    x = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    mins = np.empty((HASHES, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            mins[k] = np.minimum.reduceat(x * _MULTIPLIERS[k], starts)
        keys = np.empty((len(sets), BANDS), np.uint64)
        for b in range(BANDS):
            keys[:, b] = common.rolled(np.concatenate([np.full((1, len(sets)), b, np.uint64), mins[b * ROWS : (b + 1) * ROWS]]), ROWS + 1)[0]
        low = common._mix(mins)
    packed = np.zeros((len(sets), LOW_BITS * _WORDS), np.uint64)
    for bit in range(LOW_BITS):
        plane = np.ascontiguousarray(((low >> np.uint64(bit)) & np.uint64(1)).T, dtype=np.uint8)
        packed[:, bit * _WORDS : (bit + 1) * _WORDS] = np.ascontiguousarray(np.packbits(plane, axis=1)).view(np.uint64)
    return keys, packed


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), a.reshape(-1).view(np.int64))


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """doc_id (and what follows the text in rows), n, lo, hi (the set's print), keys and bits of each row; no keys for an empty set."""
    more = rows.columns[2:]

    def run(batches):
        for batch in batches:
            for at, n, offs, data in common.text_slices(batch):
                sets = shingle_sets(offs, data, k)
                lo, hi = set_prints(sets)
                keys, bits = np.zeros((n, BANDS), np.uint64), np.zeros((n, LOW_BITS * _WORDS), np.uint64)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    keys[full], bits[full] = signatures_of([sets[i] for i in full])
                kept = [batch.column(i).slice(at, n) for i in (0, *range(2, 2 + len(more)))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(s) for s in sets], pa.int64()), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), _lists(keys), _lists(bits)], names=["doc_id", *more, "n", "lo", "hi", "keys", "bits"])

    types = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in more)
    return rows.mapInArrow(run, f"doc_id long, {types}n long, lo long, hi long, keys array<long>, bits array<long>")


def _sets(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, lo, hi (the set's print) and the sorted set (bytes) of the rows whose id is a node."""

    def run(batches):
        for batch in batches:
            for at, n, offs, data in common.text_slices(batch):
                sets = shingle_sets(offs, data, k)
                lo, hi = set_prints(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "lo", "hi", "shingles"])

    return rows.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi").mapInArrow(run, "node long, lo long, hi long, shingles binary")


def similarity(a: str, b: str) -> Column:
    """Collision-corrected estimate from two packed signatures."""
    differ = F.lit(0)
    for w in range(_WORDS):
        either = F.lit(0).cast("long")
        for bit in range(LOW_BITS):
            x, y = F.get(a, F.lit(bit * _WORDS + w)), F.get(b, F.lit(bit * _WORDS + w))
            either = either.bitwiseOR(x.bitwiseXOR(y))
        differ = differ + F.bit_count(either)
    chance = 2.0**-LOW_BITS
    return (1 - differ / F.lit(float(HASHES)) - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the ends a, b of the edges.

    Alternating large-star and small-star steps, each a group minimum and a
    join in which hubs are no hot keys; the edges of a round are cut off
    through the shared folder. Stops when a round changes nothing.
    """
    e = common.checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    was = mark(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = common.join_counted(both.where("v > u"), least, "u", "c", 2 * was[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        # u and each of its neighbours are linked to the least of them
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = common.join_counted(large, low, "u", "c", was[0]).select(ends.alias("e")).select(F.explode("e").alias("e")).select("e.u", "e.v")
        e = common.checkpointed(small.where("u <> v").distinct())
        now = mark(e)
        if now == was:
            break
        was = now
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.unionByName(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough; many may share one b."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # a set that many pairs have goes to several tasks, SALTED pairs to each
    salts = F.ceil(F.col("c") / SALTED).cast("int")
    per = pairs.groupBy("b").agg(F.count("*").alias("c"))
    salted = common.join_counted(pairs, per, "b", "c", total).select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt"))
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    second = per.select(F.col("b").alias("node"), salts.alias("salts")).join(sets, "node").select(F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("shingles").alias("set_b"))
    return salted.join(first, "a").join(second, ["b", "salt"]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _estimated(pairs: DataFrame, bits: DataFrame, total: int) -> DataFrame:
    """The pairs a, b with their set sizes and estimate; many may share one b."""
    own = bits.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    hubs = pairs.groupBy("b").agg(F.count("*").alias("c")).join(bits.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
    met = common.join_counted(pairs.join(own, "a"), hubs, "b", "c", total)
    return met.select("a", "b", "n_a", "n_b", similarity("bits_a", "bits_b").alias("estimate"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity_at_least: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs.

    Rows are linked whose shingle sets have at least that Jaccard similarity;
    component_id is the smallest id reachable over links, the own one
    included, and kept says whether it is the own one.

    A null text, an empty one or one without words has no shingles and is
    linked with nothing; a text with fewer words than k is one shingle. A row without an id keeps its own place: its
    component_id is null and kept is true. Repeated rows (one id, one text)
    get equal results. Rows with one id and different texts are judged by
    their texts; their common id may serve for either. An empty table gives
    no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _grouped(rows, k, similarity_at_least)


def _grouped(rows: DataFrame, k: int, similarity_at_least: float) -> DataFrame:
    """near_groups of rows: doc_id, text and further columns, which are carried along."""
    common.bounded_batches(rows.sparkSession)
    spark, more = rows.sparkSession, rows.columns[2:]
    scratch = common.Scratch(spark)
    percent = round(100 * similarity_at_least)
    threshold = similarity_at_least - SLACK
    sig = scratch.written(signatures(rows, k), "signatures")
    first = F.min(F.struct("doc_id", "n", "keys", "bits")).alias("r")
    classes = scratch.written(sig.where("n > 0 and doc_id is not null").groupBy("lo", "hi").agg(first).select("lo", "hi", F.col("r.doc_id").alias("node"), "r.n", "r.keys", "r.bits"), "classes")
    bands = classes.select("node", F.explode("keys").alias("key"))
    buckets = scratch.written(bands.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("members")).where("members > 1"), "buckets")
    total = buckets.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    if not total:
        return _labelled(sig, classes, None, more)
    shared = scratch.written(common.join_counted(bands, buckets, "key", "members", total).select("key", "node", "center", "members"), "shared")
    common.release(spark)
    nodes = common.checkpointed(shared.select("node").distinct())
    small = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    # the keys tell in which bucket a pair meets first
    bits = scratch.written(classes.join(small, "node", "left_semi").select("node", "n", "bits", "keys"), "bits")
    # bucketed by node: the joins below move the pairs, not the sets, which are dealt once; texts of one id are parted by their prints
    parts, name, path = int(spark.conf.get("spark.sql.shuffle.partitions")), "sets_" + common.scratch(spark, "t").rpartition("-")[2], common.scratch(spark, "sets")
    try:
        _sets(rows, small, k).repartition(parts, "node").dropDuplicates(["node", "lo", "hi"]).write.bucketBy(parts, "node").option("path", path).saveAsTable(name)
        sets = spark.table(name)
        pairs = scratch.written(shared.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct(), "pairs")
        size_ok = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        likely = scratch.written(_estimated(pairs, bits, total).where(size_ok & (F.col("estimate") >= threshold)).select("a", "b"), "likely")
        labels = common.checkpointed(components(_verified(likely, sets, percent, likely.count())))
        links = _cross_links(_open_buckets(shared, labels, total), bits, sets, percent, threshold, scratch)
        for end in ("a", "b"):
            links = links.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")), end, "left").withColumn(end, F.coalesce(f"c_{end}", end)).drop(f"c_{end}")
        joined = common.checkpointed(components(links))
        other = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
        merged = labels.join(other, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        alone = joined.join(labels.select("node"), "node", "left_anti").select("node", "component")
        done = common.checkpointed(merged.unionByName(alone))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        common.remove(spark, path)
    scratch.remove("buckets", "shared", "bits", "pairs", "likely", "tiles")
    common.release(spark)
    return _labelled(sig, classes, done, more)


def _open_buckets(shared: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """key, node, component, main (the bucket's largest component), members and strangers (members outside it)
    of the buckets whose members are of several components."""
    own = common.checkpointed(shared.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    kinds = own.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = kinds.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("members"), F.max("c").alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = common.checkpointed(mixed.select("key", "main", "members", (F.col("members") - F.col("largest")).alias("strangers")))
    return common.join_counted(own, mixed, "key", "members", total)


def _cross_links(open_: DataFrame, bits: DataFrame, sets: DataFrame, percent: int, threshold: float, scratch: common.Scratch) -> DataFrame:
    """Links a, b between components of one bucket, on full sets.

    A tile is a block of a bucket's members and a part of its strangers; the
    strangers stream past the block. A pair that meets in several buckets
    counts in that of its first band only.
    """
    blocks, chunks = F.ceil(F.col("members") / BLOCK).cast("int"), F.ceil(F.col("strangers") / VISITORS).cast("int")
    deal = lambda turn, n: F.pmod(F.xxhash64("node", F.lit(turn)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    tile = ["key", "block", "chunk"]
    cols = [*tile, "visits", "node", "component", "main", "n", "bits", "keys"]
    rows = open_.join(bits, "node")
    at_home = rows.select("*", deal(1, blocks).alias("block"), every(chunks).alias("chunk"), F.lit(0).alias("visits"))
    visiting = rows.where("component <> main").select("*", every(blocks).alias("block"), deal(2, chunks).alias("chunk"), F.lit(1).alias("visits"))
    parts = int(bits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = at_home.select(*cols).unionByName(visiting.select(*cols)).repartition(parts, *tile).sortWithinPartitions(*tile, "visits")
    found = tiles.mapInArrow(_likely_in_tiles(percent, threshold), "key long, block long, chunk long, part long, visits long, node long, component long")
    met = scratch.written(found.distinct(), "tiles").join(sets.select("node", "shingles"), "node")
    part = [*tile, "part"]
    met = met.select(*part, "visits", "node", "component", "shingles").repartition(parts, *part).sortWithinPartitions(*part, "visits")
    return common.checkpointed(met.mapInArrow(_confirmed(percent), "a long, b long"))


def _likely_in_tiles(percent: int, threshold: float):
    """Members and visitors of a tile that have a pair whose estimate and sizes allow a link.

    Members are numbered in parts of INDEXED shingles; a visitor goes to the
    parts that hold a candidate of it.
    """
    most_off = HASHES * (1 - (threshold * (1 - 2.0**-LOW_BITS) + 2.0**-LOW_BITS))
    names = ["key", "block", "chunk", "part", "visits", "node", "component"]

    def run(batches):
        now, home, index = None, [], None
        for batch in batches:
            key, block, chunk, visits, nodes, kinds, mains, n = (c.to_numpy() for c in batch.columns[:8])
            signs = batch.column(8).flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
            keys = batch.column(9).flatten().to_numpy().reshape(len(n), -1)
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(chunk) != 0)) + 1
            out: list[np.ndarray] = []
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(n)], strict=True):
                if lo == hi:
                    continue
                if (int(key[lo]), int(block[lo]), int(chunk[lo])) != now:
                    now, home, index = (int(key[lo]), int(block[lo]), int(chunk[lo])), [], None
                split = lo + int(np.searchsorted(visits[lo:hi], 1))
                if split > lo:
                    home.append(tuple(x[lo:split] for x in (nodes, kinds, n, signs, keys)))
                if split == hi or not home:
                    continue
                if index is None:
                    index = tuple(np.concatenate(x) for x in zip(*home, strict=True))
                    part, sent = np.cumsum(index[2]) // INDEXED, np.zeros(len(index[2]), bool)
                    band = int(np.flatnonzero(keys[split] == now[0])[0])
                for at in range(split, hi, 16):
                    v = slice(at, min(at + 16, hi))
                    i, j = _close(signs[v], n[v], kinds[v], mains[v], index, most_off, percent)
                    fresh = ~(keys[at + i, :band] == index[4][j, :band]).any(axis=1)
                    i, j = at + i[fresh], j[fresh]
                    if not len(i):
                        continue
                    own = np.unique(j)
                    own = own[~sent[own]]
                    sent[own] = True
                    comes = np.unique(np.stack([i, part[j]]), axis=1)
                    for who, parts, visit in ((index[0][own], part[own], 0), (nodes[comes[0]], comes[1], 1)):
                        kind = index[1][own] if not visit else kinds[comes[0]]
                        out.append(np.stack([*(np.full(len(who), x, np.int64) for x in now), parts, np.full(len(who), visit, np.int64), who, kind]))
            rows = np.concatenate(out, axis=1) if out else np.zeros((7, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=names)

    return run


def _close(signs, n, kinds, mains, index, most_off, percent) -> tuple[np.ndarray, np.ndarray]:
    """Places of visitors and members whose estimate and sizes allow a link between components.

    Of two strangers the one whose component has the larger name visits.
    """
    _, home_kinds, home_n, home_signs, _ = index
    off = np.zeros((len(n), len(home_n)), np.uint16)
    for w in range(_WORDS):
        either = np.zeros(off.shape, np.uint64)
        for bit in range(LOW_BITS):
            either |= signs[:, bit * _WORDS + w, None] ^ home_signs[None, :, bit * _WORDS + w]
        off += np.bitwise_count(either)
    ok = (off <= most_off) & (100 * np.minimum(n[:, None], home_n) >= percent * np.maximum(n[:, None], home_n))
    ok &= ((kinds[:, None] > home_kinds) | (home_kinds == mains[:, None])) & (kinds[:, None] != home_kinds)
    return np.nonzero(ok)


def _confirmed(percent: int):
    """A part's members form an inverted index; each visitor is intersected with all of them at once.
    One link leaves for each visitor and component."""

    def run(batches):
        now, home, index = None, [], None
        for batch in batches:
            a, b = [], []
            for *tile, visits, node, component, raw in zip(*(c.to_pylist() for c in batch.columns[:7]), batch.column(7), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if tile != now:
                    now, home, index = tile, [], None
                if not visits:
                    home.append((node, component, s))
                    continue
                if not home:
                    continue
                if index is None:
                    values, owner = np.concatenate([x[2] for x in home]), np.repeat(np.arange(len(home)), [len(x[2]) for x in home])
                    order = np.argsort(values, kind="stable")
                    index = values[order], owner[order], np.array([len(x[2]) for x in home]), np.array([x[0] for x in home]), np.array([x[1] for x in home])
                values, owner, sizes, nodes, kinds = index
                lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                count = hi - lo
                spots = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                both = np.bincount(owner[spots], minlength=len(nodes))
                ok = (100 * both >= percent * (sizes + len(s) - both)) & (kinds != component)
                _, first = np.unique(kinds[ok], return_index=True)
                for other in nodes[ok][first].tolist():
                    a.append(node)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _labelled(sig: DataFrame, classes: DataFrame, labels: DataFrame | None, more: list[str]) -> DataFrame:
    named = classes.select("lo", "hi", "node")
    if labels is None:
        named = named.select("lo", "hi", F.col("node").alias("component"))
    else:
        named = named.join(labels, "node", "left").select("lo", "hi", F.coalesce("component", "node").alias("component"))
    # the copies of one text may be a third of all rows
    times = sig.groupBy("lo", "hi").agg(F.count("*").alias("c")).join(named, ["lo", "hi"], "left")
    times = common.checkpointed(times.select(F.struct("lo", "hi").alias("set"), "c", "component"))
    total = times.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    rows = common.join_counted(sig.select("doc_id", *more, "n", F.struct("lo", "hi").alias("set")), times, "set", "c", total)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")))
    return rows.select("doc_id", *more, F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the columns of docs, one document of each group (five-word shingles).

    Rows are numbered and judged by their number, so rows of one id and
    different texts are different documents, repeated rows are copies of each
    other, and rows without an id are grouped like any other. Of a group the
    row with the smallest doc_id stays (one without an id only if none has
    one), of equal ids the first row. Texts without words all stay; an empty
    table stays empty. Columns are carried inside a struct, whatever their
    names. The rows to drop are counted first: few are broadcast, many are
    joined.
    """
    numbered = common.written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "numbered")
    rows = numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").cast("string").alias("text"), F.col("doc.doc_id").cast("long").alias("rank"))
    group = common.written(_grouped(rows, 5, SIMILARITY).select(F.col("doc_id").alias("row"), "rank", F.col("component_id").alias("component")), "groups")
    best = group.groupBy("component").agg(F.min(F.struct(F.col("rank").isNull().alias("no_id"), "rank", "row")).alias("best"), F.count("*").alias("c")).where("c > 1")
    best = common.checkpointed(best.select("component", F.col("best.row").alias("stays"), "c"))
    total = best.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    gone = common.checkpointed(common.join_counted(group, best, "component", "c", total).where("row <> stays").select("row"))
    few = gone.count() <= BROADCAST_IDS
    return numbered.join(F.broadcast(gone) if few else gone, "row", "left_anti").select("doc.*")


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents"), k=2)


QUERIES = {"op5_bbit_minhash": op5_bbit_minhash}
ORACLE = {
    "op5_bbit_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, array_to_string(w[i:i + least(len(w), 2) - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.m AS component_id, d.doc_id = r.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
}
