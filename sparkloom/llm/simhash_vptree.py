"""Near-duplicate documents by SimHash, pairs found by vantage-point trees.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's
word shingles. Distinct fingerprints are the points; a tree of vantage points
parts them by Hamming distance. With `reach` bits allowed between linked
fingerprints, a node with radius r sends those within r to its inner side and
those beyond r - reach to its outer side: by the triangle inequality the two
ends of every link meet on one of them, so each shard is searched by itself
and no link between shards is lost. The upper tree is fitted on a bounded
sample and deals the points to shards; in a shard the tree goes on in memory.

A shard returns one star for each of its connected groups, so a cluster of thousands of
near copies never becomes rows of pairs.
"""

from __future__ import annotations

import heapq
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bbit_minhash import components

SEED = 42
SHINGLE, REACH = 3, 2
#: Fingerprints that a shard should hold, shards at most, and fingerprints that the upper tree is fitted on.
SHARD, SHARDS, SAMPLE = 1 << 15, 1 << 14, 1 << 20
#: Parts of a shard that are compared pair by pair; candidates for a vantage point, points they are judged on.
LEAF, CANDIDATES, JUDGED = 192, 6, 2048
#: Distances that are held at once.
AREA = 1 << 21
#: A split that leaves more than this share on one side is none.
USEFUL = 0.92
#: Hashes that are counted at once.
_AT_ONCE = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text's k-word shingles, repeats included; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(k, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _AT_ONCE):
        a, b = starts[at : at + _AT_ONCE].tolist(), ends[at : at + _AT_ONCE].tolist()
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, a, b)), repeat(SEED)), np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of rows: doc_id, text."""

    def run(batches):
        for batch in batches:
            for at, n, offs, data in common.text_slices(batch):
                raw, o = data.tobytes(), offs.tolist()
                fp = np.array([fingerprint(raw[o[i] : o[i + 1]], k) for i in range(n)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def split(points: np.ndarray, reach: int) -> tuple[int, int] | None:
    """Vantage point and radius that leave the larger side smallest, or None if no split is useful."""
    seen = points[:: -(-len(points) // JUDGED)]
    best = None
    for v in points[:: max(1, len(points) // CANDIDATES)][:CANDIDATES]:
        within = np.cumsum(np.bincount(distance(seen, v), minlength=65))
        radii = np.arange(64)
        inner, outer = within[radii], len(seen) - np.where(radii >= reach, within[np.maximum(radii - reach, 0)], 0)
        size = np.maximum(inner, outer)
        r = int(size.argmin())
        if inner[r] and (best is None or size[r] < best[0]):
            best = int(size[r]), int(v), r
    return best[1:] if best and best[0] <= USEFUL * len(seen) else None


def sides(points: np.ndarray, vantage: int, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    d = distance(points, vantage).astype(np.int64)
    return d <= radius, d > radius - reach


def upper_tree(sample: np.ndarray, total: int, reach: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inner, outer); a child below 0 is the shard -1 - child. No nodes: one shard.

    A part of the sample is split while it stands for more than SHARD points
    and SHARDS are not reached, the largest first.
    """
    nodes: list = []
    heap, done, turn = [(-len(sample), 0, sample, None)], [], 0
    while heap and len(heap) + len(done) < SHARDS:
        _, _, part, below = heapq.heappop(heap)
        cut = split(part, reach) if len(part) > 1 and total * len(part) > SHARD * len(sample) else None
        if cut is None:
            done.append(below)
            continue
        for side, kept in enumerate(sides(part, *cut, reach)):
            turn += 1
            heapq.heappush(heap, (-int(kept.sum()), turn, part[kept], (len(nodes), side)))
        nodes.append([*cut, 0, 0])
        if below is not None:
            nodes[below[0]][2 + below[1]] = len(nodes) - 1
    for shard, below in enumerate(done + [h[3] for h in heap]):
        if below is not None:
            nodes[below[0]][2 + below[1]] = -1 - shard
    return [tuple(n) for n in nodes]


def shards_of(points: np.ndarray, tree: list, reach: int):
    """(shard, places of its points) of all shards that the points belong to."""
    stack = [(0 if tree else -1, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if node < 0:
            yield -1 - node, at
            continue
        vantage, radius, inner, outer = tree[node]
        a, b = sides(points[at], vantage, radius, reach)
        stack += [(inner, at[a]), (outer, at[b])]


def near_pairs(points: np.ndarray, reach: int):
    """Arrays (i, j) of the places of all pairs within reach; a pair may come more than once."""
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        part = points[at]
        cut = split(part, reach) if len(at) > LEAF else None
        if cut is None:
            # a part that no vantage point splits may be large: so many rows at once as fit into a bounded matrix
            step = min(LEAF, max(1, AREA // len(at))) if len(at) else 1
            for lo in range(0, len(at), step):
                rows = part[lo : lo + step]
                i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ part[None, lo:]) <= reach)
                later = i < j
                if later.any():
                    yield at[lo + i[later]], at[lo + j[later]]
            continue
        stack += [at[s] for s in sides(part, *cut, reach)]


def stars(points: np.ndarray, reach: int) -> tuple[list[int], list[int]]:
    """Places of the ends of stars that connect what all pairs within reach connect."""
    top = list(range(len(points)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, j in near_pairs(points, reach):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                top[max(p, q)] = min(p, q)
    ends = [x for x in range(len(points)) if top[x] != x]
    return ends, [find(x) for x in ends]


def links(fps: DataFrame, total: int, reach: int = REACH) -> DataFrame:
    """a, b: pairs that connect the distinct fingerprints fp as all links within reach do."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # half of what is allowed is asked for, so that chance does not exceed it
    share = min(1 << 20, (SAMPLE << 19) // max(1, total)) if total > SAMPLE // 2 else 1 << 20
    drawn = fps.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 20)) < share).limit(SAMPLE)
    sample = np.array([r.fp for r in drawn.collect()] if total > SHARD else [], np.int64).view(np.uint64)
    tree = upper_tree(sample[np.argsort(common._mix(sample))], total, reach)

    def deal(batches):
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for shard, at in shards_of(points, tree, reach):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), pa.array(points[at].view(np.int64))], names=["shard", "fp"])

    def search(batches):
        now, held = None, []

        def found():
            points = np.concatenate(held)
            a, b = stars(points, reach)
            points = points.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(points[a]), pa.array(points[b])], names=["a", "b"])

        for batch in batches:
            shard, points = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            new = (np.flatnonzero(np.diff(shard)) + 1).tolist()
            for lo, hi in zip([0, *new], [*new, len(shard)], strict=True):
                if lo == hi:
                    continue
                if shard[lo] != now and held:
                    yield found()
                    held = []
                now = shard[lo]
                held.append(points[lo:hi].copy())
        if held:
            yield found()

    dealt = fps.select("fp").mapInArrow(deal, "shard long, fp long").repartition(parts, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, reach: int = REACH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs.

    Rows are linked whose fingerprints differ in at most `reach` bits;
    component_id is the smallest id reachable over links.

    A text with fewer than k words is one shingle. A null text, an empty one
    or one without words has fingerprint zero and is linked like any other. A
    row without an id connects others and has their smallest id, null if none
    has one. Repeated rows get equal results; rows with one id and different
    texts are linked by their texts. A text of any length is hashed in pieces.
    An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scratch = common.Scratch(spark)
    fps = scratch.written(fingerprints(rows, k), "fingerprints")
    classes = scratch.written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")), "points")
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    labels = components(links(classes.select("fp"), n, reach))
    named = common.checkpointed(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "c", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("points"))
    named = common.join_counted(named.select("fp", "c", "component"), least, "component", "points", n)
    known = common.checkpointed(named.select("fp", "c", "component_id"))
    scratch.remove("points")
    common.release(spark)
    out = common.join_counted(fps, known, "fp", "c", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents"))


QUERIES = {"op11_simhash_vptree": op11_simhash_vptree}
#: XXH64 is no SQL function; tests/llm hold the query against brute force.
ORACLE: dict[str, str] = {}
