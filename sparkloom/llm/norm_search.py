"""Hard negatives by norm-bucketed inner-product search.

Vectors are sorted by norm within their label and cut to buckets; a bucket
knows its largest norm. By Cauchy-Schwarz no score of an anchor exceeds the
product of the two norms, so a bucket is skipped whole where that is below
what each of its anchors still seeks: the lower limit of its score window, or
the k-th best score found so far. Buckets come in falling order of norm, so
the first one skipped by all anchors of a block ends the search of a shard.

The search runs twice: for an anchor's positives (its label, any score), then
for the negatives of each positive (other labels, scores within the window
that the positive's score sets). Blocks of anchors meet shards of buckets in
tiles, both as packed matrices; a tile returns k rows for each window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Components become floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between LOW and HIGH percent of the positive's.
LOW, HIGH = 80, 100
#: Vectors of a bucket, buckets of a shard, anchors of a block.
BUCKET, BUCKETS, BLOCK = 1024, 16, 512
_FAR = 1 << 62
_PACKED = "part int, name long, seq int, label long, top double, width int, kind int, n int, rows binary, ids binary, norms binary, vectors binary, lows binary, highs binary"
_COLS = [c.split()[0] for c in _PACKED.split(", ")]


def quantized(vector: np.ndarray, scale: int = SCALE) -> np.ndarray:
    v = np.floor(vector.astype(np.float64) * scale)
    if np.abs(v).max(initial=0) >= 2.0**62:
        raise ValueError("components beyond 2**62 have no integer scores")
    return v.astype(np.int64)


def _packed(windows: int, per: int, run: int):
    """Rows sorted by label and falling norm as matrices of up to per rows of one label;
    run matrices have one name. A name is unique within and across partitions."""

    def emit(held, name, seq):
        part, label = held[0][5], held[0][1]
        width = max(len(h[3]) for h in held)
        held = sorted(held, key=lambda h: (h[2], h[0]))  # ties of scores go by id
        m = np.zeros((len(held), width), np.int64)
        for i, h in enumerate(held):
            m[i, : len(h[3])] = h[3]
        kind = next(k for k in (2, 4, 8) if not m.size or np.abs(m).max() < 1 << (8 * k - 1))
        norms = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
        ints = [np.array([h[i] for h in held], np.int64).tobytes() for i in (0, 2)]
        lows, highs = (np.array([h[4][i] for h in held], np.int64).reshape(len(held), -1).tobytes() for i in (0, 1)) if windows else (b"", b"")
        return (part, (part << 32) + name, seq, label, float(norms.max()), width, kind, len(held), *ints, norms.tobytes(), m.astype(f"i{kind}").tobytes(), lows, highs)

    def batch_of(rows):
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_COLS)

    def pack(batches):
        held, name, seq = [], 0, 0
        for batch in batches:
            part, row, label, ids = (batch.column(i).to_pylist() for i in range(4))
            offs, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            spans = zip(*(c.to_pylist() for c in batch.columns[5:7]), strict=True) if windows else [None] * len(row)
            out = []
            for i, span in enumerate(spans):
                if held and (len(held) == per or held[0][1] != label[i]):
                    out.append(emit(held, name, seq))
                    seq += 1
                    if seq == run or held[0][1] != label[i]:
                        name, seq = name + 1, 0
                    held = []
                held.append((row[i], label[i], ids[i], flat[offs[i] : offs[i + 1]].copy(), span, part[i]))
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([emit(held, name, seq)])

    return pack


def _unpacked(r: dict) -> dict:
    n = r["n"]
    out = {k: np.frombuffer(r[k], np.int64) for k in ("rows", "ids")} | {"norms": np.frombuffer(r["norms"], np.float64), "vectors": np.frombuffer(r["vectors"], f"i{r['kind']}").reshape(n, -1)}
    if r["lows"]:
        out |= {k: np.frombuffer(r[k], np.int64).reshape(n, -1) for k in ("lows", "highs")}
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b; components that one lacks count as zero."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    most = w * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2.0**62:
        raise ValueError("scores beyond 2**62 are no long integers")
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_of(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (rows, k) of the best allowed scores of each row, earlier columns first among equal ones, and which of them are allowed."""
    n = s.shape[1]
    if n <= k:
        at = np.argsort(np.where(ok, -s, _FAR), axis=1, kind="stable")
    elif np.abs(s).max(initial=0) < _FAR // (2 * n):
        key = np.where(ok, s * n - np.arange(n), -_FAR)
        at = np.argpartition(-key, k - 1, axis=1)[:, :k]
    else:
        at = np.argsort(np.where(ok, -s, _FAR), axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(ok, at, axis=1)


def _searched(same: bool, k: int):
    """Tiles (block, shard, seq, then the packed columns) to anchor, anchor_id, window, id and score: the k best of each window."""

    def tile(block, buckets):
        a = _unpacked(block)
        n, windows = a["lows"].shape
        top = np.full((n, windows, k), -_FAR, np.int64)
        ids = np.full((n, windows, k), _FAR, np.int64)
        open_ = a["lows"] <= a["highs"]
        for bucket in buckets:
            # nothing below this can come into a window any more
            need = np.maximum(a["lows"], top[:, :, -1])
            live = open_ & (a["norms"][:, None] * bucket["top"] * (1 + 1e-9) + 1e-6 >= need)
            rows = np.flatnonzero(live.any(axis=1))
            if not len(rows):
                break
            b = _unpacked(bucket)
            s = scores(a["vectors"][rows], b["vectors"])
            free = a["rows"][rows][:, None] != b["rows"] if same else np.ones(s.shape, bool)
            for w in range(windows):
                ok = free & (s >= need[rows, w, None]) & (s <= a["highs"][rows, w, None]) & live[rows, w, None]
                some = np.flatnonzero(ok.any(axis=1))
                if not len(some):
                    continue
                at, real = best_of(s[some], ok[some], k)
                new = np.where(real, np.take_along_axis(s[some], at, axis=1), -_FAR)
                new_ids = np.where(real, b["ids"][at], _FAR)
                both, both_ids = np.concatenate([top[rows[some], w], new], axis=1), np.concatenate([ids[rows[some], w], new_ids], axis=1)
                order = np.lexsort((both_ids, -both), axis=1)[:, :k]
                top[rows[some], w], ids[rows[some], w] = np.take_along_axis(both, order, axis=1), np.take_along_axis(both_ids, order, axis=1)
        i, w, j = np.nonzero(top > -_FAR)
        cols = [a["rows"][i], a["ids"][i], w.astype(np.int64), ids[i, w, j], top[i, w, j]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "anchor_id", "window", "id", "score"])

    def run(batches):
        def entries():
            for batch in batches:
                yield from batch.to_pylist()

        now, block, ended = None, None, []

        def following(first):
            yield first
            for r in rows:
                if (r["block"], r["shard"]) != now:
                    ended.append(r)
                    return
                yield r

        rows = entries()
        r = next(rows, None)
        while r is not None:
            now, block = (r["block"], r["shard"]), r
            first = next(rows, None)
            if first is None or (first["block"], first["shard"]) != now:
                r = first
                continue
            stream = following(first)
            yield tile(block, stream)
            for _ in stream:  # buckets that were skipped
                pass
            r = ended.pop() if ended else next(rows, None)

    return run


def _ordered(df: DataFrame, parts: int) -> DataFrame:
    """Partitions of falling norm within a label; a hot label or norm is parted by id and row."""
    by = [F.col("label"), F.col("norm").desc(), F.col("vec_id"), F.col("row")]
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())


def _search(anchors: DataFrame, buckets: DataFrame, same: bool, k: int, scratch: common.Scratch) -> DataFrame:
    """anchor, anchor_id, window, id, score and rank: the k best of each window of the anchors (row, label, vec_id, norm, q, lows, highs)."""
    name = "same" if same else "other"
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _ordered(anchors, parts).select("part", "row", "label", "vec_id", "q", "lows", "highs").mapInArrow(_packed(1, BLOCK, 1), _PACKED)
    blocks = scratch.written(blocks, f"blocks_{name}")
    needs = scratch.written(_needs(blocks), f"needs_{name}")
    shards = buckets.groupBy("part", "name", "label").agg(F.max("top").alias("top"))
    met = F.col("label") == F.col("of") if same else F.col("label") != F.col("of")
    tiles = needs.select("block", F.col("label").alias("of"), "need", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).join(shards, "part")
    tiles = scratch.written(tiles.where(met & (F.col("top") * (1 + 1e-9) >= F.col("need"))).select("block", F.col("name").alias("shard"), "need"), f"tiles_{name}")
    rest = [c for c in _COLS if c not in ("part", "name", "seq")]
    home = tiles.join(blocks.withColumnRenamed("name", "block"), "block").select("block", "shard", F.lit(-1).alias("seq"), *rest)
    come = tiles.join(buckets.withColumnRenamed("name", "shard"), "shard").where(F.col("top") * (1 + 1e-9) >= F.col("need")).select("block", "shard", "seq", *rest)
    dealt = home.unionByName(come).repartition(parts, "block", "shard").sortWithinPartitions("block", "shard", "seq")
    found = dealt.mapInArrow(_searched(same, k), "anchor long, anchor_id long, window long, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    found = scratch.written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"found_{name}")
    return found


def _needs(blocks: DataFrame) -> DataFrame:
    """block, label and need of each block: no bucket with a norm below need has a score for any of its windows."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a = _unpacked(r)
                open_ = a["lows"] <= a["highs"]
                least = np.where(open_, a["lows"], _FAR).min(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(least <= 0, -1.0, least / a["norms"])
                out.append((r["name"], r["label"], float(need.min())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)] if out else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["block", "label", "need"])

    return blocks.mapInArrow(run, "block long, label long, need double")


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label", every: int = 100,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id is divisible by `every`; a row's score is
    its integer inner product with the anchor, its components floor(scale *
    x). Positives are the `positives` best rows of the anchor's label but
    itself; for each, the `negatives` best rows of other labels whose score
    is between low and high percent of the positive's. Ties go to the smaller id.

    Rows with a null label, a null vector or a component that is null or not
    finite take no part, nor do rows without an id, which no pair could name.
    Repeated rows take part each: a copy of the anchor is another row, and
    each copy of an anchor has results of its own. Of vectors of different
    lengths the shorter has zeros behind; an empty vector scores 0. Scores
    from 2**62 on raise. No rows give no rows; other columns are not read.
    """
    if not 0 <= low < high:
        raise ValueError("low and high must be percentages in rising order")
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    scratch = common.Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col(f"`{label}`") if isinstance(label, str) else label).cast("long").alias("label"), x.alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and x is not null").where(~odd)

    def whole(batches):
        for batch in batches:
            offs, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
            q = quantized(flat[offs[0] : offs[-1]], scale)
            sums = np.concatenate([[0.0], np.cumsum(q.astype(np.float64) ** 2)])
            offs = offs - offs[0]
            norm = sums[offs[1:]] - sums[offs[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norm), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(q))], names=["vec_id", "label", "norm", "q"])

    vecs = scratch.written(rows.mapInArrow(whole, "vec_id long, label long, norm double, q array<long>").withColumn("row", F.monotonically_increasing_id()), "vectors")
    buckets = scratch.written(_ordered(vecs, parts).select("part", "row", "label", "vec_id", "q").mapInArrow(_packed(0, BUCKET, BUCKETS), _PACKED), "buckets")
    anchors = vecs.where(F.col("vec_id") % every == 0)
    one = lambda v: F.array(F.lit(v).cast("long"))
    near = _search(anchors.withColumns({"lows": one(1 - _FAR), "highs": one(_FAR - 1)}), buckets, True, positives, scratch)
    # the window of a positive; one below zero has none
    window = F.struct("rank", F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"{high} * score div 100").alias("high"))
    windows = near.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("w"))
    padded = lambda field, other: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.element_at(F.map_from_entries(F.transform("w", lambda w: F.struct(w["rank"], w[field]))), i), F.lit(other).cast("long")))
    asked = anchors.join(windows.select(F.col("anchor").alias("row"), padded("low", 0).alias("lows"), padded("high", -1).alias("highs")), "row")
    far = _search(asked, buckets, False, negatives, scratch)
    pairs = near.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "window"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(common.table(spark, sf_dir, "embeddings"), label=label)


QUERIES = {"op13_norm_search": op13_norm_search}
ORACLE = {
    "op13_norm_search": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= {POSITIVES}),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
}
