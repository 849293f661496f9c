"""Index of a packed array store: append, recovery, seal, reads and verification.

The index is the truth: one row for each sample with segment, offsets, sizes
and checksums of its streams. Payload rows that no index row names are torn
writes and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..violations import Checked, ContractError, require_empty, split_by
from . import sequence as S

#: Rows that make a key hot, and keys that are treated as such at most.
HOT, MOST_HOT = 100_000, 4096


def checked_samples(df: DataFrame, layers: int, width: int) -> Checked:
    """sample_id, source_index, input_ids, loss_mask, aux, final: shapes, finiteness, duplicate ids.

    aux has tokens * layers * width values, final tokens * width.
    """
    n = F.size("input_ids")
    d = _marked_repeats(df, "sample_id", "_repeated")
    reason = (
        F.when(n < 1, "no tokens").when(F.size("loss_mask") != n, "mask length").when(F.size("aux") != n * layers * width, "aux shape")
        .when(F.size("final") != n * width, "final shape").when(~V.finite(F.col("aux")) | ~V.finite(F.col("final")), "not finite").when(F.col("_repeated"), "duplicate id")
    )
    c = split_by(d, reason)
    return Checked(c.good.drop("_repeated"), c.bad.drop("_repeated"))


def _marked_repeats(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with whether its key comes more than once (a null one does not); the rows of the MOST_HOT largest keys of
    over HOT rows stay where they are, the others are met by a shuffle in which no key is large."""
    times = df.groupBy(key).agg(F.count("*").alias("_c")).where((F.col("_c") > 1) & F.col(key).isNotNull())
    hot = F.broadcast(times.where(F.col("_c") > HOT).orderBy(F.desc("_c"), key).limit(MOST_HOT).select(key))
    cold = df.join(hot, key, "left_anti").join(times.select(key, F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df.join(hot, key, "left_semi").withColumn(name, F.lit(True)).unionByName(cold)


def index(df: DataFrame, cap: int, layers: int, width: int, shard: str = "shard") -> DataFrame:
    """Index rows: next-fit segments under cap bytes in each shard, offsets, sizes and checksums.

    Sizes: 8 bytes an id, 1 a mask value, 2 a vector value.
    """
    n = F.size("input_ids").cast("long")
    sizes = {"input_ids": n * 8, "loss_mask": n, "aux": n * (2 * layers * width), "final": n * (2 * width)}
    total = sum((v for v in sizes.values()), F.lit(0).cast("long"))
    d = df.select(shard, "sample_id", "source_index", n.alias("tokens"), total.alias("nbytes"), *[F.sha2(F.to_json(c), 256).alias(f"sha_{c}") for c in sizes])
    placed = S.segments(d, "nbytes", "source_index", cap, [shard])
    part, off = {}, F.lit(0).cast("long")
    for c in sizes:  # a stream's offset is the tokens before it in the segment times its width
        part[c] = {"input_ids": 8, "loss_mask": 1, "aux": 2 * layers * width, "final": 2 * width}[c]
    before = S.offsets(placed.withColumnRenamed("offset", "_byte_offset"), "tokens", "source_index", [shard, "segment"])
    streams = list(part)
    return before.select(
        shard, "sample_id", "source_index", "segment", "tokens",
        F.map_from_arrays(F.array(*[F.lit(c) for c in streams]), F.array(*[F.col("offset") * part[c] for c in streams])).alias("offsets"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in streams]), F.array(*[F.col("tokens") * part[c] for c in streams])).alias("nbytes"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in streams]), F.array(*[F.col(f"sha_{c}") for c in streams])).alias("sha256"),
    )


def streams(idx: DataFrame, shard: str = "shard") -> DataFrame:
    """Index in long form: one row for each sample and stream."""
    long = idx.select(shard, "segment", "sample_id", "source_index", F.explode("offsets").alias("stream", "offset"), "nbytes", "sha256")
    return long.select(shard, "segment", "sample_id", "source_index", "stream", "offset", F.try_element_at("nbytes", F.col("stream")).alias("nbytes"), F.try_element_at("sha256", F.col("stream")).alias("sha256"))


def recovered(payload: DataFrame, idx: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Payload rows that the index names, and the torn rest; overlapping ranges or missing payload raise."""
    require_empty(S.overlaps(streams(idx), ["shard", "segment", "stream"]), key, "overlapping ranges")
    require_empty(idx.join(payload.select(key), key, "left_anti"), key, "the index passes the payload")
    return payload.join(idx.select(key), key, "left_semi"), payload.join(idx.select(key), key, "left_anti")


def manifest(idx: DataFrame) -> DataFrame:
    """One row: samples, tokens and the sorted segments."""
    return idx.agg(F.count("*").alias("samples"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.sort_array(F.collect_set("segment")).alias("segments"))


def seal(idx: DataFrame) -> DataFrame:
    """What a frozen store records of each segment and stream: bytes, rows and a digest of checksums in order.

    A sample without bytes has the offset of the one behind it; such samples
    come in the order of the source. Missing checksums are left out, without
    any there is no digest.
    """
    s = streams(idx)
    ordered = F.sort_array(F.collect_list(F.struct("offset", "source_index", "sha256")))
    digest = F.when(F.count("sha256") > 0, F.sha2(F.array_join(F.transform(ordered, lambda x: x["sha256"]), "\n"), 256))
    return s.groupBy("shard", "segment", "stream").agg(F.max(F.col("offset") + F.col("nbytes")).alias("bytes"), F.count("*").alias("rows"), digest.alias("digest"))


def verify(idx: DataFrame, sealed: DataFrame) -> None:
    now = seal(idx)
    keys = ["shard", "segment", "stream"]
    both = sealed.alias("a").join(now.alias("b"), keys, "full")
    bad = both.where(~(F.col("a.bytes").eqNullSafe(F.col("b.bytes")) & F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))))
    require_empty(bad, "stream", "the store differs from its seal")


def frozen_rows(df: DataFrame, semantics: str) -> Checked:
    """Completed rows whose ids and mask agree in length and meaning."""
    reason = F.when(~F.coalesce("stage_a_complete", F.lit(False)), "not complete").when(F.coalesce(F.size("input_ids"), F.lit(0)) != F.coalesce(F.size("loss_mask"), F.lit(0)), "lengths differ").when(~F.col("mask_semantics").eqNullSafe(semantics), "mask semantics").when(F.coalesce(F.size("input_ids"), F.lit(0)) < 1, "no tokens")
    return split_by(df, reason)


def storage_bytes(tokens, layers: int, width: int):
    """Bytes of so many tokens: two-byte vectors of all layers and the final one, ids and mask."""
    return tokens * (2 * (layers + 1) * width + 9)


def compatible(a: dict, b: dict, keys: tuple[str, ...]) -> None:
    """Manifests agree on the named fields."""
    bad = [k for k in keys if a.get(k) != b.get(k)]
    if bad:
        raise ContractError(f"manifests differ in {', '.join(bad)}")


def shard_report(shards: DataFrame) -> DataFrame:
    """One row on shards (shard_id, fingerprint, runtime, condition_id, tokens): what a gate compares."""
    return shards.agg(
        F.countDistinct("shard_id").alias("shards"), F.countDistinct("fingerprint").alias("fingerprints"), F.countDistinct("runtime").alias("runtimes"),
        F.count("*").alias("rows"), F.countDistinct("condition_id").alias("conditions"), F.coalesce(F.sum((F.col("tokens") < 1).cast("long")), F.lit(0)).alias("empty"),
    )


def verified_shards(shards: DataFrame, expected: int, total: int) -> dict:
    """All shards there once, one fingerprint and runtime, unique non-empty rows, the right total."""
    r = shard_report(shards).first()
    found = [what for bad, what in ((r.shards != expected, f"{r.shards} of {expected} shards"), (r.fingerprints != 1, "several fingerprints"), (r.runtimes != 1, "several runtimes"), (r.rows != r.conditions, "repeated conditions"), (r.empty, "empty rows"), (r.rows != total, f"{r.rows} of {total} rows")) if bad]
    if found:
        raise ContractError("; ".join(found))
    return {"status": "PASS", "conditions": r.rows, "shards": r.shards}


def shard_checks(rows: DataFrame, markers: DataFrame, artifacts: DataFrame, shards: int, total: int, fingerprint: str) -> DataFrame:
    """What is wrong with the finished shards of a run, as (check, shard_id, found): no rows if all is well.

    rows (shard_id, condition_id, tokens), markers (shard_id, fingerprint,
    runtime, conditions, sha256), artifacts (shard_id, sha256, as files have
    it now). Checks: shards from 0 to shards - 1 without marker or file,
    markers of other runs or beyond those numbers, several runtimes,
    checksums and row counts that differ, conditions that come twice (in
    whatever shards), rows without tokens, and the number of all rows
    (shard_id null).
    """
    spark = rows.sparkSession
    wanted = spark.range(shards).select(F.col("id").alias("shard_id"))
    per = rows.groupBy("shard_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("tokens", F.lit(0)) < 1).alias("empty"))
    d = wanted.withColumn("wanted", F.lit(True)).join(markers, "shard_id", "full").join(artifacts.select("shard_id", F.col("sha256").alias("now")), "shard_id", "left").join(per, "shard_id", "left")
    # the runtime of the first shard that has one holds for all
    first = markers.agg(F.min_by("runtime", "shard_id").alias("first"))
    d = d.join(first, F.lit(True))  # one row
    has = F.col("fingerprint").isNotNull()
    one = [
        ("marker", F.col("wanted") & ~has, F.lit(None)), ("unexpected", F.col("wanted").isNull(), F.lit(None)), ("file", F.col("wanted") & F.col("now").isNull(), F.lit(None)),
        ("fingerprint", has & (F.col("fingerprint") != fingerprint), F.col("fingerprint")), ("runtime", has & ~F.col("runtime").eqNullSafe(F.col("first")), F.col("runtime")),
        ("checksum", has & F.col("now").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("now")), F.col("now")), ("rows", has & (F.coalesce("n", F.lit(0)) != F.col("conditions")), F.coalesce("n", F.lit(0)).cast("string")), ("empty", F.coalesce("empty", F.lit(0)) > 0, F.col("empty").cast("string")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("check"), v.cast("string").alias("found"))) for n, bad, v in one]), lambda c: c.isNotNull())
    out = d.select("shard_id", F.explode(found).alias("c")).select("c.check", "shard_id", "c.found")
    again = rows.groupBy("condition_id").agg(F.count("*").alias("c"), F.max("shard_id").alias("shard_id")).where("c > 1").groupBy("shard_id").agg(F.count("*").cast("string").alias("found"))
    out = out.unionByName(again.select(F.lit("repeated").alias("check"), F.col("shard_id").cast("long").alias("shard_id"), "found"))
    n = rows.agg(F.count("*").alias("n")).where(F.col("n") != total)
    return out.unionByName(n.select(F.lit("total").alias("check"), F.lit(None).cast("long").alias("shard_id"), F.col("n").cast("string").alias("found")))


def completed(markers: DataFrame) -> DataFrame:
    """One row: finished shards and the conditions they hold."""
    return markers.agg(F.count("*").alias("shards"), F.coalesce(F.sum("conditions"), F.lit(0)).alias("conditions"))


def verified_count(marker: dict, rows: DataFrame) -> int:
    """The number of rows, which has to be that of a marker that passed."""
    n = rows.count()
    if marker.get("status") != "PASS" or marker.get("conditions") != n:
        raise ContractError(f"{n} rows, the marker says {marker.get('status')} with {marker.get('conditions')}")
    return n


def unverified(markers: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, status, conditions and rows of the markers (key, status, conditions) that did not pass or whose count is not that of the rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("rows"))
    d = markers.join(n, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return d.where(~(F.col("status").eqNullSafe("PASS") & F.col("conditions").eqNullSafe(F.col("rows")))).select(key, "status", "conditions", "rows")


def differing(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and fields of the manifests (one row each) that disagree on some of the fields, or that one side lacks."""
    j = a.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(1).alias("_a")).join(b.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(1).alias("_b")), key, "full")
    lacks = F.col("_a").isNull() | F.col("_b").isNull()
    bad = F.filter(F.array(*[F.when(lacks | ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), f) for f in fields]), lambda f: f.isNotNull())
    return j.select(key, bad.alias("fields")).where(F.size("fields") > 0)


def shard_index(df: DataFrame, size: str, order: str, cap: int, shard: str, tokens: str = "tokens") -> DataFrame:
    """What a writer of flat shards records: each row's part (next-fit under cap bytes) and its token range
    [start, end) in it, as compressed sparse rows do."""
    placed = S.segments(df, size, order, cap, [shard]).withColumnRenamed("segment", "part").drop("offset")
    at = S.offsets(placed, tokens, order, [shard, "part"])
    return at.withColumnRenamed("offset", "start").withColumn("end", F.col("start") + F.col(tokens))


def shard_files(idx: DataFrame, shard: str, size: str, tokens: str = "tokens") -> DataFrame:
    """One row for each part: its rows, tokens, bytes and name."""
    g = idx.groupBy(shard, "part").agg(F.count("*").alias("conditions"), F.sum(tokens).alias("tokens"), F.sum(size).alias("nbytes"))
    return g.withColumn("name", F.format_string("train-%05d-%03d", F.col(shard).cast("int"), F.col("part").cast("int")))


def unpacked(df: DataFrame, layers: int, width: int) -> Checked:
    """Connector rows (token_ids, expected_ids, hidden, final) as ids, aux layers and the final vector of each token.

    hidden has tokens * layers values where final is given, else one more
    layer, which is split off and normalized. Ids have to be the expected ones.
    """
    n = F.size("token_ids")
    bare = F.col("final").isNull()
    rows = F.when(bare, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("hidden", i * ((layers + 1) * width) + 1, (layers + 1) * width)))
    aux = F.when(bare, F.flatten(F.transform(rows, lambda r: F.slice(r, 1, layers * width)))).otherwise(F.col("hidden"))
    last = F.when(bare, F.flatten(F.transform(rows, lambda r: V.rms_norm(F.slice(r, layers * width + 1, width))))).otherwise(F.col("final"))
    want = n * F.when(bare, F.lit((layers + 1) * width)).otherwise(F.lit(layers * width))
    reason = F.when((n < 1) | ~F.col("token_ids").eqNullSafe(F.col("expected_ids")), "other token ids").when(F.size("hidden") != want, "hidden shape").when(~bare & (F.size("final") != n * width), "final shape").when(~V.finite(F.col("hidden")), "not finite")
    c = split_by(df, reason)
    return Checked(c.good.select("*", aux.alias("aux"), last.alias("final_vectors")), c.bad)


def cache_report(df: DataFrame, layers: int, width: int, first_only: bool = False) -> DataFrame:
    """rows, bad rows and the first reason of a vector cache; of its first row only, if asked."""
    d = df.orderBy("source_index").limit(1) if first_only else df
    c = checked_samples(d, layers, width)
    reason = c.bad.groupBy().agg(F.count("*").alias("bad"), F.min_by("violation", "sample_id").alias("reason"))
    return d.agg(F.count("*").alias("rows")).crossJoin(reason)  # one row each


def low_rank_scores(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """prev, next and the dot product of their codebook rows."""
    a = left.select(F.col("id").alias("prev"), F.col("vector").alias("u"))
    b = right.select(F.col("id").alias("next"), F.col("vector").alias("w"))
    return pairs.join(a, "prev").join(b, "next").select("prev", "next", V.dot(F.col("u"), F.col("w")).alias("score"))


def two_tap(df: DataFrame, by: list[str], order: str, value: str, taps: tuple[float, float]) -> DataFrame:
    """taps[0] * the value before (0 at a block's begin) + taps[1] * the value."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("mixed", F.coalesce(F.lag(value).over(w), F.lit(0.0)) * taps[0] + F.col(value) * taps[1])
