"""Keyed restores, set reconciliation, ledgers and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..violations import ContractError, require_empty


def missing(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys of want that have lacks."""
    return want.select(key).distinct().join(have.select(key), key, "left_anti")


def reconcile(owned: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """Both differences: key and side ("missing" or "unexpected")."""
    a = missing(owned, committed, key).withColumn("side", F.lit("missing"))
    return a.unionByName(missing(committed, owned, key).withColumn("side", F.lit("unexpected")))


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique_or_raise(df: DataFrame, key: str) -> DataFrame:
    require_empty(duplicates(df, key), key, "duplicate keys")
    return df


def digest(df: DataFrame, key: str) -> DataFrame:
    """One row: SHA-256 over the sorted ids, each with a line end; of nothing for no ids.

    Meant for id lists that fit into one row; see ``tree_digest`` beyond that.
    """
    ids = F.sort_array(F.collect_list(F.col(key).cast("string")))
    text = F.when(F.size(ids) == 0, "").otherwise(F.concat(F.array_join(ids, "\n"), F.lit("\n")))
    return df.where(F.col(key).isNotNull()).agg(F.sha2(text, 256).alias("digest"), F.count(key).alias("n"))


def tree_digest(df: DataFrame, key: str, levels: int = 2) -> DataFrame:
    """One row, for any number of ids: SHA-256 over the digests of a tree whose nodes have 4,096 children at most.

    A leaf holds the ids whose own SHA-256 begins with its 3 * levels hex
    digits, sorted; a node the digests of its children in order, each with a
    line end.
    """
    ids = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"))
    lines = lambda c: F.sha2(F.concat(F.array_join(c, "\n"), F.lit("\n")), 256)
    t = ids.groupBy(F.left(F.sha2("k", 256), F.lit(3 * levels)).alias("b")).agg(lines(F.sort_array(F.collect_list("k"))).alias("h"), F.count("*").alias("c"))
    for level in range(levels - 1, 0, -1):
        t = t.groupBy(F.left("b", F.lit(3 * level)).alias("b")).agg(lines(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])).alias("h"), F.sum("c").alias("c"))
    top = F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
    return t.agg(F.when(F.size(top) == 0, F.sha2(F.lit(""), 256)).otherwise(lines(top)).alias("digest"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def keep_first(df: DataFrame, key, order, keep_last: bool = False) -> DataFrame:
    """One row for each key: the first (or last) in an explicit order."""
    keys = [key] if isinstance(key, str) else list(key)
    by = [F.col(c).desc() if keep_last else F.col(c).asc() for c in ([order] if isinstance(order, str) else order)]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn")


def ordered_union(frames: list[DataFrame], key: str) -> DataFrame:
    """All rows once a key; an earlier frame's row wins."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_source", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return keep_first(out, key, "_source").drop("_source")


def restore(targets: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Targets with the first source row of their keys; a target is served once."""
    first = keep_first(source, keys, order)
    return targets.join(first, keys)


def restore_anywhere(targets: DataFrame, source: DataFrame, key: str, priority: list[tuple[str, int]], place: str, order: str) -> DataFrame:
    """Targets of unknown place: the source row of the best place; unlisted places serve none."""
    ranks = source.sparkSession.createDataFrame(priority, f"{place} string, _rank int")
    ranked = source.join(F.broadcast(ranks), place)
    return targets.join(keep_first(ranked, key, ["_rank", order]).drop("_rank"), key)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert or replace on each key in turn; the highest seq wins."""
    out = table.unionByName(changes)
    for k in keys:
        out = keep_first(out, k, seq, keep_last=True)
    return out


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join that raises for keys the table lacks."""
    require_empty(missing(df, table, key), key, "keys not found")
    return df.join(table, key)


def outer_map(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a table of unique keys."""
    return df.join(unique_or_raise(table, key), key, "left")


def ledger_state(events: DataFrame, key: str = "id", seq: str = "seq", status: str = "status") -> DataFrame:
    """The last status of each id."""
    return events.groupBy(key).agg(F.max_by(status, seq).alias(status))


def unresolved(events: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    return ledger_state(events, key, seq).where("status = 'error'").select(key)


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """key, matches; both runs need the same keys and a value in every row.

    With order, the last row of a key counts; without, a key has one row.
    """
    last = lambda d: d.groupBy(key).agg(F.max_by(value, order).alias(value)) if order else unique_or_raise(d, key)
    both = last(a).select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")).join(last(b).select(key, F.col(value).alias("_b"), F.lit(1).alias("_y")), key, "full")
    what = F.when(F.col("_x").isNull() | F.col("_y").isNull(), "keys of one run only").when(F.col("_a").isNull() | F.col("_b").isNull(), "values are missing")
    if found := both.select(F.col(key).cast("string").alias("k"), what.alias("what")).where("what is not null").orderBy("what", "k").limit(10).collect():
        raise ContractError("; ".join(f"{r.what}: {r.k}" for r in found))
    return both.select(key, (F.col("_a") == F.col("_b")).alias("matches"))


def speedup(matches: DataFrame, baseline_tps: float, candidate_tps: float, exact: bool = False) -> DataFrame:
    if baseline_tps <= 0:
        raise ContractError("the baseline's rate must be positive")
    if exact:
        require_empty(matches.where("not matches"), matches.columns[0], "outputs differ")
    return matches.agg(F.bool_and("matches").alias("exact"), F.avg(F.col("matches").cast("double")).alias("match_rate"), F.lit(candidate_tps / baseline_tps).alias("speedup"))


def comparison_checks(runs: DataFrame, samples: DataFrame, exact: bool) -> DataFrame:
    """What forbids the comparison of candidate runs with their baselines, as (pair, check, found).

    runs: pair, role (baseline or candidate), fixture_sha256, sampling (JSON
    text), temperature, rejection_mode, tps, drafts, draft_tokens. samples:
    pair, role, sample_id, output_token_ids. Checks: both runs there, the same
    samples, fixtures and sampling, outputs recorded and, with exact, equal;
    a positive rate of the baseline; drafts of the candidate; standard
    rejection where it samples.
    """
    of = lambda role: runs.where(F.col("role") == role).select("pair", *[F.col(c).alias(f"{role[0]}_{c}") for c in runs.columns if c not in ("pair", "role")])
    d = runs.select("pair").distinct().join(of("baseline"), "pair", "left").join(of("candidate"), "pair", "left")
    side = lambda role: samples.where(F.col("role") == role).select("pair", "sample_id", F.col("output_token_ids").alias(role), F.lit(True).alias(f"has_{role}"))
    s = side("baseline").join(side("candidate"), ["pair", "sample_id"], "full")
    s = s.groupBy("pair").agg(
        F.count_if(F.col("has_baseline").isNull() | F.col("has_candidate").isNull()).alias("lacking"),
        F.count_if(F.col("baseline").isNull() | F.col("candidate").isNull()).alias("unrecorded"), F.count_if(F.col("baseline") != F.col("candidate")).alias("differing"),
    )
    d = d.join(s, "pair", "left")
    differ = lambda c: ~F.col(f"b_{c}").eqNullSafe(F.col(f"c_{c}"))
    at_least = lambda c: F.coalesce(F.col(c), F.lit(0)) <= 0
    whole = F.col("b_tps").isNotNull() & F.col("c_tps").isNotNull()
    one = [
        ("runs", ~whole, F.lit(None)), ("samples", F.coalesce("lacking", F.lit(1)) > 0, F.col("lacking")), ("fixture", differ("fixture_sha256"), F.col("c_fixture_sha256")), ("sampling", differ("sampling"), F.col("c_sampling")),
        ("outputs", F.col("unrecorded") > 0, F.col("unrecorded")), ("exact", F.lit(exact) & (F.col("differing") > 0), F.col("differing")), ("rate", at_least("b_tps"), F.col("b_tps")),
        ("drafts", at_least("c_drafts") | at_least("c_draft_tokens"), F.col("c_drafts")), ("rejection", (F.coalesce("c_temperature", F.lit(0.0)) > 0) & ~F.col("c_rejection_mode").eqNullSafe(F.lit("standard")), F.col("c_rejection_mode")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("check"), v.cast("string").alias("found"))) for n, bad, v in one]), lambda c: c.isNotNull())
    return d.select("pair", F.explode(found).alias("c")).select("pair", "c.check", "c.found")


def drift(a: Column, b: Column) -> Column:
    """Keys whose values differ between two map columns, with both values."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("left"), y.alias("right")))
    return F.map_filter(both, lambda k, v: ~v["left"].eqNullSafe(v["right"]))


def gates_failed(required: DataFrame, results: DataFrame, name: str = "gate") -> DataFrame:
    """Required gates that no result passes, and results that fail."""
    return required.join(results.groupBy(name).agg(F.bool_and("passed").alias("ok")), name, "left").where("not coalesce(ok, false)").select(name)


def consistent(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Whether all rows of a group have one value."""
    return df.groupBy(*by).agg((F.countDistinct(value) == 1).alias("consistent"))


def partition_law(base: DataFrame, shards: list[DataFrame], key: str) -> DataFrame:
    """key and reason of what keeps the shards from being a partition of base: "missing", "unexpected" or "repeated"."""
    every = None
    for d in shards:
        every = d.select(key) if every is None else every.unionByName(d.select(key))
    have, want = every.groupBy(key).agg(F.count("*").alias("_h")), base.groupBy(key).agg(F.count("*").alias("_w"))
    j = want.join(have, key, "full")
    reason = F.when(F.col("_h").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").when(F.col("_h") > F.col("_w"), "repeated").when(F.col("_h") < F.col("_w"), "missing")
    return j.select(key, reason.alias("reason")).where("reason is not null")


def any_and_all(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Whether any and whether every row of a group is set; a missing flag is not set."""
    set_ = F.coalesce(F.col(flag), F.lit(False))
    return df.groupBy(*by).agg(F.bool_or(set_).alias("any"), F.bool_and(set_).alias("all"))
