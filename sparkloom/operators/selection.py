"""Row identity, ranges, shards and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from ..violations import ContractError


def belongs(index: Column, shard: int, shards: int) -> Column:
    """index modulo shards == shard; arguments are checked."""
    if shards < 1 or not 0 <= shard < shards:
        raise ContractError(f"shard {shard} of {shards}")
    return F.pmod(index, F.lit(shards)) == shard


def with_global_index(df: DataFrame, file_col: str, row_col: str, out: str = "global_index") -> DataFrame:
    """Position over all files (by path parts), then rows within a file.

    Files are counted first; the table of counts has a row for each file and
    is summed up there, so that no window runs over the data itself.
    """
    per_file = df.groupBy(F.col(file_col).alias("_f")).agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.split("_f", "/")).rowsBetween(Window.unboundedPreceding, -1)
    base = per_file.select("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return df.join(base, df[file_col] == base["_f"]).withColumn(out, F.col("_base") + F.col(row_col)).drop("_f", "_base")


def dealt_in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df range-partitioned by order, with the partition's number in "_part".

    Written down once through the shared folder: ranges are sampled, so a
    second run, or one after a lost executor, could cut them elsewhere.
    """
    return checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running_sum(df: DataFrame, value: Column, order: list[str], out: str, by: list[str] | None = None) -> DataFrame:
    """Sum of value over the rows in front, within each group of by, in two levels.

    Ranges of (by, order) are summed where they lie; only the sums of ranges
    are summed up in order. A group with a third of all rows is many ranges,
    where one window over the group would be one task.
    """
    by = by or []
    dealt = dealt_in_order(df, [*by, *order])
    local = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    sums = dealt.groupBy("_part", *by).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", *by, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    keys = ["_part", *by]
    match = None
    base = base.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_base")
    for k in keys:
        same = rows[k].eqNullSafe(base[f"_k_{k}"])
        match = same if match is None else match & same
    return rows.join(base, match, "left").withColumn(out, (F.col("_base") + F.col("_local")).cast("long")).drop("_part", "_local", "_base", *[f"_k_{k}" for k in keys])


def ordered_index(df: DataFrame, order: str | list[str], out: str = "global_index") -> DataFrame:
    """0-based position by columns without a window over all rows."""
    return running_sum(df, F.lit(1), [order] if isinstance(order, str) else list(order), out)


def select_rows(df: DataFrame, row_id: str | None = None, kinds: list[str] | None = None, id_col: str = "id", kind_col: str = "input_kind") -> DataFrame:
    """Rows with that id and one of the kinds; an id has to match one row exactly."""
    if kinds:
        df = df.where(F.col(kind_col).isin(kinds))
    if row_id is not None:
        df = df.where(F.col(id_col) == row_id)
        if (n := df.limit(2).count()) != 1:
            raise ContractError(f"{n or 'no'} rows have the id {row_id}")
    return df


def in_range(index: Column, start: int = 0, end: int | None = None) -> Column:
    return (index >= start) if end is None else (index >= start) & (index < end)


def limit_after(df: DataFrame, done: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows in order among those whose key is not done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti").orderBy(order).limit(n)


def ordered_batches(df: DataFrame, order: str | list[str], rows: int) -> DataFrame:
    """df with batch and place (both from 0): batches of so many rows in order, the last one shorter.

    A consumer that takes one batch after the other reads `where batch = n`;
    none is gathered here, and the order needs no window over all rows.
    """
    if rows < 1:
        raise ContractError(f"batches of {rows} rows")
    at = ordered_index(df, order, "_at")
    return at.withColumn("batch", F.expr(f"_at div {rows}")).withColumn("place", (F.col("_at") % rows).cast("int")).drop("_at")
