"""Streams: idempotent commits by batch and the last state of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_by_batch(stream: DataFrame, path: str, checkpoint: str):
    """Each micro-batch goes to a folder of its own number, so a replay overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_states(stream: DataFrame, key: str = "id", seq: str = "seq", status: str = "status") -> DataFrame:
    """Streaming form of the ledger's state: one row for each id, updated as events come."""
    return stream.groupBy(key).agg(F.max_by(status, seq).alias(status), F.count("*").alias("events"))


def without_done(stream: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Stream rows whose key is not in the static table of finished ones."""
    return stream.join(done.select(F.col(key).alias("_k")).distinct().withColumn("_d", F.lit(True)), F.col(key) == F.col("_k"), "left").where("_d is null").drop("_k", "_d")


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
