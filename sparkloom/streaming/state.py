"""Keyed state on streams: counter deltas and an error ledger that forgets.

Both run on transformWithState; the session needs the RocksDB state store
(`with_state_store`). A key's state is one small row, so a stream's memory is
its live keys. Times are microseconds inside the state.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Scrapes of a counter that are sorted in memory at once, and rows of a batch of results.
RUN, ROWS = 1 << 18, 1 << 14
_SCRAPE = np.dtype([("at", "<i8"), ("value", "<f8")])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield spark
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _renewed(handle, at: int, keep_ms: int) -> None:
    """One timer a key, keep after its last event."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at // 1000 + keep_ms)


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The scrapes of frames by time and value, ROWS at once. Runs of RUN scrapes are sorted and lie in a file
    until they are merged, so that no counter is held whole."""
    with tempfile.TemporaryFile(buffering=0) as f:
        ends, held, n = [0], [], 0

        def put() -> None:
            run = np.concatenate(held)
            raw = memoryview(run[np.lexsort((run["value"], run["at"]))].tobytes())
            ends.append(ends[-1] + len(run))
            while raw:
                raw = raw[f.write(raw) :]
            held.clear()

        def run(a: int, b: int):
            for i in range(a, b, ROWS):
                # a value that is no number comes behind the others of its time
                yield from ((t, v != v, v) for t, v in np.frombuffer(os.pread(f.fileno(), (min(b, i + ROWS) - i) * _SCRAPE.itemsize, i * _SCRAPE.itemsize), _SCRAPE).tolist())

        for frame in frames:
            part = np.empty(len(frame), _SCRAPE)
            part["at"], part["value"] = frame["at"].to_numpy(), frame["value"].to_numpy()
            held.append(part)
            n += len(part)
            if n >= RUN:
                put()
                n = 0
        if held:
            put()
        merged = heapq.merge(*[run(a, b) for a, b in pairwise(ends)])
        while some := [(t, v) for t, _, v in islice(merged, ROWS)]:
            yield np.array(some, _SCRAPE)


class _Deltas(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self._keep = keep_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at long, value double")

    def handleInputRows(self, key, rows, timerValues):
        last = tuple(self._last.get()) if self._last.exists() else None
        begun = last
        for part in _in_order(rows):
            at, value = part["at"], part["value"]
            fresh = np.append(True, at[1:] > at[:-1]) & (last is None or at > last[0])
            kind, delta, since, none = np.full(len(part), "late", object), np.zeros(len(part)), np.zeros(len(part), np.int64), ~fresh
            if fresh.any():
                new, now = at[fresh], value[fresh]
                before = np.append(np.nan if last is None else last[1], now[:-1])
                reset = now < before
                kind[fresh], delta[fresh] = np.where(reset, "reset", "step"), np.where(reset, now, now - before)
                since[fresh] = np.append(0 if last is None else last[0], new[:-1])
                if last is None:
                    kind[0], none[0] = "first", True
                last = (int(new[-1]), float(now[-1]))
            real = lambda x, t, mask=None: pd.Series(pa.array(x, mask=mask), dtype=pd.ArrowDtype(t))  # noqa: E731  no null for what is no number
            yield pd.DataFrame({
                "source": pd.Series([key[0]] * len(part), dtype=object), "counter": pd.Series([key[1]] * len(part), dtype=object), "at": at, "value": real(value, pa.float64()),
                "delta": real(delta, pa.float64(), none), "since": real(since, pa.int64(), none), "kind": kind,
            })
        if last != begun:
            self._last.update(last)
            _renewed(self._handle, last[0], self._keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._last.clear()
        return iter(())

    def close(self) -> None:
        pass


def counter_deltas(stream: DataFrame, source: str, counter: str, ts: str, value: str, keep: int = 24 * 3600, late: str = "1 hour") -> DataFrame:
    """source, counter, ts, value, delta, since and kind of each scrape of a stream.

    delta is the growth since the scrape before (since). kind: "first" has
    no delta; after a "reset" (a value below the one before) the delta is the
    whole value; a "late" scrape, not newer than the last one seen, has no
    delta and changes nothing, so a replayed one counts once; else "step".
    Scrapes behind the watermark (late) are dropped. A counter that is silent
    for keep seconds of event time is forgotten: its next scrape is a first
    one. Scrapes without time or value are left out. Null sources or counters
    are keys of their own.
    """
    rows = stream.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(source).cast("string").alias("source"), F.col(counter).cast("string").alias("counter"), F.unix_micros(F.col(ts)).alias("at"), F.col(value).cast("double").alias("value"), F.col(ts).alias("event_time"))
    out = rows.groupBy("source", "counter").transformWithStateInPandas(_Deltas(keep * 1000), "source string, counter string, at long, value double, delta double, since long, kind string", "Append", "eventTime")
    return out.select(F.col("source").alias(source), F.col("counter").alias(counter), F.timestamp_micros("at").alias(ts), F.col("value").alias(value), "delta", F.timestamp_micros("since").alias("since"), "kind")


class _Ledger(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self._keep = keep_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "seq long, status string, at long, events long")

    def handleInputRows(self, key, rows, timerValues):
        seq, status, at, events = tuple(self._last.get()) if self._last.exists() else (None, None, 0, 0)
        before = seq
        for r in rows:
            events += 1
            at = max(at, r.at)
            if seq is None or r.seq > seq:
                seq, status = r.seq, r.status
        self._last.update((seq, status, at, events))
        _renewed(self._handle, at, self._keep)
        if seq != before:
            yield Row(id=key[0], seq=seq, status=status, at=at, events=events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._last.exists():
            seq, status, at, events = tuple(self._last.get())
            self._last.clear()
            yield Row(id=key[0], seq=seq, status=f"{status} (expired)", at=at, events=events)

    def close(self) -> None:
        pass


def error_ledger(stream: DataFrame, key: str, seq: str, status: str, ts: str, keep: int, late: str = "0 seconds") -> DataFrame:
    """Changes of each id's status (id, seq, status, at, events): the event with the greatest seq counts, in whatever order they come.

    An id without events for keep seconds of event time is forgotten: its
    last status leaves once more, marked as expired, and an event after that
    begins it anew. Until then the state of a resolved id stays, so that an
    older error that comes late does not open it again. Events behind the
    watermark (late) are dropped. Rows without id, seq or time are left out.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key).cast("string").alias("id"), F.col(seq).cast("long").alias("seq"), F.col(status).cast("string").alias("status"), F.unix_micros(F.col(ts)).alias("at"), F.col(ts).alias("event_time"))
    out = rows.groupBy("id").transformWithState(_Ledger(keep * 1000), "id string, seq long, status string, at long, events long", "Update", "eventTime")
    return out.select("id", "seq", "status", F.timestamp_micros("at").alias("at"), "events")
