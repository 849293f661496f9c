"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches, checkpointed, shared_dir  # noqa: F401

#: Rows handled at once inside an Arrow batch; bounds the temporary arrays.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this application: what a lost driver leaves lies below one name, run-<application id>."""
    _made.append(f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    return len(_made)


def clean(spark: SparkSession, since: int = 0, last: bool = False) -> None:
    """Remove the intermediate tables that this process made (since made() was that number; not the last one, if
    asked); results that were not written are gone with them."""
    kept = [_made.pop()] if last and len(_made) > since else []
    while len(_made) > since:
        remove(spark, _made.pop())
    _made.extend(kept)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once and kept as Parquet in the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one run. ``remove`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self._paths.pop(name))


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Between phases: Spark deletes shuffle files once the driver's JVM has collected what they belong to.

    A driver with a large heap may collect late, and then the disks of the
    executors hold the shuffles of phases that are over.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_counted(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, share: int = 4096) -> DataFrame:
    """rows joined with one row of groups for each key; n is the number of rows of the key.

    Keys with more than 1 / share of the ``total`` rows are share at most, so
    their groups are broadcast and their rows stay where they are, however
    hot; the others are joined by a shuffle, in which no key is large. rows
    is read twice, so it should be a written table.
    """
    most = max(1, total // share)
    hot = F.broadcast(groups.where(F.col(n) > most))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(n) <= most), key)
    return rows.join(hot, key).unionByName(cold)


def text_slices(batch: pa.RecordBatch, column: str = "text"):
    """(first row, rows, offsets, bytes) of consecutive rows of about SLICE_BYTES each.

    offsets are relative to the bytes; a null text counts as empty. A text
    longer than SLICE_BYTES makes a slice of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + SLICE_BYTES, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to - at, offs[at : to + 1] - offs[at], data[offs[at] : offs[to]]
        at = to


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _lut(seed: int) -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _lut(17)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n-1 modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _BASE, np.uint64)]).cumprod(dtype=np.uint64)[:n]


_POWERS: list[np.ndarray] = []
#: Bytes whose powers are kept in a worker (16 bytes each).
_KEPT = 4 * SLICE_BYTES


def _kept_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64, to the powers of 0 .. n-1 at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = min(_KEPT, max(n, SLICE_BYTES + (SLICE_BYTES >> 2)))
        with np.errstate(over="ignore"):
            inverse = np.full(max(0, size - 1), pow(_BASE, -1, 1 << 64), np.uint64)
            _POWERS[:] = [powers(size), np.concatenate([np.ones(1, np.uint64), inverse]).cumprod(dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def word_hashes(offs: np.ndarray, data: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit fingerprints of the words ``[^\\x20\\x09-\\x0D]+`` of several texts (between: another table of separators).

    Returns (hashes, starts, ends, word offsets): starts and ends are byte
    positions, word offsets has the first word of each text and the total.
    Words are hashed in pieces of SLICE_BYTES, so that the temporary arrays
    do not grow with one very long text.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    space = between[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs[offs <= n]] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= edge[1:]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    del before, after, edge
    lut = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_BYTES)))
        lo, hi = starts[at], ends[to - 1]
        s, lens = starts[at:to] - lo, ends[at:to] - starts[at:to]
        with np.errstate(over="ignore"):
            v = lut[data[lo:hi]]
            if len(v) <= _KEPT:
                # a word is the difference of two running sums, moved to its begin
                up, down = _kept_powers(len(v))
                sums = np.zeros(len(v) + 1, np.uint64)
                np.cumsum(np.multiply(v, up[: len(v)], out=v), out=sums[1:])
                v = (sums[s + lens] - sums[s]) * down[s]
            else:
                v[space[lo:hi]] = 0
                span = np.diff(np.append(s, hi - lo))
                place = np.arange(hi - lo, dtype=np.int64) - np.repeat(s, span)
                v *= powers(int(span.max()))[place]
                v = np.add.reduceat(v, s)
            out[at:to] = _mix(v + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out, starts, ends, np.searchsorted(starts, offs).astype(np.int64)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of each run of k consecutive word hashes; len(h) - k + 1 of them, from 0."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros((m, *h.shape[1:]), np.uint64)
        for i in range(k):
            out *= np.uint64(_BASE)
            out += h[i : i + m]
        return _mix(out)


def row_key(*cols) -> F.Column:
    """One 64-bit key of several columns, nulls included."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) if isinstance(c, str) else c for c in cols])
