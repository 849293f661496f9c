"""Byte ranges of files, read and written on the executors.

Files are opened where the tasks run, through the file systems that Arrow
knows by URI (local, HDFS, S3, GCS), and read from 64-bit offsets; no file
passes the driver or a single row. What is listed comes from Spark's own
listing, which reads no content.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sequence as S
from ..operators.reconcile import tree_digest
from ..violations import ContractError

#: Ranges of one file that go to one task, files a task holds open, and bytes of an output batch.
SPAN, OPEN, BATCH = 256 << 20, 16, 32 << 20
#: Bytes that are hashed by one row of work.
CHUNK = 64 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it; file:/x, file:///x and /x are local."""
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


class _Files:
    """A few open files, the least recently used one closed first."""

    def __init__(self):
        self._open: OrderedDict = OrderedDict()

    def get(self, path: str):
        if path in self._open:
            self._open.move_to_end(path)
        else:
            fs, p = located(path)
            info = fs.get_file_info(p)
            self._open[path] = (fs.open_input_file(p), info.size) if info.type == pafs.FileType.File else (None, 0)
            if len(self._open) > OPEN:
                self._close(self._open.popitem(last=False)[1])
        return self._open[path]

    @staticmethod
    def _close(entry) -> None:
        if entry[0] is not None:
            entry[0].close()

    def close(self) -> None:
        while self._open:
            self._close(self._open.popitem()[1])


def files_below(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and bytes of the files below root that are not empty; their content is not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return listed.select("path", F.col("length").alias("bytes"))


def read_ranges(df: DataFrame, ranges: dict[str, tuple], order: list[str]) -> DataFrame:
    """df with a column for each named range, and "violation".

    ranges: name to (path, offset, nbytes, sha256 or None, numpy type or
    None), each a Column of df but the type. With a type the range becomes an
    array of numbers, else it stays bytes. Rows go to tasks by their first
    path and SPAN of offsets and are sorted there, so that a file is opened
    once and read forwards, and a large file is read by many tasks.

    Violations: "missing" file, "short" (the file ends before the range
    does), "checksum", "alignment" (no whole numbers); such a range is null.
    The other columns are carried along, whatever their names.
    """
    names = list(ranges)
    path, offset = ranges[names[0]][:2]
    parts = [F.struct(p.alias("path"), o.cast("long").alias("offset"), n.cast("long").alias("nbytes"), (F.lit(None).cast("string") if s is None else s).alias("sha256")) for p, o, n, s, _ in ranges.values()]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.array(*parts).alias("parts"), path.alias("_p"), offset.cast("long").alias("_o"))
    rows = rows.repartition("_p", F.expr(f"_o div {SPAN}")).sortWithinPartitions("_p", "_o", *[f"row.`{c}`" for c in order]).select("row", "parts")
    types = [r[4] for r in ranges.values()]
    arrow = [pa.binary() if t is None else pa.list_(pa.int64() if np.dtype(t).kind in "iu" else pa.float64()) for t in types]

    def one(files, part, kind):
        f, size = files.get(part["path"])
        if f is None:
            return None, "missing"
        if part["offset"] < 0 or part["nbytes"] < 0 or part["offset"] + part["nbytes"] > size:
            return None, "short"
        f.seek(part["offset"])
        raw = f.read(part["nbytes"])
        if part["sha256"] is not None and hashlib.sha256(raw).hexdigest() != part["sha256"]:
            return None, "checksum"
        if kind is None:
            return raw, None
        if len(raw) % np.dtype(kind).itemsize:
            return None, "alignment"
        return np.frombuffer(raw, kind).astype(np.int64 if np.dtype(kind).kind in "iu" else np.float64), None

    def run(batches):
        files = _Files()
        try:
            for batch in batches:
                at, held, cols, bad = 0, 0, [[] for _ in names], []
                for i, parts in enumerate(batch.column(1).to_pylist()):
                    found = [one(files, p, t) for p, t in zip(parts, types, strict=True)]
                    for c, (v, _) in zip(cols, found, strict=True):
                        c.append(v)
                    bad.append(next((f"{n}: {b}" for n, (_, b) in zip(names, found, strict=True) if b), None))
                    held += sum(p["nbytes"] for p in parts)
                    if held > BATCH or i == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), *[pa.array(c, t) for c, t in zip(cols, arrow, strict=True)], pa.array(bad, pa.string())], names=["row", *names, "violation"])
                        at, held, cols, bad = i + 1, 0, [[] for _ in names], []
        finally:
            files.close()

    spark_types = [T.BinaryType() if t is None else T.ArrayType(T.LongType() if np.dtype(t).kind in "iu" else T.DoubleType()) for t in types]
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, t) for n, t in zip(names, spark_types, strict=True)], T.StructField("violation", T.StringType())])
    return rows.mapInArrow(run, schema).select("row.*", *names, "violation")


def segment_path(root: str, shard: Column, segment: Column, stream: str) -> Column:
    return F.concat(F.lit(f"{root.rstrip('/')}/shard="), shard.cast("string"), F.format_string("/segment-%05d/", segment.cast("int")), F.lit(f"{stream}.bin"))


def write_packed(df: DataFrame, root: str, streams: dict[str, str], cap: int, shard: str = "shard", key: str = "sample_id", order: str = "source_index") -> DataFrame:
    """Array columns of df as packed streams of segment files; returns the index, which is the commit.

    streams: column to numpy type. Rows of a shard go, in order, to segments
    of at most cap bytes (next-fit). A task writes the files of a segment
    under a name of its own and moves them into place when they are whole, so
    a repeated task replaces its own work. The index (root/index: shard,
    segment, key, order, tokens, and maps of offsets, nbytes and sha256 by
    stream) is written last; payload that it does not name is no part of the store.
    """
    names, types = list(streams), [np.dtype(t) for t in streams.values()]
    size = sum((F.coalesce(F.size(c), F.lit(0)).cast("long") * t.itemsize for c, t in zip(names, types, strict=True)), F.lit(0).cast("long"))
    placed = S.segments(df.select(shard, key, order, *names, size.alias("nbytes")), "nbytes", order, cap, [shard]).drop("offset")
    rows = placed.repartition(shard, "segment").sortWithinPartitions(shard, "segment", order)
    rows = rows.select(F.col(shard).cast("string").alias("shard"), "segment", F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("order"), *names)

    def folder(now) -> tuple[pafs.FileSystem, str]:
        fs, base = located(root)
        return fs, f"{base.rstrip('/')}/shard={now[0]}/segment-{now[1]:05d}"

    def run(batches):
        now, out, mark, at = None, [], "", []

        def close():
            for name, f in zip(names, out, strict=True):
                f.close()
                fs, place = folder(now)
                fs.move(f"{place}/_{mark}-{name}", f"{place}/{name}.bin")

        for batch in batches:
            entries = []
            columns = [batch.column(4 + k) for k in range(len(names))]
            for i, (s, g, k, o) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True)):
                if (s, g) != now:
                    if now is not None:
                        close()
                    now, mark, at = (s, g), uuid.uuid4().hex, [0] * len(names)
                    fs, place = folder(now)
                    fs.create_dir(place, recursive=True)
                    out = [fs.open_output_stream(f"{place}/_{mark}-{name}") for name in names]
                raws = [np.asarray(c[i].as_py() or [], np.float64 if t.kind == "f" else np.int64).astype(t).tobytes() for c, t in zip(columns, types, strict=True)]
                for f, raw in zip(out, raws, strict=True):
                    f.write(raw)
                entries.append((s, g, k, o, len(raws[0]) // types[0].itemsize, list(zip(names, at, strict=True)), [(n, len(r)) for n, r in zip(names, raws, strict=True)], [(n, hashlib.sha256(r).hexdigest()) for n, r in zip(names, raws, strict=True)]))
                at = [a + len(r) for a, r in zip(at, raws, strict=True)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.int64()), pa.map_(pa.string(), pa.int64()), pa.map_(pa.string(), pa.string())]
            cols = zip(*entries, strict=True) if entries else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "segment", "sample_id", "source_index", "tokens", "offsets", "nbytes", "sha256"])
        if now is not None:
            close()

    schema = "shard string, segment long, sample_id string, source_index long, tokens long, offsets map<string,long>, nbytes map<string,long>, sha256 map<string,string>"
    rows.mapInArrow(run, schema).write.parquet(f"{root}/index")
    return df.sparkSession.read.parquet(f"{root}/index")


def read_packed(index: DataFrame, root: str, streams: dict[str, str], verify: bool = True) -> DataFrame:
    """The samples of index rows with their arrays, read from the segment files, and "violation"."""
    entry = lambda c, n: F.try_element_at(F.col(c), F.lit(n))
    ranges = {n: (segment_path(root, F.col("shard"), F.col("segment"), n), entry("offsets", n), entry("nbytes", n), entry("sha256", n) if verify else None, t) for n, t in streams.items()}
    return read_ranges(index, ranges, ["source_index"])


def footers(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, columns, rows and row_groups of the Parquet files below root, from their footers alone."""

    def run(batches):
        for batch in batches:
            out = []
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, p = located(path)
                with fs.open_input_file(p) as f:
                    meta = pq.read_metadata(f)
                out.append((path, size, list(meta.schema.to_arrow_schema().names), meta.num_rows, meta.num_row_groups))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64()]
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", "bytes", "columns", "rows", "row_groups"])

    return files_below(spark, root, "*.parquet").mapInArrow(run, "path string, bytes long, columns array<string>, rows long, row_groups long")


def missing_columns(spark: SparkSession, root: str, columns) -> DataFrame:
    """path and missing: the files below root that lack some of the columns. A column of nulls is there."""
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in columns]), "columns"))
    return footers(spark, root).select("path", lacking.alias("missing")).where(F.size("missing") > 0)


def require_file_columns(spark: SparkSession, root: str, columns) -> None:
    found = missing_columns(spark, root, columns).orderBy("path").limit(10).collect()
    if found:
        raise ContractError("; ".join(f"{r.path} lacks {', '.join(r.missing)}" for r in found))


def file_hashes(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, bytes and digest of files (path, bytes): SHA-256 over the SHA-256 of each chunk, in order.

    Chunks of one file are hashed by different tasks; an empty file has no chunk.
    """
    pieces = files.select("path", "bytes", F.explode(F.when(F.col("bytes") > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {chunk}"))).otherwise(F.array(F.lit(-1).cast("long")))).alias("i"))
    pieces = pieces.repartition("path", "i").sortWithinPartitions("path", "i")  # a task opens a file once

    def run(batches):
        files = _Files()
        try:
            for batch in batches:
                paths, sizes, at = (c.to_pylist() for c in batch.columns)
                out = []
                for path, i in zip(paths, at, strict=True):
                    f, size = files.get(path)
                    if f is None:
                        raise FileNotFoundError(path)
                    digest, left = hashlib.sha256(), min(chunk, size - i * chunk) if i >= 0 else 0
                    if left:
                        f.seek(i * chunk)
                    while left > 0:
                        raw = f.read(min(left, 4 << 20))
                        digest.update(raw)
                        left -= len(raw)
                    out.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64()), pa.array(at, pa.int64()), pa.array(out)], names=["path", "bytes", "i", "h"])
        finally:
            files.close()

    hashed = pieces.mapInArrow(run, "path string, bytes long, i long, h string")
    order = F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
    return hashed.groupBy("path", "bytes").agg(F.sha2(F.array_join(order, ""), 256).alias("digest"))


def whole_hashes(files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of files (path, bytes): the plain SHA-256 of the whole file."""

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                fs, p = located(path)
                digest = hashlib.sha256()
                with fs.open_input_stream(p) as f:
                    while raw := f.read(4 << 20):
                        digest.update(raw)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["path", "bytes", "sha256"])

    return files.select("path", "bytes").repartition("path").mapInArrow(run, "path string, bytes long, sha256 string")


def content_fingerprint(spark: SparkSession, root: str, chunk: int = CHUNK, relative: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row: files, bytes, rows, row_groups and fingerprint of the Parquet files below root.

    The fingerprint is that of the set of their names below root with sizes,
    row counts and chunk hashes; neither tasks nor the order of listing
    matter. Files of any size are hashed in chunks.
    """
    base = located(root)[1].rstrip("/")
    name = relative(F.col("path")) if relative else F.substring_index("path", base + "/", -1)
    all_ = file_hashes(files_below(spark, root, "*.parquet"), chunk).join(footers(spark, root).select("path", "rows", "row_groups"), "path")
    lines = all_.select("bytes", "rows", "row_groups", F.concat_ws("\t", name, "bytes", "rows", "row_groups", "digest").alias("line"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    totals = lines.agg(F.count("*").alias("files"), zero("bytes"), zero("rows"), zero("row_groups"), F.lit(1).alias("one"))
    return totals.join(tree_digest(lines, "line", 1).select(F.lit(1).alias("one"), F.col("digest").alias("fingerprint")), "one").drop("one")
