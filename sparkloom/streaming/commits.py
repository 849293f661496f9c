"""A table of committed batches: staged, then shown by one rename.

root/_staging/<name> holds what is being written; root/batch=<number> what is
committed, data and manifest together. The rename fails if the batch is
there, so a reader sees whole batches only, a replayed batch is no second
one, and of two racing writers one wins. A writer takes an epoch in
root/_writers the same way; an older one can commit no more.

It needs a file system whose rename is one step (HDFS, local disks).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..violations import ContractError


class Committed:
    """One writer's view of the table below root."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root, self._epoch = spark, root.rstrip("/"), None
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self._root}/{p}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _shown(self, staged: str, target: str) -> bool:
        """The rename; False if the target is there."""
        if self._fs.exists(self._path(target)):
            return False
        try:
            self._context.rename(self._path(staged), self._path(target), self._none)
        except Exception:
            if self._fs.exists(self._path(target)):
                return False
            raise
        return True

    def _put(self, path: str, value: dict) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(json.dumps(value, sort_keys=True).encode())
        finally:
            out.close()

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        p = self._path(folder) if folder else self._path("x").getParent()
        found = self._fs.listStatus(p) if self._fs.exists(p) else []
        return sorted(int(n[len(prefix) :]) for n in (f.getPath().getName() for f in found) if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def claim(self, name: str) -> int:
        """Become the writer: the next epoch. Writers of earlier epochs can commit no more."""
        staged = f"_staging/{uuid.uuid4().hex}"
        while True:
            epoch = max(self._numbers("_writers", "epoch="), default=0) + 1
            self._put(f"{staged}/writer.json", {"name": name, "epoch": epoch})
            self._fs.mkdirs(self._path("_writers"))
            if self._shown(staged, f"_writers/epoch={epoch}"):
                self._epoch = epoch
                return epoch

    def _require_writer(self) -> None:
        newest = max(self._numbers("_writers", "epoch="), default=0)
        if self._epoch is not None and newest != self._epoch:
            raise ContractError(f"epoch {newest} writes to {self._root}, this writer has epoch {self._epoch}")

    def append(self, df: DataFrame, number: int) -> bool:
        """Commit df as batch number; False if that batch is committed already. Nothing of it is seen before.

        A batch whose Spark job breaks leaves only what lies in _staging.
        """
        self._require_writer()
        if number in self.batches():
            return False
        staged = f"_staging/{uuid.uuid4().hex}"
        df.write.parquet(f"{self._root}/{staged}")
        rows = self._spark.read.schema(df.schema).parquet(f"{self._root}/{staged}").count()
        self._put(f"{staged}/manifest.json", {"batch": number, "rows": rows, "epoch": self._epoch})
        self._require_writer()
        done = self._shown(staged, f"batch={number}")
        if not done:
            self._fs.delete(self._path(staged), True)
        return done

    def batches(self) -> list[int]:
        return self._numbers("", "batch=")

    def read(self) -> DataFrame:
        """The committed rows with their batch."""
        if not self.batches():
            raise ContractError(f"nothing is committed in {self._root}")
        return self._spark.read.option("basePath", self._root).option("pathGlobFilter", "*.parquet").parquet(f"{self._root}/batch=*")

    def manifests(self) -> DataFrame:
        return self._spark.read.schema("batch long, rows long, epoch long").json([f"{self._root}/batch={n}/manifest.json" for n in self.batches()])

    def verify(self) -> None:
        """Each batch has the rows that its manifest says."""
        have = self.read().groupBy("batch").agg(F.count("*").alias("n"))
        bad = self.manifests().join(have, "batch", "left").where(F.coalesce("n", F.lit(0)) != F.col("rows")).orderBy("batch").limit(10).collect()
        if bad:
            raise ContractError(f"batches differ from their manifests: {', '.join(str(r.batch) for r in bad)}")

    def sweep(self) -> int:
        """Remove what broken or beaten writers left in _staging; for the one writer, between its batches."""
        self._require_writer()
        p = self._path("_staging")
        left = list(self._fs.listStatus(p)) if self._fs.exists(p) else []
        for f in left:
            self._fs.delete(f.getPath(), True)
        return len(left)


def committed_stream(stream: DataFrame, root: str, checkpoint: str, name: str = "stream"):
    """Each micro-batch is one committed batch of its number; replays after a failure commit nothing twice."""
    table = Committed(stream.sparkSession, root)
    table.claim(name)
    return stream.writeStream.foreachBatch(lambda batch, number: table.append(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
