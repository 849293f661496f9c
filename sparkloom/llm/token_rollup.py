"""Token counts as delta-maintained rollups.

A change is a signed row: +1 document and +n tokens for an insert, both
negated for a delete, and the pair (old negated, new) for a revised count.
A batch of changes is summed by source, language and tokenizer version and
committed once under its batch id; totals are the sums over all batches.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenizing import RANKS, VOCABULARY, encoder

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
VERSION = "byte_bpe_50k"


def token_counts(docs: DataFrame, version: str = VERSION, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens, n_chars and text_md5 of each row of docs.

    A null or empty text has 0 tokens and 0 characters; long texts count
    whole; null source, lang and doc_id stay null; repeated rows are counted
    each. An empty table gives no rows; other columns are not read.
    """

    def run(batches):
        enc = encoder(vocabulary, ranks)
        for batch in batches:
            text = batch.column(4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([len(enc.encode(t.as_py() or "")) for t in text], pa.int64()), pa.array([len(t.as_py() or "") for t in text], pa.int64())], names=["doc_id", "source", "lang", "text_md5", "n_tokens", "n_chars"])

    common.bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.md5(text).alias("text_md5"), text.alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, text_md5 string, n_tokens long, n_chars long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens", "n_chars", "text_md5")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_chars")).alias("n_chars"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that turn the counts ``old`` into ``new``; equal rows cancel in the sums."""
    return deletes(old).unionByName(inserts(new))


def with_end(counts: DataFrame) -> DataFrame:
    """The counts with the end id that packing puts behind each document."""
    return counts.withColumn("n_tokens", F.col("n_tokens") + 1)


def first_of_each_text(counts: DataFrame) -> DataFrame:
    """One row for each text: that of the smallest doc_id (null ids last), then of the least source and lang.

    A group of copies is reduced by partial minima, whatever its size.
    """
    rest = [c for c in counts.columns if c != "text_md5"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_no_id"), *rest))
    return counts.groupBy("text_md5").agg(least.alias("r")).select("text_md5", "r.*").select(*counts.columns)


class Rollup:
    """Totals kept as one folder of summed deltas for each committed batch.

    A batch is written to a hidden staging folder and appears under its id by
    one rename, which fails if the id is there. So a broken write is never
    counted, and of two writers of one id one commits. (On a store whose
    renames are copies, keep the rollup on a file system that has them.)

    compact() sums what is committed into one base, shown by a rename too: its
    sums and the ids it stands for. Those ids stay committed, so a batch that
    is sent again counts no second time, and a batch folder that a broken
    compaction left is no longer read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs().mkdirs(self._hadoop(self.path))

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, batch_id: str) -> str:
        if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id):
            raise ValueError("a batch id has letters, digits, '-', '_' and '.'")
        return f"{self.path}/batch_id={batch_id}"

    def committed(self, batch_id: str) -> bool:
        if self._fs().exists(self._hadoop(self._folder(batch_id))):
            return True
        base = self._base()
        return base is not None and self._ids(base).where(F.col("batch_id") == batch_id).limit(1).count() > 0

    def _named(self, folder: str, prefix: str) -> list[str]:
        p = self._hadoop(folder)
        names = [f.getPath().getName() for f in self._fs().listStatus(p)] if self._fs().exists(p) else []
        return [n[len(prefix) :] for n in names if n.startswith(prefix)]

    def _base(self) -> int | None:
        return max((int(n) for n in self._named(f"{self.path}/_bases", "base=")), default=None)

    def _ids(self, base: int) -> DataFrame:
        return self.spark.read.schema("batch_id string").parquet(f"{self.path}/_bases/base={base}/ids")

    def _renamed(self, staged: str, target: str) -> None:
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files.rename(self._hadoop(staged), self._hadoop(target), no_overwrite)

    def stage(self, signed: DataFrame) -> str:
        """Sum a batch into a staging folder, which no reader sees; returns the folder."""
        summed = signed.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        folder = f"{self.path}/_staging/{uuid.uuid4().hex}"
        summed.write.parquet(folder)
        return folder

    def publish(self, batch_id: str, staged: str) -> bool:
        """Make a staged batch the one of its id; False, and the staged rows gone, if another was first."""
        if self.committed(batch_id):
            common.remove(self.spark, staged)
            return False
        try:
            self._renamed(staged, self._folder(batch_id))
        except Py4JJavaError as e:
            if not self.committed(batch_id):
                raise
            del e
            common.remove(self.spark, staged)
            return False
        return True

    def commit(self, batch_id: str, signed: DataFrame) -> bool:
        """Sum and keep the batch; False, and nothing done, if it is there already."""
        return not self.committed(batch_id) and self.publish(batch_id, self.stage(signed))

    def _deltas(self) -> tuple[DataFrame, int | None]:
        """Rows of the base and of the batches that are not in it, and the base's number."""
        sums = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"
        rows, base = self.spark.read.schema(f"{sums}, batch_id string").parquet(self.path), self._base()
        if base is None:
            return rows, None
        old = self.spark.read.schema(sums).parquet(f"{self.path}/_bases/base={base}/sums").withColumn("batch_id", F.lit(None).cast("string"))
        return rows.join(self._ids(base), "batch_id", "left_anti").select(*rows.columns).unionByName(old), base

    def totals(self) -> DataFrame:
        """Sums over the committed batches; rows whose documents all cancelled are gone."""
        deltas, _ = self._deltas()
        return deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def compact(self) -> bool:
        """Sum the committed batches into a new base and remove their folders; False if another compaction was first.

        Batches committed meanwhile are not in it and stay. What broken
        writers left in the staging folder is for sweep().
        """
        deltas, base = self._deltas()
        ids = self.spark.createDataFrame([(n,) for n in self._named(self.path, "batch_id=")], "batch_id string")
        staged = f"{self.path}/_staging/{uuid.uuid4().hex}"
        known = ids if base is None else ids.unionByName(self._ids(base)).distinct()
        known.write.parquet(f"{staged}/ids")
        deltas.where(F.col("batch_id").isNull()).unionByName(deltas.join(ids, "batch_id", "left_semi").select(*deltas.columns)).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).write.parquet(f"{staged}/sums")
        self._fs().mkdirs(self._hadoop(f"{self.path}/_bases"))
        try:
            self._renamed(staged, f"{self.path}/_bases/base={1 + (base or 0)}")
        except Py4JJavaError:
            common.remove(self.spark, staged)
            if self._base() == base:
                raise
            return False
        for batch_id in ids.toLocalIterator():
            common.remove(self.spark, self._folder(batch_id[0]))
        return True

    def sweep(self) -> None:
        """Remove what broken writers left and the bases before the last; for one writer, between its batches."""
        common.remove(self.spark, f"{self.path}/_staging")
        for n in self._named(f"{self.path}/_bases", "base="):
            if int(n) != self._base():
                common.remove(self.spark, f"{self.path}/_bases/base={n}")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through three batches: inserted; each count revised to hold the
    end id; repeated texts deleted. Each batch is sent twice and counts once."""
    counts = common.written(token_counts(common.table(spark, sf_dir, "documents")), "token-counts")
    final = with_end(counts)
    rollup = Rollup(spark, common.scratch(spark, "rollup"))
    for batch_id, signed in (("load", inserts(counts)), ("end-id", changes(counts, final)), ("copies", changes(final, first_of_each_text(final)))):
        rollup.commit(batch_id, signed)
        rollup.commit(batch_id, signed)
    return rollup.totals()


QUERIES = {"op9_token_rollup": op9_token_rollup}
ORACLE: dict[str, str] = {}
