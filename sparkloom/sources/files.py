"""Scans of corpora, JSON lines, prompt fixtures and counter texts; sinks with manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.selection import with_global_index
from ..violations import Checked, ContractError, require_columns, split_by
from .ranges import content_fingerprint, files_below, missing_columns, whole_hashes  # noqa: F401


def scan(spark: SparkSession, root: str, columns=None) -> DataFrame:
    """All Parquet files below root; with columns, exactly those, checked."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    return require_columns(df, columns) if columns else df


def scan_shards(spark: SparkSession, root: str) -> DataFrame:
    """processed/*/*/part-*.parquet; manifests and caches beside them are not read."""
    return spark.read.parquet(f"{root.rstrip('/')}/processed/*/*/part-*.parquet")


def indexed(spark: SparkSession, root: str, columns) -> DataFrame:
    """The columns with source_path, source_row (in its file) and global_index (over all files by path)."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    require_columns(df, columns)
    df = df.select(*columns, F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.row_index").alias("source_row"))
    return with_global_index(df, "source_path", "source_row")


def conditions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A condition file's required columns, and the evaluation where there is one (else null); the first rows in
    the file's order, if limited."""
    df = spark.read.parquet(path)
    required = require_columns(df, CONDITION_COLUMNS).columns
    evaluation = F.col("evaluation_json") if "evaluation_json" in df.columns else F.lit(None).cast("string").alias("evaluation_json")
    out = df.select(*required, evaluation, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    return (out if limit is None else out.orderBy("_f", "_r").limit(limit)).drop("_f", "_r")


# The columns that a condition file has to have.
CONDITION_COLUMNS = ("condition_id", "source", "source_subset", "modality", "language", "task", "messages_json", "tools_json", "media_json")


def files_without(spark: SparkSession, root: str, columns) -> list[tuple[str, list[str]]]:
    """(path, missing columns) of the Parquet files below root that lack some of the columns, by their footers."""
    return [(r.path, r.missing) for r in missing_columns(spark, root, columns).orderBy("path").toLocalIterator()]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1, in its file) and value of each line of text files, blank ones included.

    A file is read in splits; the lines of each split are counted where they
    lie, and the counts are summed up in the order of the splits (one small
    row each), so neither a file nor its lines pass one task. Lines are
    numbered within a partition as they are read, and a split's lines lie
    together there: its first number is what the sum begins at.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("path", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "_at", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(splits, ["path", "_at"]).select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value")


def parsed_lines(spark: SparkSession, path: str, schema: str) -> Checked:
    """Rows of JSON-lines files, with path and line_no in front; blank lines are skipped. Lines that are no object of
    the schema are bad, with their number and text."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", "_corrupt_record string, " + schema, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    whole = F.regexp_like("value", F.lit(r"(?s)^\s*\{.*\}\s*$")) & F.col("_r._corrupt_record").isNull()
    c = split_by(parsed, F.when(~whole, "no JSON object"))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return Checked(c.good.select("path", "line_no", *[F.col(f"_r.`{n}`").alias(n) for n in names]), c.bad.select("path", "line_no", "value", "violation"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped, anything but an object raises with its line's number.

    The files are parsed once more for what is returned, without numbers, so that no join is left in the plan.
    """
    found = parsed_lines(spark, path, schema).bad.orderBy("path", "line_no").limit(10).collect()
    if found:
        raise ContractError("; ".join(f"line {r.line_no} is no JSON object: {r.value[:80]}" for r in found))
    lines = spark.read.text(path).where(F.trim("value") != "")
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return lines.select(F.from_json("value", schema).alias("r")).select(*[F.col(f"r.`{n}`").alias(n) for n in names])


def whole_lines(df: DataFrame, raw: str = "content") -> DataFrame:
    """A binaryFile row's lines that end with a line break; a torn tail is left out."""
    text = F.decode(F.col(raw), "utf-8")
    return df.select(F.posexplode(F.slice(F.split(text, "\n", -1), 1, F.size(F.split(text, "\n", -1)) - 1)).alias("line_no", "line"))


def prompts(df: DataFrame, limit: int | None = None, order: str = "line_no") -> DataFrame:
    """id (else sample_id, else the line's number) and the prompt or messages; neither raises."""
    out = df.select(order, F.coalesce("id", "sample_id", F.col(order).cast("string")).alias("id"), "messages", F.when(F.col("messages").isNull(), F.col("prompt")).alias("prompt"))
    if out.where("messages is null and prompt is null").limit(1).count():
        raise ContractError("a row has neither messages nor a prompt")
    out = out.orderBy(order)
    return out if limit is None else out.limit(limit)


# The counters of interest and their short names.
COUNTERS = {
    "vllm:spec_decode_num_drafts_total": "num_drafts",
    "vllm:spec_decode_num_draft_tokens_total": "num_draft_tokens",
    "vllm:spec_decode_num_accepted_tokens_total": "num_accepted_tokens",
}


def counters(df: DataFrame, text: str, by: list[str], names: dict[str, str] = COUNTERS) -> DataFrame:
    """by, counter, value: samples of an exposition text summed over label sets.

    Comments and other names are skipped; a value that is not finite or a
    text with some of the counters only is marked in "violation".
    """
    line = F.explode(F.split(F.col(text), "\r?\n")).alias("line")
    form = r"^\s*([A-Za-z_:][A-Za-z0-9_:]*)(?:\{[^}]*\})?\s+([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\b"
    rows = df.select(*by, line).select(*by, F.regexp_extract("line", form, 1).alias("name"), F.regexp_extract("line", form, 2).cast("double").alias("value"))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rows = rows.select(*by, F.try_element_at(table, F.col("name")).alias("counter"), "value").where("counter is not null")
    out = rows.groupBy(*by, "counter").agg(F.sum("value").alias("value"), F.max(F.abs("value")).alias("_top"))
    found = rows.groupBy(*by).agg(F.countDistinct("counter").alias("_n"))
    reason = F.when(F.col("_top") == float("inf"), "not finite").when(F.col("_n") < len(names), "incomplete")
    return out.join(found, by).select(*by, "counter", "value", reason.alias("violation"))


def write_dataset(df: DataFrame, path: str, key: str) -> dict:
    """Parquet (zstd) and what a manifest records: rows, distinct keys and a digest of the keys."""
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.parquet(path)
    from ..operators.reconcile import tree_digest

    d, n = tree_digest(kept, key).first()
    return {"path": path, "rows": kept.count(), "keys": n, "digest": d}


def verify_dataset(spark: SparkSession, manifest: dict, key: str) -> None:
    from ..operators.reconcile import tree_digest

    df = spark.read.parquet(manifest["path"])
    d, n = tree_digest(df, key).first()
    if (df.count(), n, d) != (manifest["rows"], manifest["keys"], manifest["digest"]):
        raise ContractError(f"{manifest['path']} differs from its manifest")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each file; a file streams through one task, in pieces."""
    return whole_hashes(files_below(spark, path))


def pending_shards(shards: DataFrame, markers: DataFrame, fingerprint: str) -> DataFrame:
    """Shards without a marker; a marker of another run raises."""
    if markers.where(F.col("fingerprint") != fingerprint).limit(1).count():
        raise ContractError("a shard was finished by a run with another fingerprint")
    return shards.join(markers.select("shard_id"), "shard_id", "left_anti")
