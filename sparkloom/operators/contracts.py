"""Gates before a run: manifests, attestations, bindings, fingerprints and recipes.

Manifests are small objects; what they speak of is counted and hashed by Spark.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical, canonical_json
from ..violations import ContractError


def _checks(df: DataFrame, key: str, checks: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """key, check, wanted, found and passed: a row for each check (name, wanted, found, passed) of each row."""
    one = [F.struct(F.lit(n).alias("check"), w.cast("string").alias("wanted"), f.cast("string").alias("found"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, w, f, ok in checks]
    return df.select(key, F.explode(F.array(*one)).alias("c")).select(key, "c.*")


def require_checks(checks: DataFrame, key: str) -> None:
    """Raises with the first failed checks."""
    found = checks.where("not passed").orderBy(key, "check").limit(10).collect()
    if found:
        raise ContractError("; ".join(f"{r[key]}: {r.check} is {r.found}, not {r.wanted}" for r in found))


def manifest_checks(manifests: DataFrame, files: DataFrame, key: str, statuses: list[str]) -> DataFrame:
    """What is wrong with manifests (key, status, unresolved_errors, bytes, sha256) of files (key, bytes, sha256), as check rows.

    The status has to be one of statuses, no error unresolved, and the size
    and digest that the manifest records those of its one file; what it does
    not record is not compared.
    """
    now = files.groupBy(key).agg(F.count("*").alias("_n"), F.max("bytes").alias("_bytes"), F.max("sha256").alias("_sha256"))
    d = manifests.join(now, key, "left")
    errors = F.coalesce("unresolved_errors", F.lit(0))
    checks = [("status", F.lit("|".join(statuses)), F.col("status"), F.col("status").isin(statuses)), ("unresolved_errors", F.lit(0), errors, errors == 0)]
    for c in ("bytes", "sha256"):
        checks.append((c, F.col(c), F.col(f"_{c}"), F.col(c).isNull() | ((F.col("_n") == 1) & (F.col(c) == F.col(f"_{c}")))))
    return _checks(d, key, checks)


def attestation_checks(claims: DataFrame, key: str, claim: str, expected: dict[str, str], stated: list[str], counts: list[str]) -> DataFrame:
    """What is wrong with operators' claims (JSON objects), as check rows.

    expected: values by JSON path; stated: paths that need a value that is
    not empty; counts: paths that need a whole number of at least one.
    """
    at = lambda p: F.get_json_object(F.col(claim), f"$.{p}")
    checks = [(p, F.lit(v), at(p), at(p) == v) for p, v in expected.items()]
    checks += [(p, F.lit("a value"), at(p), ~at(p).isin("", "null")) for p in stated]
    checks += [(p, F.lit("1 or more"), at(p), F.regexp_like(at(p), F.lit("^[1-9][0-9]*$"))) for p in counts]
    return _checks(claims, key, checks)


def attested(claims: DataFrame, checks: DataFrame, key: str, claim: str) -> DataFrame:
    """key and sha256 (over canonical JSON) of the claims that pass all checks, and verified: never, as nobody looked at the weights."""
    failed = checks.where("not passed").select(key).distinct()
    return claims.join(failed, key, "left_anti").select(key, F.sha2(canonical(F.col(claim)), 256).alias("sha256"), F.lit(False).alias("verified"))


def bindings(files: DataFrame) -> dict[str, str]:
    """name to SHA-256 of the bound files (name, content); a handful by their nature, so more than 1,000 raise."""
    rows = files.select("name", F.sha2("content", 256).alias("h")).limit(1001).collect()
    if len(rows) > 1000:
        raise ContractError("an attestation binds a few files, not a dataset")
    return {r.name: r.h for r in rows}


def bound(recorded: dict[str, str], current: dict[str, str], passed: bool = True) -> dict[str, str]:
    """The bindings, if the recorded result passed and each current digest is the recorded one."""
    if passed is not True:
        raise ContractError("a failed result binds nothing")
    if bad := [k for k, h in sorted(current.items()) if recorded.get(k) != h]:
        raise ContractError(f"changed since the attestation: {', '.join(bad)}")
    return current


def config_fingerprint(*values) -> str:
    """SHA-256 over canonical JSON of one value, or of the list of several."""
    return hashlib.sha256(canonical_json(values[0] if len(values) == 1 else list(values)).encode()).hexdigest()


def fixture_fingerprint(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row: SHA-256 over the JSON of the ordered rows of a fixture, which has to fit into one row."""
    item = F.struct(F.col(order).alias("_o"), F.to_json(F.struct(*sorted(columns))).alias("j"))
    texts = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["j"])
    return rows.agg(F.sha2(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), 256).alias("fingerprint"), F.count("*").alias("n"))


def verified_files(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """path and reason of the recorded files (path, bytes, sha256) that are missing or differ now."""
    now = current.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    reason = F.when(F.col("_h").isNull(), "missing").when(F.col("bytes") != F.col("_b"), "bytes").when(F.col("sha256") != F.col("_h"), "sha256")
    return recorded.join(now, "path", "left").select("path", reason.alias("reason")).where("reason is not null")


def same_run(recorded: dict, wanted: dict, keys: tuple[str, ...]) -> None:
    """A resumed run has the recorded run's contract."""
    if bad := [k for k in keys if recorded.get(k) != wanted.get(k)]:
        raise ContractError(f"the run to resume differs in {', '.join(bad)}")


def recipe(method: Column, block_size: Column, epochs: Column, lr: Column, gamma: Column, short: str) -> Column:
    """struct<block_size, epochs, lr, gamma, violation> with a method's defaults where nothing is given.

    The method named short needs blocks of 8.
    """
    # Block sizes, epochs, rate and decay.
    size = F.coalesce(block_size, F.when(method == short, 8).otherwise(16))
    decay = F.coalesce(gamma, F.when(size == 8, 4.0).otherwise(7.0))
    bad = F.when((method == short) & (size != 8), "block size must be 8")
    return F.struct(size.alias("block_size"), F.coalesce(epochs, F.lit(3)).alias("epochs"), F.coalesce(lr, F.lit(6e-4)).alias("lr"), decay.alias("gamma"), bad.alias("violation"))


def isolated(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_rows: int = 64) -> DataFrame:
    """The rows that work makes of batches of df, with the column error.

    A batch that fails is halved until its parts pass or are single rows; a
    row that fails alone comes back with its own columns where schema has
    them, nulls elsewhere, and what was raised in error.
    """
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def one(part: pd.DataFrame, done: list[pd.DataFrame], failed: list[tuple]) -> None:
        try:
            done.append(work(part)[names])
        except Exception as e:
            if len(part) > 1:
                half = len(part) // 2
                one(part.iloc[:half], done, failed)
                one(part.iloc[half:], done, failed)
            else:
                failed.append((part, f"{type(e).__name__}: {e}"))

    def run(batches):
        for batch in batches:
            done, failed = [], []
            for at in range(0, len(batch), batch_rows):
                one(batch.iloc[at : at + batch_rows], done, failed)
            # few frames go back, however many rows failed
            if done:
                yield pd.concat(done).assign(error=None)
            if failed:
                yield pd.concat([p for p, _ in failed]).reindex(columns=names).assign(error=[e for _, e in failed])

    return df.mapInPandas(run, f"{schema}, error string")


def publish_whole(spark: SparkSession, parts: dict[str, DataFrame], path: str, identity: dict) -> dict:
    """All parts of a bundle or none: they are written beside the target, and one rename shows them.

    The marker that comes back records the rows of each part and the identity's fingerprint; a target that
    is there raises and stays as it is.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise ContractError(f"{path} is there already")
    # a name of its own: two writers do not touch each other's parts, and the second rename fails
    stage = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_stage-{target.getName()}-{uuid.uuid4().hex}")
    marker = {"identity": identity, "fingerprint": config_fingerprint(identity), "rows": {}}
    for name, df in parts.items():
        df.write.option("compression", "zstd").parquet(f"{stage}/{name}")
        marker["rows"][name] = spark.read.parquet(f"{stage}/{name}").count()
    put_json(spark, marker, f"{stage}/_marker.json")
    fs.mkdirs(target.getParent())
    try:
        _renamed(spark, fs, stage, target, over=False)
    except Exception:
        fs.delete(stage, True)
        if fs.exists(target):
            raise ContractError(f"{path} is there already") from None
        raise
    return marker


def _renamed(spark: SparkSession, fs, source, target, over: bool) -> None:
    """One step on file systems that can: what is there stays, or gives way to the whole of the new."""
    jvm = spark._jvm
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, int(over))
    if over:
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(source), fs.makeQualified(target), options)


def put_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small object as canonical JSON, written beside the target and renamed over it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    side = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(side, True)
    try:
        out.write(bytearray((canonical_json(value) + "\n").encode()))
    finally:
        out.close()
    _renamed(spark, fs, side, target, over=True)
