"""Session defaults of the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def session(app: str = "sparkloom", **conf: str) -> SparkSession:
    """A session with the defaults, then conf (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most so many bytes: texts are wide, and 10,000 rows of
    them in each Python worker, and again outside the heap, cost more than the work.
    A smaller setting of the session stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower()
    size = int(now.rstrip("bkmg")) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1:], 0)
    if not 0 < size <= most:
        spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is
    unset on one machine (tests) a temporary folder takes its place. On a
    cluster each executor would write to its own disk then, so it raises.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get().rstrip("/")
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_places: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for what a result still reads: run-<application id>/<name>-<random>."""
    _places.append(f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _places[-1]


def clean_places(spark: SparkSession) -> None:
    """Remove the folders that this process asked for; results that read them are gone with them."""
    while _places:
        p = spark._jvm.org.apache.hadoop.fs.Path(_places.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
