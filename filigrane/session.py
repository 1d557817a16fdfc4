"""A session with the settings the engine relies on."""

import re
import uuid

from pyspark.sql import SparkSession


def _name(key: str) -> str:
    return key.replace("_", ".")


def session(app: str = "filigrane", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; conf: further settings with _ for the dots of their names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true"}
    for k, v in (settings | {_name(k): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir, removed when the JVM ends; a folder of this machine only if all runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.sparkContext._jvm.java.lang.System.getProperty('java.io.tmpdir')}/filigrane"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return where.toString()


#: Rows up to which a side counts as small by its measured size.
SMALL_ROWS = 500_000


def small(rows):
    """Staged rows, marked for a broadcast if there are few of them; else a join shuffles both sides."""
    from pyspark.sql import functions as F

    return F.broadcast(rows) if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else rows


def repeats(rows, key: str) -> bool:
    """Whether some key is in several rows; a job that reads the keys only."""
    return not rows.groupBy(key).count().filter("count > 1").isEmpty()


def write_by(rows, column: str, most: int, path: str) -> None:
    """Write rows to a folder for each of at most so many values of a column: each task keeps a file open for each, so that rows are neither shuffled nor sorted."""
    conf, key = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(most))
    try:
        rows.write.mode("overwrite").partitionBy(column).parquet(path)
    finally:
        conf.set(key, before)


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that doesn't bound them itself."""
    said = spark.conf.getAll
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 2 << 20)):
        if f"spark.sql.execution.arrow.{key}" not in said:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
