"""Session settings the queries are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # All times are UTC.
    "spark.sql.session.timeZone": "UTC",
    # Long rule chains make large methods, which the JVM interprets; beyond this size Spark splits them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Of a plan that runs once: its shuffle files are removed at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster; where a local session names none, one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share.")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="runlens-")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder


def written(frame: DataFrame) -> DataFrame:
    """``frame`` written once as a table in the shared folder and read back, which cuts its lineage.

    The table stays until ``drop_written`` is called for its session, as results that are still to be computed may read it.
    """
    path = f"{shared_dir(frame.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    # What was shuffled for this table alone goes when it is written; else it would stay until the driver collects its garbage.
    conf = frame.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    _WRITTEN.setdefault(frame.sparkSession.sparkContext.applicationId, []).append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one for tables and files of a query, which ``drop_written`` removes with the others."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Remove the intermediate tables of a session once all its results are stored; returns how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
