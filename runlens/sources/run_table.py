"""A table of runs that several writers may change at once: data folders, and numbered snapshots that name the live ones.

A writer puts its rows into folders of its own and then creates the snapshot after the one it started from. Creating a file that
must not exist yet is the only step that writers contend for: of two, one succeeds, and the other looks again at what is stored.
Readers take the newest snapshot, so they see whole changes and none that were given up.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.folders import local_path

SNAPSHOTS = "_snapshots"
MONTH = "run_month"


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def _folders(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def snapshot(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of the newest snapshot and the folders it names; number 0 stands for the month folders of a table without snapshots."""
    names = sorted(n for n in _folders(spark, f"{path}/{SNAPSHOTS}") if n.isdigit())
    if not names:
        return 0, sorted(n for n in _folders(spark, path) if n.startswith(f"{MONTH}="))
    file, fs = _hadoop(spark, f"{path}/{SNAPSHOTS}/{names[-1]}")
    stream = fs.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(names[-1]), [line for line in text.split("\n") if line]


def commit(spark: SparkSession, path: str, number: int, folders: list[str]) -> bool:
    """Create snapshot ``number``; false if another writer has created it."""
    name, text = f"{path}/{SNAPSHOTS}/{number:020}", "".join(f"{f}\n" for f in folders)
    if _is_local(path):
        # A link appears with its whole content or, where the name is taken, not at all.
        target = local_path(name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{uuid.uuid4().hex}"
        with open(part, "w") as file:
            file.write(text)
        try:
            os.link(part, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    file, fs = _hadoop(spark, name)
    try:
        stream = fs.create(file, False)
    except Exception as error:
        if fs.exists(file):
            return False
        raise error
    stream.write(text.encode())
    stream.close()
    return True


def read(spark: SparkSession, path: str, schema, folders: list[str] | None = None) -> DataFrame:
    """The rows of the folders, by default those of the newest snapshot. Filters on ``run_month`` choose folders."""
    live = snapshot(spark, path)[1] if folders is None else folders
    if not live:
        return spark.createDataFrame([], schema)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/{f}" for f in live)).select(*names)


def write_batch(rows: DataFrame, path: str, batch: str) -> list[str]:
    """Write rows as a batch of their own, one folder a month; returns the folders."""
    # Without this each task has a file for each month; large months are split by size.
    rows.hint("rebalance", MONTH).write.partitionBy(MONTH).mode("overwrite").parquet(f"{path}/batch={batch}")
    # One name for each month that the batch has.
    return sorted(f"batch={batch}/{name}" for name in _folders(rows.sparkSession, f"{path}/batch={batch}") if name.startswith(f"{MONTH}="))


def drop_batch(spark: SparkSession, path: str, batch: str) -> None:
    """Remove the files of a batch that no snapshot names."""
    folder, fs = _hadoop(spark, f"{path}/batch={batch}")
    fs.delete(folder, True)


def month_of(folder: str) -> str:
    return folder.rsplit(f"{MONTH}=", 1)[1]


def rewrite_without(spark: SparkSession, path: str, schema, dropped: DataFrame, key: str = "run_key") -> bool:
    """A snapshot without the rows of the keys ``dropped`` (``key``, ``run_month``). Only folders of months with such keys are written anew.

    A job that ends before the snapshot is created changes nothing. False if another writer was faster; the call can be repeated.
    """
    number, live = snapshot(spark, path)
    months = {r[MONTH] for r in dropped.select(F.col(MONTH).cast("string").alias(MONTH)).distinct().collect()}
    touched = [f for f in live if month_of(f) in months]
    if not touched:
        return True
    rows = read(spark, path, schema, touched)
    batch = uuid.uuid4().hex
    added = write_batch(rows.join(dropped.select(key), key, "left_anti").select(*(f.name for f in schema)), path, batch)
    done = commit(spark, path, number + 1, [f for f in live if f not in set(touched)] + added)
    if not done:
        drop_batch(spark, path, batch)
    return done
