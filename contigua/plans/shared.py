"""Cutting long lineages with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in `spark.checkpoint.dir`.

    Where none is set, a local session gets a temporary one; a cluster must name its own, because a
    folder of one machine is lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="contigua-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Tables that are in the shared folder for results not yet read, by session.
_HELD: dict[str, set[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> int:
    """Deletes what operators keep in the shared folder for their results, and says how many tables.

    A result is a lazy plan over such tables: call this when all results so far have been read or written.
    """
    held = _HELD.pop(spark.sparkContext.applicationId, set())
    for path in held:
        _delete(spark, path)
    return len(held)


class Kept:
    """A DataFrame written to the shared folder and read again, so that a lost executor costs no earlier step."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _HELD.setdefault(self.spark.sparkContext.applicationId, set()).add(self.path)

    def drop(self) -> None:
        _HELD.get(self.spark.sparkContext.applicationId, set()).discard(self.path)
        _delete(self.spark, self.path)
