"""Tables that cut the lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files when the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What this process has written, by application.
WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder becomes this session's setting if driver and executors are one process
    (tests, notebooks); on a cluster it must be set, as executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Later stages reread committed files, so a lost executor costs no more than its own tasks.  The shuffle files of the write are
    deleted when it is done: nothing reads them again, and the files of many steps would add up on the executors' disks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Paths of this application's tables that were not cleared."""
    return list(WRITTEN.get(spark.sparkContext.applicationId, ()))


def clear(spark: SparkSession) -> None:
    """Delete this application's tables.  Results are lazy and read them, so do this when all results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in WRITTEN.pop(spark.sparkContext.applicationId, ()):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
