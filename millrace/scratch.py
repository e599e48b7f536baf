"""Tables between steps: written to the folder that driver and executors share, and deleted with the
application. A table cuts its lineage, so a lost executor costs no recomputation of what made it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system of a path, and the path: works for any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local session gets a temporary one;
    on a cluster, whose machines share no such folder, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in this application's part of the shared folder."""
    context = spark.sparkContext
    top = f"{shared_dir(spark)}/millrace-{context.applicationId}"
    if getattr(context, "_millrace_scratch", None) != top:
        context._millrace_scratch = top
        atexit.register(forget, *file_system(spark, top))
    return f"{top}/{name}-{uuid.uuid4().hex}"


def forget(fs, where) -> None:  # noqa: ANN001
    """Deletes the application's folder; at its end the JVM may be gone, and the folder stays."""
    try:
        fs.delete(where, True)
    except Exception:  # noqa: BLE001
        return


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, with no lineage behind it."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dispose(*tables: DataFrame) -> None:
    """Deletes tables of ``cut_lineage`` that nothing reads any more."""
    for df in tables:
        fs, where = file_system(df.sparkSession, df._scratch_path)
        fs.delete(where, True)
