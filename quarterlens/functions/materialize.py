"""Lineage cuts at stage boundaries.

A table that several branches of a plan read (the quarterly fact, the
distinct-value table of a rank, the forest's node table) is written once as
Parquet into the shared folder the cluster names in ``spark.checkpoint.dir``
and read back.  Every branch then scans those files instead of recomputing
the upstream joins; the scan gets column pruning and filter pushdown, and a
lost executor loses nothing that was written.  On a cluster the folder must
be set; a scratch folder is made up in local mode only.

The tables of an application are removed when it ends, or by ``release`` at
the end of a job whose results have been written.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_FOLDERS: dict[str, list[str]] = {}


def table_folder(df: DataFrame) -> str:
    """A new folder for a table of this application, removed with its other tables."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ql-tables/{uuid.uuid4().hex}"
    if spark.sparkContext.applicationId not in _FOLDERS:
        atexit.register(_at_exit, spark)
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and return a scan of it."""
    path = table_folder(df)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def marked(spark: SparkSession) -> int:
    """How many tables the application has cut so far, for ``release``."""
    return len(_FOLDERS.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> int:
    """Remove the tables cut after the first ``since``; frames that still read them become unusable."""
    folders = _FOLDERS.get(spark.sparkContext.applicationId, [])
    gone, folders[since:] = folders[since:], []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def _at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # noqa: BLE001 - the application is gone already, and its folder with it
        return
