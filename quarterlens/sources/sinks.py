"""Sinks (S5-S7): tables written to a folder, CSV or Parquet.

Writers are the only actions of a job; everything before them is lazy.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> str:
    """Overwrite ``path`` with ``df`` (CSV gets a header row)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_dated(df: DataFrame, folder: str, name: str, run_date: _dt.date | None = None,
                fmt: str = "parquet") -> str:
    """``<folder>/<name>_<dd-mm-YYYY>``."""
    run_date = run_date or _dt.date.today()
    return write_table(df, f"{folder.rstrip('/')}/{name}_{run_date.strftime('%d-%m-%Y')}", fmt)


def write_if_findings(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write a quality report only when it has at least one row."""
    if df.limit(1).count() == 0:
        return False
    write_table(df, path, fmt)
    return True
