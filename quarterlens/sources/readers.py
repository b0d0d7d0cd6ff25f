"""File sources.

Every reader declares its columns up front so Catalyst prunes the scan to
them, and returns lazily: nothing is read until a sink or action runs.
Parquet landings are read with ``mergeSchema`` so monthly files whose
columns differ are stacked by name (missing columns become NULL); CSV
landings are read as text, each file by its own header, and typed afterwards.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.exprs import to_number
from . import schemas as S

ROW_ORDER = "_row"


def _read(spark: SparkSession, paths: str | Sequence[str], fmt: str,
          encoding: str | None = None) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise FileNotFoundError("no input paths given")
    reader = spark.read
    try:
        if fmt == "parquet":
            return reader.option("mergeSchema", "true").parquet(*paths)
        if fmt == "csv":
            return _read_csv(spark, _files(spark, paths), encoding)
        return reader.format(fmt).load(paths)
    except AnalysisException as exc:  # glob matched nothing
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"no files match {paths}") from exc
        raise


def _files(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """path -> address of the files behind ``paths`` (globs and folders), in their order and then by name."""
    out: dict[str, str] = {}
    for p in paths:
        names = spark.read.format("binaryFile").load(p).select("path", "_metadata.file_path")  # no contents
        for r in sorted(names.collect()):
            out.setdefault(r["path"], r["file_path"])
    if not out:
        raise FileNotFoundError(f"no files match {paths}")
    return out


def _read_csv(spark: SparkSession, files: dict[str, str], encoding: str | None) -> DataFrame:
    """CSV files stacked by column name: files that share a header are read together.

    ``_row`` orders rows by file and by place in the file, whatever partition
    they are read in.
    """
    reader = spark.read.option("header", "true").option("inferSchema", "false")
    if encoding:
        reader = reader.option("encoding", encoding)
    by_header: dict[tuple, list[str]] = {}
    for f in files:
        header = tuple(reader.csv(f).columns)
        if header:
            by_header.setdefault(header, []).append(f)
    place = F.array_position(F.array(*[F.lit(f) for f in files.values()]), F.col("_metadata.file_path"))
    parts = [reader.csv(group).select("*", F.struct(
        place.alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id")).alias(ROW_ORDER)) for group in by_header.values()]
    if not parts:
        return spark.createDataFrame([], f"{ROW_ORDER} struct<file: long, block: long, id: long>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _with_row_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` as text plus the file order (files of one Parquet read are in Spark's order)."""
    order = F.col(ROW_ORDER) if ROW_ORDER in df.columns else F.struct(F.monotonically_increasing_id().alias("id"))
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns], order.alias(ROW_ORDER))


def _ensure_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add absent columns as NULL text (stacked files may lack some)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        df = df.withColumns({c: F.lit(None).cast("string") for c in missing})
    return df


def read_reports(spark: SparkSession, paths, fmt: str = "parquet") -> DataFrame:
    """All monthly sales reports matching ``paths`` stacked into one table.

    Ids are text, measures double; unparsable numbers become NULL.
    """
    df = _read(spark, paths, fmt)
    return typed_report(df)


def typed_report(df: DataFrame) -> DataFrame:
    df = _ensure_columns(df, S.REPORT_ID_COLUMNS + S.REPORT_MEASURES)
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in S.REPORT_ID_COLUMNS],
        *[to_number(F.col(c)).alias(c) for c in S.REPORT_MEASURES],
    )


def read_customer_master(spark: SparkSession, paths, fmt: str = "csv",
                         encoding: str = "ISO-8859-1") -> DataFrame:
    """Customer master; CSV is decoded as latin-1 (every byte is valid).

    A ``_row`` column records file order for the first-non-missing dedup.
    """
    df = _read(spark, paths, fmt, encoding=encoding if fmt == "csv" else None)
    df = _ensure_columns(df, S.CUSTOMER_RAW_COLUMNS)
    return _with_row_order(df, S.CUSTOMER_RAW_COLUMNS)


def read_product_master(spark: SparkSession, paths, fmt: str = "csv") -> DataFrame:
    """S3: product master."""
    df = _read(spark, paths, fmt)
    df = _ensure_columns(df, S.PRODUCT_RAW_COLUMNS)
    return _with_row_order(df, S.PRODUCT_RAW_COLUMNS)


def read_category_dictionary(spark: SparkSession, paths, fmt: str = "csv") -> DataFrame:
    """Category -> category_smo dictionary (path is a parameter)."""
    df = _read(spark, paths, fmt)
    df = _ensure_columns(df, S.DICTIONARY_COLUMNS)
    return df.select(*[F.col(c).cast("string").alias(c) for c in S.DICTIONARY_COLUMNS])


def read_saved_table(spark: SparkSession, paths, fmt: str = "parquet") -> DataFrame:
    """Re-read a table written by a sink (CSV types are inferred)."""
    if fmt == "csv":
        return spark.read.option("header", "true").option("inferSchema", "true").csv(paths)
    return _read(spark, paths, fmt)
