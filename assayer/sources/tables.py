"""Table readers, writers, shape checks and the table catalog."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.digests import stable_text
from assayer.functions.text import title

PROFILE_VERSION = 4


def read_table(spark: SparkSession, path: str, schema=None, columns=None) -> DataFrame:
    """Parquet, CSV (header row) or JSON lines by the suffix of the path.

    Give a schema for CSV and JSON: without one Spark reads the text twice to infer it.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    elif kind == ".json":
        df = (spark.read.schema(schema) if schema else spark.read).json(path)
    elif kind in ("", ".parquet"):
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    else:
        raise ValueError(f"Unsupported file type {kind!r}: use CSV, JSON or Parquet.")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write once as Parquet, or as CSV or JSON lines by the suffix of the path."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    writer = df.write.mode(mode)
    if kind == ".csv":
        writer.option("header", True).csv(path)
    elif kind == ".json":
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def check_shape(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """The same table, or an error where it is empty, too long or too wide."""
    if not df.columns or df.isEmpty():
        raise ValueError("The table has no data rows.")
    if max_columns is not None and len(df.columns) > max_columns:
        raise ValueError(f"Maximum table width is {max_columns:,} columns.")
    if max_rows is not None and df.count() > max_rows:
        raise ValueError(f"Maximum table size is {max_rows:,} rows.")
    return df


def table_digest(df: DataFrame) -> DataFrame:
    """One row with the row count and a digest that ignores the order of the rows."""
    # The separator keeps ("a", "bc") and ("ab", "c") apart.
    row = F.md5(F.concat_ws("|", *[stable_text(f) for f in df.schema.fields]))
    number = F.conv(F.substring(row, 1, 8), 16, 10).cast("decimal(20,0)")
    return (df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").alias("total"))
            .select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("total").cast("string")), 256)
                    .alias("digest")))


def config_digest(df: DataFrame, columns=None) -> DataFrame:
    """Row-wise sha256 of the columns as JSON, names in sorted order."""
    names = sorted(columns or df.columns)
    return df.withColumn("config_digest", F.sha2(F.to_json(F.struct(*names)), 256))


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: name, display title, rows, columns."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), title(F.lit(name)).alias("title"), "rows", F.lit(len(df.columns)).alias("columns"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def fresh_profile(saved: DataFrame | None, build, version: int = PROFILE_VERSION) -> DataFrame:
    """The saved profile where it has the current version, otherwise a new one."""
    if saved is not None and "profile_version" in saved.columns:
        current = saved.filter(F.col("profile_version") >= version)
        if not current.isEmpty():
            return current
    return build().withColumn("profile_version", F.lit(version))
