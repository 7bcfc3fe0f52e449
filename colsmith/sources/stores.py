"""Exports and append-only stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_SCHEMA = (
    "dataset string, column string, action string, confidence double, "
    "features struct<null_pct: double, is_numeric: double, cardinality_ratio: double, skewness: double, kurtosis: double>, "
    "explanation string"
)


def export(df: DataFrame, path: str, form: str = "csv") -> DataFrame:
    """Write CSV (with header) or JSON lines; returns the one-row metadata table, also written."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(f"{path}/data")
    elif form == "json":
        writer.json(f"{path}/data")
    else:
        raise ValueError(f"unknown form {form}")
    metadata = df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(form).alias("form"), F.current_timestamp().alias("written_at"))
    metadata.write.mode("overwrite").json(f"{path}/metadata")
    return metadata


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_store(spark: SparkSession, path: str, **equal) -> DataFrame:
    """Rows of a parquet store whose columns equal the given values."""
    stored = spark.read.parquet(path)
    for name, value in equal.items():
        stored = stored.where(F.col(name) == value)
    return stored


def read_labels(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """Validated labels from a JSON array file, or from JSON lines."""
    return spark.read.schema(LABEL_SCHEMA).option("multiLine", array_file).json(path)
