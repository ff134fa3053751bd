"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, before work that is heavy for each row: a given table may be one file of one row group."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def joined(value: Column | str, sep: str = " | ") -> Column:
    return F.array_join(value, sep)


def texts(*values: str | None) -> Column:
    """Literal array of strings."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def sql_list(values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}]::VARCHAR[]"


def stamp(value: Column | str) -> Column:
    """Timestamp as text with seconds, for comparison across engines."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
