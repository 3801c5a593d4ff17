"""A table of daily snapshots that one day at a time is replaced in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def replace_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """Write the days that rows hold, in place of what the table has of them; other days stay.

    Each day is a partition; a rerun leaves the same table. A day without rows is not touched: write it with the rows of a
    wider span, or drop its partition. rows must not be read from the table itself.
    """
    rows.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def days(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table; the schema (DDL, the day included) spares a pass over the files and keeps types as they were written."""
    return spark.read.schema(schema).parquet(path)
