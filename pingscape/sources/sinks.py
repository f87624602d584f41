"""Sinks: results are written by the tasks, nothing passes through the driver."""

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrite Parquet, optionally with one folder per value of `by` (e.g. day)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrite text from the one string column besides those of `by`, one line per row."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)
