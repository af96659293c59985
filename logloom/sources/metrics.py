"""Metric points from any table."""

from pyspark.sql import Column, DataFrame, functions as F


def _column(value, default) -> Column:
    if value is None:
        return default
    return F.col(value) if isinstance(value, str) else value


def read_metrics(
    df: DataFrame, namespace, metric_name, value, timestamp="timestamp", dimensions=None, unit=None
) -> DataFrame:
    """METRICS rows; each argument is a column, or the name of one."""
    return df.select(
        _column(namespace, None).cast("string").alias("namespace"),
        _column(metric_name, None).cast("string").alias("metric_name"),
        _column(dimensions, F.create_map().cast("map<string,string>")).alias("dimensions"),
        _column(timestamp, None).cast("timestamp").alias("timestamp"),
        _column(value, None).cast("double").alias("value"),
        _column(unit, F.lit(None)).cast("string").alias("unit"),
    )
