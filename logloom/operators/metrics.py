"""Metric series and the metric catalogue."""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.fixed import SPIKE_BAR_WIDTH, SPIKE_HIGH, SPIKE_MEDIUM
from logloom.functions.text import normalize_stat
from logloom.functions.times import duration_argument
from logloom.operators.filters import moment, select_metrics


def _statistic(stat: str) -> Column:
    return {
        "Sum": F.sum("value"),
        "Average": F.avg("value"),
        "Minimum": F.min("value"),
        "Maximum": F.max("value"),
        "SampleCount": F.count("value").cast("double"),
    }[normalize_stat(stat)]


def metric_range(start, end):
    """A2: (start, end) with a start given as a duration counted back from the end."""
    end = moment(end)
    if isinstance(start, str):
        try:
            return end - F.lit(duration_argument(start)), end
        except ValueError:
            pass
    return moment(start), end


def metric_stats(
    metrics: DataFrame, namespace, metric_name, dimensions=None, stat: str = "Sum", period: str = "5 minutes",
    start=None, end=None, by: tuple = (),
) -> DataFrame:
    """One statistic per period, by time: (timestamp, value, unit).

    The end is exclusive. ``by`` keeps more columns of the points as series keys.
    """
    points = select_metrics(metrics, namespace, metric_name, dimensions)
    if end is not None:
        first, last = metric_range(start, end) if start is not None else (None, moment(end))
        points = points.filter(F.col("timestamp") < last)
    else:
        first = moment(start) if start is not None else None
    if first is not None:
        points = points.filter(F.col("timestamp") >= first)
    return (
        points.groupBy(F.window("timestamp", period).alias("w"), *by, "unit")
        .agg(_statistic(stat).alias("value"))
        .select(F.col("w.start").alias("timestamp"), *by, "value", "unit")
        .orderBy("timestamp", *by, "unit")
    )


def metric_catalog(metrics: DataFrame, namespace=None, metric_name=None) -> DataFrame:
    """A4: distinct (namespace, metric_name, dimensions).

    Maps are compared as name-sorted pairs.
    """
    pairs = F.array_sort(F.map_entries("dimensions"))
    chosen = select_metrics(metrics, namespace, metric_name)
    return (
        chosen.select("namespace", "metric_name", pairs.alias("pairs"))
        .distinct()
        .select("namespace", "metric_name", F.map_from_entries("pairs").alias("dimensions"))
    )


def metric_names(metrics: DataFrame, namespace=None) -> DataFrame:
    """A5: (namespace, metric_names) with each name once, sorted."""
    names = select_metrics(metrics, namespace).select("namespace", "metric_name").distinct()
    return names.groupBy("namespace").agg(F.array_sort(F.collect_set("metric_name")).alias("metric_names"))


def with_spike_level(series: DataFrame, keys: tuple = ()) -> DataFrame:
    """Ratio to the series' greatest value, its level and bar length.

    The greatest value is a plain aggregate joined back, not a window over a whole
    series; values at or below zero have ratio 0.
    """
    greatest = F.greatest(F.max("value"), F.lit(0.0)).alias("_max")
    if keys:
        peaks = series.groupBy(*keys).agg(greatest)
        joined = series.join(peaks, list(keys))
    else:
        joined = series.withColumn("_max", series.agg(greatest).scalar())
    ratio = F.when(F.col("_max") > 0, F.col("value") / F.col("_max")).otherwise(F.lit(0.0))
    return (
        joined.withColumn("ratio", ratio)
        .withColumn(
            "level",
            F.when(F.col("ratio") > SPIKE_HIGH, F.lit("high"))
            .when(F.col("ratio") > SPIKE_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("low")),
        )
        .withColumn("bar", F.greatest((F.col("ratio") * SPIKE_BAR_WIDTH).cast("int"), F.lit(0)))
        .drop("_max")
    )
