"""Exports. Every sink writes a folder, one file per task."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.operators.projections import dimension_text, to_export, to_export_flat, utc_text

# Folders that the cases of an export are dealt over: a folder for each would be as many as there are cases.
CASE_FOLDERS = 64

_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _write(df: DataFrame, path: str, fmt: str, mode: str = "error", by: tuple = ()) -> None:
    if by:
        # A few files for each folder; a folder that holds much is split over as many as it needs.
        df = df.hint("rebalance", *by)
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "json":
        writer.option("ignoreNullFields", True).json(path)
    elif fmt == "csv":
        writer.options(header=True, quote='"', escape='"', emptyValue="", nullValue="").csv(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}: use json or csv")


def read_csv_export(spark, path: str, schema: str) -> DataFrame:
    """Reads a CSV export back, messages of several lines included."""
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True).schema(schema).csv(path)


def write_entries(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """K1, K2"""
    _write(to_export(df) if fmt == "json" else to_export_flat(df), path, fmt, mode)


def streams_export(streams: DataFrame) -> DataFrame:
    """K3"""
    return streams.select(
        "name",
        utc_text(F.col("last_time"), _SECONDS).alias("lastTime"),
        utc_text(F.col("first_time"), _SECONDS).alias("firstTime"),
        "size",
    )


def groups_export(groups: DataFrame, fmt: str = "json") -> DataFrame:
    """K4; a retention of 0 is left out of JSON and written in CSV."""
    days = F.col("retention_days")
    return groups.select(
        "name",
        F.col("stored_bytes").alias("storedBytes"),
        (F.nullif(days, F.lit(0)) if fmt == "json" else F.coalesce(days, F.lit(0))).alias("retentionDays"),
        utc_text(F.col("creation_time"), _SECONDS).alias("creationTime"),
    )


def series_export(series: DataFrame, fmt: str = "json", **head) -> DataFrame:
    """K5: points of a series; ``head`` (namespace, metricName, …) goes on every JSON row."""
    value = F.col("value") if fmt == "json" else F.format_string("%f", F.col("value"))
    named = [F.lit(v).alias(k) for k, v in head.items()] if fmt == "json" else []
    return series.select(
        *named, utc_text(F.col("timestamp"), _SECONDS).alias("timestamp"), value.alias("value"),
        F.nullif("unit", F.lit("")).alias("unit"),
    )


def catalog_export(catalog: DataFrame, fmt: str = "json") -> DataFrame:
    """K6"""
    dimensions = F.col("dimensions")
    shown = F.when(F.size(dimensions) > 0, dimensions) if fmt == "json" else dimension_text(dimensions)
    return catalog.select("namespace", F.col("metric_name").alias("metricName"), shown.alias("dimensions"))


def write_streams(streams: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    _write(streams_export(streams), path, fmt, mode)


def write_groups(groups: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    _write(groups_export(groups, fmt), path, fmt, mode)


def write_series(series: DataFrame, path: str, fmt: str = "json", mode: str = "error", **head) -> None:
    _write(series_export(series, fmt, **head), path, fmt, mode)


def write_catalog(catalog: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    _write(catalog_export(catalog, fmt), path, fmt, mode)


def case_folder(case_id: Column) -> Column:
    """The number of the folder that holds a case, the whole of it."""
    return F.pmod(F.crc32(F.coalesce(case_id, F.lit(""))), F.lit(CASE_FOLDERS)).cast("int")


def _write_cases(df: DataFrame, path: str, mode: str) -> None:
    _write(df.withColumn("folder", case_folder(F.col("case_id"))), path, "json", mode, by=("folder",))


def read_case(spark: SparkSession, path: str, schema: str, case_id: str) -> DataFrame:
    """The rows of one case from ``write_report`` or ``write_evidence``; only its folder is read."""
    rows = spark.read.schema(f"{schema}, folder int").json(path)
    return rows.filter((F.col("folder") == case_folder(F.lit(case_id))) & (F.col("case_id") == case_id)).drop("folder")


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """K7: report rows as JSON lines, each case in one of CASE_FOLDERS folders."""
    _write_cases(report, path, mode)


def write_evidence(evidence: DataFrame, path: str, mode: str = "error") -> None:
    """K8: evidence as JSON lines, each case in one of CASE_FOLDERS folders."""
    _write_cases(evidence, path, mode)


def append_timeline(rows: DataFrame, path: str) -> None:
    """K9: audit rows added to a stored timeline."""
    rows.write.mode("append").parquet(path)
