"""Counts, group-by statistics and listings."""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.fixed import BUCKET, GROUPS_LIMIT, QUERY_LIMIT, RETENTION_LIMIT, SCAN_PRICE_PER_GIB, STREAMS_LIMIT
from logloom.functions.text import format_bytes
from logloom.operators.filters import grep, moment, name_prefix


def count_by_bucket(
    df: DataFrame, bucket: str = BUCKET, pattern: str | None = None, limit: int | None = QUERY_LIMIT
) -> DataFrame:
    """A1: (time_bucket, count), newest first."""
    counts = (
        grep(df, pattern)
        .filter(F.col("timestamp").isNotNull())
        .groupBy(F.window("timestamp", bucket).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("time_bucket"), "count")
        .orderBy(F.col("time_bucket").desc())
    )
    return counts.limit(limit) if limit and limit > 0 else counts


def field_column(df: DataFrame, name: str) -> Column:
    """A column of the entry, or a parsed field of that name."""
    return F.col(name) if name in df.columns else F.try_element_at("fields", F.lit(name))


def stats(
    df: DataFrame, aggs: dict[str, Column], by: list[str], having: Column | None = None,
    sort: str | None = None, limit: int | None = None,
) -> DataFrame:
    """A3: aggregates per value of one or more fields, greatest ``sort`` first.

    ``aggs`` maps result names to aggregate columns; ``having`` filters results.
    """
    keyed = df.groupBy(*[field_column(df, name).alias(name) for name in by])
    out = keyed.agg(*[agg.alias(name) for name, agg in aggs.items()])
    if having is not None:
        out = out.filter(having)
    if sort:
        out = out.orderBy(F.col(sort).desc_nulls_last(), *[F.col(f"`{name}`") for name in by])
    return out.limit(limit) if limit and limit > 0 else out


def list_streams(
    df: DataFrame, prefix: str | None = None, order: str = "last_time", limit: int | None = STREAMS_LIMIT
) -> DataFrame:
    """(name, size, first_time, last_time), latest event first or by name."""
    out = name_prefix(df, prefix, "stream").groupBy(F.col("stream").alias("name")).agg(
        F.sum(F.octet_length("message").cast("bigint")).alias("size"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )
    return order_streams(out, order, limit)


def order_streams(streams: DataFrame, order: str = "last_time", limit: int | None = STREAMS_LIMIT) -> DataFrame:
    """T4"""
    by = [F.col("name").desc()] if order == "name" else [F.col("last_time").desc_nulls_last(), F.col("name")]
    out = streams.orderBy(*by)
    return out.limit(limit) if limit and limit > 0 else out


def list_groups(
    df: DataFrame, retention: DataFrame | None = None, prefix: str | None = None, limit: int | None = GROUPS_LIMIT
) -> DataFrame:
    """A10: (name, stored_bytes, creation_time, retention_days, retention) by name.

    ``retention`` has (name, retention_days); no entry or 0 means it never expires.
    """
    sizes = name_prefix(df, prefix, "source").groupBy(F.col("source").alias("name")).agg(
        F.sum(F.octet_length("message").cast("bigint")).alias("stored_bytes"),
        F.min("timestamp").alias("creation_time"),
    )
    if retention is None:
        joined = sizes.withColumn("retention_days", F.lit(0))
    else:
        joined = sizes.join(retention.select("name", "retention_days"), "name", "left")
    out = joined.select(
        "name", "stored_bytes", "creation_time",
        F.coalesce("retention_days", F.lit(0)).cast("int").alias("retention_days"),
    ).withColumn("retention", retention_text(F.col("retention_days"))).orderBy("name")
    return out.limit(limit) if limit and limit > 0 else out


def list_retention(
    df: DataFrame, retention: DataFrame | None = None, prefix: str | None = None, limit: int | None = RETENTION_LIMIT
) -> DataFrame:
    """A10, retention view: (name, retention, stored) with sizes as text."""
    groups = list_groups(df, retention, prefix, limit)
    return groups.select("name", "retention", format_bytes(F.col("stored_bytes")).alias("stored"))


def retention_text(days: Column) -> Column:
    return F.when(days > 0, F.concat(days.cast("string"), F.lit(" days"))).otherwise(F.lit("Never expire"))


def estimate_scan(groups: DataFrame, start, end, now) -> DataFrame:
    """Per group the bytes and price a scan of the range would take.

    The share of its bytes is the range over the group's age, at most all of them;
    NULL where the group has no bytes or no known age.
    """
    span = F.unix_micros(moment(end)) - F.unix_micros(moment(start))
    age = F.unix_micros(moment(now)) - F.unix_micros("creation_time")
    known_age = F.when(age <= 0, F.lit(24 * 3600 * 1_000_000).cast("bigint")).otherwise(age)
    share = F.least(F.lit(1.0), span / known_age)
    known = F.col("creation_time").isNotNull() & (F.coalesce("stored_bytes", F.lit(0)) != 0)
    estimated = F.when(known, (F.col("stored_bytes") * share).cast("bigint"))
    return groups.select("*", estimated.alias("estimated_bytes")).select(
        "*",
        format_bytes(F.col("estimated_bytes")).alias("estimated_size"),
        (F.col("estimated_bytes") / F.lit(float(1 << 30)) * F.lit(SCAN_PRICE_PER_GIB)).alias("estimated_cost"),
    )


def total_estimate(estimates: DataFrame) -> DataFrame:
    """The sum over all groups."""
    return estimates.agg(
        F.sum("estimated_bytes").alias("estimated_bytes"), F.sum("estimated_cost").alias("estimated_cost")
    )


def result_count(df: DataFrame) -> DataFrame:
    """One row, ``results``."""
    return df.agg(F.count(F.lit(1)).alias("results"))


def counted(df: DataFrame, observation):
    """A14 without a second scan: ``observation.get['results']`` after the action."""
    return df.observe(observation, F.count(F.lit(1)).alias("results"))
