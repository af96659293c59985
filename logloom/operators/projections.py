"""Column choices of results and exports."""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.fixed import ENVELOPE_FIELDS, REPORTED_FIELDS, STATS_COLUMN_RANK
from logloom.functions.text import truncate


def default_fields(df: DataFrame) -> DataFrame:
    """R1"""
    return df.select("timestamp", "message", "stream", "ptr")


def rfc3339_text(ts: Column) -> Column:
    """UTC text of an instant, with only as many fraction digits as it needs."""
    micros = F.unix_micros(ts)
    fraction = F.rtrim(F.lpad((F.pmod(micros, F.lit(1_000_000))).cast("string"), 6, "0"), F.lit("0"))
    base = utc_text(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(fraction == "", F.concat(base, F.lit("Z"))).otherwise(
        F.concat(base, F.lit("."), fraction, F.lit("Z"))
    )


def utc_text(ts: Column, layout: str) -> Column:
    """Text of an instant in UTC, whatever the session's zone is."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")), layout)


def _context(events: Column) -> Column:
    shown = F.transform(
        events, lambda e: F.struct(rfc3339_text(e["timestamp"]).alias("timestamp"), e["message"].alias("message"))
    )
    return F.when(F.size(events) > 0, shown)


def to_export(df: DataFrame) -> DataFrame:
    """R2: nested export rows; empty members are NULL and vanish from JSON."""
    own = F.map_filter("fields", lambda k, v: ~k.isin(*ENVELOPE_FIELDS))
    context = []
    if "context" in df.columns:
        context = [
            _context(F.col("context.before")).alias("context_before"),
            _context(F.col("context.after")).alias("context_after"),
        ]
    return df.select(
        rfc3339_text(F.col("timestamp")).alias("timestamp"),
        "stream",
        F.when(F.col("source") != "", F.col("source")).alias("source"),
        "message",
        F.when(F.col("ptr") != "", F.col("ptr")).alias("ptr"),
        *context,
        F.when(F.size(own) > 0, own).alias("fields"),
    )


def to_export_flat(df: DataFrame) -> DataFrame:
    """R3"""
    return df.select(rfc3339_text(F.col("timestamp")).alias("timestamp"), "stream", "source", "message", "ptr")


def order_stats_columns(df: DataFrame) -> DataFrame:
    """Bucket, count, sum, avg, min, max, then the rest by name; no pointer."""
    last = len(STATS_COLUMN_RANK)
    names = sorted((c for c in df.columns if c not in ("@ptr", "ptr")), key=lambda c: (STATS_COLUMN_RANK.get(c, last), c))
    return df.select(*[F.col(f"`{c}`") for c in names])


def with_provenance(df: DataFrame, meta: dict) -> DataFrame:
    """R5"""
    names = {"source_type": "type", "source_uri": "uri", "profile": "profile", "region": "region", "account_id": "account_id"}
    return df.withColumns({c: F.lit(meta.get(k)).cast("string") for c, k in names.items()})


def extra_fields(raw_fields: Column) -> Column:
    """(name, value) pairs a report adds, by name; shown fields and empties left out."""
    kept = F.map_filter(raw_fields, lambda k, v: ~k.isin(*REPORTED_FIELDS) & (v != ""))
    return F.array_sort(F.map_entries(kept))


def dimension_text(dimensions: Column) -> Column:
    """``k=v;k=v`` by name."""
    pairs = F.array_sort(F.map_entries(dimensions))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def short_messages(df: DataFrame, n: int = 200) -> DataFrame:
    """Messages cut for display."""
    return df.withColumn("message", truncate(F.col("message"), n))
