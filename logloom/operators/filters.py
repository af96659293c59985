"""Filters on entries, metrics, listings and case tables."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.regex import matches
from logloom.functions.times import time_argument


def moment(value, now=None) -> Column:
    """A time argument: a column, a datetime, or text (see ``time_argument``)."""
    return value if isinstance(value, Column) else F.lit(time_argument(value, now)).cast("timestamp")


def time_range(df: DataFrame, start=None, end=None, keep_null: bool = True, column: str = "timestamp") -> DataFrame:
    """both ends inclusive, either may be open; unknown times pass."""
    ts = F.col(column)
    within = [ts >= moment(start)] if start is not None else []
    within += [ts <= moment(end)] if end is not None else []
    if not within:
        return df
    inside = reduce(Column.__and__, within)
    return df.filter(ts.isNull() | inside) if keep_null else df.filter(inside)


def grep(df: DataFrame, pattern: str | None, column: str = "message") -> DataFrame:
    """rows whose text has a match, in any case."""
    return df.filter(matches(F.col(column), pattern)) if pattern else df


def or_terms(text: str) -> list[str]:
    """the terms of ``a|b``, trimmed, inner blanks collapsed, empty ones dropped."""
    return [t for t in (re.sub(r"\s+", " ", part).strip() for part in text.split("|")) if t]


def contains_any(df: DataFrame, text: str, column: str = "message") -> DataFrame:
    """rows that contain at least one of the terms, as written."""
    terms = or_terms(text)
    if not terms:
        return df
    return df.filter(reduce(Column.__or__, [F.col(column).contains(t) for t in terms]))


def name_prefix(df: DataFrame, prefix: str | None, column: str = "name") -> DataFrame:
    """F4"""
    return df.filter(F.col(column).startswith(prefix)) if prefix else df


def by_name(df: DataFrame, name: str, column: str = "name", required: bool = False) -> DataFrame:
    """the row of exactly this name. ``required`` checks now that there is one."""
    found = df.filter(F.col(column) == name)
    if required and found.isEmpty():
        raise LookupError(f"{name!r} not found")
    return found


def dimension_arguments(pairs) -> dict[str, str]:
    """``Name=Value`` texts, split at the first ``=``."""
    if isinstance(pairs, dict):
        return pairs
    out = {}
    for pair in pairs or []:
        name, mark, value = pair.partition("=")
        if not mark:
            raise ValueError(f"invalid dimension {pair!r}: use Name=Value")
        out[name] = value
    return out


def select_metrics(metrics: DataFrame, namespace=None, metric_name=None, dimensions=None) -> DataFrame:
    """points of one metric; every given dimension must be equal."""
    out = metrics
    if namespace:
        out = out.filter(F.col("namespace") == namespace)
    if metric_name:
        out = out.filter(F.col("metric_name") == metric_name)
    for name, value in dimension_arguments(dimensions).items():
        out = out.filter(F.try_element_at("dimensions", F.lit(name)) == value)
    return out


def field_equals(df: DataFrame, name: str, value: str) -> DataFrame:
    """rows whose parsed field has this value."""
    return df.filter(F.try_element_at("fields", F.lit(name)) == value)


def timeline_filter(timeline: DataFrame, type: str | None = None, marked_only: bool = False) -> DataFrame:
    """F8"""
    out = timeline.filter(F.col("type") == type) if type else timeline
    return out.filter(F.col("marked")) if marked_only else out


def report_filter(timeline: DataFrame, full: bool = False) -> DataFrame:
    """what a report shows: everything, or marked rows, notes and evidence."""
    if full:
        return timeline
    return timeline.filter(F.coalesce("marked", F.lit(False)) | F.col("type").isin("note", "evidence"))


def status_filter(cases: DataFrame, status: str = "all") -> DataFrame:
    """``active``, ``closed``, anything else means all."""
    return cases.filter(F.col("status") == status) if status in ("active", "closed") else cases
