"""Record pointers: ``file://path#line``, ``s3://bucket/key#offset``, opaque."""

from pyspark.sql import Column, functions as F

from logloom.fixed import SHORT_PTR_CHARS

_INT = r"[+-]?\d+"


def source_ptr(source: Column, line_no: Column) -> Column:
    """Pointer of a line of any source; bare paths get the ``file://`` scheme."""
    uri = F.when(source.contains("://"), source).otherwise(F.concat(F.lit("file://"), source))
    return F.concat(uri, F.lit("#"), line_no.cast("string"))


def make_ptr(path: Column, line_no: Column) -> Column:
    """Pointer of a line of a file."""
    return F.concat(F.lit("file://"), path, F.lit("#"), line_no.cast("string"))


def make_s3_ptr(bucket: Column, key: Column, offset: Column) -> Column:
    """Pointer of an object position."""
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key, F.lit("#"), offset.cast("string"))


def _fragment(ptr: Column) -> Column:
    return F.when(ptr.contains("#"), F.regexp_extract(ptr, "(?s)^[^#]*#(.*)$", 1)).otherwise(F.lit(""))


def _number(fragment: Column) -> Column:
    return F.when(fragment == "", F.lit(0).cast("bigint")).otherwise(
        F.when(fragment.rlike(f"^{_INT}\\z"), fragment.try_cast("bigint"))
    )


def parse_ptr(ptr: Column) -> Column:
    """struct(path, line), or NULL when it is no file pointer."""
    path = F.regexp_extract(ptr, r"(?s)^file://[^/#?]*(/[^#?]*)", 1)
    line = _number(_fragment(ptr))
    return F.when(
        ptr.startswith("file://") & (path != "") & line.isNotNull(),
        F.struct(path.alias("path"), line.alias("line")),
    )


def parse_s3_ptr(ptr: Column) -> Column:
    """struct(bucket, key, offset), or NULL when bucket or key is missing."""
    bucket = F.regexp_extract(ptr, r"(?s)^s3://([^/#?]*)", 1)
    key = F.regexp_extract(ptr, r"(?s)^s3://[^/#?]*/([^#?]*)", 1)
    offset = _number(_fragment(ptr))
    return F.when(
        ptr.startswith("s3://") & (bucket != "") & (key != "") & offset.isNotNull(),
        F.struct(bucket.alias("bucket"), key.alias("key"), offset.alias("offset")),
    )


def ptr_type(ptr: Column) -> Column:
    """Local, s3, cloudwatch (any text without a scheme) or unknown."""
    return (
        F.when(ptr.startswith("file://"), F.lit("local"))
        .when(ptr.startswith("s3://"), F.lit("s3"))
        .when((ptr != "") & ~ptr.contains("://"), F.lit("cloudwatch"))
        .otherwise(F.lit("unknown"))
    )


def short_ptr(ptr: Column) -> Column:
    """File name and line, or the last characters of an opaque pointer."""
    return F.when(ptr.startswith("file://"), F.substring_index(ptr, "/", -1)).otherwise(
        F.right(ptr, F.lit(SHORT_PTR_CHARS))
    )
