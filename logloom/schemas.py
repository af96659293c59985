"""Schemas of the tables the engine reads and produces."""

from pyspark.sql import types as T

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()
_STRINGS = T.MapType(_S, _S)


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


LINES = _schema(source=_S, line_no=_L, line=_S)

ENTRY = _schema(timestamp=_TS, message=_S, stream=_S, source=_S, line_no=_L, ptr=_S, fields=_STRINGS)

EVENT = _schema(timestamp=_TS, message=_S, stream=_S)

METRICS = _schema(
    namespace=_S, metric_name=_S, dimensions=_STRINGS, timestamp=_TS, value=T.DoubleType(), unit=_S
)

GROUPS = _schema(name=_S, stored_bytes=_L, creation_time=_TS, retention_days=T.IntegerType())

STREAMS = _schema(name=_S, size=_L, first_time=_TS, last_time=_TS)

CASES = _schema(id=_S, title=_S, created=_TS, updated=_TS, status=_S, summary=_S)

TIMELINE = _schema(
    case_id=_S, seq=_L, ts=_TS, type=_S, source_uri=_S, source_type=_S, profile=_S, account_id=_S,
    command=_S, filter=_S, query=_S, start_time=_TS, end_time=_TS, results=T.IntegerType(),
    marked=T.BooleanType(), content=_S, source=_S,
)

EVIDENCE = _schema(
    case_id=_S, seq=_L, ptr=_S, message=_S, timestamp=_TS, source_uri=_S, source_type=_S, stream=_S,
    profile=_S, account_id=_S, collected_at=_TS, annotation=_S, raw_fields=_STRINGS,
)

RESULT_INDEX = _schema(
    idx=T.IntegerType(), ptr=_S, source_uri=_S, source_type=_S, stream=_S, profile=_S, account_id=_S
)
