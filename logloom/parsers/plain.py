"""Plain text: one entry per non-empty line, with or without a leading time."""

from pyspark.sql import DataFrame, functions as F

from logloom.functions.times import leading_layout, leading_time, plain_message, plain_time
from logloom.parsers.rows import no_fields, parsed, worked_out


def parse_plain(rows: DataFrame, tz: str = "UTC", **_) -> DataFrame:
    """P1, P2."""
    line = F.col("line")
    matched = rows.filter(line != "").withColumn("leading_no", leading_layout(line))
    timed = matched.withColumn("leading", leading_time(line, F.col("leading_no"), tz))
    found = plain_time(line, F.col("leading_no"), F.col("leading"), tz)
    known = worked_out(timed.withColumn("found", found), layout=F.col("found.layout"), ts=F.col("found.ts"))
    return parsed(known, F.col("ts"), plain_message(line, F.col("layout")), no_fields())
