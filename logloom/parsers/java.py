"""Java logs: header layouts, stack traces, times without a date."""

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from logloom.fixed import JAVA_LAYOUTS, TRACE_LINE
from logloom.functions.text import strip_ansi
from logloom.functions.times import instant
from logloom.operators.multiline import join_rows
from logloom.parsers.rows import groups_of, parsed, worked_out

def header_layout(line: Column) -> Column:
    """Number of the first layout a (clean) line has, or NULL."""
    return F.coalesce(*[F.when(line.rlike(f"(?s){p}"), F.lit(no)) for no, (p, _) in enumerate(JAVA_LAYOUTS)])


def is_header(line: Column) -> Column:
    """Does a (clean) line begin an entry?"""
    dated = line.rlike(r"^\d{2}") & header_layout(line).isNotNull()
    return F.coalesce(~line.rlike(TRACE_LINE) & dated, F.lit(False))


def header_parts(line: Column, layout: Column) -> Column:
    """date, time, level, thread, logger, message of a header; '' where it has none."""
    parts = F.lit(None).cast("array<string>")
    for no, (pattern, order) in enumerate(JAVA_LAYOUTS):
        parts = F.when(layout == no, groups_of(line, f"(?s){pattern}", order)).otherwise(parts)
    return parts


def java_time(day: Column, clock: Column, tz: str = "UTC") -> Column:
    """Date and time, with or without milliseconds after a comma or point."""
    return instant(F.concat(day, F.lit(" "), F.translate(clock, ",", ".")), tz)


def header_date(line: Column, tz: str = "UTC") -> Column:
    """Date of a header that has a full and valid one."""
    layout = header_layout(line)
    day, clock = F.left(line, F.lit(10)), F.regexp_extract(line, r"^.{10}[T\s]\s*([\d:,.]+)", 1)
    return F.when(line.rlike(r"^\d{4}-") & (layout <= 5) & java_time(day, clock, tz).isNotNull(), day.try_cast("date"))


def parse_java(rows: DataFrame, default_date: date | str | None = None, tz: str = "UTC", **_) -> DataFrame:
    """Clean lines, join traces, then read each entry's header."""
    default = str(default_date or datetime.now(timezone.utc).date())
    clean = rows.withColumn("line", strip_ansi(F.col("line")))
    joined = join_rows(clean, is_header(F.col("line")), header_date(F.col("line"), tz))
    head = joined.withColumn("layout", header_layout(F.col("head")))
    split = worked_out(head, p=header_parts(F.col("head"), F.col("layout")))
    p = [F.get("p", F.lit(i)) for i in range(6)]
    day = F.when(p[0] != "", p[0]).otherwise(F.coalesce(F.col("carried").cast("string"), F.lit(default)))
    message = F.concat_ws("\n", F.coalesce(p[5], F.col("head")), "rest")
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("key"), F.when(p[i] != "", p[i]).alias("value"))
            for name, i in (("level", 2), ("thread", 3), ("logger", 4))
        ]
    )
    fields = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return parsed(split, java_time(day, p[1], tz), message, fields)
