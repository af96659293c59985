"""What every parser shares: LINES in, ENTRY out.

A parser is a function of (source, chunk, pos, line) rows that returns
(source, chunk, pos, timestamp, message, fields) rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.pointers import source_ptr

NO_FIELDS = "map<string,string>"


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, however often they are used above.

    A filter over a plain projection is pushed below it and repeats the projected
    expressions, regular expressions and JSON parsing included. It is not pushed
    through a generator, and this one gives exactly one row for each.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def groups_of(text: Column, pattern: str, groups) -> Column:
    """Groups of a matching text as an array; group 0 stands for an empty text.

    One run of the expression gives them all, with a byte between them that log text
    hardly ever has. Text that has it is taken apart group by group instead.
    """
    mark = "\x01"
    spelled = mark.join(f"${g}" if g else "" for g in groups)
    at_once = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(spelled)), mark, len(groups))
    singly = F.array(*[F.regexp_extract(text, pattern, g) if g else F.lit("") for g in groups])
    return F.when(F.contains(text, F.lit(mark)), singly).otherwise(at_once)


def no_fields() -> Column:
    return F.lit(None).cast(NO_FIELDS)


def parsed(rows: DataFrame, timestamp: Column, message: Column, fields: Column) -> DataFrame:
    return rows.select(
        "source", "chunk", "pos", timestamp.alias("timestamp"), message.alias("message"), fields.alias("fields")
    )


def to_entries(rows: DataFrame, line_no: str = "line_no") -> DataFrame:
    """Parsed rows with a line number as ENTRY rows."""
    return rows.select(
        "timestamp",
        "message",
        F.substring_index("source", "/", -1).alias("stream"),
        "source",
        F.col(line_no).cast("bigint").alias("line_no"),
        source_ptr(F.col("source"), F.col(line_no)).alias("ptr"),
        "fields",
    )
