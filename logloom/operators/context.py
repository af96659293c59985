"""What stands around a match: lines of its file, or events of its stream."""

from pyspark.sql import DataFrame, functions as F

from logloom.fixed import CONTEXT_LOOKBACK
from logloom.functions.times import duration_argument
from logloom.plans.latest import SLICE_ROWS, latest_before
from logloom.plans.sizing import small_side

_EVENT = "struct<timestamp:timestamp,message:string,stream:string>"


def with_context(
    matches: DataFrame, lines: DataFrame, before: int, after: int, max_matches: int | None = None,
    whole_entries: bool = False,
) -> DataFrame:
    """``context`` = the physical lines before and after each match, oldest first.

    ``max_matches`` is the limit the matches were cut to; it proves that the wanted
    lines are few, and they are then broadcast instead of moving ``lines``.
    ``whole_entries`` starts after the last line of a joined entry.
    """
    here = F.col("line_no")
    last = here
    if whole_entries:
        last = here + F.length("message") - F.length(F.replace("message", F.lit("\n"), F.lit("")))
    wanted = matches.select(
        "source",
        here.alias("match"),
        F.explode(
            F.concat(
                F.sequence(here - before, here - 1) if before > 0 else F.array().cast("array<bigint>"),
                F.sequence(last + 1, last + after) if after > 0 else F.array().cast("array<bigint>"),
            )
        ).alias("line_no"),
    ).distinct()
    bound = None if max_matches is None else max_matches * (before + after)
    found = lines.join(small_side(wanted, bound), ["source", "line_no"]).select(
        "source", "match", "line_no",
        F.struct(
            F.lit(None).cast("timestamp").alias("timestamp"),
            F.col("line").alias("message"),
            F.substring_index("source", "/", -1).alias("stream"),
        ).alias("event"),
    )
    # At most before + after rows per match.
    events = F.array_sort(F.collect_list(F.struct("line_no", "event")))
    around = found.groupBy("source", "match").agg(events.alias("events"))

    def side(keep):
        picked = F.transform(F.filter("events", keep), lambda e: e["event"])
        return F.coalesce(picked, F.array().cast(f"array<{_EVENT}>"))

    joined = matches.join(around.withColumnRenamed("match", "line_no"), ["source", "line_no"], "left")
    return joined.select(
        *[F.col(c) for c in matches.columns],
        F.struct(
            side(lambda e: e["line_no"] < F.col("line_no")).alias("before"),
            side(lambda e: e["line_no"] > F.col("line_no")).alias("after"),
        ).alias("context"),
    )


def with_time_context(
    matches: DataFrame, logs: DataFrame, n: int, lookback=CONTEXT_LOOKBACK, key: str = "ptr", tie: str = "ptr",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``context.before`` = the last ``n`` events of the match's stream within
    [ts - lookback, ts - 1 ms], oldest first.

    ``key`` identifies a match, ``tie`` orders events of the same time.
    """
    back = int(duration_argument(lookback).total_seconds() * 1_000_000)
    micros = F.unix_micros("timestamp")
    timed = F.col("timestamp").isNotNull() & (F.coalesce("stream", F.lit("")) != "")
    asks = matches.filter(timed).select("stream", F.col(key).alias("ask"), (micros - 1000).alias("at")).dropDuplicates(["ask"])
    events = logs.filter(F.col("timestamp").isNotNull()).select(
        "stream", micros.alias("at"), F.col(tie).alias("tie"), F.struct("timestamp", "message", "stream").alias("event")
    )
    found = latest_before(events, asks, ["stream"], n, max(back - 1000, 0), slice_rows)
    # At most n events per match.
    in_order = F.array_sort(F.collect_list(F.struct("at", "tie", "event")))
    seen = found.groupBy(F.col("ask").alias(key)).agg(F.transform(in_order, lambda e: e["event"]).alias("_before"))
    nothing = F.array().cast(f"array<{_EVENT}>")
    return matches.join(seen, key, "left").select(
        *matches.columns, F.struct(F.coalesce("_before", nothing).alias("before"), nothing.alias("after")).alias("context")
    )
