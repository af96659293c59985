"""Entries around a moment, or around many."""

from pyspark.sql import DataFrame, functions as F

from logloom.fixed import AROUND_LIMIT
from logloom.functions.times import duration_argument
from logloom.operators.filters import grep, moment, time_range
from logloom.operators.ranking import newest
from logloom.plans.latest import SLICE_ROWS, latest_before
from logloom.plans.ordered import CHUNK_LINES
from logloom.plans.segments import merged_windows, within_segments


def around(df: DataFrame, ts, window="5m", pattern: str | None = None, limit: int | None = AROUND_LIMIT) -> DataFrame:
    """newest entries within ``window`` before and after ``ts``, ends included."""
    span = F.lit(duration_argument(window))
    centre = moment(ts).cast("timestamp")
    return newest(grep(time_range(df, centre - span, centre + span), pattern), limit)


def around_many(
    logs: DataFrame, anchors: DataFrame, window="5m", pattern: str | None = None,
    limit: int | None = AROUND_LIMIT, key: str = "anchor_id", at: str = "anchor_ts", salts: int = 8,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Per anchor (``key`` is unique), the newest ``limit`` entries within ``window`` of it.

    With a limit only the rows that are kept are ever joined. Without one the result
    is every entry in every window: a join on time buckets as wide as the window, an
    anchor standing in the three it can reach, with the entries of a bucket dealt
    out over ``salts`` parts because a bucket may hold a large part of the logs.
    """
    width = int(duration_argument(window).total_seconds() * 1_000_000)
    rows = grep(logs.filter(F.col("timestamp").isNotNull()), pattern)
    micros = F.unix_micros("timestamp")
    centre = F.unix_micros(F.col(at).cast("timestamp"))
    if limit and limit > 0:
        events = rows.select(micros.alias("at"), F.col("ptr").alias("tie"), F.struct(*logs.columns).alias("event"))
        asks = anchors.select(F.col(key).alias("ask"), (centre + width).alias("at"))
        found = latest_before(events, asks, [], limit, 2 * width, slice_rows).select(F.col("ask").alias(key), "event.*")
        return anchors.select(key, at).join(found, key)
    step = max(width, 1)
    left = rows.withColumn("_bucket", F.floor(micros / F.lit(step))).withColumn(
        "_salt", F.pmod(F.xxhash64("ptr", "timestamp", "message"), F.lit(salts))
    )
    home = F.floor(centre / F.lit(step))
    parts = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    right = (
        anchors.select(key, at, centre.alias("_centre"))
        .withColumn("_bucket", F.explode(F.array(home - 1, home, home + 1)))
        .withColumn("_salt", F.explode(parts))
    )
    near = left.join(right, ["_bucket", "_salt"]).filter(F.abs(micros - F.col("_centre")) <= width)
    return near.select(key, at, *logs.columns)


def around_segments(
    logs: DataFrame, anchors: DataFrame, window="5m", pattern: str | None = None, key: str = "anchor_id", at: str = "anchor_ts", chunk_rows: int = CHUNK_LINES,
) -> tuple[DataFrame, DataFrame]:
    """J6 without a limit: every entry in some anchor's window, once, and which anchors to look at it from.

    Overlapping windows are merged to segments of time. Gives the entries with their ``segment``,
    and a table (segment, low, high, ``key``, ``at``) with one row an anchor; ``low`` and ``high`` are the segment's
    ends. Both are as long as what they are made of, however many windows an entry lies in. The entries
    of one anchor are those of its segment that are no further from it than ``window``. Anchors of unknown time
    have no row, entries of unknown time no segment.
    """
    width = int(duration_argument(window).total_seconds() * 1_000_000)
    moments = anchors.select(key, at, F.unix_micros(F.col(at).cast("timestamp")).alias("_at")).filter(F.col("_at").isNotNull())
    members = merged_windows(moments, width, chunk_rows)
    segments = members.groupBy("segment").agg((F.min("_at") - width).alias("low"), (F.max("_at") + width).alias("high"))
    rows = grep(logs.filter(F.col("timestamp").isNotNull()), pattern).withColumn("_at", F.unix_micros("timestamp"))
    tagged = within_segments(rows, segments, width).select(*logs.columns, "segment")
    micros = lambda c: F.timestamp_micros(F.col(c)).alias(c)
    ends = segments.select("segment", micros("low"), micros("high"))
    return tagged, members.join(ends, "segment").select("segment", "low", "high", key, at)
