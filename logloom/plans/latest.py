"""The last events at or before a moment, for many moments at once."""

from pyspark.sql import Column, DataFrame, Window, functions as F

# Events of one time slice that one task sorts; a slice of more is dealt out.
SLICE_ROWS = 2_000_000


def _slice(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("bigint")


def latest_before(
    events: DataFrame, asks: DataFrame, keys: list[str], n: int, span: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Per ask: the last ``n`` events of its key with ``at - span <= event.at <= at``.

    ``events`` has (…keys, at, tie, event), ``asks`` (…keys, ask, at), times in
    microseconds, ``ask`` unique. Gives (ask, at, tie, event), at most ``n`` per ask.

    No pair of ask and event is formed to be thrown away. Time is cut into slices
    as wide as the span, and events and asks of a slice are sorted together once: an
    event's place is its rank, and an ask learns how many events stand before it.
    The ranks it wants are then fetched by equality. An ask goes to the two slices
    its span touches. A slice of more than ``slice_rows`` events is dealt out over
    parts, each ask goes to all of them, and the nearest of all answers are kept.
    """
    width = max(span, 1)
    place = [*keys, "slice"]
    dated = events.withColumn("slice", _slice(F.col("at"), width))
    visits = asks.withColumn(
        "slice", F.explode(F.sequence(_slice(F.col("at") - span, width), _slice(F.col("at"), width)))
    )
    near = dated.join(visits.select(*place).distinct(), place, "left_semi")
    # At most one row per ``slice_rows`` events, so this stays small beside any table.
    crowded = (
        near.groupBy(*place).agg(F.count(F.lit(1)).alias("size"))
        .filter(F.col("size") > slice_rows)
        .select(*place, F.ceil(F.col("size") / F.lit(slice_rows)).cast("bigint").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    dealt = near.join(crowded, place, "left").withColumn(
        "part", F.pmod(F.xxhash64("at", "tie"), parts)
    ).drop("parts")
    sent = visits.join(crowded, place, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    ).drop("parts")

    group = [*place, "part"]
    ask_type, event_type = asks.schema["ask"].dataType, events.schema["event"].dataType
    tie_type = events.schema["tie"].dataType
    both = dealt.select(
        *group, "at", "tie", "event", F.lit(None).cast(ask_type).alias("ask"), F.lit(0).alias("is_ask")
    ).unionByName(
        sent.select(
            *group, "at", F.lit(None).cast(tie_type).alias("tie"), F.lit(None).cast(event_type).alias("event"), "ask",
            F.lit(1).alias("is_ask"),
        )
    )
    order = Window.partitionBy(*group).orderBy("at", "is_ask", "tie").rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("rank", F.sum(1 - F.col("is_ask")).over(order))
    standing = ranked.filter(F.col("is_ask") == 0).select(*group, "rank", "at", "tie", "event")
    wanted = ranked.filter((F.col("is_ask") == 1) & (F.col("rank") > 0)).select(
        *group, "ask", F.col("at").alias("ask_at"),
        F.explode(F.sequence(F.greatest(F.col("rank") - (n - 1), F.lit(1)), F.col("rank"))).alias("rank"),
    )
    found = standing.join(wanted, [*group, "rank"]).filter(F.col("at") >= F.col("ask_at") - span)
    nearest = Window.partitionBy("ask").orderBy(F.col("at").desc(), F.col("tie").desc())
    return (
        found.select("ask", "at", "tie", "event")
        .withColumn("_n", F.row_number().over(nearest))
        .filter(F.col("_n") <= n)
        .drop("_n")
    )
