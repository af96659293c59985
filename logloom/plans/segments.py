"""Disjoint stretches of time, from many windows that may overlap."""

from pyspark.sql import DataFrame, Window, functions as F

from logloom.plans.ordered import CHUNK_LINES, before_in_source, range_cuts, range_of


def merged_windows(centres: DataFrame, width: int, chunk_rows: int = CHUNK_LINES) -> DataFrame:
    """``centres`` (with ``_at``, in microseconds, not null) with the ``segment`` of each row.

    Windows of ``width`` before and after two centres overlap, or touch, if these are no further
    apart than twice that; a segment is what a chain of such windows covers, named by its first
    centre. Centres are put in order inside ranges of bounded size; a table with one row
    for each range carries what crosses them.
    """
    cuts = range_cuts(centres, "_at", chunk_rows)
    place = range_of(cuts, F.col("_at"), "bigint").cast("bigint") if cuts else F.lit(0).cast("bigint")
    rows = centres.withColumn("chunk", place)
    along = Window.partitionBy("chunk").orderBy("_at")
    # One row for each centre in use: anchors of one moment are one.
    moments = rows.select("chunk", "_at").distinct()
    inside = moments.withColumn("_prev", F.lag("_at").over(along))
    ends = moments.groupBy("chunk").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).withColumn("_all", F.lit(0))
    # At most one row a range.
    ends = before_in_source(ends, "_all", _before=F.max("_last")).select("chunk", "_before")
    begun = inside.join(F.broadcast(ends), "chunk").withColumn("_prev", F.coalesce("_prev", "_before"))
    begun = begun.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col("_at") - F.col("_prev") > 2 * width), F.col("_at")))
    started = begun.withColumn("_here", F.max("_start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    carried = started.groupBy("chunk").agg(F.max("_start").alias("_latest")).withColumn("_all", F.lit(0))
    carried = before_in_source(carried, "_all", _carried=F.max("_latest")).select("chunk", "_carried")
    named = started.join(F.broadcast(carried), "chunk").select("_at", F.coalesce("_here", "_carried").alias("segment"))
    return centres.join(named, "_at")


def within_segments(events: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """``events`` (with ``_at``) that lie in a segment, each once, with its ``segment``.

    ``segments`` has (segment, low, high), disjoint. Time is cut into slices as wide as the narrowest segment can be,
    so a slice touches two segments at most, and a segment of k windows k + 1 slices at most: the join
    meets every event with two rows at most, however crowded its slice is.
    """
    step = max(2 * width, 1)
    slice_of = lambda c: F.floor(c / F.lit(step)).cast("bigint")
    touched = segments.withColumn("_slice", F.explode(F.sequence(slice_of(F.col("low")), slice_of(F.col("high")))))
    placed = events.withColumn("_slice", slice_of(F.col("_at")))
    met = placed.join(touched, "_slice").filter((F.col("_at") >= F.col("low")) & (F.col("_at") <= F.col("high")))
    return met.drop("_slice", "low", "high")
