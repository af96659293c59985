"""Following logs as they arrive.

The source is a folder that closed files are moved into (or any other streaming
DataFrame); Spark keeps its place in a checkpoint, so nothing is polled twice and
nothing is dropped when the sink is slow.
"""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.fixed import BUCKET
from logloom.functions.times import duration_argument
from logloom.operators.filters import grep, moment
from logloom.parsers.registry import parse_rows
from logloom.session import fresh_folder
from logloom.sources.address import LogSource
from logloom.sources.lines import LineScan, line_text, literal_path, source_of

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
SERVICE_LOOKBACK = "5s"
POLL_LOOKBACK = "30s"


def tail_lines(spark: SparkSession, folder: str, max_files: int | None = None, since: datetime | None = None) -> DataFrame:
    """Streaming (source, chunk, pos, line) rows of the files that arrive.

    ``since`` leaves out files last changed at or before that moment: the time of the
    call follows the folder from now on, None begins with all that is there. A restart
    from a checkpoint passes the same moment again. ``pos`` is NULL: a stream cannot
    number its rows (``tail_files`` does).
    """
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(folder)
    if since is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") > F.lit(since))
    return lines.select(
        source_of(F.col("_metadata.file_path")).alias("source"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.lit(None).cast("bigint").alias("pos"),
        line_text(F.col("value")).alias("line"),
    )


def tail_filter(events: DataFrame, pattern: str | None = None, start=None, lookback: str = SERVICE_LOOKBACK) -> DataFrame:
    """Matching events from a little before the start on; unknown times pass."""
    found = grep(events, pattern)
    if start is None:
        return found
    earliest = moment(start).cast("timestamp") - F.lit(duration_argument(lookback))
    return found.filter(F.col("timestamp").isNull() | (F.col("timestamp") >= earliest))


def tail_logs(
    spark: SparkSession, folder: str, fmt: str = "plain", pattern: str | None = None, start=None,
    lookback: str = SERVICE_LOOKBACK, max_files: int | None = None, since: datetime | None = None, **options,
) -> DataFrame:
    """A stream of (timestamp, message, stream, source, fields) events.

    For formats of one line per entry. Java logs, whose entries span lines, are
    followed with ``tail_files`` or ``tail_multiline``.
    """
    if fmt == "java":
        raise ValueError("entries of several lines: use tail_files or tail_multiline")
    rows = parse_rows(tail_lines(spark, folder, max_files, since), fmt, **options)
    events = rows.select(
        "timestamp", "message", F.substring_index("source", "/", -1).alias("stream"), "source", "fields"
    )
    return tail_filter(events, pattern, start, lookback)


def tail_files(
    spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "plain",
    pattern: str | None = None, trigger: dict | None = None, max_files: int = 1_000, **options,
) -> StreamingQuery:
    """X1, X5 for whole files: each batch of new files is read as a batch source,
    so entries are numbered, traces joined and pointers made as in a query.

    The stream itself carries file names only. ``sink(entries, batch_id)`` gets
    ENTRY rows; a batch has at most ``max_files`` files.
    """
    arrived = (
        spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", max_files)
        .load(folder).select("path")
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        files = [literal_path(r["path"]) for r in batch.collect()]
        if files:
            source = LogSource("local", folder, scan=LineScan(batch.sparkSession, files), format=fmt, options=options)
            sink(grep(source.entries(), pattern), batch_id)

    return (
        arrived.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    )


def dedup_stream(
    events: DataFrame, keys=("timestamp", "message"), delay: str = "10 minutes", by: str = "arrival"
) -> DataFrame:
    """Each key once, with state bounded by time.

    ``by='arrival'`` forgets a key ``delay`` after it came in and loses no event
    however late it is; ``by='timestamp'`` measures in event time, where events more
    than ``delay`` behind are dropped as late.
    """
    if by == "timestamp":
        return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(keys))
    arrived = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")


def tail_counts(events: DataFrame, bucket: str = BUCKET, delay: str = "10 minutes", pattern: str | None = None) -> DataFrame:
    """Streaming (time_bucket, count); write it in ``update`` mode."""
    return (
        grep(events, pattern)
        .filter(F.col("timestamp").isNotNull())
        .withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", bucket).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("time_bucket"), "count")
    )


def keep_updates(counts: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Writes every update with the batch it came in; ``latest_counts`` reads them."""

    def each(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def latest_counts(updates: DataFrame) -> DataFrame:
    """The last count written for each bucket, newest first."""
    return (
        updates.groupBy("time_bucket").agg(F.max_by("count", "batch").alias("count"))
        .orderBy(F.col("time_bucket").desc())
    )


def write_stream(events: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None, mode: str = "append") -> StreamingQuery:
    """A stream to Parquet, exactly once."""
    checkpoint = checkpoint or fresh_folder(events.sparkSession, "checkpoint")
    return (
        events.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def watch(
    ticks: DataFrame, query: Callable[[datetime], DataFrame], sink: Callable[[DataFrame, int], None],
    checkpoint: str, trigger: dict | None = None, clock: Callable[[], datetime] | None = None,
    before: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Run ``query(now)`` again at every trigger and hand the result to ``sink``.

    ``ticks`` is any stream: the arriving data itself, or ``every(spark)``. ``before``
    may first add the new rows to the table the query reads.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if before is not None:
            before(batch, batch_id)
        sink(query((clock or datetime.now)()), batch_id)

    return (
        ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"})).start()
    )


def every(spark: SparkSession) -> DataFrame:
    """A stream that only ticks, for a watch on a clock."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load()
