"""Queries: streams, run to the end of what has arrived."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from checks.inputs import SQL_MESSAGE, entries, event_message, micros, table
from checks.parsing import _SQL_TRACE, _trace_lines
from checks.registry import query
from logloom.operators.aggregates import count_by_bucket
from logloom.parsers.java import is_header
from logloom.session import cut_lineage, fresh_folder
from logloom.sources.lines import file_streams
from logloom.streaming import buckets as bucket_totals
from logloom.streaming.multiline import tail_multiline
from logloom.streaming.seen import dedup_newest
from logloom.streaming.tail import (
    dedup_stream, keep_updates, latest_counts, tail_counts, tail_files, tail_filter, tail_logs, watch, write_stream,
)

_NOW = {"availableNow": True}


def _arriving(spark, df, files=4):
    """The rows of ``df`` as a stream of files, one file a batch."""
    folder = fresh_folder(spark, "arriving")
    df.repartition(files).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _in_order(spark, df, by, steps=3, files=2):
    """The rows of ``df`` as a stream that arrives in the order of a whole-numbered column, a step a batch."""
    folder, df = fresh_folder(spark, "arriving"), cut_lineage(df)
    low, high = df.agg(F.min(by), F.max(by)).first()
    for k in range(steps):
        first, end = (low + (high + 1 - low) * i // steps for i in (k, k + 1))
        df.filter((by >= first) & (by < end)).repartition(files).write.mode("append").parquet(folder)
        time.sleep(0.05)  # the change times of the files order them
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("tail_dedup", """
SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE event_type IN ('error', 'click') AND ts >= TIMESTAMP '2024-01-09 23:59:55'""")
def tail_dedup(spark, sf):
    events = entries(spark, sf).select("timestamp", "message", "stream", "line_no")
    stream = _arriving(spark, events.unionByName(events))
    kept = dedup_stream(tail_filter(stream, "^(error|CLICK) ", "2024-01-10T00:00:00Z"), ("stream", "timestamp"), "1 hour")
    out = fresh_folder(spark, "tail")
    write_stream(kept, out).awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select(F.col("line_no").alias("event_id"), micros().alias("ts_us"))


@query("tail_text", f"""
SELECT epoch_us(date_trunc('millisecond', ts)) AS ts_us, {SQL_MESSAGE} AS message FROM events WHERE event_type = 'view'""")
def tail_text(spark, sf):
    folder = fresh_folder(spark, "text")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), event_message())
    table(spark, sf, "events").select(line.alias("value")).repartition(4).write.text(folder)
    out = fresh_folder(spark, "tail")
    events = tail_logs(spark, folder, "plain", "^VIEW", max_files=2).select("timestamp", "message", "stream")
    write_stream(events, out).awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select(micros().alias("ts_us"), "message")


@query("tail_since", f"""
SELECT epoch_us(date_trunc('millisecond', ts)) AS ts_us, {SQL_MESSAGE} AS message FROM events WHERE event_id % 2 = 1""")
def tail_since(spark, sf):
    """Followed from a moment on: the files that were there before it are left out."""
    folder, out = fresh_folder(spark, "text"), fresh_folder(spark, "tail")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), event_message())
    rows = table(spark, sf, "events").select("event_id", line.alias("value"))
    rows.filter("event_id % 2 = 0").select("value").repartition(2).write.text(folder)
    # File systems may keep the seconds of a change only.
    changed = file_streams(spark, folder).agg(F.max("last_time")).first()[0]
    time.sleep(1.1)
    rows.filter("event_id % 2 = 1").select("value").repartition(2).write.mode("append").text(folder)
    events = tail_logs(spark, folder, "plain", since=changed).select("timestamp", "message")
    write_stream(events, out).awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select(micros().alias("ts_us"), "message")


@query("tail_counts", """
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS bucket_us, count(*) AS count FROM events GROUP BY 1""")
def counts(spark, sf):
    # In time order, so that old windows expire as the stream goes on.
    stream = _in_order(spark, entries(spark, sf).select("timestamp", "message"), F.unix_micros("timestamp"), 4)
    out, at = fresh_folder(spark, "counts"), fresh_folder(spark, "checkpoint")
    keep_updates(tail_counts(stream, delay="1 day"), out, at, _NOW).awaitTermination()
    found = latest_counts(spark.read.option("basePath", out).parquet(out))
    return found.select(micros("time_bucket").alias("bucket_us"), "count")


@query("watch_counts", """
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS bucket_us, count(*) AS count
FROM events WHERE event_type = 'error' GROUP BY 1""")
def watched(spark, sf):
    logs = entries(spark, sf).select("timestamp", "message")
    stored, shown, at = (fresh_folder(spark, n) for n in ("stored", "shown", "checkpoint"))

    def add(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{stored}/batch={batch_id}")

    def ask(now):
        return count_by_bucket(spark.read.schema(logs.schema).parquet(stored), pattern="^error", limit=None)

    def show(result, batch_id):
        result.write.mode("overwrite").parquet(shown)

    watch(_arriving(spark, logs, 2), ask, show, at, _NOW, lambda: datetime(2024, 2, 1), add).awaitTermination()
    return spark.read.parquet(shown).select(micros("time_bucket").alias("bucket_us"), "count")


@query("watch_incremental", """
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS bucket_us, count(*) AS count
FROM events WHERE event_type = 'error' GROUP BY 1""")
def watched_incrementally(spark, sf):
    """The totals after ticks that each read what had newly arrived, in no order of time."""
    logs = entries(spark, sf).select("timestamp", "message")
    path, at = fresh_folder(spark, "totals"), fresh_folder(spark, "checkpoint")
    changed = fresh_folder(spark, "changed")

    def show(result, batch_id):
        result.write.mode("overwrite").parquet(f"{changed}/batch={batch_id}")

    bucket_totals.watch_counts(_arriving(spark, logs, 3), show, path, at, pattern="^error", trigger=_NOW).awaitTermination()
    # What the ticks have shown, the last of each bucket, is the same as what is stored.
    shown = latest_counts(spark.read.option("basePath", changed).parquet(changed))
    stored = bucket_totals.BucketTotals(spark, path).totals()
    return shown.join(stored, ["time_bucket", "count"]).select(micros("time_bucket").alias("bucket_us"), "count")


@query("tail_dedup_bounded", """
SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE event_type IN ('error', 'click')""")
def tail_dedup_bounded(spark, sf):
    """Every event comes twice, one right after the other, at most a few of its part between them."""
    events = entries(spark, sf).select("timestamp", "message", "stream", "line_no")
    twice = events.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).repartitionByRange(4, "line_no").sortWithinPartitions("line_no").drop("again")
    folder = fresh_folder(spark, "arriving")
    twice.write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = fresh_folder(spark, "tail")
    write_stream(dedup_newest(tail_filter(stream, "^(error|CLICK) "), ("stream", "timestamp", "line_no"), 2_000, parts=8), out).awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select(F.col("line_no").alias("event_id"), micros().alias("ts_us"))


@query("tail_multiline", f"""
SELECT '/v/app-' || user_id % 4 || '.log' AS source, event_id * 10 + 1 AS line_no,
       strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || {SQL_MESSAGE} || replace({_SQL_TRACE},
         'java.io.IOException:', chr(27) || '[31mjava.io.IOException' || chr(27) || '[0m:') AS message
FROM events""")
def multiline(spark, sf):
    header = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), event_message())
    lines = _trace_lines(spark, sf, header)
    out, at = (fresh_folder(spark, n) for n in ("joined", "checkpoint"))
    # Entries go on from one batch to the next.
    stream = _in_order(spark, lines, F.col("line_no"))

    def keep(entries, batch_id):
        entries.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    tail_multiline(stream, is_header(F.col("line")), keep, at).finish()
    return spark.read.schema("source string, line_no bigint, message string").parquet(out).select("source", "line_no", "message")


@query("tail_multiline_restart", f"""
SELECT '/v/app-' || user_id % 4 || '.log' AS source, event_id * 10 + 1 AS line_no,
       strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || {SQL_MESSAGE} || replace({_SQL_TRACE},
         'java.io.IOException:', chr(27) || '[31mjava.io.IOException' || chr(27) || '[0m:') AS message
FROM events""")
def multiline_restart(spark, sf):
    """The stream is stopped after each part of the lines has come, in the middle of entries, started again, and flushed after a start that finds nothing new."""
    header = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), event_message())
    lines = cut_lineage(_trace_lines(spark, sf, header))
    out, at, folder = (fresh_folder(spark, n) for n in ("joined", "checkpoint", "arriving"))
    low, high = lines.agg(F.min("line_no"), F.max("line_no")).first()

    def keep(entries, batch_id):
        entries.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def start():
        stream = spark.readStream.schema(lines.schema).parquet(folder)
        return tail_multiline(stream, is_header(F.col("line")), keep, at)

    for k in range(3):
        first, end = (low + (high + 1 - low) * i // 3 for i in (k, k + 1))
        lines.filter((F.col("line_no") >= first) & (F.col("line_no") < end)).repartition(2).write.mode("append").parquet(folder)
        start().query.awaitTermination()
    start().finish()
    return spark.read.schema("source string, line_no bigint, message string").parquet(out).select("source", "line_no", "message")


@query("tail_files", f"""
SELECT event_id * 10 + 1 AS key, epoch_us(date_trunc('second', ts)) AS ts_us, {SQL_MESSAGE} || {_SQL_TRACE} AS message FROM events""")
def files(spark, sf):
    header = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), event_message(), F.lit(" #"), F.col("event_id") * 10 + 1)
    folder, out, at = fresh_folder(spark, "files"), fresh_folder(spark, "entries"), fresh_folder(spark, "checkpoint")
    day = table(spark, sf, "events").select((F.col("event_id") * 10 + 1).alias("head"), F.to_date("ts").alias("day"))
    (
        _trace_lines(spark, sf, header).withColumn("head", F.floor(F.col("line_no") / 10) * 10 + 1).join(day, "head")
        .repartition("source", "day").sortWithinPartitions("source", "day", "line_no")
        .select(F.regexp_extract("source", r"app-(\d)", 1).alias("app"), "day", F.col("line").alias("value"))
        .write.partitionBy("app", "day").text(folder)
    )

    def keep(found, batch_id):
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    tail_files(spark, f"{folder}/*/*", keep, at, "java", None, _NOW, 64, default_date="2020-01-01").awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    key = F.regexp_extract("message", r"(?s)#(\d+)", 1).cast("bigint")
    return rows.select(key.alias("key"), micros().alias("ts_us"), F.regexp_replace("message", r" #\d+", "").alias("message"))
