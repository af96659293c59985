"""Joining continuation lines of a stream.

What a stopped stream has to know is in folders below its checkpoint: ``open/batch=n`` names
the entries that were open after a batch, ``pieces/batch=n`` holds the text that the batch added
to them. A restarted stream, or a flush by another process, goes on from there. Text is written
once, as it comes, and read once, when its entry ends.
"""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.multiline import join_rows
from logloom.plans.ordered import CHUNK_LINES
from logloom.session import drop_folder, folders_in, fresh_folder, is_there

_OPEN = "source string, line_no bigint, since bigint, grown timestamp"
_PIECES = "source string, line_no bigint, text string"
_KEY = ["source", "line_no"]


class JoinedStream:
    """A running ``tail_multiline``: ``query`` is the stream, ``flush`` gives out what is still open."""

    def __init__(self, query: StreamingQuery, state: "OpenEntries", sink: Callable[[DataFrame, int], None]):
        self.query, self._state, self._sink = query, state, sink

    def flush(self) -> None:
        """After the stream has ended: the last entry of every source, as one more batch.

        Its number is negative, -1 - n after batch n, so it never meets one of the stream's. What was
        open is closed then, also for a stream that is started again later; a second flush does nothing.
        """
        last = self._state.last()
        if last is not None and not self._state.is_flushed(last):
            entries = self._state.open_after(last).select(*_KEY, "since", F.lit(None).cast("string").alias("text"))
            self._sink(self._state.whole(entries, last + 1), -1 - last)
            self._state.mark_flushed(last)

    def finish(self) -> None:
        """Wait for the end of the stream, then flush."""
        self.query.awaitTermination()
        self.flush()


class OpenEntries:
    """The entries that may still grow, at most one a source, in folders for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(name.partition("=")[2]) for name in folders_in(self.spark, f"{self.path}/{kind}") if name.startswith("batch="))

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch}"

    def last(self) -> int | None:
        """The last batch whose open entries are written whole."""
        done = [n for n in self._numbers("open") if is_there(self.spark, f"{self._folder('open', n)}/_SUCCESS")]
        return done[-1] if done else None

    def is_flushed(self, batch: int) -> bool:
        return is_there(self.spark, self._folder("flushed", batch))

    def mark_flushed(self, batch: int) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder("flushed", batch))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(at)

    def open_after(self, batch: int) -> DataFrame:
        """(source, line_no, since, grown): ``since`` is the batch that began the entry."""
        known = batch >= 0 and not self.is_flushed(batch)
        return self.spark.read.schema(_OPEN).parquet(self._folder("open", batch)) if known else self.spark.createDataFrame([], _OPEN)

    def add(self, pieces: DataFrame, batch: int) -> None:
        """Text that the batch adds to open entries; a batch that is run again replaces its own."""
        pieces.write.mode("overwrite").parquet(self._folder("pieces", batch))

    def commit(self, entries: DataFrame, batch: int) -> None:
        """The entries open after the batch. Folders that neither it nor the batch before needs go."""
        entries.write.mode("overwrite").parquet(self._folder("open", batch))
        for n in self._numbers("open"):
            if n < batch - 1:
                drop_folder(self.spark, self._folder("open", n))
        both = [self.open_after(n) for n in (batch - 1, batch)]
        needed = both[0].unionByName(both[1]).agg(F.min("since")).first()[0]
        # A batch that is run again reads what was there when it first ran.
        least = min(batch if needed is None else needed, batch)
        for n in self._numbers("pieces"):
            if n < least:
                drop_folder(self.spark, self._folder("pieces", n))

    def whole(self, ended: DataFrame, batch: int) -> DataFrame:
        """(source, line_no, message) of ended entries (source, line_no, since, text), whose pieces of
        batches before ``batch`` come before ``text``, if there is any."""
        # What began in this batch is whole already and need not be gathered.
        own = ended.filter((F.col("since") == batch) & F.col("text").isNotNull()).select(*_KEY, F.col("text").alias("message"))
        older = ended.filter(F.col("since") < batch)
        first = older.agg(F.min("since")).first()[0]
        if first is None:
            return own
        folders = [self._folder("pieces", n) for n in self._numbers("pieces") if first <= n < batch]
        texts = older.filter("text IS NOT NULL").select(*_KEY, F.lit(batch).cast("bigint").alias("batch"), "text")
        if folders:
            pieces = self.spark.read.schema(f"{_PIECES}, batch bigint").option("basePath", f"{self.path}/pieces").parquet(*folders)
            texts = texts.unionByName(pieces.join(older.select(*_KEY), _KEY, "left_semi").select(*_KEY, "batch", "text"))
        parts = F.array_sort(F.collect_list(F.struct("batch", "text")))
        gathered = texts.groupBy(*_KEY).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("message"))
        return own.unionByName(gathered)


def tail_multiline(
    lines: DataFrame, is_head: Column, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None,
    quiet: str | None = None, ticks: DataFrame | None = None,
) -> JoinedStream:
    """Streaming (source, line_no, line) rows to batches of (source, line_no, message) entries for ``sink(entries, batch_id)``.

    A batch is joined as stored lines are, in bounded chunks of a source. The last entry of a
    source stays open until its next one begins, until a batch finds that it has not grown for
    ``quiet`` (an interval such as ``5 seconds``), or until ``flush``; of an open entry a later
    batch reads the key only, not the text. ``ticks`` is any stream that makes batches when no
    lines arrive (``every(spark)``). Lines of a source must not arrive after later ones of an
    earlier batch. A batch that is run again finds what was open after the batch before it; its
    sink call has the same id. A stream started again with the same ``checkpoint`` goes on where it stopped.
    """
    spark = lines.sparkSession
    state = OpenEntries(spark, checkpoint)
    rows = lines.select("source", "line_no", "line")
    if ticks is not None:
        none = F.lit(None)
        rows = rows.unionByName(ticks.select(none.cast("string").alias("source"), none.cast("bigint").alias("line_no"), none.cast("string").alias("line")))

    def each(batch: DataFrame, batch_id: int) -> None:
        # One moment for all that is asked about a batch.
        now = F.timestamp_micros(F.lit(time.time_ns() // 1000))
        earlier = state.open_after(batch_id - 1)
        fresh = batch.filter("source IS NOT NULL").select("source", "line_no", "line", is_head.alias("_head"))
        # An open entry is a head without text, to which the lines before the next head go.
        held = earlier.select("source", "line_no", F.lit(None).cast("string").alias("line"), F.lit(True).alias("_head"))
        all_lines = fresh.unionByName(held)
        chunk = F.floor((F.col("line_no") - 1) / F.lit(CHUNK_LINES)).cast("bigint")
        placed = all_lines.select("source", chunk.alias("chunk"), F.col("line_no").alias("pos"), F.coalesce("line", F.lit("")).alias("line"), F.coalesce("_head", F.lit(False)).alias("_head"))
        joined = join_rows(placed, F.col("_head")).select("source", F.col("pos").alias("line_no"), "head", "rest")
        known = earlier.select(*_KEY, F.col("since").alias("begun"), F.col("grown").alias("before"))
        text = F.when(F.col("begun").isNull(), F.concat_ws("\n", "head", "rest")).otherwise(F.col("rest"))
        added = joined.join(known, _KEY, "left").select(*_KEY, F.coalesce("begun", F.lit(batch_id)).cast("bigint").alias("since"), text.alias("text"), "before")
        entries = fresh_folder(spark, "entries")
        added.write.parquet(entries)
        added = spark.read.schema(added.schema).parquet(entries)
        # An entry without text is one that no line of this batch went to.
        grown = F.max(F.when(F.col("text").isNotNull(), now).otherwise(F.col("before")))
        newest = added.groupBy("source").agg(F.max("line_no").alias("newest"), grown.alias("grown"))
        added = added.drop("before")
        told = added.join(newest, "source")
        still = F.col("line_no") == F.col("newest")
        if quiet is not None:
            still = still & (F.col("grown") > now - F.expr(f"INTERVAL {quiet}"))
        state.add(told.filter(still & F.col("text").isNotNull()).select(*_KEY, "text"), batch_id)
        sink(state.whole(told.filter(~still).select(*_KEY, "since", "text"), batch_id), batch_id)
        state.commit(told.filter(still).select(*_KEY, "since", "grown"), batch_id)
        drop_folder(spark, entries)

    query = (
        rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    return JoinedStream(query, state, sink)
