"""Totals by time bucket that follow a stream, batch by batch.

Buckets belong to parts, spans of time. A batch of events becomes a few sums; only the parts it
touches are read, summed up and written anew, under the batch's number. A batch counts once its
commit is there, so one that is run again, after whatever failure, changes nothing twice.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.fixed import BUCKET
from logloom.operators.filters import grep
from logloom.session import drop_folder, folders_in, is_there

_TOTALS = "time_bucket timestamp, count bigint"
PART_SECONDS = 86_400


class BucketTotals:
    """(time_bucket, count) below ``path``, a folder that driver and executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, part_seconds: int = PART_SECONDS):
        self.spark, self.path, self.part_seconds = spark, path.rstrip("/"), part_seconds

    def _numbers(self, folder: str, name: str) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in folders_in(self.spark, f"{self.path}/{folder}") if n.startswith(f"{name}="))

    def last(self) -> int:
        """The last committed batch, -1 before the first."""
        return max(self._numbers("commits", "batch"), default=-1)

    def _version(self, part: int, before: int) -> int | None:
        """The batch below ``before`` that wrote the part's current rows. A batch that failed half-way is run
        again before any later one, so what is there of others is committed."""
        return max((b for b in self._numbers(f"parts/part={part}", "batch") if b < before), default=None)

    def _folder(self, part: int, batch: int) -> str:
        return f"{self.path}/parts/part={part}/batch={batch}"

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(_TOTALS).parquet(*folders) if folders else self.spark.createDataFrame([], _TOTALS)

    def add(self, counts: DataFrame, batch: int) -> DataFrame:
        """Adds a batch's (time_bucket, count) and gives the new totals of the buckets it touched.

        The batch is not committed by this; ``commit`` does that when its results are handed on.
        """
        part = F.floor(F.unix_seconds("time_bucket") / F.lit(self.part_seconds)).cast("bigint")
        # A row for each bucket of the batch.
        staged = f"{self.path}/staged/batch={batch}"
        counts.withColumn("part", part).write.mode("overwrite").parquet(staged)
        fresh = self.spark.read.schema(f"{_TOTALS}, part bigint").parquet(staged)
        parts = sorted(r["part"] for r in fresh.select("part").distinct().collect())
        versions = [(p, self._version(p, batch)) for p in parts]
        before = self._read([self._folder(p, old) for p, old in versions if old is not None])
        total = fresh.select("time_bucket", "count").unionByName(before).groupBy("time_bucket").agg(F.sum("count").alias("count"))
        for p in parts:
            if is_there(self.spark, self._folder(p, batch)):
                drop_folder(self.spark, self._folder(p, batch))
        named = total.withColumns({"part": part, "batch": F.lit(batch)}).repartition("part")
        named.write.mode("append").partitionBy("part", "batch").parquet(f"{self.path}/parts")
        now = self._read([self._folder(p, batch) for p in parts])
        return now.join(fresh.select("time_bucket"), "time_bucket", "left_semi")

    def commit(self, batch: int) -> None:
        """From now on the batch counts. What no batch that may be run again needs goes."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/batch={batch}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(at)
        staged = f"{self.path}/staged/batch={batch}"
        touched = self.spark.read.parquet(staged).select("part").distinct().collect() if is_there(self.spark, staged) else []
        for p in (r["part"] for r in touched):
            # This batch may be run again if the stream ends before it notes that it was done: it needs the one before.
            for old in [b for b in self._numbers(f"parts/part={p}", "batch") if b < batch][:-1]:
                drop_folder(self.spark, self._folder(p, old))
        for old in self._numbers("commits", "batch")[:-2]:
            drop_folder(self.spark, f"{self.path}/commits/batch={old}")
        drop_folder(self.spark, staged)

    def totals(self) -> DataFrame:
        """All buckets as of the last committed batch."""
        last = self.last()
        parts = self._numbers("parts", "part") if last >= 0 else []
        current = [(p, self._version(p, last + 1)) for p in parts]
        return self._read([self._folder(p, b) for p, b in current if b is not None])


def watch_counts(
    events: DataFrame, sink: Callable[[DataFrame, int], None], path: str, checkpoint: str, bucket: str = BUCKET,
    pattern: str | None = None, trigger: dict | None = None, part_seconds: int = PART_SECONDS,
) -> StreamingQuery:
    """At every trigger, ``sink`` gets the new totals of the time buckets that changed: (time_bucket, count).

    A tick reads the events that have arrived since the last one, and of the totals the
    parts (``part_seconds`` of time each) that these fall into. Late events count where they belong.
    ``BucketTotals(spark, path).totals()`` has all of them. Events of unknown time are left out.
    """
    spark = events.sparkSession
    kept = BucketTotals(spark, path, part_seconds)

    def each(batch: DataFrame, batch_id: int) -> None:
        start = F.window("timestamp", bucket)["start"]
        found = grep(batch.filter(F.col("timestamp").isNotNull()), pattern)
        counts = found.groupBy(start.alias("time_bucket")).agg(F.count(F.lit(1)).alias("count"))
        sink(kept.add(counts, batch_id), batch_id)
        kept.commit(batch_id)

    return (
        events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"})).start()
    )
