"""Text scan: files to numbered lines."""

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.plans.ordered import before_in_source
from logloom.plans.sizing import BROADCAST_ROWS, byte_conf, small_side


def literal_path(name: str) -> str:
    """A file name as a path that means this file, whatever characters it has."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The members of an explicit list that exist, in name order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in sorted(paths):
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        matches = jpath.getFileSystem(conf).globStatus(jpath)
        if matches is not None and len(matches) > 0:
            found.append(path)
    return found


def path_label(paths: list[str]) -> str:
    """What a list of files is called: ``first (+N more)``."""
    ordered = sorted(paths)
    return ordered[0] if len(ordered) == 1 else f"{ordered[0]} (+{len(ordered) - 1} more)"


def source_of(file_path):
    """Plain path of a local file, URI of any other."""
    decoded = F.try_url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(decoded, file_path), F.lit("^file:/+"), F.lit("/"))


def source_name(path: str) -> str:
    """``source_of`` for a path the driver holds."""
    return re.sub("^file:/+", "/", unquote(path))


def line_text(value):
    """A line without its carriage return."""
    return F.when(F.endswith(value, F.lit("\r")), F.left(value, F.length(value) - 1)).otherwise(value)


class LineScan:
    """A text scan whose lines are identified by (source, chunk, pos).

    ``chunk`` is the byte offset of the file split, ``pos`` rises along it. This
    identity is free; turning it into a line number needs the line counts of the
    earlier splits, one more (column-less) pass. So number few rows, late.
    """

    def __init__(self, spark: SparkSession, paths, skip_missing: bool = False, max_line_bytes: int | None = None):
        paths = [paths] if isinstance(paths, str) else list(paths)
        if not paths:
            raise ValueError("no files provided")
        if skip_missing:
            paths = existing_paths(spark, paths)
            if not paths:
                raise FileNotFoundError("none of the specified files exist")
        self.spark, self.paths, self.label = spark, paths, path_label(paths)
        # Both passes must cut files alike, whatever executors come and go.
        self.min_splits = int(
            spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism
        )
        # Set for the session once and left: a plan is cut into splits when it runs.
        if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
            spark.conf.set("spark.sql.files.minPartitionNum", str(self.min_splits))
        self.raw = spark.read.option("lineSep", "\n").text(paths)
        self.identified = self.raw.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("chunk"),
            F.monotonically_increasing_id().alias("pos"),
            "value",
        )
        self.max_line_bytes = max_line_bytes

    def rows(self) -> DataFrame:
        """(source, chunk, pos, line); a line of over ``max_line_bytes`` is an error, never left out."""
        value = F.col("value")
        if self.max_line_bytes is not None:
            said = F.concat(F.lit(f"a line of more than {self.max_line_bytes} bytes in "), "file")
            value = F.when(F.octet_length("value") > self.max_line_bytes, F.raise_error(said).cast("string")).otherwise(value)
        return self.identified.select(source_of(F.col("file")).alias("source"), "chunk", "pos", line_text(value).alias("line"))

    def only(self, sources: list[str]) -> "LineScan":
        """A scan of these of its files."""
        return LineScan(self.spark, [literal_path(f) for f in sorted(sources)], max_line_bytes=self.max_line_bytes)

    def unnumbered(self, rows: DataFrame) -> DataFrame:
        """Rows of this scan with a ``line_no`` that is not known."""
        return rows.withColumn("line_no", F.lit(None).cast("bigint"))

    def split_bound(self) -> int:
        """An upper bound on the number of file splits, from the file listing alone."""
        files = len(self.raw._jdf.inputFiles())
        total = int(str(self.raw._jdf.queryExecution().analyzed().stats().sizeInBytes()))
        largest = byte_conf(self.spark, "spark.sql.files.maxPartitionBytes", 128 << 20)
        opening = byte_conf(self.spark, "spark.sql.files.openCostInBytes", 4 << 20)
        share = (total + files * opening) // max(self.min_splits, 1)
        return files + total // max(min(largest, max(opening, share)), 1) + 1

    def offsets(self) -> DataFrame:
        """Per split: its first ``pos`` and the number of lines before it in its file."""
        counts = self.identified.groupBy("file", "chunk").agg(
            F.count(F.lit(1)).alias("lines"), F.min("pos").alias("first_pos")
        )
        return before_in_source(counts, "file", lines_before=F.sum("lines")).select(
            source_of(F.col("file")).alias("source"), "chunk", "first_pos",
            F.coalesce("lines_before", F.lit(0)).alias("lines_before"),
        )

    def number(self, rows: DataFrame, row_bound: int | None = None) -> DataFrame:
        """Adds ``line_no`` to rows that carry this scan's (source, chunk, pos).

        The offsets are broadcast when the listing proves them small. ``row_bound``
        says that the rows are few; then any join will do, and none is forced.
        """
        offsets = self.offsets()
        if row_bound is None or row_bound > BROADCAST_ROWS:
            offsets = small_side(offsets, self.split_bound())
        joined = rows.join(offsets, ["source", "chunk"], "left")
        unknown = F.raise_error(F.lit("files changed between two passes of one scan"))
        line_no = F.when(F.col("first_pos").isNull(), unknown.cast("bigint")).otherwise(
            F.col("lines_before") + F.col("pos") - F.col("first_pos") + 1
        )
        return joined.withColumn("line_no", line_no).drop("first_pos", "lines_before")

    def numbered(self) -> DataFrame:
        """LINES: (source, line_no, line)"""
        return self.number(self.rows()).select("source", "line_no", "line")


def read_lines(spark: SparkSession, paths, skip_missing: bool = False, max_line_bytes: int | None = None) -> DataFrame:
    """Files (paths, globs, lists) to (source, line_no, line)."""
    return LineScan(spark, paths, skip_missing, max_line_bytes).numbered()


def file_streams(spark: SparkSession, paths) -> DataFrame:
    """A9, file form: name, size and change time of each file, no content read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        source_of(F.col("path")).alias("name"),
        F.col("length").alias("size"),
        F.lit(None).cast("timestamp").alias("first_time"),
        F.col("modificationTime").alias("last_time"),
    )
