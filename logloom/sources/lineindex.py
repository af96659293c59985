"""A stored index of line numbers, so that a line is found without reading its file.

A file is cut into splits of a few megabytes; the index has one row a split: where it begins
and how many lines come before. A line is then read from the beginning of its split on.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.plans.sizing import small_side
from logloom.session import is_there
from logloom.sources.detect import FILES_AT_ONCE
from logloom.sources.lines import LineScan, file_streams, literal_path, read_lines

SPLIT_BYTES = 4 << 20
STEP_BYTES = 1 << 18
# Lines that the driver looks up one by one.
SEEKS = 100
_SCHEMA = "source string, chunk bigint, lines_before bigint, size bigint, changed bigint"


def write_index(spark: SparkSession, paths, path: str, split_bytes: int = SPLIT_BYTES, mode: str = "overwrite") -> None:
    """One pass over the files, which reads no more of a line than its end: (source, chunk, lines_before) of every split.

    Size and time of change of each file are kept with it: a file that has changed since is not looked up.
    """
    # Splits of its own size, whatever the session's reads are cut into.
    cut = spark.newSession()
    cut.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    cut.conf.set("spark.sql.files.openCostInBytes", str(split_bytes))
    files = file_streams(cut, paths).select(F.col("name").alias("source"), "size", F.unix_millis("last_time").alias("changed"))
    offsets = LineScan(cut, paths).offsets().select("source", "chunk", "lines_before")
    # Sorted, so that a look-up reads few row groups.
    offsets.join(files, "source").sort("source", "chunk").write.mode(mode).parquet(path)


def _file(spark: SparkSession, source: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_line(spark: SparkSession, source: str, chunk: int, skip: int) -> str | None:
    """The line ``skip`` lines after the first that begins in the split at ``chunk``; None beyond the end of the file.

    The line in which a split begins belongs to the one before, also if it begins right there.
    """
    at, files = _file(spark, source)
    stream = files.open(at)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(at)
        if codec is not None:
            stream = codec.createInputStream(stream)
        elif chunk:
            stream.seek(chunk)
        left, held = skip + (chunk > 0), []
        while True:
            part = bytes(stream.readNBytes(STEP_BYTES))
            lines = part.count(b"\n")
            if left > lines:
                if len(part) < STEP_BYTES:
                    return None
                left -= lines
                continue
            # The line begins in this step.
            begin = 0
            for _ in range(left):
                begin = part.index(b"\n", begin) + 1
            while (end := part.find(b"\n", begin)) < 0 and len(part) == STEP_BYTES:
                held.append(part[begin:])
                part, begin = bytes(stream.readNBytes(STEP_BYTES)), 0
            line = b"".join(held) + (part[begin:] if end < 0 else part[begin:end])
            # What follows the last line break is no line.
            return line.decode("utf-8", "replace").removesuffix("\r") if line or end >= 0 else None
    finally:
        stream.close()


def indexed_lines(spark: SparkSession, wanted: list[tuple[str, int]], path: str) -> DataFrame:
    """(source, line_no, line) of the wanted lines that exist, as many as the caller listed.

    Reads the index rows of their files, and of each file from the split that holds a line up to this line.
    More than SEEKS lines come from one scan of their files by all executors instead.
    """
    if not is_there(spark, path):
        raise FileNotFoundError(path)
    wanted = sorted(set(wanted))
    asked = spark.createDataFrame(wanted, "source string, line_no bigint")
    names = sorted({s for s, _ in wanted})
    index = spark.read.schema(_SCHEMA).parquet(path).filter(F.col("source").isin(names))
    known = {r["source"]: (r["size"], r["changed"]) for r in index.select("source", "size", "changed").distinct().collect()}
    missing = sorted(set(names) - set(known))
    if missing:
        raise ValueError(f"not in the index: {', '.join(missing)}")
    for source in names:
        at, files = _file(spark, source)
        now = files.getFileStatus(at)
        if (now.getLen(), now.getModificationTime()) != known[source]:
            raise ValueError(f"{source} has changed since it was indexed")
    if len(wanted) > SEEKS:
        lines = read_lines(spark, [literal_path(s) for s in names])
        return lines.join(small_side(asked, len(wanted)), ["source", "line_no"], "left_semi").select("source", "line_no", "line")
    # The last split with fewer lines before it than the wanted number. Splits without a line of their own have as many as the next.
    near = index.join(F.broadcast(asked), "source").filter(F.col("lines_before") < F.col("line_no"))
    found = near.groupBy("source", "line_no").agg(F.max(F.struct("lines_before", "chunk")).alias("at")).collect()
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        lines = list(pool.map(lambda r: read_line(spark, r["source"], r["at"]["chunk"], r["line_no"] - r["at"]["lines_before"] - 1), found))
    rows = [(r["source"], r["line_no"], line) for r, line in zip(found, lines, strict=True) if line is not None]
    return spark.createDataFrame(rows, "source string, line_no bigint, line string")
