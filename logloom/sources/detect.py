"""S3: which format a source is in."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logloom.fixed import DETECT_LINES, JAVA_LEVEL_WORD, MONTHS
from logloom.parsers.json import BLANKS, trimmed

# A file's beginning is read in steps of so many bytes.
HEAD_BYTES, LINE_BYTES = 1 << 16, 1 << 20
FILES_AT_ONCE, FILES_TOLD = 32, 10_000


def line_format(line: Column) -> Column:
    """Format a trimmed line speaks for, or NULL."""
    long_enough = F.length(line) >= 15
    status = line.rlike(r"(?s)^..:..:..[,.].*\|-") & (F.length(line) >= 20)
    dated = line.rlike(r"(?s)^(?:.{4}-.{2}-|.{2}/.{2}/)")
    java = long_enough & (status | (dated & F.upper(line).rlike(JAVA_LEVEL_WORD)))
    syslog = long_enough & (line.rlike(r"(?s)^<[^>]{0,3}>") | line.rlike(f"^(?:{'|'.join(MONTHS)}) "))
    return F.when(line.startswith("{"), F.lit("json")).when(java, F.lit("java")).when(syslog, F.lit("syslog"))


def detect_format(lines: DataFrame) -> DataFrame:
    """(source, format) from the first ten non-blank lines of every source.

    Ranking keeps ten rows per source in each task before anything is exchanged, and no line is.
    """
    told = lines.select("source", F.col("line_no").alias("place"), trimmed(F.col("line")).alias("line"))
    written = told.select("source", "place", F.when(F.col("line") != "", F.struct(line_format(F.col("line")).alias("fmt"))).alias("seen"))
    order = Window.partitionBy("source").orderBy(F.col("seen").isNull(), "place")
    first = written.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= DETECT_LINES)
    hit = F.min(F.when(F.col("seen.fmt").isNotNull(), F.struct("rank", "seen.fmt")))["fmt"]
    return first.groupBy("source").agg(F.coalesce(hit, F.lit("plain")).alias("format"))


def first_lines(spark: SparkSession, path: str) -> list[str]:
    """The first lines of a file that have text, ten at most, read step by step; compressed files as Spark reads them.

    A line of more than LINE_BYTES is taken by its beginning and is the last that is looked at.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(path))
    stream = at.getFileSystem(conf).open(at)
    lines: list[str] = []
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        stream = stream if codec is None else codec.createInputStream(stream)
        begun, ended = bytearray(), False
        while len(lines) < DETECT_LINES and not ended:
            part = bytes(stream.readNBytes(HEAD_BYTES))
            first, *more = part.split(b"\n")
            begun += first
            ended = len(part) < HEAD_BYTES or len(begun) > LINE_BYTES
            # The last piece may go on in the next step.
            whole = [bytes(begun), *more] if more or ended else []
            begun = begun if not whole else bytearray() if ended else bytearray(whole.pop())
            texts = (line[:LINE_BYTES].decode("utf-8", "replace").strip(BLANKS) for line in whole)
            lines += [t for t in texts if t]
    finally:
        stream.close()
    return lines[:DETECT_LINES]


def formats_by_file(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The format of each file (URIs), told by its first lines; nothing beyond them is read.

    Files are opened side by side from here, FILES_AT_ONCE of them, as they are when they are
    listed: that takes less than planning a task for each would. Lines of FILES_TOLD files are held at a time.
    """
    told = {}
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        for k in range(0, len(files), FILES_TOLD):
            some = files[k : k + FILES_TOLD]
            heads = pool.map(lambda f: first_lines(spark, f), some)
            rows = [(f, i, line) for f, lines in zip(some, heads, strict=True) for i, line in enumerate(lines)]
            lines = spark.createDataFrame(rows, "source string, line_no bigint, line string")
            told |= {r["source"]: r["format"] for r in detect_format(lines).collect()}
    return told


def detect_first(rows: DataFrame) -> str:
    """Format of one file, read only as far as ten non-blank lines."""
    sample = rows.select(trimmed(F.col("line")).alias("line")).filter(F.col("line") != "").limit(DETECT_LINES)
    for row in sample.select(line_format(F.col("line")).alias("fmt")).collect():
        if row["fmt"] is not None:
            return row["fmt"]
    return "plain"
