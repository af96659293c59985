"""The main query: scan, parse, filter, newest first, cut, number, add context."""

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logloom.fixed import QUERY_LIMIT
from logloom.functions.times import time_argument
from logloom.operators.context import with_context
from logloom.operators.filters import grep, time_range
from logloom.operators.ranking import newest
from logloom.parsers.rows import to_entries
from logloom.session import cut_lineage
from logloom.sources.address import LogSource


def _range(start, end, now):
    """Both ends resolved against one ``now``; a range must start before it ends."""
    start, end = (v if v is None or isinstance(v, Column) else time_argument(v, now) for v in (start, end))
    if isinstance(start, datetime) and isinstance(end, datetime) and not start < end:
        raise ValueError("start time must be before end time")
    return start, end


def _search(rows: DataFrame, start, end, pattern, keep_null) -> DataFrame:
    return grep(time_range(rows, start, end, keep_null), pattern)


def query_logs(
    source: LogSource | DataFrame, start=None, end=None, pattern: str | None = None,
    limit: int | None = QUERY_LIMIT, before: int = 0, after: int = 0, keep_null: bool = True,
    now: datetime | None = None,
) -> DataFrame:
    """Entries in a time range whose message matches, newest first.

    Times are columns, datetimes, or text such as ``2h`` (before ``now``).

    On text with a limit, all files are read once: scanned, parsed, filtered and cut in
    one stage. What is left names at most ``limit`` files; the search is done again on
    these, and only they are numbered and read for context lines.
    """
    start, end = _range(start, end, now or datetime.now(timezone.utc))
    limited = limit is not None and limit > 0
    bound = limit if limited else None
    if isinstance(source, DataFrame) or source.scan is None:
        entries = source if isinstance(source, DataFrame) else source.table
        return newest(_search(entries, start, end, pattern, keep_null), limit)
    parts = source.parts()
    if not limited:
        # Every match is asked for: all files are numbered.
        found = [to_entries(scan.number(_search(source.read(scan, fmt), start, end, pattern, keep_null))) for scan, fmt in parts]
        result = newest(reduce(DataFrame.unionByName, found), limit)
        return newest(with_context(result, source.lines(), before, after), limit) if before > 0 or after > 0 else result
    found, files = [], []
    for scan, fmt in parts:
        search = lambda s, fmt=fmt: newest(_search(source.read(s, fmt), start, end, pattern, keep_null), limit)
        # At most ``limit`` rows are left, and so are their files.
        own = [r["source"] for r in search(scan).select("source").distinct().collect()]
        if own:
            files += own
            # Again on these files only, where the numbering pass is as small.
            few = scan.only(own)
            found.append(to_entries(few.number(search(few), bound)))
    none = to_entries(source.scan.unnumbered(source.read(*parts[0]))).limit(0)
    result = newest(reduce(DataFrame.unionByName, found), limit) if found else none
    if before <= 0 and after <= 0:
        return result
    lines = source.scan.only(files).numbered() if files else source.lines().limit(0)
    return newest(with_context(cut_lineage(result), lines, before, after, bound), limit)


def ingest(source: LogSource, path: str, mode: str = "error") -> None:
    """Parse once, keep as a table by day: later queries prune days and columns.

    Rows are rebalanced by day: small days share a file, a day that holds much of
    the table is split over as many as it needs.
    """
    by_day = source.entries().withColumn("day", F.to_date("timestamp"))
    by_day.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)
