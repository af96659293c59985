"""Streams: the same answers as the batch operators, state, timers, watches."""

import os
import random
import time
from datetime import datetime as ts, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators.aggregates import count_by_bucket
from logloom.parsers.java import is_header
from logloom.session import fresh_folder
from logloom.streaming import tail as T
from logloom.streaming.buckets import BucketTotals, watch_counts
from logloom.streaming.multiline import OpenEntries, tail_multiline
from logloom.streaming.seen import dedup_newest

NOW = {"availableNow": True}
T0 = ts(2025, 1, 15, 10, 0)


@pytest.fixture
def stream(spark, tmp_path):
    """Batches of rows as a stream, one file a batch."""

    def make(batches, schema):
        for i, rows in enumerate(batches):
            folder = tmp_path / "arriving"
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            time.sleep(0.05)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "arriving"))

    return make


EVENT = "timestamp timestamp, message string, stream string"


def run(spark, events):
    out = fresh_folder(spark, "out")
    T.write_stream(events, out).awaitTermination()
    return spark.read.schema(events.schema).parquet(out)


def test_dedup_keeps_one_of_each(spark, stream):
    same, later = (T0, "m", "s"), (T0 + timedelta(milliseconds=1), "m", "s")
    source = stream([[same, same], [later, same], [(None, "n", "s"), (None, "n", "s")]], EVENT)
    got = run(spark, T.dedup_stream(source))
    assert sorted(str(r["timestamp"]) for r in got.collect()) == ["2025-01-15 10:00:00", "2025-01-15 10:00:00.001000", "None"]


def test_dedup_loses_no_late_event(spark, stream):
    source = stream([[(T0 + timedelta(days=30), "new", "s")], [(T0, "old", "s")], [(T0, "old", "s")]], EVENT)
    assert sorted(r["message"] for r in run(spark, T.dedup_stream(source, ("stream", "timestamp"))).collect()) == ["new", "old"]


def test_tail_filter_and_lookback(spark, stream):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(at(-10), "error: early", "s"), (at(-4), "Error: problem", "s"), (at(1), "info: all good", "s"), (None, "error: untimed", "s")]
    got = run(spark, T.tail_filter(stream([rows], EVENT), "error", "2025-01-15T10:00:00Z"))
    assert sorted(r["message"] for r in got.collect()) == ["Error: problem", "error: untimed"]


def test_tail_text_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text('{"ts":1705315845,"msg":"error: problem"}\nnoise\n{"msg":"info"}\n')
    rows = run(spark, T.tail_logs(spark, str(tmp_path / "logs"), "json", "error").select("timestamp", "message", "stream")).collect()
    assert [(r["timestamp"], r["message"], r["stream"]) for r in rows] == [(ts(2024, 1, 15, 10, 50, 45), "error: problem", "a.log")]
    with pytest.raises(ValueError):
        T.tail_logs(spark, str(tmp_path / "logs"), "java")


def test_follow_from_a_moment_on(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for name, age in (("old", 3600), ("at", 600), ("new", 10)):
        (tmp_path / "logs" / f"{name}.log").write_text(f"2025-01-15 10:30:45 {name}\n")
        moment = 1_760_000_000 - age
        os.utime(tmp_path / "logs" / f"{name}.log", (moment, moment))
    seen = lambda since: sorted(r["message"] for r in run(spark, T.tail_logs(spark, str(tmp_path / "logs"), since=since).select("message")).collect())
    assert seen(None) == ["at", "new", "old"]
    # A file changed at the moment itself was there before.
    assert seen(ts.fromtimestamp(1_760_000_000 - 600)) == ["new"]
    assert seen(ts.fromtimestamp(1_760_000_000)) == []


def test_counts_equal_the_batch_counts(spark, stream):
    batches = [[(T0 + timedelta(seconds=i * 97 % 1500), f"m{i}", "s") for i in range(b, 60, 3)] for b in range(3)]
    source = stream(batches, EVENT)
    out = fresh_folder(spark, "counts")
    T.keep_updates(T.tail_counts(source, delay="1 day"), out, fresh_folder(spark, "cp"), NOW).awaitTermination()
    got = T.latest_counts(spark.read.option("basePath", out).parquet(out)).collect()
    table = spark.createDataFrame([r for b in batches for r in b], EVENT)
    assert got == count_by_bucket(table).collect()


LINES = "source string, line_no bigint, line string"


def test_multiline_over_batches(spark, stream):
    head = "2025-01-15 10:30:45 INFO x"
    source = stream(
        [[("a", 2, "\tat y"), ("a", 1, head), ("b", 1, ""), ("b", 2, "opening")], [("a", 3, ""), ("a", 4, head)], [("a", 5, head), ("b", 3, "more"), ("b", 4, head)]],
        LINES,
    )
    got = {}
    joined = tail_multiline(source, is_header(F.col("line")), lambda rows, n: got.update({n: rows.collect()}), fresh_folder(spark, "at"))
    joined.query.awaitTermination()
    before = sorted(tuple(r) for rows in got.values() for r in rows)
    assert before == [("a", 1, head + "\n\tat y\n"), ("a", 4, head), ("b", 2, "opening\nmore")]
    joined.flush()
    joined.flush()
    assert sorted(tuple(r) for rows in got.values() for r in rows) == sorted(before + [("a", 5, head), ("b", 4, head)])


HEAD = "2025-01-15 10:30:45 INFO x"


class Arrivals:
    """Files of lines that arrive between the runs of a stream, each run a new start from the checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.got, self.at = spark, str(folder / "arriving"), {}, fresh_folder(spark, "at")

    def arrive(self, rows):
        self.spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(self.folder)
        time.sleep(0.05)

    def keep(self, rows, n):
        self.got[n] = [tuple(r) for r in rows.collect()]

    def run(self):
        source = self.spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(self.folder)
        joined = tail_multiline(source, is_header(F.col("line")), self.keep, self.at)
        joined.query.awaitTermination()
        return joined

    def all(self):
        return sorted(r for rows in self.got.values() for r in rows)


def test_multiline_goes_on_after_a_restart(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    a.arrive([("a", 1, HEAD), ("a", 2, "\tone"), ("b", 1, HEAD)])
    a.run()
    # Stopped between batches; the next start knows what was open.
    a.arrive([("a", 3, ""), ("b", 2, HEAD + " two")])
    a.arrive([("a", 4, "\ttwo")])
    a.run()
    assert a.all() == [("b", 1, HEAD)]
    a.arrive([("a", 5, HEAD + " new")])
    # Stopped at the end: started again without new files, then flushed.
    a.run()
    ended = a.run()
    ended.flush()
    ended.flush()
    want = [("a", 1, HEAD + "\n\tone\n\n\ttwo"), ("a", 5, HEAD + " new"), ("b", 1, HEAD), ("b", 2, HEAD + " two")]
    assert a.all() == want
    # What was flushed is closed: it neither comes again nor takes further lines.
    a.run().flush()
    assert a.all() == want
    a.arrive([("a", 6, "\tlate"), ("c", 1, HEAD)])
    a.run().flush()
    assert a.all() == sorted(want + [("a", 6, "\tlate"), ("c", 1, HEAD)])


def test_a_batch_that_is_run_again_gives_the_same(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    a.arrive([("a", 1, HEAD), ("a", 2, "one")])
    a.arrive([("a", 3, "two")])
    a.run()
    a.arrive([("a", 4, "three"), ("a", 5, HEAD + " new")])
    fail, keep = {"now": True}, a.keep

    def failing(rows, n):
        keep(rows, n)
        if fail["now"]:
            raise RuntimeError("the sink has failed")

    a.keep = failing
    with pytest.raises(Exception, match="the sink has failed"):
        a.run()
    fail["now"] = False
    a.run().flush()
    assert a.all() == [("a", 1, HEAD + "\none\ntwo\nthree"), ("a", 5, HEAD + " new")]


def test_an_open_entry_is_written_once(spark, tmp_path):
    """A long entry that grows over many batches: bytes of its pieces are those of its text, and go with it."""
    a, lines = Arrivals(spark, tmp_path), 40_000
    for k in range(6):
        rows = spark.range(k * lines + 1, (k + 1) * lines + 1).select(F.lit("a").alias("source"), F.col("id").alias("line_no"), F.when(F.col("id") == 1, HEAD).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("line"))
        rows.coalesce(1).write.mode("append").parquet(a.folder)
        time.sleep(0.05)
    a.run()
    pieces = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{a.at}/pieces") for f in names if f.endswith(".parquet")]
    assert sum(pieces) < 1.3 * 6 * lines * 65
    a.arrive([("a", 6 * lines + 1, HEAD)])
    a.run()
    (source, first, message), = a.all()
    assert (source, first, message.count("\n")) == ("a", 1, 6 * lines - 1)
    a.arrive([("a", 6 * lines + 2, HEAD)])
    a.arrive([("a", 6 * lines + 3, HEAD)])
    a.run()
    left = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{a.at}/pieces") for f in names if f.endswith(".parquet")]
    assert sum(left) < 100_000


def test_multiline_gives_out_a_quiet_entry(spark, stream):
    source = stream([[("a", 1, "2025-01-15 10:30:45 INFO x"), ("a", 2, "\tat y")]], LINES)
    got = []
    joined = tail_multiline(
        source, is_header(F.col("line")), lambda rows, n: got.extend(r["message"] for r in rows.collect()), fresh_folder(spark, "at"),
        trigger={"processingTime": "200 milliseconds"}, quiet="1 second", ticks=T.every(spark),
    )
    try:
        deadline = time.time() + 60
        while not got and time.time() < deadline:
            time.sleep(0.5)
    finally:
        joined.query.stop()
    assert got == ["2025-01-15 10:30:45 INFO x\n\tat y"]


def test_whole_files_are_numbered_and_joined(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("2025-01-15 10:30:45 INFO x\n\tat y\n15:00:00,000 |-WARN in z\n")
    found = []
    T.tail_files(spark, str(tmp_path / "logs"), lambda df, _: found.extend(df.collect()), fresh_folder(spark, "cp"), "java", None, NOW).awaitTermination()
    assert sorted((r["line_no"], r["message"], str(r["timestamp"])) for r in found) == [(1, "x\n\tat y", "2025-01-15 10:30:45"), (3, "z", "2025-01-15 15:00:00")]


def test_watch_asks_again_with_a_new_time(spark, stream):
    times, seen, stored = iter([T0, T0 + timedelta(hours=1)]), [], fresh_folder(spark, "stored")
    source = stream([[(T0, "a", "s")], [(T0 + timedelta(hours=1), "b", "s")]], EVENT)

    def last_minute(now):
        table = spark.read.schema(EVENT).parquet(stored)
        return table.filter(F.col("timestamp") >= F.lit(now - timedelta(minutes=1)))

    T.watch(
        source, last_minute, lambda df, _: seen.append([r["message"] for r in df.collect()]), fresh_folder(spark, "cp"), NOW,
        lambda: next(times), lambda batch, i: batch.write.mode("overwrite").parquet(f"{stored}/batch={i}"),
    ).awaitTermination()
    assert seen == [["a"], ["b"]]


class Remembered:
    """The last ``capacity`` keys in the order in which they first came, by loops."""

    def __init__(self, capacity):
        self.capacity, self.keys = capacity, []

    def is_new(self, key):
        if key in self.keys:
            return False
        self.keys = [*self.keys, key][-self.capacity :]
        return True


@pytest.mark.parametrize("capacity", [1, 5, 40])
def test_dedup_by_number_of_keys_is_a_replay(spark, stream, capacity):
    random.seed(capacity)
    batches = [[(T0 + timedelta(seconds=random.randrange(6)), random.choice(["a", "b", None]), "s") for _ in range(60)] for _ in range(3)]
    got = run(spark, dedup_newest(stream(batches, EVENT), capacity=capacity)).collect()
    memory = Remembered(capacity)
    want = [r for b in batches for r in b if memory.is_new(r[:2])]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert len(want) > 18 or capacity == 40


def test_dedup_over_parts_drops_no_new_key(spark, stream):
    batches = [[(T0, f"m{i % 50}", "s") for i in range(k, 100 + k)] for k in range(2)]
    got = run(spark, dedup_newest(stream(batches, EVENT), capacity=1000, parts=7)).collect()
    assert sorted(r["message"] for r in got) == sorted(f"m{i}" for i in range(50))


def test_bucket_totals_follow_the_batches(spark, stream):
    days = lambda d, s=0: T0 + timedelta(days=d, seconds=s)
    batches = [[(days(0), "error a", "s"), (days(1), "error b", "s"), (None, "error", "s")], [(days(1, 1), "error c", "s"), (days(2), "fine", "s")], [(days(0, 299), "late error", "s")]]
    path, at, seen, fail = fresh_folder(spark, "totals"), fresh_folder(spark, "cp"), {}, {"now": True}

    def sink(rows, n):
        seen[n] = sorted((r["time_bucket"], r["count"]) for r in rows.collect())
        if n == 1 and fail.pop("now", False):
            raise RuntimeError("the sink has failed")

    source = stream(batches, EVENT)
    with pytest.raises(Exception, match="the sink has failed"):
        watch_counts(source, sink, path, at, pattern="error", trigger=NOW).awaitTermination()
    totals = BucketTotals(spark, path)
    # The failed batch does not count yet; run again it counts once.
    assert totals.last() == 0 and sorted(r["count"] for r in totals.totals().collect()) == [1, 1]
    watch_counts(source, sink, path, at, pattern="error", trigger=NOW).awaitTermination()
    assert seen == {0: [(days(0), 1), (days(1), 1)], 1: [(days(1), 2)], 2: [(days(0), 2)]}
    assert sorted((r["time_bucket"], r["count"]) for r in totals.totals().collect()) == [(days(0), 2), (days(1), 2)]
    assert BucketTotals(spark, fresh_folder(spark, "none")).totals().collect() == []
    # What is written for a tick is the parts it touched, and old versions go.
    parts = {d: sorted(os.listdir(f"{path}/parts/{d}")) for d in os.listdir(f"{path}/parts") if d.startswith("part=")}
    assert sorted(map(len, parts.values())) == [2, 2]


def test_a_tick_reads_the_new_rows_only(spark, stream):
    batches = [[(T0 + timedelta(seconds=i), "m", "s") for i in range(200)], [(T0 + timedelta(seconds=i), "m", "s") for i in range(7)]]
    query = watch_counts(stream(batches, EVENT), lambda rows, n: rows.collect(), fresh_folder(spark, "totals"), fresh_folder(spark, "cp"), trigger=NOW)
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    # foreachBatch counts the rows of each of its reads: one.
    assert read == [200, 7]


def test_entries_of_one_batch_are_not_gathered(spark, tmp_path):
    state = OpenEntries(spark, str(tmp_path))
    kinds = "source string, line_no bigint, since bigint, text string"
    own = state.whole(spark.createDataFrame([("s", 1, 3, "a\nb"), ("t", 1, 3, "c")], kinds), 3)
    assert "Aggregate" not in own._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, own.collect())) == [("s", 1, "a\nb"), ("t", 1, "c")]
    for batch, text in ((1, "first"), (2, "second")):
        state.add(spark.createDataFrame([("s", 1, text), ("u", 1, "other")], "source string, line_no bigint, text string"), batch)
    ended = spark.createDataFrame([("s", 1, 1, "third"), ("s", 9, 3, "new"), ("u", 1, 1, None)], kinds)
    assert sorted(map(tuple, state.whole(ended, 3).collect())) == [("s", 1, "first\nsecond\nthird"), ("s", 9, "new"), ("u", 1, "other\nother")]
