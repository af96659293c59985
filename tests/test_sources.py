"""Files: line numbers over splits, lists, addresses, queries with context."""

import gzip
import os
from datetime import datetime as ts

import pytest
from pyspark.sql import functions as F

from logloom.operators.lookup import get_lines
from logloom.plans.query import ingest, query_logs
from logloom.sources import detect, lineindex
from logloom.sources.address import OPENERS, LogSource, open_ptr, open_source, register_source
from logloom.sources.lines import LineScan, existing_paths, file_streams, path_label, read_lines


@pytest.fixture
def small_splits(spark):
    """Splits of 4 KiB, so that small files have many."""
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1024"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, text):
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)
    return str(path)


def numbered(df):
    return [(r["source"].rsplit("/", 1)[-1], r["line_no"], r["line"]) for r in df.orderBy("source", "line_no").collect()]


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    want = []
    for name in ("a.log", "b b.log", "c+%.log"):
        rows = [f"{name} {i} " + "x" * (i * 37 % 400) for i in range(1, 200)]
        write(tmp_path / name, "\r\n".join(rows) + "\n")
        want += [(name, i, row) for i, row in enumerate(rows, 1)]
    lines = read_lines(spark, str(tmp_path / "*.log"))
    assert LineScan(spark, str(tmp_path / "*.log")).raw.rdd.getNumPartitions() > 8
    assert numbered(lines) == want


def test_line_numbers_without_broadcast(spark, tmp_path, small_splits, monkeypatch):
    write(tmp_path / "a.log", "\n".join(f"line {i} " + "y" * 50 for i in range(1, 500)))
    monkeypatch.setattr(LineScan, "split_bound", lambda self: 10**9)
    got = numbered(read_lines(spark, str(tmp_path / "a.log")))
    assert [(n, line.split()[1]) for _, n, line in got] == [(i, str(i)) for i in range(1, 500)]


def test_split_bound_holds(spark, tmp_path, small_splits):
    for i in range(5):
        write(tmp_path / f"{i}.log", "z" * 99 + "\n" + "line\n" * 3000)
    scan = LineScan(spark, str(tmp_path))
    assert scan.split_bound() >= scan.identified.select("file", "chunk").distinct().count()


def test_empty_lines_and_missing_end(spark, tmp_path):
    assert numbered(read_lines(spark, write(tmp_path / "a", "\na\n\nb"))) == [("a", 1, ""), ("a", 2, "a"), ("a", 3, ""), ("a", 4, "b")]


def test_compressed_file(spark, tmp_path):
    write(tmp_path / "a.log.gz", gzip.compress(b"one\ntwo\n"))
    assert [n for _, n, _ in numbered(read_lines(spark, str(tmp_path / "a.log.gz")))] == [1, 2]


def test_long_lines_are_never_left_out(spark, tmp_path):
    path = write(tmp_path / "a", "short\n" + "x" * 100 + "\nend")
    assert len(numbered(read_lines(spark, path, max_line_bytes=100))) == 3
    with pytest.raises(Exception, match="a line of more than 50 bytes"):
        numbered(read_lines(spark, path, max_line_bytes=50))


def test_file_lists(spark, tmp_path):
    a, b, gone = write(tmp_path / "a", "1"), write(tmp_path / "b", "2"), str(tmp_path / "gone")
    assert existing_paths(spark, [b, gone, a]) == [a, b]
    assert len(numbered(read_lines(spark, [b, gone, a], skip_missing=True))) == 2
    assert path_label([b, a, "/z"]) == f"{min(a, '/z')} (+2 more)" and path_label([a]) == a
    for paths in ([gone], []):
        with pytest.raises((FileNotFoundError, ValueError)):
            read_lines(spark, paths, skip_missing=True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_lines(spark, gone)


def test_addresses(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "app.log", '{"message": "m"}\n')
    monkeypatch.chdir(tmp_path)
    for address in (path, f"file://{path}", "app.log", "./app.log", f"{path}?format=JSON", "@app", "@full"):
        source = open_source(spark, address, {"app": path, "full": {"uri": path, "format": "json"}})
        assert [r["message"] for r in source.entries().collect()] == ["m"], address
    assert open_source(spark, f"{path}?format=plain").entries().first()["message"] == '{"message": "m"}'
    assert open_source(spark, [path, "/gone"]).metadata()["uri"] == path
    for bad, error in (("file:///x@format=json", "come after"), ("///x", "no scheme"), ("ftp://x", "unknown source scheme")):
        with pytest.raises(ValueError, match=error):
            open_source(spark, bad)
    with pytest.raises(KeyError, match="app"):
        open_source(spark, "@other", {"app": path})


@pytest.mark.parametrize("name", ["a b.log", "a[1].log", "{x,y}.log", "50%.log", "a*.log", "q?.log"])
def test_odd_file_names(spark, tmp_path, name):
    path = write(tmp_path / name, '{"message":"one"}\n{"message":"two"}\n')
    source = open_source(spark, f"{tmp_path}/*")
    (row,) = query_logs(source, pattern="two", before=1).collect()
    assert (row["source"], row["line_no"], row["context"]["before"][0]["message"]) == (path, 2, '{"message":"one"}')
    if "?" not in name:  # a pointer is an address, where '?' begins its parameters
        assert get_lines(spark, [row["ptr"]], "json").first()["message"] == "two"
        assert open_ptr(spark, row["ptr"]).entries().count() == 2


def test_own_source(spark):
    table = spark.sql("SELECT timestamp '2025-01-01 00:00:00' AS timestamp, 'm' AS message, 's' AS stream, 'x' AS source, 1L AS line_no, 'p' AS ptr")
    register_source("mine", lambda spark, uri, **_: LogSource("mine", uri, table=table))
    try:
        assert query_logs(open_source(spark, "mine://x")).count() == 1
    finally:
        del OPENERS["mine"]


def test_open_by_pointer(spark, tmp_path):
    path = write(tmp_path / "app.log", "a\nb")
    assert open_ptr(spark, f"file://{path}#2").entries().count() == 2
    assert open_ptr(spark, "opaque", {"uri": path}).entries().count() == 2
    for bad in ("opaque", "http://x", "file://#3", ""):
        with pytest.raises(ValueError):
            open_ptr(spark, bad)


def test_filter_and_limit(spark, tmp_path):
    source = open_source(spark, write(tmp_path / "a.log", "line 1\nline 2 contains error\nline 3\n"))
    assert query_logs(source).count() == 3
    assert [r["message"] for r in query_logs(source, pattern="ERROR").collect()] == ["line 2 contains error"]
    assert query_logs(source, limit=2).count() == 2
    assert query_logs(source, limit=0).count() == 3


def test_json_range_and_order(spark, tmp_path):
    rows = [("10:30", "first", "info"), ("10:31", "second", "warn"), ("10:32", "third", "error")]
    text = "\n".join('{"timestamp":"2025-01-15T%s:00Z","message":"%s event","level":"%s"}' % r for r in rows)
    source = open_source(spark, write(tmp_path / "a.log", text))
    found = query_logs(source).collect()
    assert [r["message"] for r in found] == ["third event", "second event", "first event"]
    assert found[0]["fields"] == {"level": "error"} and found[0]["ptr"].endswith("a.log#3")
    found = query_logs(source, "2025-01-15T10:30:30Z", "2025-01-15T10:31:30Z").collect()
    assert [r["message"] for r in found] == ["second event"]


def test_relative_range(spark, tmp_path):
    source = open_source(spark, write(tmp_path / "a.log", "2025-01-15 10:00:00 a\n2025-01-15 11:30:00 b\nuntimed\n"))
    assert [r["message"] for r in query_logs(source, "1h", "now", now=ts(2025, 1, 15, 12)).collect()] == ["b", "untimed"]
    with pytest.raises(ValueError, match="before end"):
        query_logs(source, "1h", "2h")


def test_limited_query_numbers_like_full_query(spark, tmp_path, small_splits):
    for name in "ab":
        text = "".join(f"2025-01-15 10:{i // 60 % 60:02d}:{i % 60:02d} {name} {i}\n" for i in range(1, 900))
        write(tmp_path / f"{name}.log", text)
    source = open_source(spark, str(tmp_path / "*.log"))
    whole = {r["ptr"]: r["message"] for r in source.entries().collect()}
    found = query_logs(source, limit=300).collect()
    assert len(found) == 300 and all(whole[r["ptr"]] == r["message"] for r in found)
    assert all(r["message"].endswith(f" {r['line_no']}") for r in found)


CONTEXT = [(4, 2, 2, [2, 3], [5, 6]), (1, 2, 2, [], [2, 3]), (7, 2, 2, [5, 6], []), (4, 0, 1, [], [5]), (4, 1, 0, [3], [])]


@pytest.mark.parametrize("line, before, after, want_before, want_after", CONTEXT)
def test_context(spark, tmp_path, line, before, after, want_before, want_after):
    source = open_source(spark, write(tmp_path / "a.log", "\n".join(f"line {i}" for i in range(1, 8))))
    (row,) = query_logs(source, pattern=f"line {line}$", before=before, after=after).collect()
    assert [e["message"] for e in row["context"]["before"]] == [f"line {i}" for i in want_before]
    assert [e["message"] for e in row["context"]["after"]] == [f"line {i}" for i in want_after]
    assert all(e["timestamp"] is None and e["stream"] == "a.log" for e in row["context"]["before"] + row["context"]["after"])


def test_context_of_no_match(spark, tmp_path):
    source = open_source(spark, write(tmp_path / "a.log", "x\n"))
    assert query_logs(source, pattern="nothing", before=1).collect() == []


def test_get_lines(spark, tmp_path):
    path = write(tmp_path / "app.log", "line 1\nline 2\n\n2025-01-15 10:30:45 x")
    rows = {r["line_no"]: r for r in get_lines(spark, [f"file://{path}#{n}" for n in (2, 3, 4, 100)]).collect()}
    assert sorted(rows) == [2, 3, 4]
    assert (rows[2]["message"], rows[3]["message"], rows[4]["message"]) == ("line 2", "", "x")
    assert rows[4]["timestamp"] == ts(2025, 1, 15, 10, 30, 45) and rows[4]["raw"] == "2025-01-15 10:30:45 x"
    with pytest.raises(ValueError, match="not-a-valid-pointer"):
        get_lines(spark, ["not-a-valid-pointer"])


def test_formats_by_file(spark, tmp_path):
    write(tmp_path / "a.log", '{"message":"j"}\n')
    write(tmp_path / "b.log", "2025-01-15 10:30:45 INFO t\n\tat x\n")
    write(tmp_path / "c.log", "plain\n")
    write(tmp_path / "d.log", "\n" * 30 + '{"message":"late"}\n')
    write(tmp_path / "e.log", "")
    want = ["j", "late", "plain", "t\n\tat x"]
    source = open_source(spark, str(tmp_path / "*.log"))
    assert sorted(r["message"] for r in source.entries().collect()) == want
    free = source.entries(numbered=False).collect()
    assert sorted(r["message"] for r in free) == want and {r["line_no"] for r in free} == {None}
    assert sorted(r["message"] for r in query_logs(source, limit=5).collect()) == want
    assert query_logs(source, limit=1, pattern="plain", before=1).first()["context"]["before"] == []
    assert query_logs(source, limit=5, pattern="nowhere", before=1).collect() == []
    assert open_source(spark, str(tmp_path / "*.log"), scope="first").entries().count() == 2  # the first file's format for all


def test_format_beyond_a_blank_split(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        write(tmp_path / "a.log", "\n" * 300 + '{"message":"late"}\n')
        write(tmp_path / "b.log", "text\n" * 50)
        found = query_logs(open_source(spark, str(tmp_path / "*.log")), limit=500)
        assert sorted((r["message"], r["line_no"]) for r in found.collect())[0] == ("late", 301)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_streams(spark, tmp_path):
    path = write(tmp_path / "a.log", "12345")
    (row,) = file_streams(spark, path).collect()
    assert (row["name"], row["size"], row["first_time"]) == (path, 5, None) and row["last_time"] is not None


def test_ingest_keeps_a_table_by_day(spark, tmp_path):
    text = "2025-01-15 10:00:00 a\n2025-01-16 10:00:00 b\nno time\n"
    ingest(open_source(spark, write(tmp_path / "a.log", text)), str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(str(r["day"]) for r in table.select("day").collect()) == ["2025-01-15", "2025-01-16", "None"]
    stored = open_source(spark, f"parquet://{tmp_path}/table")
    assert [r["message"] for r in query_logs(stored, start="2025-01-16T00:00:00Z", keep_null=False).collect()] == ["b"]


def bytes_read(spark):
    return spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file").getLong("bytesRead")


def test_detection_reads_the_first_lines_only(spark, tmp_path):
    with open(tmp_path / "long.log", "w") as f:
        f.writelines(f"2025-01-15 10:30:45,123 INFO line {i} of a long file\n" for i in range(400_000))
    (tmp_path / "late.log").write_text("\n  \n\t\n" * 100 + '{"message": "after blank lines"}\n')
    (tmp_path / "eleventh.log").write_text("note\n\n" * 10 + '{"message": "one line too late"}\n')
    (tmp_path / "tenth.log").write_text("note\n\n" * 9 + '{"message": "the last that counts"}\n')
    (tmp_path / "blank.log").write_text("\n \n")
    (tmp_path / "empty.log").write_text("")
    size = os.path.getsize(tmp_path / "long.log")
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 9))
    try:
        source = open_source(spark, str(tmp_path / "*.log"))
        before = bytes_read(spark)
        parts = source.parts()
        read = bytes_read(spark) - before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    told = {os.path.basename(p): fmt for scan, fmt in parts for p in scan.paths}
    assert told == {"long.log": "java", "late.log": "json", "eleventh.log": "plain", "tenth.log": "json", "blank.log": "plain", "empty.log": "plain"}
    assert read < size // 9


@pytest.mark.parametrize("step", [1, 3, 64])
def test_first_lines_step_by_step(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(detect, "HEAD_BYTES", step)
    monkeypatch.setattr(detect, "LINE_BYTES", 40)
    texts = ["", "\n", "a", "a\r\n\r\n b \n", "\u2003\n\u00e9\n\x1c\nx", "\n".join(map(str, range(30))), "ab\n" + "x" * 200 + "\nlater\n", "1\n\n" * 12]
    for text in texts:
        (tmp_path / "a.log").write_text(text, newline="")
        want = [line[:40].strip(detect.BLANKS) for line in text.split("\n")]
        long = next((i for i, line in enumerate(text.split("\n")) if len(line) > 40 + step), None)
        want = [t for t in (want if long is None else want[: long + 1]) if t][:10]
        assert detect.first_lines(spark, (tmp_path / "a.log").as_uri()) == want
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("one\n\ntwo\n")
    assert detect.first_lines(spark, (tmp_path / "b.log.gz").as_uri()) == ["one", "two"]


@pytest.mark.parametrize("split, step", [(64, 16), (1000, 1 << 18), (1 << 22, 50)])
def test_lines_are_found_by_their_index(spark, tmp_path, monkeypatch, split, step):
    monkeypatch.setattr(lineindex, "STEP_BYTES", step)
    lines = [("x" * (i * 7 % 40)) + f" line {i}" + ("\r" if i % 5 == 0 else "") for i in range(400)] + ["y" * 300, "", "", "é" * 60, "last"]
    (tmp_path / "a b.log").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.log").write_bytes("\n".join(lines[:90]).encode() + b"\n")
    (tmp_path / "empty.log").write_bytes(b"")
    with gzip.open(tmp_path / "c.log.gz", "wt", newline="") as f:
        f.write("\n".join(lines[:50]))
    index = str(tmp_path / "index")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lineindex.write_index(spark, str(tmp_path / "*.log*"), index, split)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    wanted = [(str(tmp_path / name), n) for name, count in (("a b.log", 405), ("b.log", 90), ("c.log.gz", 50)) for n in [*range(1, count + 1, 11), count - 1, count, count + 1, 9999]]
    got = {(r["source"], r["line_no"]): r["line"] for r in lineindex.indexed_lines(spark, wanted, index).collect()}
    sizes = {str(tmp_path / "a b.log"): 405, str(tmp_path / "b.log"): 90, str(tmp_path / "c.log.gz"): 50}
    assert got == {(s, n): lines[n - 1].removesuffix("\r") for s, n in wanted if n <= sizes[s]}
    ptrs = [f"file://{tmp_path}/b.log#{n}" for n in (1, 90, 91)]
    assert [r["raw"] for r in get_lines(spark, ptrs, index=index).orderBy("line_no").collect()] == [lines[0].removesuffix("\r"), lines[89]]
    with pytest.raises(ValueError, match="not in the index"):
        lineindex.indexed_lines(spark, [(str(tmp_path / "new.log"), 1)], index)
    (tmp_path / "b.log").write_bytes(b"other\n")
    with pytest.raises(ValueError, match="has changed"):
        lineindex.indexed_lines(spark, [(str(tmp_path / "b.log"), 1)], index)


@pytest.mark.parametrize("seeks", [0, 1000])
def test_many_lines_are_looked_up_by_a_scan(spark, tmp_path, monkeypatch, seeks):
    monkeypatch.setattr(lineindex, "SEEKS", seeks)
    if not seeks:
        monkeypatch.setattr(lineindex, "read_line", None)  # no line is read by the driver
    lines = [f"line {i} é" + ("\r" if i % 5 == 0 else "") for i in range(300)] + ["", "last"]
    (tmp_path / "a b{1}.log").write_bytes("\n".join(lines).encode() + b"\n\xff")
    with gzip.open(tmp_path / "c.log.gz", "wt", newline="") as f:
        f.write("\n".join(lines[:50]))
    (tmp_path / "other.log").write_text("other\n" * 300)
    index = str(tmp_path / "index")
    lineindex.write_index(spark, str(tmp_path / "*.log*"), index, 500)
    sizes = {str(tmp_path / "a b{1}.log"): lines + ["\ufffd"], str(tmp_path / "c.log.gz"): lines[:50]}
    wanted = [(s, n) for s in sizes for n in [*range(-1, 305, 3), 302, 303, 304, 9999]]
    got = [tuple(r) for r in lineindex.indexed_lines(spark, wanted, index).collect()]
    assert sorted(got) == sorted({(s, n, sizes[s][n - 1].removesuffix("\r")) for s, n in wanted if 0 < n <= len(sizes[s])})
    with pytest.raises(ValueError, match="not in the index"):
        lineindex.indexed_lines(spark, [(str(tmp_path / "new.log"), 1)], index)
    (tmp_path / "c.log.gz").write_bytes(b"other\n")
    with pytest.raises(ValueError, match="has changed"):
        lineindex.indexed_lines(spark, wanted, index)


def test_a_look_up_reads_two_splits_at_most(spark, tmp_path):
    with open(tmp_path / "long.log", "w") as f:
        f.writelines(f"line {i} of a long file\n" for i in range(400_000))
    lineindex.write_index(spark, str(tmp_path / "long.log"), str(tmp_path / "index"), 1 << 20)
    index_size = sum(os.path.getsize(tmp_path / "index" / n) for n in os.listdir(tmp_path / "index"))
    before = bytes_read(spark)
    rows = lineindex.indexed_lines(spark, [(str(tmp_path / "long.log"), 399_000)], str(tmp_path / "index")).collect()
    assert [r["line"] for r in rows] == ["line 398999 of a long file"]
    assert bytes_read(spark) - before < (2 << 20) + 10 * index_size
