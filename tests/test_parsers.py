"""Line parsers, detection and joining, from literal lines."""

from datetime import datetime as ts

import pytest
from pyspark.sql import functions as F

from logloom.operators.multiline import fill_reference_date, join_multiline
from logloom.parsers.java import is_header
from logloom.parsers.registry import PARSERS, format_name, parse_lines, register_parser
from logloom.parsers.rows import no_fields, parsed
from logloom.schemas import ENTRY
from logloom.sources.detect import detect_first, detect_format
from logloom.sources.remote import from_field_rows, from_records

PLAIN = [
    ("The kettle, it boils!", None, "The kettle, it boils!"),
    ("Fault: wheel 3 stuck @ 192.0.2.7:99", None, "Fault: wheel 3 stuck @ 192.0.2.7:99"),
    ("2025-12-01 06:08:28 shelves counted twice", ts(2025, 12, 1, 6, 8, 28), "shelves counted twice"),
    ("2025-12-01T10:30:45Z Shop is open", ts(2025, 12, 1, 10, 30, 45), "Shop is open"),
    ("2025-12-01T10:30:45.123Z Weighing a parcel", ts(2025, 12, 1, 10, 30, 45, 123000), "Weighing a parcel"),
    ("2025-12-01 10:30:45,123 INFO Lamps on", ts(2025, 12, 1, 10, 30, 45, 123000), "INFO Lamps on"),
    ("2025-12-01 06:08:28.123 two crates", ts(2025, 12, 1, 6, 8, 28, 123000), "two crates"),
    ("2025-12-01T06:08:28+00:00 message", ts(2025, 12, 1, 6, 8, 28), "message"),
    ("2025-12-01T06:08:28 zone-less", ts(2025, 12, 1, 6, 8, 28), "zone-less"),
    ("[2025-12-01 10:30:45] Guest came by", ts(2025, 12, 1, 10, 30, 45), "Guest came by"),
    ("12/01/2025 10:30:45 Door moved", ts(2025, 12, 1, 10, 30, 45), "Door moved"),
    ("Seen at 2025-12-01 06:08:28", None, "Seen at 2025-12-01 06:08:28"),
    ("2025-12-01 06:08:28.123456 x", None, "2025-12-01 06:08:28.123456 x"),
    ("25/12/2025 10:00:00 x", None, "25/12/2025 10:00:00 x"),
    ("25-12-2025 10:00:00 x", ts(2025, 12, 25, 10), "x"),
    ("2025-12-01T06:08:28+0000 x", None, "2025-12-01T06:08:28+0000 x"),
    ("prog 2025-12-01 06:08:28: x", ts(2025, 12, 1, 6, 8, 28), "x"),
    ("[1733043708] x", ts(2024, 12, 1, 9, 1, 48), "x"),
    ("(1733043708000) x", ts(2024, 12, 1, 9, 1, 48), "x"),
    ("2025-13-45 10:00:00 bad date", None, "2025-13-45 10:00:00 bad date"),
    ("2025-12-01T25:00:00 2025-12-01 06:08:28: falls through", ts(2025, 12, 1, 6, 8, 28), "falls through"),
    ("[1733043708] 2025-99-01 06:08:28: falls through twice", ts(2024, 12, 1, 9, 1, 48), "2025-99-01 06:08:28: falls through twice"),
]


def test_plain(lines):
    entries = parse_lines(lines([p[0] for p in PLAIN]), "plain")
    assert [f.name for f in entries.schema.fields] == ENTRY.fieldNames()
    rows = entries.orderBy("line_no").collect()
    assert [(r["timestamp"], r["message"]) for r in rows] == [(p[1], p[2]) for p in PLAIN]
    assert (rows[2]["stream"], rows[2]["source"], rows[2]["ptr"]) == ("app.log", "/var/log/app.log", "file:///var/log/app.log#3")


def test_plain_skips_empty_lines(lines):
    assert [r["line_no"] for r in parse_lines(lines("a\n\n \nb")).orderBy("line_no").collect()] == [1, 3, 4]


JSON = [
    ('{"message": "apples sold", "level": "info"}', None, "apples sold", {"level": "info"}),
    ('{"msg": "apples sold", "service": "api"}', None, "apples sold", {"service": "api"}),
    ('{"timestamp": "2025-01-15T10:30:45Z", "message": "event"}', ts(2025, 1, 15, 10, 30, 45), "event", {}),
    ('{"ts": 1705315845, "message": "event"}', ts(2024, 1, 15, 10, 50, 45), "event", {}),
    ('{"time": 1705315845000, "message": "event"}', ts(2024, 1, 15, 10, 50, 45), "event", {}),
    ('{"message": "test", "count": 42, "ratio": 3.14, "big": 1e3, "tiny": 1.5e-7}', None, "test", {"count": "42", "ratio": "3.14", "big": "1000", "tiny": "0.00000015"}),
    ('  {"message": "test", "enabled": true, "none": null}  ', None, "test", {"enabled": "true", "none": "null"}),
    ('{"message": "test", "meta": {"key": "value"}}', None, "test", {"meta": '{"key":"value"}'}),
    ('{"event": "startup", "pid": 1234}', None, '{"event": "startup", "pid": 1234}', {"event": "startup", "pid": "1234"}),
    ('{"broken": json', None, '{"broken": json', None),
    ('{"a": 1} tail', None, '{"a": 1} tail', None),
    ('{"a": 1, "a": 2}', None, '{"a": 1, "a": 2}', {"a": "2"}),
    ('{"message": "", "a": "b"}', None, '{"message": "", "a": "b"}', {"a": "b"}),
    ('{"text": 5, "body": "b"}', None, "b", {"text": "5"}),
    ('{"time": "soon", "ts": "02/Jan/2006:15:04:05 -0700", "log": "x"}', ts(2006, 1, 2, 22, 4, 5), "x", {"time": "soon"}),
    ('{"date": "2025/01/15 10:30:45", "timestamp": "2025-01-15 10:30:45.5", "log": "x"}', ts(2025, 1, 15, 10, 30, 45, 500000), "x", {"date": "2025/01/15 10:30:45"}),
    ('{"timestamp": "2025-01-15T10:30:45", "log": "x"}', None, "x", {"timestamp": "2025-01-15T10:30:45"}),
    ('{"a": 1}, {"b": 2}', None, '{"a": 1}, {"b": 2}', None),
]


def test_json(lines):
    rows = parse_lines(lines([j[0] for j in JSON]), "json").orderBy("line_no").collect()
    for row, (line, when, message, fields) in zip(rows, JSON, strict=True):
        assert (row["timestamp"], row["message"], row["fields"]) == (when, message, fields), line


@pytest.mark.parametrize("text, read", [
    ('{"a":1e400}', False), ('{"a":[{"b":-1E+0400}]}', False), ('{"a":' + "9" * 400 + "}", False), ('{"a":' + "9" * 350 + "e-100}", True),
    ('{"a":"1e400"}', True), ('{"a":"\\"1e400"}', True), ('{"a":1e308}', True), ('{"a":1e-400}', True), ('{"a":' + "9" * 38 + "}", True), ('{"1e999":1}', True),
])
def test_numbers_out_of_range_make_a_line_invalid(lines, text, read):
    row = parse_lines(lines([text]), "json").first()
    assert (row["message"], bool(row["fields"])) == (text, read)
    if text == '{"a":' + "9" * 38 + "}":
        assert row["fields"]["a"] == "9" * 38


def test_json_skips_other_lines(lines):
    assert parse_lines(lines(["", "no braces here", " ", '{"a":1}']), "json").count() == 1


def test_syslog(lines):
    text = [
        "<134>1 2025-01-15T10:30:45.123456Z till4 scaled 1234 ID47 - Shop is open",
        "Jan 15 10:30:45 till4 gated[1234]: opened the side door",
        "Dec  5 08:15:30 server kernel: rack2: fan slower than asked",
        "A note without any prefix",
        "",
        "Feb 30 10:30:45 host no colon",
        "Xyz 12 10:30:45 host :odd",
    ]
    rows = parse_lines(lines(text), "syslog", year=2024).orderBy("line_no").collect()
    got = [(r["timestamp"], r["message"], r["fields"]) for r in rows]
    assert got == [
        (ts(2025, 1, 15, 10, 30, 45, 123456), "- Shop is open",
         {"facility": "16", "severity": "6", "hostname": "till4", "app": "scaled", "procid": "1234", "msgid": "ID47"}),
        (ts(2024, 1, 15, 10, 30, 45), "opened the side door", {"hostname": "till4", "program": "gated", "pid": "1234"}),
        (ts(2024, 12, 5, 8, 15, 30), "rack2: fan slower than asked", {"hostname": "server", "program": "kernel"}),
        (None, "A note without any prefix", {}),
        (None, "no colon", {"hostname": "host"}),
        (None, ":odd", {"hostname": "host"}),
    ]


JAVA = [
    ("2025-01-15 10:30:45,123 INFO [main] org.shop.Till - Shop is open", ts(2025, 1, 15, 10, 30, 45, 123000), "Shop is open",
     {"level": "INFO", "thread": "main", "logger": "org.shop.Till"}),
    ("2025-01-15 10:30:45.123 [worker-1] ERROR org.shop.Scale - Belt torn", ts(2025, 1, 15, 10, 30, 45, 123000), "Belt torn",
     {"level": "ERROR", "thread": "worker-1", "logger": "org.shop.Scale"}),
    ("2025-01-15 10:30:45 [main] INFO org.shop.Till - Started", ts(2025, 1, 15, 10, 30, 45), "Started", {"level": "INFO", "thread": "main", "logger": "org.shop.Till"}),
    ("2025-01-15 10:30:45,123 WARN Label missing", ts(2025, 1, 15, 10, 30, 45, 123000), "Label missing", {"level": "WARN"}),
    ("2025-01-15 10:30:45 WARN Plain", ts(2025, 1, 15, 10, 30, 45), "Plain", {"level": "WARN"}),
    ("2025-01-15T10:30:45.123Z DEBUG Weighing a parcel", ts(2025, 1, 15, 10, 30, 45, 123000), "Weighing a parcel", {"level": "DEBUG"}),
    ("2025-11-21 15:07:22,165 INFO [main] logger - Starting", ts(2025, 11, 21, 15, 7, 22, 165000), "Starting", {"level": "INFO", "thread": "main", "logger": "logger"}),
    ("15:08:00,000 |-INFO in org.shop.Board - All well", ts(2025, 11, 21, 15, 8), "org.shop.Board - All well", {"level": "INFO"}),
    ("\x1b[32m15:08:01.500 DEBUG\x1b[0m coloured", ts(2025, 11, 21, 15, 8, 1, 500000), "coloured", {"level": "DEBUG"}),
]


def test_java_layouts(lines):
    rows = parse_lines(lines([j[0] for j in JAVA]), "java").orderBy("line_no").collect()
    for row, (line, when, message, fields) in zip(rows, JAVA, strict=True):
        assert (row["timestamp"], row["message"], row["fields"]) == (when, message, fields), line


def test_java_default_date(lines):
    rows = parse_lines(lines("15:07:20,910 |-INFO in ch.qos.logback"), "java", default_date="2025-11-21").collect()
    assert [r["timestamp"] for r in rows] == [ts(2025, 11, 21, 15, 7, 20, 910000)]


def test_unstructured_java_line(lines):
    (row,) = parse_lines(lines("A note of no known shape"), "java").collect()
    assert (row["timestamp"], row["message"], row["fields"]) == (None, "A note of no known shape", {})


TRACE = """2025-01-15 10:30:45,123 INFO [main] org.shop.Till - Starting
2025-01-15 10:30:46,000 ERROR [main] org.shop.Till - Drawer jammed
java.lang.NullPointerException: value was null
\tat org.shop.Till.process(App.java:42)
\tat org.shop.Till.main(App.java:10)
Caused by: java.io.IOException: File not found
\tat org.shop.IO.read(IO.java:100)
\t... 5 more
2025-01-15 10:30:47,000 INFO [main] org.shop.Till - Recovered"""


@pytest.mark.parametrize("chunk", [1, 2, 3, 4, 250_000])
def test_trace_joins_whatever_the_chunks(lines, chunk):
    rows = parse_lines(lines(TRACE), "java", chunk_lines=chunk).orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == [1, 2, 9]
    assert rows[1]["message"] == "\n".join(["Drawer jammed", *TRACE.split("\n")[2:8]])
    assert rows[1]["ptr"].endswith("#2")


@pytest.mark.parametrize("chunk", [1, 2, 3, 250_000])
def test_opening_lines_and_blanks(lines, chunk):
    text = "\n\n opening\n  goes on\n\n2025-01-15 10:30:45 INFO a\n\nb\n"
    rows = join_multiline(lines(text), is_header(F.col("line")), chunk).orderBy("line_no").collect()
    assert [(r["line_no"], r["message"]) for r in rows] == [(3, " opening\n  goes on\n"), (6, "2025-01-15 10:30:45 INFO a\n\nb\n")]


def test_only_blank_lines_make_no_entry(lines):
    assert join_multiline(lines("\n\n"), is_header(F.col("line")), 2).count() == 0


@pytest.mark.parametrize("line, head", [
    ("", False), ("\tat org.shop.Till.main(App.java:10)", False), ("    at org.shop", False), ("\t... 15 more", False), ("Caused by: x", False),
    ("Suppressed: y", False), ("java.lang.NullPointerException: z", False), ("java.lang.OutOfMemoryError: heap", False), ("Some regular message", False),
    ("2025-01-15 10:30:45,123 INFO [main] org.shop.Till - x", True), ("15:07:20,910 |-INFO in ch.qos.logback", True), ("2025-01-15 no level", False),
])
def test_continuation_rule(one, line, head):
    assert one(is_header(F.lit(line))) is head


@pytest.mark.parametrize("chunk", [1, 2, 250_000])
def test_reference_date(spark, chunk):
    days = [None, None, "2025-01-02", None, None, "2025-01-03", None]
    rows = spark.createDataFrame([("a", i, d) for i, d in enumerate(days, 1)] + [("b", 1, None)], "source string, line_no bigint, day string")
    rows = rows.withColumn("day", F.col("day").cast("date"))
    got = fill_reference_date(rows, "2024-12-31", chunk).orderBy("source", "line_no").collect()
    assert [str(r["filled"]) for r in got] == ["2024-12-31"] * 2 + ["2025-01-02"] * 3 + ["2025-01-03"] * 2 + ["2024-12-31"]


def test_detect(spark, lines):
    first = {
        "/j": '{"message": "test"}', "/v": "2025-01-15 10:30:45,123 INFO [main] x - y", "/s": "Jan 15 10:30:45 till4 gated[1234]: Accepted",
        "/p": "A note that says nothing", "/5": "<13>1 2025-01-15T10:30:45Z h a 1 - - m", "/l": "15:07:20,910 |-INFO in ch.qos.logback", "/u": "01/15/25 10:30:45 ERROR x",
    }
    rows = None
    for source, line in first.items():
        part = lines(["", "plain line first", line], source)
        rows = part if rows is None else rows.unionByName(part)
    late = lines(["p"] * 10 + ['{"a":1}'], "/late").unionByName(lines([" "] * 2000 + ['{"a":1}'], "/blank"))
    got = {r["source"]: r["format"] for r in detect_format(rows.unionByName(late)).collect()}
    assert got == {"/j": "json", "/v": "java", "/s": "syslog", "/p": "plain", "/5": "syslog", "/l": "java", "/u": "java", "/late": "plain", "/blank": "json"}
    assert detect_first(lines(["", '  {"a": 1}'])) == "json"
    assert [format_name(h) for h in ("JSON", "Syslog", "other", None)] == ["json", "syslog", "auto", "auto"]


def test_own_parser(lines):
    register_parser("upper", lambda rows, **_: parsed(rows, F.lit(None).cast("timestamp"), F.upper("line"), no_fields()))
    try:
        assert [r["message"] for r in parse_lines(lines("a"), "upper").collect()] == ["A"]
    finally:
        del PARSERS["upper"]


def test_field_rows(spark):
    cells = [(1, "@timestamp", "2025-12-03 19:13:20.000"), (1, "@message", "m"), (1, "@logStream", "s"), (1, "@ptr", "p"), (1, "x", "1"), (1, "x", "2"),
             (2, "@timestamp", ""), (2, "@message", "n"), (3, "@timestamp", "bad"), (4, None, "v"), (4, "y", None)]
    rows = from_field_rows(spark.createDataFrame(cells, "row_id bigint, field string, value string"), "/group").orderBy("row_id").collect()
    assert [(r["timestamp"], r["message"], r["stream"], r["ptr"]) for r in rows] == [
        (ts(2025, 12, 3, 19, 13, 20), "m", "s", "p"), (None, "n", "", ""), (None, "", "", ""), (None, "", "", "")
    ]
    assert rows[0]["fields"]["x"] == "2" and rows[0]["source"] == "/group"
    record = spark.createDataFrame([({"@message": "m", "@timestamp": "2025-12-03T19:13:20Z"},)], "fields map<string,string>")
    assert from_records(record).first()["timestamp"] == ts(2025, 12, 3, 19, 13, 20)
