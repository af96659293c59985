"""Column functions."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logloom.functions import pointers, regex, text, times

L = F.lit


def ts(*parts):
    return datetime(*parts)


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_iso8601(spark):
    got = column(
        spark,
        ["2025-12-01T06:08:28Z", "2025-12-01T06:08:28.123456789Z", "2025-12-01T06:08:28-05:00", "2025-12-01T06:08:28.5",
         "2025-12-01T06:08:28+0000", "2025", "2025-12-01 06:08:28", "2025-02-30T00:00:00Z", "2025-12-01T06:08:28Z\n", ""],
        times.iso8601,
    )
    assert got == [
        ts(2025, 12, 1, 6, 8, 28), ts(2025, 12, 1, 6, 8, 28, 123456), ts(2025, 12, 1, 11, 8, 28), ts(2025, 12, 1, 6, 8, 28, 500000),
        None, None, None, None, None, None,
    ]


def test_service_time(spark):
    got = column(
        spark,
        ["2025-12-03 19:13:20.000", "2025-12-03 19:13:20", "2025-12-03T19:13:20Z", "2025-12-03T19:13:20-05:00", "2025-12-03T19:13:20.123Z",
         "2025-12-03T19:13:20.123", "2025-12-03T19:13:20", "not a time", ""],
        times.service_time,
    )
    assert got[:6] == [
        ts(2025, 12, 3, 19, 13, 20), ts(2025, 12, 3, 19, 13, 20), ts(2025, 12, 3, 19, 13, 20), ts(2025, 12, 4, 0, 13, 20),
        ts(2025, 12, 3, 19, 13, 20, 123000), ts(2025, 12, 3, 19, 13, 20, 123000),
    ]
    assert got[6:] == [None, None, None]


def test_parse_timestamp(spark):
    got = column(spark, ["2025-12-04T10:30:00Z", "2025-12-04T10:30:00", "2025-12-04 10:30:00", "2025-12-04 10:30:00.250", "invalid"], times.parse_timestamp)
    assert got == [ts(2025, 12, 4, 10, 30)] * 3 + [ts(2025, 12, 4, 10, 30, 0, 250000), None]


def test_time_zone_of_zoneless_text(one):
    assert one(times.parse_timestamp(L("2025-12-04 10:30:00"), "Europe/Berlin")) == ts(2025, 12, 4, 9, 30)


def test_parse_time(spark):
    base = L("2025-12-04T10:30:00Z").cast("timestamp")
    got = column(spark, ["", "now", "2h", "30m", "7d", "2025-12-02T06:00:00Z", "2w", "tomorrow", "2025-12-02"], lambda c: times.parse_time(c, base))
    now = ts(2025, 12, 4, 10, 30)
    assert got == [now, now, ts(2025, 12, 4, 8, 30), ts(2025, 12, 4, 10, 0), ts(2025, 11, 27, 10, 30), ts(2025, 12, 2, 6), None, None, None]


DURATIONS = [("1h", 3600), ("24h", 86400), ("7d", 604800), ("5m", 300), ("1h30m", 5400), ("1.5h", 5400), ("250ms", 0.25), ("1m0.5s", 60.5), ("-2m", -120), ("0", 0)]


def test_durations(spark):
    got = column(spark, [d for d, _ in DURATIONS] + ["x", "5", "1h x", ""], times.duration_micros)
    assert got == [round(s * 1e6) for _, s in DURATIONS] + [None] * 4
    for d, s in DURATIONS:
        assert times.duration_argument(d) == timedelta(seconds=s)
    with pytest.raises(ValueError):
        times.duration_argument("soon")


def test_parse_duration_is_an_interval(one):
    assert one(times.parse_duration(L("1h30m"))) == timedelta(minutes=90)


def test_time_arguments():
    now = datetime(2025, 12, 4, 10, 30, tzinfo=timezone.utc)
    for text, want in {"": now, "now": now, "2h": now - timedelta(hours=2), "30m": now - timedelta(minutes=30), "7d": now - timedelta(days=7),
                       "2025-12-04T12:30:00+02:00": now, "2025-12-04 10:30:00": now, "2025-12-04T10:30:00.000": now}.items():
        assert times.time_argument(text, now) == want
    for bad in ("2w", "2025-12-04", "yesterday", "1h30m"):
        with pytest.raises(ValueError):
            times.time_argument(bad, now)


def test_format_duration(spark):
    rows = spark.createDataFrame([(s,) for s in (30, 2700, 3600, 5400, 4140, 4500, 86399, 86400, 172800, 216000)], "s bigint")
    got = [r[0] for r in rows.select(times.format_duration(F.col("s"))).collect()]
    assert got == ["0m", "45m", "1.0h", "1.5h", "1.1h", "1.2h", "24.0h", "1.0d", "2.0d", "2.5d"]


def test_check_time_range(one):
    at = lambda t: L(t).cast("timestamp")
    check = lambda s, e: one(times.check_time_range(at(s), at(e), at("2025-06-15T12:00:00Z")))
    assert check("2025-06-15T11:00:00Z", "2025-06-15T12:00:00Z") == []
    assert check("2025-06-15T11:00:00Z", "2025-06-16T12:00:00Z") == ["end_in_future"]
    assert check("2025-06-16T11:00:00Z", "2025-06-17T12:00:00Z") == ["end_in_future", "start_in_future"]
    assert check("2025-04-16T12:00:00Z", "2025-06-15T12:00:00Z") == ["range_over_30_days"]
    assert check("2025-06-15T11:59:30Z", "2025-06-15T12:00:00Z") == ["range_under_1_minute"]
    assert not one(times.valid_time_range(at("2025-06-15T12:00:00Z"), at("2025-06-15T12:00:00Z")))


def test_format_bytes(spark):
    sizes = [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1280, "1.2 KB"), (1048575, "1024.0 KB"),
             (1048576, "1.0 MB"), (1572864, "1.5 MB"), (1 << 30, "1.0 GB"), (1 << 40, "1.0 TB"), (1 << 50, "1.0 PB"), (1 << 60, "1.0 EB")]
    rows = spark.createDataFrame([(s,) for s, _ in sizes], "s bigint")
    assert [r[0] for r in rows.select(text.format_bytes(F.col("s"))).collect()] == [t for _, t in sizes]


def test_one_decimal_agrees_with_exact_rounding(spark):
    values = [1 + i / 20 for i in range(2000)] + [1 + i / 7 for i in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(text.one_decimal(F.col("v"))).collect()] == [f"{v:.1f}" for v in values]


def test_truncate(one):
    assert one(text.truncate(L("hello world"), 8)) == "hello wo..."
    assert one(text.truncate(L("hello\nworld"), 20)) == "hello world"
    assert one(text.truncate(L("a\r\nb"), 20)) == "a b"
    assert one(text.truncate_total(L("hello world"), 8)) == "hello..."
    assert one(text.truncate_total(L("hello"), 5)) == "hello"


def test_slug(one):
    today = L(date(2025, 1, 15))
    assert one(text.slug(L("Bug #123: Critical Error!"), today)) == "bug-123-critical-error-2025-01-15"
    assert one(text.slug(L("error_logs_analysis"), today)) == "error-logs-analysis-2025-01-15"
    assert one(text.slug(L("Too   Many    Spaces"), today)) == "too-many-spaces-2025-01-15"
    assert one(text.slug(L("Outage 2024-12-31"), today)) == "outage-2024-12-31"


def test_pointers(spark):
    got = column(spark, ["file:///var/log/app.log#42", "file:///var/log/app.log", "file:///var/log/app.log#notanumber", "file://#42", "", "s3://b/k"], pointers.parse_ptr)
    assert [tuple(g) if g else None for g in got] == [("/var/log/app.log", 42), ("/var/log/app.log", 0), None, None, None, None]
    got = column(spark, ["s3://mybucket/logs/app.log#1024", "s3://b/k", "s3:///key", "s3://bucket/", "s3://bucket/key#notanumber"], pointers.parse_s3_ptr)
    assert [tuple(g) if g else None for g in got] == [("mybucket", "logs/app.log", 1024), ("b", "k", 0), None, None, None]
    got = column(spark, ["file:///a#1", "s3://b/k#1", "ABC123xyz", "", "http://example.com"], pointers.ptr_type)
    assert got == ["local", "s3", "cloudwatch", "unknown", "unknown"]
    got = column(spark, ["file:///var/log/app.log#42", "abcdefghijklmnopqrst", "short"], pointers.short_ptr)
    assert got == ["app.log#42", "ijklmnopqrst", "short"]


def test_make_pointers(one):
    assert one(pointers.make_ptr(L("/var/log/app.log"), L(42))) == "file:///var/log/app.log#42"
    assert one(pointers.make_s3_ptr(L("b"), L("k/x"), L(7))) == "s3://b/k/x#7"


def test_stat_names(spark):
    for stat, names in {
        "Sum": ["sum", "Sum", "SUM", "median", ""], "Average": ["average", "Average", "avg", "AVG"], "Minimum": ["minimum", "Minimum", "min", "MIN"],
        "Maximum": ["maximum", "Maximum", "max", "MAX"], "SampleCount": ["samplecount", "SampleCount", "count", "COUNT"],
    }.items():
        assert [text.normalize_stat(n) for n in names] == [stat] * len(names)
        assert column(spark, names, text.normalize_stat_column) == [stat] * len(names)


def test_split_log_field(spark):
    assert column(spark, ["1234:/app/x", "1234:/app:x", "plain"], text.split_log_field) == ["/app/x", "/app:x", None]


@pytest.mark.parametrize("pattern, value, found", [
    ("error|warn", "An ERROR here", True), ("^a$", "A", True), ("^a$", "a\n", False), ("x.a", "x\ra", True), ("x.a", "x\na", False), ("ä", "Ä", True),
    ("(?P<n>b)c", "abc", True), ("[[:digit:]]+", "a1", True), ("[[:^digit:]]", "1", False), ("[a[b]", "[", True), ("[a&&b]", "&", True), (r"\Qa.b\E", "a.b", True),
    (r"\Qa.b\E", "axb", False), ("(?m)^b$", "a\nb\nc", True), (r"\p{Greek}", "α", True), ("[]a]", "]", True), ("[^]a]", "]", False), (r"a\$", "a$", True),
])
def test_search_patterns(one, pattern, value, found):
    assert one(regex.matches(L(value), pattern)) is found


@pytest.mark.parametrize("pattern, value, found", [
    ("(?P<a_b>x)(?P<aUb>y)", "xy", True), ("^*b", "ab", True), ("(?:a{500}){2}", "a" * 1000, True), (r"^[\d-z]$", "-", True), (r"^[\d-z]$", "m", False),
    ("^[]a]$", "]", True), ("^[^]a]$", "]", False), ("^[a-c&&b]$", "&", True), (r"^[\x41-\x{43}]$", "B", True), ("x{,3}", "x{,3}", True), (r"^[\t-\r]$", "\n", True),
    ("^[a-]+$", "-a", True), ("(|a)b", "b", True),
])
def test_brackets_counts_and_names(one, pattern, value, found):
    assert one(regex.matches(L(value), pattern)) is found


@pytest.mark.parametrize("pattern", [
    "a(?=b)", "(?<!a)b", r"(a)\1", "(?>a)", "a\\", "a{1001}", "a{2,1}", "(?:a{500}){3}", "(?P<a>x)(?P<a>y)", r"[a-\d]", "[z-a]", "[[:foo:]]", "a|*", "(*a)", "{2}", "(?:)|+",
])
def test_refused_patterns(pattern):
    """At the call, not in the running job."""
    with pytest.raises(ValueError):
        regex.to_java_regex(pattern)


def test_highlight(one):
    assert one(regex.highlight(L("An error, an ERROR"), "error", "<b>", "</b>")) == "An <b>error</b>, an <b>ERROR</b>"
    assert one(regex.highlight(L("cost"), "c(o)s", "$[", "]$")) == "$[cos]$t"


def test_strip_ansi(one):
    assert one(text.strip_ansi(L("\x1b[1;31mred\x1b[0m x\x1b[m"))) == "red x"


def test_sample_value(spark):
    rows = spark.createDataFrame([(v,) for v in ("1", "1.50", "1e3", "true", "null", '"s"', "1e-7", "1e25", "0.25", "[1,2]")], "t string")
    got = [r[0] for r in rows.select(text.sample_value(F.try_parse_json("t"))).collect()]
    assert got == ["1", "1.5", "1000", "true", "null", "s", "1e-07", "1e+25", "0.25", "[1,2]"]
