"""Queries: scalar functions over whole tables."""

from pyspark.sql import functions as F

from checks.inputs import entries, micros, table
from checks.registry import query
from logloom.functions.regex import highlight, matches
from logloom.functions.text import normalize_stat_column, slug, split_log_field, strip_ansi, truncate, truncate_total
from logloom.functions.times import check_time_range, duration_micros, format_duration, iso8601, parse_time, parse_timestamp


@query("truncate_text", """
SELECT doc_id, CASE WHEN length(flat) > 60 THEN left(flat, 60) || '...' ELSE flat END AS short,
       CASE WHEN length(text) <= 40 THEN text ELSE left(text, 37) || '...' END AS total
FROM (SELECT doc_id, text, replace(replace(text, chr(10), ' '), chr(13), '') AS flat FROM documents)""")
def truncated(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", truncate(text, 60).alias("short"), truncate_total(text, 40).alias("total"))


@query("highlight_text", r"""
SELECT doc_id, regexp_replace(text, '(?i)(the|der|l[ea])', '[[\1]]', 'g') AS marked FROM documents""")
def highlighted(spark, sf):
    return table(spark, sf, "documents").select("doc_id", highlight(F.col("text"), "the|der|l[ea]", "[[", "]]").alias("marked"))


@query("slugs", r"""
SELECT doc_id, CASE WHEN regexp_matches(s, '\d{4}-\d{2}-\d{2}') THEN s ELSE s || '-2025-01-15' END AS slug
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), ' _', '--'), '[^\p{L}\p{Nd}-]', '', 'g'), '-+', '-', 'g'), '-') AS s
      FROM documents)""")
def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", slug(F.col("text"), F.lit("2025-01-15").cast("date")).alias("slug"))


@query("log_field", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '/app/' || event_type || ':x' ELSE '' END AS log_group FROM events""")
def log_fields(spark, sf):
    account = F.concat(F.lit("1234:/app/"), "event_type", F.lit(":x"))
    log = F.when(F.col("user_id") % 2 == 0, account).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", F.coalesce(split_log_field(log), F.lit("")).alias("log_group"))


@query("strip_ansi", "SELECT event_id, event_type || ' ' || user_id AS text FROM events")
def stripped(spark, sf):
    colored = F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m "), "user_id", F.lit("\x1b[m"))
    return table(spark, sf, "events").select("event_id", strip_ansi(colored).alias("text"))


@query("time_parse", """
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - user_id * 60000000 WHEN 2 THEN epoch_us(ts) - user_id * 3600000000
    WHEN 3 THEN epoch_us(ts) - user_id * 86400000000 WHEN 4 THEN epoch_us(date_trunc('second', ts)) - 7200000000 ELSE -1 END AS relative_us,
  CASE event_id % 3 WHEN 0 THEN epoch_us(date_trunc('millisecond', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) ELSE -1 END AS absolute_us,
  CASE event_id % 2 WHEN 0 THEN epoch_us(date_trunc('second', ts)) + 18000000000 ELSE epoch_us(ts) END AS iso_us
FROM events""")
def times(spark, sf):
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    relative = (
        F.when(n % 6 == 0, "now").when(n % 6 == 1, F.concat(user, F.lit("m"))).when(n % 6 == 2, F.concat(user, F.lit("h")))
        .when(n % 6 == 3, F.concat(user, F.lit("d"))).when(n % 6 == 4, F.concat(seconds, F.lit("+02:00"))).otherwise(F.concat(user, F.lit("w")))
    )
    absolute = (
        F.when(n % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).when(n % 3 == 1, seconds).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    iso = F.when(n % 2 == 0, F.concat(seconds, F.lit("-05:00"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return table(spark, sf, "events").select(
        "event_id", micros(parse_time(relative, F.col("ts"))).alias("relative_us"),
        micros(parse_timestamp(absolute)).alias("absolute_us"), micros(iso8601(iso)).alias("iso_us"),
    )


@query("durations", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id * 86400000000 WHEN 1 THEN user_id * 3600000000 + 30 * 60000000
  WHEN 2 THEN CAST(user_id * 1500000 AS BIGINT) ELSE -1 END AS micros,
  CASE WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN printf('%.1fh', s / 3600.0) ELSE printf('%.1fd', s / 3600.0 / 24.0) END AS shown
FROM (SELECT *, event_id * 7 AS s FROM events)""")
def durations(spark, sf):
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    text = (
        F.when(n % 4 == 0, F.concat(user, F.lit("d"))).when(n % 4 == 1, F.concat(user, F.lit("h30m")))
        .when(n % 4 == 2, F.concat(F.format_string("%d", F.floor(F.col("user_id") * 1.5)), F.lit("."),
                                   F.when(F.col("user_id") % 2 == 1, "5").otherwise("0"), F.lit("s")))
        .otherwise(F.concat(user, F.lit(" hours")))
    )
    return table(spark, sf, "events").select(
        "event_id", F.coalesce(duration_micros(text), F.lit(-1)).alias("micros"), format_duration(n * 7).alias("shown")
    )


@query("range_warnings", """
WITH r AS (SELECT event_id, ts AS s, ts + to_seconds(user_id * user_id * 150) AS e, TIMESTAMP '2024-01-25' AS n FROM events)
SELECT event_id, concat_ws(' ', CASE WHEN e > n + INTERVAL 1 MINUTE THEN 'end_in_future' END, CASE WHEN s > n + INTERVAL 1 MINUTE THEN 'start_in_future' END,
  CASE WHEN epoch_us(e) - epoch_us(s) > 2592000000000 THEN 'range_over_30_days' END,
  CASE WHEN epoch_us(e) - epoch_us(s) < 60000000 AND e > s THEN 'range_under_1_minute' END) AS warnings FROM r""")
def warnings(spark, sf):
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("user_id") * F.col("user_id") * 150_000_000)
    codes = check_time_range(F.col("ts"), end, F.lit("2024-01-25T00:00:00Z").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.array_join(codes, " ").alias("warnings"))


@query("stat_aliases", """
SELECT event_id, ['Sum', 'Average', 'Maximum', 'SampleCount', 'Sum'][event_id % 5 + 1] AS stat FROM events""")
def aliases(spark, sf):
    names = F.array(*[F.lit(n) for n in ("SUM", "avg", "max", "COUNT", "median")])
    named = F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", normalize_stat_column(named).alias("stat"))


@query("time_parse_extremes", """
SELECT event_id, CASE event_id % 4 WHEN 2 THEN epoch_us(ts) - 60000000 ELSE -1 END AS relative_us,
       CASE event_id % 4 WHEN 3 THEN 86400000000 ELSE -1 END AS micros FROM events""")
def extreme_times(spark, sf):
    """Numbers beyond any time or duration give no value and end no job."""
    n = F.col("event_id")
    text = F.when(n % 4 == 0, "9999999999999999d").when(n % 4 == 1, "99999999999999999999h").when(n % 4 == 2, "1m").otherwise("900000000000000m")
    span = F.when(n % 4 == 0, "999999999999d").when(n % 4 == 1, "9" * 30 + "h").when(n % 4 == 2, "x").otherwise("1d")
    return table(spark, sf, "events").select(
        "event_id", micros(parse_time(text, F.col("ts"))).alias("relative_us"), F.coalesce(duration_micros(span), F.lit(-1)).alias("micros")
    )


@query("regex_boundaries", r"""
SELECT doc_id, regexp_matches(text, '(?i)la\b') AS after, regexp_matches(text, '(?i)\bété') AS before,
       regexp_matches(text, '(?i)e\Bn') AS inside, regexp_matches(text, '(?i)e\sd\w+é') AS blank FROM documents""")
def boundaries(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", matches(text, r"la\b").alias("after"), matches(text, r"\bété").alias("before"), matches(text, r"e\Bn").alias("inside"),
        matches(text, r"e\sd\w+é").alias("blank"),
    )
