"""Queries: cases, timelines, evidence, exports."""

from pyspark.sql import functions as F

from checks.inputs import SQL_MESSAGE, cases, entries, evidence, metrics, micros, table, timeline
from checks.counting import _groups, _SQL_GROUPS
from checks.registry import query
from logloom.operators.aggregates import list_streams
from logloom.operators.cases import (
    annotate, audit_rows, case_list, case_report, case_stats, collect_evidence, mark_last, numbered_evidence,
    report_rows, unknown_evidence,
)
from logloom.operators.filters import timeline_filter
from logloom.operators.metrics import metric_catalog, metric_stats
from logloom.operators.projections import extra_fields, rfc3339_text, to_export, with_provenance
from logloom.operators.sinks import (
    append_timeline, read_csv_export, write_catalog, write_entries, write_evidence, write_groups, write_report,
    write_series, write_streams,
)
from logloom.session import fresh_folder

_SQL_TIMELINE = f"""
SELECT 'case-' || user_id AS case_id, event_id AS seq, ts, user_id, event_type,
       CASE WHEN event_type IN ('click', 'view') THEN 'query' WHEN event_type = 'signup' THEN 'note' ELSE 'evidence' END AS type,
       event_type = 'view' AS marked, {SQL_MESSAGE} AS content FROM events"""

_SQL_STATS = f"""
SELECT case_id, CAST(count_if(type = 'query') AS BIGINT) AS queries, CAST(count_if(type = 'query' AND marked) AS BIGINT) AS marked, CAST(count_if(type = 'note') AS BIGINT) AS notes,
       CAST(count_if(event_type = 'purchase') AS BIGINT) AS evidence, min_by(ts, seq) AS first_ts, max_by(ts, seq) AS last_ts
FROM ({_SQL_TIMELINE}) GROUP BY case_id"""


@query("case_stats", f"""
SELECT case_id, queries, marked, notes, evidence, epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us FROM ({_SQL_STATS})""")
def stats_of_cases(spark, sf):
    return case_stats(timeline(spark, sf), evidence(spark, sf)).select(
        "case_id", "queries", "marked", "notes", "evidence", micros("first_action").alias("first_us"), micros("last_action").alias("last_us")
    )


@query("case_list", f"""
SELECT s.case_id AS id, CASE WHEN user_id % 3 = 0 THEN 'closed' ELSE 'active' END AS status, epoch_us(updated) AS updated_us, queries, notes, evidence
FROM ({_SQL_STATS}) s JOIN (SELECT user_id, max(ts) AS updated FROM events GROUP BY user_id) c ON s.case_id = 'case-' || c.user_id
WHERE user_id % 3 <> 0""")
def list_of_cases(spark, sf):
    return case_list(cases(spark, sf), timeline(spark, sf), evidence(spark, sf), "active").select(
        "id", "status", micros("updated").alias("updated_us"), "queries", "notes", "evidence"
    )


@query("timeline_view", f"SELECT case_id, seq, content FROM ({_SQL_TIMELINE}) WHERE type = 'query' AND marked")
def view(spark, sf):
    return timeline_filter(timeline(spark, sf), "query", True).select("case_id", "seq", "content")


@query("report_rows", f"""
SELECT case_id, seq, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS number
FROM ({_SQL_TIMELINE}) WHERE marked OR type IN ('note', 'evidence')""")
def report(spark, sf):
    return report_rows(timeline(spark, sf)).select("case_id", "seq", "number")


@query("numbered_evidence", """
SELECT 'case-' || user_id AS case_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number
FROM events WHERE event_type = 'purchase'""")
def numbers(spark, sf):
    return numbered_evidence(evidence(spark, sf)).select("case_id", "seq", "number")


@query("mark_last", f"""
SELECT case_id, seq, marked OR (type = 'query' AND seq = max(CASE WHEN type = 'query' THEN seq END) OVER (PARTITION BY case_id)) AS marked
FROM ({_SQL_TIMELINE})""")
def marked(spark, sf):
    return mark_last(timeline(spark, sf)).select("case_id", "seq", "marked")


_SQL_PICKED = """
WITH ev AS (SELECT * FROM events WHERE event_type = 'purchase'),
picked AS (SELECT * FROM events WHERE event_type = 'error'),
used AS (SELECT user_id, max(event_id) AS used FROM ev GROUP BY 1),
acted AS (SELECT user_id, max(event_id) AS acted FROM events GROUP BY 1)"""


@query("collect_evidence", f"""{_SQL_PICKED}
SELECT 'case-' || user_id AS case_id, coalesce(used, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
       'file:///events/error#' || event_id AS ptr, {SQL_MESSAGE} AS message, 'file:///events/error' AS source_uri,
       'why ' || event_id AS annotation, 'evidence' AS kind
FROM picked p LEFT JOIN used USING (user_id)
UNION ALL
SELECT 'case-' || user_id, acted + row_number() OVER (PARTITION BY user_id ORDER BY event_id), '', {SQL_MESSAGE}, 'file:///events/error', '', 'timeline'
FROM picked p JOIN acted USING (user_id)""")
def collected(spark, sf):
    logs = entries(spark, sf)
    wanted = logs.filter(F.col("source").isin("/events/error", "/events/purchase")).select(
        F.concat(F.lit("case-"), F.substring_index("stream", "-", -1)).alias("case_id"), "ptr",
        F.col("line_no").alias("seq"), F.concat(F.lit("why "), "line_no").alias("annotation"),
    )
    again = wanted.withColumn("seq", F.col("seq") + 1).withColumn("annotation", F.lit("again"))
    new, actions = collect_evidence(logs, wanted.unionByName(again), evidence(spark, sf), timeline(spark, sf), "2024-03-01T00:00:00Z")
    items = new.select("case_id", "seq", "ptr", "message", "source_uri", "annotation", F.lit("evidence").alias("kind"))
    return items.unionByName(actions.select(
        "case_id", "seq", F.lit("").alias("ptr"), F.col("content").alias("message"), F.col("source").alias("source_uri"),
        F.lit("").alias("annotation"), F.lit("timeline").alias("kind"),
    ))


@query("annotate", """
SELECT 'case-' || user_id AS case_id, event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'note ' || event_id ELSE '' END AS annotation
FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'case-' || user_id, -1, 'unknown' FROM events WHERE event_type = 'click'""")
def annotated(spark, sf):
    held = evidence(spark, sf)
    updates = held.filter(F.substring_index("case_id", "-", -1).cast("bigint") % 2 == 0).select(
        "case_id", "ptr", F.concat(F.lit("note "), "seq").alias("annotation")
    )
    clicks = table(spark, sf, "events").filter("event_type = 'click'").select(
        F.concat(F.lit("case-"), "user_id").alias("case_id"), F.concat(F.lit("ptr-"), "event_id").alias("ptr"), F.lit("x").alias("annotation")
    )
    done = annotate(held, updates).select("case_id", "seq", F.coalesce("annotation", F.lit("")).alias("annotation"))
    unknown = unknown_evidence(held, updates.unionByName(clicks)).select(
        "case_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("unknown").alias("annotation")
    )
    return done.unionByName(unknown)


@query("extra_fields", """
SELECT event_id, 'action=' || event_type || ' k=' || json_extract_string(props, '$.k') AS extra FROM events WHERE event_type = 'purchase'""")
def extras(spark, sf):
    pairs = F.transform(extra_fields(F.map_concat("raw_fields", F.create_map(F.lit("@ptr"), F.lit("p"), F.lit("none"), F.lit("")))),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return evidence(spark, sf).select(F.col("seq").alias("event_id"), F.array_join(pairs, " ").alias("extra"))


@query("case_report", f"""
SELECT 'case-' || user_id AS case_id, 'case' AS section, 1 AS number, 'User ' || user_id AS text FROM events GROUP BY user_id
UNION ALL SELECT 'case-' || user_id, 'evidence', row_number() OVER (PARTITION BY user_id ORDER BY event_id), {SQL_MESSAGE} FROM events WHERE event_type = 'purchase'
UNION ALL SELECT case_id, 'timeline', row_number() OVER (PARTITION BY case_id ORDER BY seq), content FROM ({_SQL_TIMELINE}) WHERE marked OR type IN ('note', 'evidence')""")
def reports(spark, sf):
    folder = fresh_folder(spark, "report")
    write_report(case_report(cases(spark, sf), timeline(spark, sf), evidence(spark, sf)), folder)
    rows = spark.read.schema("section string, number bigint, at timestamp, body string, case_id string").json(folder)
    text = F.coalesce(*[F.get_json_object("body", f"$.{k}") for k in ("title", "message", "content")])
    return rows.select("case_id", "section", "number", text.alias("text"))


@query("union_sources", f"""
SELECT event_id, {SQL_MESSAGE} AS message, 'local' AS source_type, '/events' AS source_uri FROM events""")
def unions(spark, sf):
    logs = entries(spark, sf)
    errors = logs.filter(F.col("source") == "/events/error")
    rest = logs.filter(F.col("source") != "/events/error")
    both = with_provenance(errors.unionByName(rest, allowMissingColumns=True), {"type": "local", "uri": "/events"})
    return both.select(F.col("line_no").alias("event_id"), "message", "source_type", "source_uri")


_SQL_RFC3339 = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
  ELSE '.' || rtrim(strftime(ts, '%f'), '0') END || 'Z'"""


@query("export_json", f"""
SELECT {_SQL_RFC3339} AS timestamp, 'user-' || user_id AS stream, '/events/' || event_type AS source, {SQL_MESSAGE} || chr(10) || 'x' AS message,
       'file:///events/' || event_type || '#' || event_id AS ptr, event_type AS action
FROM events""")
def exported_json(spark, sf):
    folder = fresh_folder(spark, "json")
    write_entries(entries(spark, sf).withColumn("message", F.concat("message", F.lit("\nx"))), folder, "json")
    rows = spark.read.schema("timestamp string, stream string, source string, message string, ptr string, fields map<string,string>").json(folder)
    return rows.select("timestamp", "stream", "source", "message", "ptr", F.col("fields")["action"].alias("action"))


@query("export_csv", f"""
SELECT {_SQL_RFC3339} AS timestamp, 'user-' || user_id AS stream, '/events/' || event_type AS source, {SQL_MESSAGE} || chr(10) || '"q", x' AS message,
       'file:///events/' || event_type || '#' || event_id AS ptr
FROM events""")
def exported_csv(spark, sf):
    folder = fresh_folder(spark, "csv")
    write_entries(entries(spark, sf).withColumn("message", F.concat("message", F.lit('\n"q", x'))), folder, "csv")
    return read_csv_export(spark, folder, "timestamp string, stream string, source string, message string, ptr string")


@query("export_nested", f"""
SELECT {_SQL_RFC3339} AS timestamp, {SQL_MESSAGE} AS message, event_type AS action, json_extract_string(props, '$.k') AS k FROM events""")
def nested(spark, sf):
    rows = to_export(entries(spark, sf))
    return rows.select("timestamp", "message", F.col("fields")["action"].alias("action"), F.col("fields")["k"].alias("k"))


@query("export_catalogs", f"""
SELECT 'stream' AS kind, 'user-' || user_id AS name, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS detail FROM events GROUP BY user_id
UNION ALL SELECT 'group', name, stored_bytes || ' ' || retention_days || ' ' || strftime(created, '%Y-%m-%dT%H:%M:%SZ') FROM ({_SQL_GROUPS})
UNION ALL SELECT DISTINCT 'metric', event_type, 'shard=' || user_id % 3 FROM events
UNION ALL SELECT 'point', strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%dT%H:%M:%SZ'), CAST(count(*) AS VARCHAR) || '.000000' FROM events WHERE event_type = 'error' GROUP BY 2""")
def catalogs(spark, sf):
    folder = fresh_folder(spark, "catalogs")
    points = metrics(spark, sf)
    write_streams(list_streams(entries(spark, sf), limit=None), f"{folder}/streams", "json")
    write_groups(_groups(spark, sf), f"{folder}/groups", "csv")
    write_catalog(metric_catalog(points), f"{folder}/catalog", "csv")
    write_series(metric_stats(points, "app/events", "error", stat="count", period="1 day"), f"{folder}/series", "csv")
    streams = spark.read.schema("name string, lastTime string, firstTime string, size bigint").json(f"{folder}/streams")
    groups = read_csv_export(spark, f"{folder}/groups", "name string, storedBytes bigint, retentionDays int, creationTime string")
    names = read_csv_export(spark, f"{folder}/catalog", "namespace string, metricName string, dimensions string")
    series = read_csv_export(spark, f"{folder}/series", "timestamp string, value string, unit string")
    kind = lambda k: F.lit(k).alias("kind")
    return (
        streams.select(kind("stream"), "name", F.col("lastTime").alias("detail"))
        .union(groups.select(kind("group"), "name", F.concat_ws(" ", "storedBytes", "retentionDays", "creationTime")))
        .union(names.select(kind("metric"), "metricName", "dimensions"))
        .union(series.select(kind("point"), "timestamp", "value"))
    )


@query("export_evidence", f"""
SELECT 'case-' || user_id AS case_id, 'file:///events/purchase#' || event_id AS ptr, {SQL_MESSAGE} AS message, event_type AS action
FROM events WHERE event_type = 'purchase'""")
def exported_evidence(spark, sf):
    folder = fresh_folder(spark, "evidence")
    write_evidence(evidence(spark, sf), folder)
    rows = spark.read.schema("case_id string, ptr string, message string, raw_fields map<string,string>").json(folder)
    return rows.select("case_id", "ptr", "message", F.col("raw_fields")["action"].alias("action"))


@query("audit_append", f"""
WITH u AS (SELECT user_id, max(event_id) AS used FROM events GROUP BY user_id)
SELECT case_id, seq, type, content FROM ({_SQL_TIMELINE})
UNION ALL SELECT 'case-' || user_id, used + row_number() OVER (PARTITION BY user_id ORDER BY event_id),
  CASE WHEN event_type = 'signup' THEN 'note' ELSE 'query' END, CASE WHEN event_type = 'signup' THEN 'seen' ELSE '' END
FROM events JOIN u USING (user_id) WHERE event_type IN ('signup', 'click')""")
def audited(spark, sf):
    folder = fresh_folder(spark, "timeline")
    known = timeline(spark, sf)
    append_timeline(known, folder)
    runs = table(spark, sf, "events").filter("event_type IN ('signup', 'click')").select(
        F.concat(F.lit("case-"), "user_id").alias("case_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", "seen").alias("content"),
    )
    append_timeline(audit_rows(runs, known), folder)
    rows = spark.read.schema(known.schema).parquet(folder)
    return rows.select("case_id", "seq", "type", F.coalesce("content", F.lit("")).alias("content"))


@query("export_catalogs_other", f"""
SELECT 'stream' AS kind, 'user-' || user_id AS name, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS detail FROM events GROUP BY user_id
UNION ALL SELECT 'group', name, stored_bytes || ' ' || CASE WHEN retention_days <> 0 THEN CAST(retention_days AS VARCHAR) ELSE '-' END FROM ({_SQL_GROUPS})
UNION ALL SELECT DISTINCT 'metric', event_type, CAST(user_id % 3 AS VARCHAR) FROM events
UNION ALL SELECT 'point', strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%dT%H:%M:%SZ'), 'error ' || CAST(count(*) AS VARCHAR) FROM events WHERE event_type = 'error' GROUP BY 2""")
def catalogs_other(spark, sf):
    """The catalogues in the formats that ``export_catalogs`` does not write."""
    folder = fresh_folder(spark, "catalogs")
    points = metrics(spark, sf)
    write_streams(list_streams(entries(spark, sf), limit=None), f"{folder}/streams", "csv")
    write_groups(_groups(spark, sf), f"{folder}/groups", "json")
    write_catalog(metric_catalog(points), f"{folder}/catalog", "json")
    write_series(metric_stats(points, "app/events", "error", stat="count", period="1 day"), f"{folder}/series", "json", metricName="error")
    streams = read_csv_export(spark, f"{folder}/streams", "name string, lastTime string, firstTime string, size bigint")
    groups = spark.read.schema("name string, storedBytes bigint, retentionDays int").json(f"{folder}/groups")
    names = spark.read.schema("metricName string, dimensions map<string,string>").json(f"{folder}/catalog")
    series = spark.read.schema("metricName string, timestamp string, value double").json(f"{folder}/series")
    kind = lambda k: F.lit(k).alias("kind")
    return (
        streams.select(kind("stream"), "name", F.col("lastTime").alias("detail"))
        .union(groups.select(kind("group"), "name", F.concat_ws(" ", "storedBytes", F.coalesce(F.col("retentionDays").cast("string"), F.lit("-")))))
        .union(names.select(kind("metric"), "metricName", F.col("dimensions")["shard"]))
        .union(series.select(kind("point"), "timestamp", F.concat_ws(" ", "metricName", F.col("value").cast("bigint"))))
    )
