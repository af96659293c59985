"""Queries: counts, metrics, discovery, listings."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from checks.inputs import SQL_MESSAGE, entries, metrics, micros, spread, table
from checks.registry import query
from logloom.fixed import STATISTICS
from logloom.functions.text import format_bytes
from logloom.operators.aggregates import (
    count_by_bucket, estimate_scan, list_groups, list_retention, list_streams, stats, total_estimate,
)
from logloom.operators.discover import discover_fields, discover_json_paths
from logloom.operators.metrics import metric_catalog, metric_names, metric_stats, with_spike_level
from logloom.operators.projections import dimension_text, order_stats_columns


@query("count_by_bucket", """
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS bucket_us, count(*) AS count
FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1""")
def bucket_counts(spark, sf):
    counts = count_by_bucket(entries(spark, sf), pattern="^(ERROR|PURCHASE) ", limit=None)
    return counts.select(micros("time_bucket").alias("bucket_us"), "count")


@query("count_by_bucket_top", """
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS bucket_us, count(*) AS count
FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 500""")
def bucket_counts_top(spark, sf):
    return count_by_bucket(entries(spark, sf)).select(micros("time_bucket").alias("bucket_us"), "count")


_SQL_STATS = {
    "Sum": "sum(value)", "Average": "avg(value)", "Minimum": "min(value)", "Maximum": "max(value)", "SampleCount": "count(value)",
}


@query("metric_stats", " UNION ALL ".join(
    f"""SELECT '{stat}' AS stat, event_type AS metric_name, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS ts_us,
    round(CAST({agg} AS DOUBLE), 4) AS value FROM events
    WHERE user_id % 3 = 1 AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 2, 3"""
    for stat, agg in _SQL_STATS.items()))
def all_stats(spark, sf):
    points = metrics(spark, sf)
    parts = [
        metric_stats(
            points, "app/events", None, ["shard=1"], stat, "1 hour", "14d", "2024-01-22T00:00:00Z", by=("metric_name",)
        ).select(F.lit(stat).alias("stat"), "metric_name", micros().alias("ts_us"), F.round("value", 4).alias("value"))
        for stat in STATISTICS
    ]
    return reduce(DataFrame.unionByName, parts)


@query("metric_series", """
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS ts_us, round(avg(value), 4) AS value, 'None' AS unit
FROM events WHERE event_type = 'error' GROUP BY 1""")
def one_series(spark, sf):
    series = metric_stats(metrics(spark, sf), "app/events", "error", stat="avg")
    return series.select(micros().alias("ts_us"), F.round("value", 4).alias("value"), "unit")


@query("metric_catalog", """
SELECT DISTINCT 'app/events' AS namespace, event_type AS metric_name, 'shard=' || user_id % 3 AS dimensions FROM events""")
def catalog(spark, sf):
    found = metric_catalog(metrics(spark, sf))
    return found.select("namespace", "metric_name", dimension_text(F.col("dimensions")).alias("dimensions"))


@query("metric_names", """
SELECT 'app/events' AS namespace, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS metric_names FROM events""")
def names_of_metrics(spark, sf):
    return metric_names(metrics(spark, sf)).select("namespace", F.array_join("metric_names", ",").alias("metric_names"))


@query("spike_level", """
WITH s AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS h, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1, 2),
r AS (SELECT event_type, h, v / max(v) OVER (PARTITION BY event_type) AS ratio FROM s)
SELECT event_type AS metric_name, epoch_us(h) AS ts_us, round(ratio, 6) AS ratio,
       CASE WHEN ratio > 0.8 THEN 'high' WHEN ratio > 0.5 THEN 'medium' ELSE 'low' END AS level,
       CAST(floor(ratio * 40) AS BIGINT) AS bar FROM r""")
def spikes(spark, sf):
    points = metrics(spark, sf).withColumn("value", F.round(F.col("value") * 100))
    series = metric_stats(points, "app/events", None, stat="Sum", period="1 hour", by=("metric_name",))
    return with_spike_level(series, ("metric_name",)).select(
        "metric_name", micros().alias("ts_us"), F.round("ratio", 6).alias("ratio"), "level", F.col("bar").cast("bigint").alias("bar")
    )


@query("stats_by_field", """
SELECT json_extract_string(props, '$.k') AS k, count(*) AS total, round(avg(length(event_type)), 6) AS avg
FROM events WHERE event_type = 'error' OR event_type = 'view' GROUP BY 1 HAVING count(*) > 3 ORDER BY total DESC, k LIMIT 20""")
def field_stats(spark, sf):
    logs = entries(spark, sf).filter(F.col("fields")["action"].isin("error", "view"))
    out = stats(
        logs, {"total": F.count(F.lit(1)), "avg": F.round(F.avg(F.length(F.col("fields")["action"])), 6)}, ["k"],
        having=F.col("total") > 3, sort="total", limit=20,
    )
    return order_stats_columns(out)


@query("discover_fields", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_type, event_id) AS rn FROM events)
SELECT 'action' AS name, 'custom' AS kind, count(*) AS count, min_by(event_type, rn) AS sample FROM n
UNION ALL SELECT '@k', 'system', count(*), min_by(json_extract_string(props, '$.k'), rn) FROM n WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def fields_found(spark, sf):
    logs = entries(spark, sf)
    renamed = F.transform_keys("fields", lambda k, v: F.when(k == "k", F.lit("@k")).otherwise(k))
    return discover_fields(logs.withColumn("fields", renamed), sample=None)


@query("discover_fields_sample", """
SELECT 'action' AS name, 'custom' AS kind, CAST(20 AS BIGINT) AS count, (SELECT event_type FROM events ORDER BY ts DESC LIMIT 1) AS sample
UNION ALL SELECT 'k', 'custom', 20, (SELECT json_extract_string(props, '$.k') FROM events ORDER BY ts DESC LIMIT 1)""")
def fields_in_sample(spark, sf):
    return discover_fields(entries(spark, sf))


@query("discover_json_paths", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS rn FROM events),
p AS (
  SELECT 'type' AS name, event_type AS v, rn FROM n
  UNION ALL SELECT 'user.id', CAST(user_id AS VARCHAR), rn FROM n
  UNION ALL SELECT 'user.tags[]', CASE WHEN user_id % 2 = 0 THEN '(empty array)' ELSE 'a' END, rn FROM n
  UNION ALL SELECT 'list[].k', json_extract_string(props, '$.k'), rn FROM n
  UNION ALL SELECT 'deep.a.b.c.d.e.f.g.h.i.j', 'null', rn FROM n WHERE event_type = 'error'
)
SELECT name, count(*) AS count, min_by(v, rn) AS sample FROM p GROUP BY name""")
def paths_found(spark, sf):
    deep = F.when(
        F.col("event_type") == "error", F.lit(',"deep":{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":null}}}}}}}}}}')
    ).otherwise("")
    tags = F.when(F.col("user_id") % 2 == 0, "[]").otherwise('["a","b"]')
    message = F.concat(
        F.lit(' {"type":"'), "event_type", F.lit('","user":{"id":'), "user_id", F.lit(',"tags":'), tags,
        F.lit('},"list":['), "props", F.lit(',{"z":2}],"none":{}'), deep, F.lit("}"),
    )
    logs = spread(table(spark, sf, "events")).select(
        F.col("ts").cast("timestamp").alias("timestamp"), message.alias("message"), F.col("event_id").alias("line_no")
    )
    return discover_json_paths(logs, sample=None)


@query("list_streams", f"""
SELECT 'user-' || user_id AS name, CAST(sum(octet_length(encode({SQL_MESSAGE}))) AS BIGINT) AS size,
       epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id""")
def streams(spark, sf):
    found = list_streams(entries(spark, sf), limit=None)
    return found.select("name", "size", micros("first_time").alias("first_us"), micros("last_time").alias("last_us"))


@query("list_streams_prefix", """
SELECT name FROM (SELECT 'user-' || user_id AS name, max(ts) AS last FROM events GROUP BY 1) WHERE starts_with(name, 'user-1')
ORDER BY last DESC LIMIT 20""")
def streams_by_prefix(spark, sf):
    return list_streams(entries(spark, sf), "user-1").select("name")


def _groups(spark, sf):
    kept = table(spark, sf, "events").select(
        F.concat(F.lit("/events/"), "event_type").alias("name"), (F.length("event_type") - 5).alias("retention_days")
    ).distinct()
    return list_groups(entries(spark, sf), kept, limit=None)


_SQL_GROUPS = f"""
SELECT '/events/' || event_type AS name, CAST(sum(octet_length(encode({SQL_MESSAGE}))) AS BIGINT) AS stored_bytes,
       min(ts) AS created, length(event_type) - 5 AS retention_days FROM events GROUP BY event_type"""


@query("list_groups", f"""
SELECT name, stored_bytes, epoch_us(created) AS created_us, retention_days,
       CASE WHEN retention_days > 0 THEN retention_days || ' days' ELSE 'Never expire' END AS retention FROM ({_SQL_GROUPS})""")
def groups(spark, sf):
    return _groups(spark, sf).select(
        "name", "stored_bytes", micros("creation_time").alias("created_us"), F.col("retention_days").cast("bigint").alias("retention_days"), "retention"
    )


@query("list_retention", f"""
SELECT name, CASE WHEN retention_days > 0 THEN retention_days || ' days' ELSE 'Never expire' END AS retention,
       CASE WHEN stored_bytes < 1024 THEN stored_bytes || ' B' WHEN stored_bytes < 1048576 THEN printf('%.1f KB', stored_bytes / 1024.0)
            ELSE printf('%.1f MB', stored_bytes / 1048576.0) END AS stored FROM ({_SQL_GROUPS})""")
def retention(spark, sf):
    kept = table(spark, sf, "events").select(
        F.concat(F.lit("/events/"), "event_type").alias("name"), (F.length("event_type") - 5).alias("retention_days")
    ).distinct()
    return list_retention(entries(spark, sf), kept)


_SQL_ESTIMATE = f"""
SELECT name, CAST(floor(stored_bytes * least(1.0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(TIMESTAMP '2024-01-13')) / (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created)))) AS BIGINT) AS estimated_bytes
FROM ({_SQL_GROUPS})"""


@query("estimate_scan", f"""
SELECT name, estimated_bytes, round(estimated_bytes / 1073741824.0 * 0.005, 12) AS estimated_cost,
       CASE WHEN estimated_bytes < 1024 THEN estimated_bytes || ' B' WHEN estimated_bytes < 1048576 THEN printf('%.1f KB', estimated_bytes / 1024.0)
            ELSE printf('%.1f MB', estimated_bytes / 1048576.0) END AS estimated_size
FROM ({_SQL_ESTIMATE})""")
def scan_estimates(spark, sf):
    found = estimate_scan(_groups(spark, sf), "2024-01-13T00:00:00Z", "2024-01-20T00:00:00Z", "2024-02-01T00:00:00Z")
    return found.select("name", "estimated_bytes", F.round("estimated_cost", 12).alias("estimated_cost"), "estimated_size")


@query("estimate_total", f"SELECT CAST(sum(estimated_bytes) AS BIGINT) AS estimated_bytes FROM ({_SQL_ESTIMATE})")
def scan_total(spark, sf):
    found = estimate_scan(_groups(spark, sf), "2024-01-13T00:00:00Z", "2024-01-20T00:00:00Z", "2024-02-01T00:00:00Z")
    return total_estimate(found).select("estimated_bytes")


@query("format_sizes", """
SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0)
  WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824.0)
  ELSE printf('%.1f TB', b / 1099511627776.0) END AS size
FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * o_orderkey * 64 AS BIGINT) AS b FROM orders)""")
def sizes(spark, sf):
    # The cube of a large key is no 64-bit number.
    key = F.col("o_orderkey").cast("decimal(38,0)")
    return table(spark, sf, "orders").select("o_orderkey", format_bytes(key * key * key * 64).alias("size"))


@query("estimate_total_users", f"""
SELECT CAST(sum(estimated_bytes) AS BIGINT) AS estimated_bytes FROM (
  SELECT CAST(floor(stored_bytes * least(1.0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(TIMESTAMP '2024-01-13')) / (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created)))) AS BIGINT) AS estimated_bytes
  FROM (SELECT user_id, CAST(sum(octet_length(encode({SQL_MESSAGE}))) AS BIGINT) AS stored_bytes, min(ts) AS created FROM events GROUP BY user_id))""")
def users_total(spark, sf):
    """A group per user: more groups than a listing shows."""
    groups = list_groups(entries(spark, sf).withColumn("source", F.col("stream")), limit=None)
    found = estimate_scan(groups, "2024-01-13T00:00:00Z", "2024-01-20T00:00:00Z", "2024-02-01T00:00:00Z")
    return total_estimate(found).select("estimated_bytes")
