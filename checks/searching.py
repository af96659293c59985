"""Queries: filters, order, context, pointers, names."""

from pyspark.sql import functions as F

from checks.inputs import SQL_MESSAGE, entries, event_message, micros, numbered_lines, table
from checks.parsing import _FILE, _written_lines
from checks.registry import query
from logloom.functions.pointers import make_s3_ptr, parse_ptr, parse_s3_ptr, ptr_type, short_ptr
from logloom.operators.aggregates import list_streams, result_count
from logloom.operators.around import around, around_many, around_segments
from logloom.operators.context import with_context, with_time_context
from logloom.operators.filters import by_name, contains_any, field_equals, grep, time_range
from logloom.operators.lookup import get_records, lookup_provenance, missing_ptrs, resolve_ptrs
from logloom.operators.projections import default_fields
from logloom.operators.ranking import dedup_events, keep_latest, newest, result_index
from logloom.operators.similar import similar_names
from logloom.plans.query import query_logs
from logloom.session import fresh_folder
from logloom.sources.address import open_source
from logloom.sources.textindex import search_indexed, write_text_index


@query("time_range_filter", f"""
SELECT event_id, epoch_us(ts) AS ts_us FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' OR event_type = 'signup'""")
def time_range_filter(spark, sf):
    df = entries(spark, sf).withColumn("at", F.col("timestamp"))
    df = df.withColumn("timestamp", F.when(F.col("source") != "/events/signup", F.col("timestamp")))
    kept = time_range(df, "2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z")
    return kept.select(F.col("line_no").alias("event_id"), micros("at").alias("ts_us"))


@query("regex_filter", r"""
SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)é[a-z]+ (de|la|un)\b|erst$')""")
def regex_filter(spark, sf):
    return grep(table(spark, sf, "documents"), r"é[a-z]+ (de|la|un)\b|erst$", "text").select("doc_id", "lang")


@query("regex_indexed", """
SELECT event_id FROM events WHERE user_id % 16 = 3 AND event_type IN ('click', 'purchase')""")
def regex_indexed(spark, sf):
    """Files by user; the index says which of them can hold the pattern's letters."""
    folder, index = fresh_folder(spark, "files"), fresh_folder(spark, "index")
    part = F.col("user_id") % 16
    line = F.concat(event_message(), F.lit(" at shard-"), F.conv((part + 2748).cast("string"), 10, 16), F.lit(" #"), "event_id")
    rows = table(spark, sf, "events").select(part.alias("part"), line.alias("value"))
    rows.repartition("part").write.partitionBy("part").text(folder)
    logs = open_source(spark, f"{folder}/*", format="plain")
    write_text_index(logs, index)
    found = search_indexed(logs, index, "(CLICK|pur.hase) .* at SHARD-abf", numbered=False)
    return found.select(F.regexp_extract("message", "#([0-9]+)", 1).cast("int").alias("event_id"))


@query("contains_any", """
SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'the of') OR contains(text, '@')""")
def any_term(spark, sf):
    return contains_any(table(spark, sf, "documents"), " license | the   of||@", "text").select("doc_id")


@query("field_filter", "SELECT event_id FROM events WHERE event_type = 'purchase'")
def field_filter(spark, sf):
    return field_equals(entries(spark, sf), "action", "purchase").select(F.col("line_no").alias("event_id"))


@query("result_count", "SELECT count(*) AS results FROM events WHERE event_type IN ('error', 'click')")
def count_results(spark, sf):
    return result_count(grep(entries(spark, sf), "^(ERROR|click) "))


@query("newest_topk", f"""
SELECT epoch_us(ts) AS ts_us, {SQL_MESSAGE} AS message, 'user-' || user_id AS stream, 'file:///events/' || event_type || '#' || event_id AS ptr
FROM events ORDER BY ts DESC, event_type, event_id LIMIT 500""")
def newest_topk(spark, sf):
    kept = default_fields(newest(entries(spark, sf)))
    return kept.select(micros().alias("ts_us"), "message", "stream", "ptr")


@query("query_text", f"""
WITH n AS (
  SELECT *, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS line_no FROM events
)
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, line_no, epoch_us(date_trunc('millisecond', ts)) AS ts_us, {SQL_MESSAGE} AS message
FROM n WHERE ts >= TIMESTAMP '2024-01-03' AND regexp_matches({SQL_MESSAGE}, '(error|view) .*7$')
ORDER BY date_trunc('millisecond', ts) DESC, event_type, line_no LIMIT 500""")
def query_text(spark, sf):
    # The lines of the first file are plain; those that begin with "error" look like Java.
    source = open_source(spark, f"{_written_lines(spark, sf)}/*/*", scope="first")
    found = query_logs(source, start="2024-01-03T00:00:00Z", pattern="(error|VIEW) .*7$")
    return found.select(
        F.regexp_extract("source", _FILE, 1).alias("event_type"), F.regexp_extract("source", _FILE, 2).alias("day"),
        "line_no", micros().alias("ts_us"), "message",
    )


@query("query_text_context", f"""
WITH n AS (
  SELECT *, row_number() OVER w AS line_no,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' || {SQL_MESSAGE} AS line
  FROM events WINDOW w AS (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id)
), c AS (
  SELECT *, coalesce(lag(line, 2) OVER w || '|', '') || coalesce(lag(line, 1) OVER w, '') AS before_text,
         coalesce(lead(line, 1) OVER w, '') AS after_text
  FROM n WINDOW w AS (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id)
)
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, line_no, before_text, after_text
FROM c WHERE event_type = 'error' ORDER BY date_trunc('millisecond', ts) DESC, event_type, line_no LIMIT 500""")
def query_text_context(spark, sf):
    source = open_source(spark, f"{_written_lines(spark, sf)}/*/*", format="plain")
    found = query_logs(source, pattern="^error", before=2, after=1)
    text = lambda side: F.array_join(F.transform(F.col(f"context.{side}"), lambda e: e["message"]), "|")
    return found.select(
        F.regexp_extract("source", _FILE, 1).alias("event_type"), F.regexp_extract("source", _FILE, 2).alias("day"),
        "line_no", text("before").alias("before_text"), text("after").alias("after_text"),
    )


@query("line_context", f"""
WITH l AS (
  SELECT '/v/part-' || user_id % 8 || '.log' AS source, event_type, {SQL_MESSAGE} AS line,
         row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS line_no FROM events
), c AS (
  SELECT *, coalesce(lag(line, 2) OVER w || '|', '') || coalesce(lag(line, 1) OVER w, '') AS before_text,
         coalesce(lead(line, 1) OVER w, '') || coalesce('|' || lead(line, 2) OVER w, '') AS after_text
  FROM l WINDOW w AS (PARTITION BY source ORDER BY line_no)
)
SELECT source, line_no, before_text, after_text FROM c WHERE event_type = 'error'""")
def line_context(spark, sf):
    lines = numbered_lines(spark, sf)
    matches = lines.filter(F.col("line").startswith("error")).select("source", "line_no", F.col("line").alias("message"))
    found = with_context(matches, lines.select("source", "line_no", "line"), 2, 2)
    text = lambda side: F.array_join(F.transform(F.col(f"context.{side}"), lambda e: e["message"]), "|")
    return found.select("source", "line_no", text("before").alias("before_text"), text("after").alias("after_text"))


@query("time_context", f"""
WITH p AS (
  SELECT m.event_id, e.event_id AS other, e.ts, row_number() OVER (PARTITION BY m.event_id ORDER BY e.ts DESC, e.event_id DESC) AS rn
  FROM events m JOIN events e ON m.user_id = e.user_id
   AND e.ts BETWEEN m.ts - INTERVAL 36 HOUR AND m.ts - INTERVAL 1 MILLISECOND
  WHERE m.event_type = 'error'
), t AS (SELECT event_id, string_agg(other, ' ' ORDER BY ts) AS seen FROM p WHERE rn <= 3 GROUP BY event_id)
SELECT e.event_id, coalesce(seen, '') AS seen FROM events e LEFT JOIN t USING (event_id) WHERE event_type = 'error'""")
def time_context(spark, sf):
    logs = entries(spark, sf).withColumn("message", F.col("line_no").cast("string"))
    matches = logs.filter(F.col("source") == "/events/error")
    found = with_time_context(matches, logs, 3, "36h")
    seen = F.array_join(F.transform("context.before", lambda e: e["message"]), " ")
    return found.select(F.col("line_no").alias("event_id"), seen.alias("seen"))


@query("around_anchor", """
SELECT event_id FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-15 06:00:00' AND TIMESTAMP '2024-01-15 18:00:00' AND event_type IN ('error', 'view')
ORDER BY ts DESC, event_id LIMIT 200""")
def around_anchor(spark, sf):
    found = around(entries(spark, sf), "2024-01-15T12:00:00Z", "6h", "error|view")
    return found.select(F.col("line_no").alias("event_id"))


@query("around_many", """
WITH n AS (
  SELECT a.event_id AS anchor_id, e.event_id,
         row_number() OVER (PARTITION BY a.event_id ORDER BY e.ts DESC, 'file:///events/' || e.event_type || '#' || e.event_id DESC) AS rn
  FROM events a JOIN events e ON e.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts + INTERVAL 5 MINUTE
  WHERE a.event_type = 'error')
SELECT anchor_id, event_id FROM n WHERE rn <= 3""")
def around_anchors(spark, sf):
    logs = entries(spark, sf)
    anchors = logs.filter(F.col("source") == "/events/error").select(
        F.col("line_no").alias("anchor_id"), F.col("timestamp").alias("anchor_ts")
    )
    return around_many(logs, anchors, "5m", limit=3).select("anchor_id", F.col("line_no").alias("event_id"))


@query("around_many_all", """
SELECT a.event_id AS anchor_id, e.event_id FROM events a JOIN events e ON e.ts BETWEEN a.ts - INTERVAL 90 SECOND AND a.ts + INTERVAL 90 SECOND
WHERE a.event_type = 'error' AND e.event_type <> 'view'""")
def around_anchors_all(spark, sf):
    logs = entries(spark, sf)
    anchors = logs.filter(F.col("source") == "/events/error").select(
        F.col("line_no").alias("anchor_id"), F.col("timestamp").alias("anchor_ts")
    )
    found = around_many(logs, anchors, "90s", "^(?:error|click|signup|purchase)", limit=None)
    return found.select("anchor_id", F.col("line_no").alias("event_id"))


@query("around_many_segments", """
WITH a AS (SELECT event_id, ts, ts - INTERVAL 20 SECOND AS low, ts + INTERVAL 20 SECOND AS high,
    CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) <= INTERVAL 40 SECOND THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type = 'error'),
  n AS (SELECT *, sum(fresh) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a),
  s AS (SELECT island, epoch_us(min(ts)) AS segment, min(low) AS low, max(high) AS high FROM n GROUP BY island)
SELECT 'anchor' AS kind, event_id, segment FROM n JOIN s USING (island)
UNION ALL SELECT 'entry', event_id, segment FROM events JOIN s ON ts BETWEEN low AND high WHERE event_type <> 'view'""")
def around_anchors_by_segment(spark, sf):
    """Every entry near an error once, however many errors it is near."""
    logs = entries(spark, sf)
    anchors = logs.filter(F.col("source") == "/events/error").select(F.col("line_no").alias("anchor_id"), F.col("timestamp").alias("anchor_ts"))
    tagged, members = around_segments(logs, anchors, "20s", "^(?:error|click|signup|purchase)")
    return members.select(F.lit("anchor").alias("kind"), F.col("anchor_id").alias("event_id"), "segment").unionByName(
        tagged.select(F.lit("entry").alias("kind"), F.col("line_no").alias("event_id"), "segment")
    )


@query("get_by_ptr", f"""
SELECT 'file:///events/' || event_type || '#' || event_id AS ptr, 'found' AS status, {SQL_MESSAGE} AS message FROM events WHERE event_type = 'error'
UNION ALL SELECT 'file:///events/gone#' || event_id, 'missing', '' FROM events WHERE event_type = 'click'""")
def get_by_ptr(spark, sf):
    logs = entries(spark, sf)
    gone = table(spark, sf, "events").filter("event_type = 'click'").select(
        F.concat(F.lit("file:///events/gone#"), "event_id").alias("ptr")
    )
    wanted = logs.filter(F.col("source") == "/events/error").select("ptr").unionByName(gone)
    found = get_records(logs, wanted).select("ptr", F.lit("found").alias("status"), "message")
    absent = missing_ptrs(logs, wanted).select("ptr", F.lit("missing").alias("status"), F.lit("").alias("message"))
    return found.unionByName(absent)


def _opaque(spark, sf):
    """Entries with a pointer of 64 hexadecimal digits."""
    ptr = F.sha2(F.concat(F.lit("e"), F.col("line_no").cast("string")), 256)
    return entries(spark, sf).withColumn("ptr", ptr)


_SQL_INDEX = """
WITH p AS (
  SELECT *, sha256('e' || event_id) AS ptr FROM events
), x AS (
  SELECT row_number() OVER (ORDER BY ts DESC, event_type, event_id) AS idx, ptr, event_type FROM p
  QUALIFY idx <= 500
)"""


@query("result_index", f"{_SQL_INDEX} SELECT idx, ptr, '/events/' || event_type AS source_uri FROM x")
def index_of_results(spark, sf):
    return result_index(_opaque(spark, sf)).select(F.col("idx").cast("bigint").alias("idx"), "ptr", "source_uri")


@query("resolve_all_ptrs", """
WITH p AS (SELECT sha256('e' || event_id) AS ptr FROM events),
  e AS (SELECT right(ptr, 12) AS term, count(*) AS matches, min(ptr) AS hit FROM p GROUP BY 1
    UNION ALL SELECT right(ptr, 2), count(*), min(ptr) FROM p GROUP BY 1)
SELECT '@' || term AS ref, CASE WHEN matches = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN matches = 1 THEN hit ELSE '' END AS ptr, matches FROM e""")
def resolve_all(spark, sf):
    """The endings of all pointers, a long one and a short one of each, among all pointers."""
    index = _opaque(spark, sf).select(F.col("line_no").cast("int").alias("idx"), "ptr")
    refs = index.select(F.explode(F.array(F.right("ptr", F.lit(12)), F.right("ptr", F.lit(2)))).alias("end")).select(F.concat(F.lit("@"), "end").alias("ref"))
    return resolve_ptrs(refs, index).select("ref", "status", F.coalesce("ptr", F.lit("")).alias("ptr"), "matches")


@query("resolve_ptrs", f"""{_SQL_INDEX}, r AS (
  SELECT '@' || right(ptr, 12) AS ref, right(ptr, 12) AS term, 0 AS n FROM x
  UNION SELECT 'z' || right(ptr, 2), 'z' || right(ptr, 2), 0 FROM x
  UNION SELECT CAST(idx AS VARCHAR), CAST(idx AS VARCHAR), idx FROM x
  UNION SELECT '@' || right(ptr, 1), right(ptr, 1), 0 FROM x
), m AS (
  SELECT ref, r.n, count(x.ptr) AS matches, min(x.ptr) AS hit FROM r LEFT JOIN x ON suffix(x.ptr, r.term) GROUP BY ref, r.n
), s AS (
  SELECT ref, CASE WHEN n > 0 THEN 'index' WHEN matches = 1 THEN 'resolved' WHEN matches > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
         matches, hit, n FROM m
  UNION ALL SELECT ptr, 'full', 1, ptr, 0 FROM x
)
SELECT ref, status, CASE status WHEN 'index' THEN (SELECT ptr FROM x WHERE idx = n) WHEN 'resolved' THEN hit WHEN 'full' THEN hit ELSE '' END AS ptr,
       CASE WHEN status IN ('full', 'index') THEN 1 ELSE matches END AS matches
FROM s""")
def resolve(spark, sf):
    index = result_index(_opaque(spark, sf))
    refs = index.select(F.explode(F.array(
        "ptr", F.concat(F.lit("@"), F.right("ptr", F.lit(12))), F.concat(F.lit("z"), F.right("ptr", F.lit(2))),
        F.col("idx").cast("string"), F.concat(F.lit("@"), F.right("ptr", F.lit(1))),
    )).alias("ref"))
    return resolve_ptrs(refs, index).select("ref", "status", F.coalesce("ptr", F.lit("")).alias("ptr"), "matches")


@query("ptr_provenance", f"""{_SQL_INDEX}
SELECT event_id, coalesce('/events/' || x.event_type, 'none') AS uri FROM p LEFT JOIN x USING (ptr)""")
def provenance(spark, sf):
    logs = _opaque(spark, sf)
    known = lookup_provenance(logs.select("ptr", F.col("line_no").alias("event_id")), result_index(logs))
    return known.select("event_id", F.coalesce("source_uri", F.lit("none")).alias("uri"))


@query("pointers", """
SELECT event_id, 'local' AS kind, '/events/' || event_type AS path, event_id AS line,
       event_type || '#' || event_id AS short, 's3://logs/' || event_type || '/' || user_id || '#' || event_id AS s3_ptr,
       event_type || '/' || user_id AS s3_key
FROM events""")
def pointers(spark, sf):
    logs = table(spark, sf, "events")
    ptr = F.concat(F.lit("file:///events/"), "event_type", F.lit("#"), "event_id")
    s3 = make_s3_ptr(F.lit("logs"), F.concat("event_type", F.lit("/"), "user_id"), F.col("event_id"))
    return logs.select(
        "event_id", ptr_type(ptr).alias("kind"), parse_ptr(ptr)["path"].alias("path"), parse_ptr(ptr)["line"].alias("line"),
        short_ptr(ptr).alias("short"), s3.alias("s3_ptr"), parse_s3_ptr(s3)["key"].alias("s3_key"),
    )


@query("dedup_events", """
SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type""")
def dedup(spark, sf):
    logs = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return dedup_events(logs.unionByName(logs), ("user_id", "event_type"), "event_id")


@query("keep_latest", """
SELECT user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50""")
def latest_rows(spark, sf):
    return keep_latest(table(spark, sf, "events"), "user_id", "ts", 50, "event_id").select("user_id", "event_id")


_NAMES = "SELECT DISTINCT p_name AS name FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region"


@query("similar_names", f"""
WITH names AS ({_NAMES}),
targets AS (SELECT DISTINCT upper(replace(replace(name, 'e', ''), '_1', '-2')) AS target FROM names),
d AS (SELECT target, name, levenshtein(lower(target), lower(name)) AS distance FROM targets CROSS JOIN names)
SELECT target, name, distance, row_number() OVER (PARTITION BY target ORDER BY distance, name) AS rank
FROM d WHERE distance <= 3 QUALIFY rank <= 3""")
def similar(spark, sf):
    names = (
        table(spark, sf, "part").select(F.col("p_name").alias("name"))
        .union(table(spark, sf, "nation").select("n_name")).union(table(spark, sf, "region").select("r_name"))
    )
    typo = F.upper(F.replace(F.replace("name", F.lit("e"), F.lit("")), F.lit("_1"), F.lit("-2")))
    return similar_names(names, names.select(typo.alias("target"))).select(
        "target", "name", F.col("distance").cast("bigint").alias("distance"), F.col("rank").cast("bigint").alias("rank")
    )


@query("similar_customers", """
WITH t AS (SELECT DISTINCT replace(c_name, 'Customer', 'Custmer') AS target FROM customer),
d AS (SELECT target, c_name AS name, levenshtein(lower(target), lower(c_name)) AS distance FROM t CROSS JOIN customer)
SELECT target, name, distance, row_number() OVER (PARTITION BY target ORDER BY distance, name) AS rank
FROM d WHERE distance <= 3 QUALIFY rank <= 3""")
def similar_customers(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    targets = names.select(F.replace("name", F.lit("Customer"), F.lit("Custmer")).alias("target"))
    return similar_names(names, targets).select(
        "target", "name", F.col("distance").cast("bigint").alias("distance"), F.col("rank").cast("bigint").alias("rank")
    )


@query("exact_name", "SELECT DISTINCT 'user-' || user_id AS name FROM events WHERE user_id = 7")
def exact_name(spark, sf):
    return by_name(list_streams(entries(spark, sf), limit=None), "user-7").select("name")
