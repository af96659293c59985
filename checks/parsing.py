"""Queries: reading lines and parsing them."""

from pyspark.sql import functions as F

from checks.inputs import SQL_MESSAGE, event_message, micros, rendered, spread, table
from checks.registry import query
from logloom.operators.aggregates import count_by_bucket
from logloom.operators.lookup import get_lines
from logloom.operators.multiline import fill_reference_date, join_multiline
from logloom.parsers.java import is_header
from logloom.parsers.registry import parse_lines
from logloom.session import fresh_folder
from logloom.sources.address import open_source
from logloom.sources.detect import detect_format
from logloom.sources.lineindex import write_index
from logloom.sources.lines import file_streams, read_lines
from logloom.sources.remote import from_field_rows


def _stamp(layout):
    return F.date_format("ts", layout)


def _case(by, options):
    out = None
    for i, value in enumerate(options):
        out = F.when(by == i, value) if out is None else out.when(by == i, value)
    return out


@query("parse_plain_lines", f"""
SELECT event_id + 1 AS line_no,
       CASE WHEN event_id % 10 IN (0, 2) THEN epoch_us(date_trunc('millisecond', ts))
            WHEN event_id % 10 = 9 THEN -1
            ELSE epoch_us(date_trunc('second', ts)) END AS ts_us,
       CASE WHEN event_id % 10 = 9 THEN 'at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' ELSE '' END
         || {SQL_MESSAGE} AS message
FROM events""")
def parse_plain_lines(spark, sf):
    m = event_message()
    epoch = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    line = _case(F.col("event_id") % 10, [
        F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z "), m),
        F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), m),
        F.concat(_stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), m),
        F.concat(_stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" "), m),
        F.concat(F.lit("["), _stamp("yyyy-MM-dd HH:mm:ss"), F.lit("] "), m),
        F.concat(F.lit("prog "), _stamp("yyyy-MM-dd HH:mm:ss"), F.lit(": "), m),
        F.concat(_stamp("MM/dd/yyyy HH:mm:ss"), F.lit(" "), m),
        F.concat(_stamp("dd-MM-yyyy HH:mm:ss"), F.lit(" "), m),
        F.concat(F.lit("["), epoch, F.lit("] "), m),
        F.concat(F.lit("at "), _stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" "), m),
    ])
    return parse_lines(rendered(spark, sf, line), "plain").select("line_no", micros().alias("ts_us"), "message")


@query("parse_json_lines", f"""
SELECT event_id + 1 AS line_no,
       CASE WHEN event_id % 4 IN (0, 1) THEN epoch_us(date_trunc('millisecond', ts))
            ELSE epoch_us(date_trunc('second', ts)) END AS ts_us,
       {SQL_MESSAGE} AS message, event_type AS level, CAST(user_id AS VARCHAR) AS user_text,
       replace(props, ' ', '') AS props, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'null' END AS flag
FROM events""")
def parse_json_lines(spark, sf):
    at = F.col("ts").cast("timestamp")
    stamp = _case(F.col("event_id") % 4, [
        F.concat(F.lit('"timestamp":"'), _stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('Z"')),
        F.concat(F.lit('"time":'), F.unix_millis(at)),
        F.concat(F.lit('"ts":'), F.unix_seconds(at)),
        F.concat(F.lit('"time":"soon","datetime":"'), _stamp("yyyy/MM/dd HH:mm:ss"), F.lit('"')),
    ])
    flag = F.when(F.col("user_id") % 2 == 0, "true").otherwise("null")
    line = F.concat(
        F.lit("{"), stamp, F.lit(',"level":"'), "event_type", F.lit('","msg":"'), event_message(),
        F.lit('","user":'), "user_id", F.lit(',"props":'), "props", F.lit(',"flag":'), flag, F.lit("}"),
    )
    f = F.col("fields")
    return parse_lines(rendered(spark, sf, line), "json").select(
        "line_no", micros().alias("ts_us"), "message", f["level"].alias("level"), f["user"].alias("user_text"),
        f["props"].alias("props"), f["flag"].alias("flag"),
    )


@query("parse_syslog_lines", f"""
SELECT event_id + 1 AS line_no,
       CASE event_id % 3 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(date_trunc('second', ts)) ELSE -1 END AS ts_us,
       CASE event_id % 3 WHEN 0 THEN '- ' WHEN 1 THEN '' ELSE 'plain ' END || {SQL_MESSAGE} AS message,
       CASE WHEN event_id % 3 < 2 THEN 'host' || user_id % 7 ELSE '' END AS hostname,
       CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 192 // 8 AS VARCHAR) ELSE '' END AS facility,
       CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 192 % 8 AS VARCHAR) ELSE '' END AS severity,
       CASE WHEN event_id % 3 = 1 THEN 'svc' ELSE '' END AS program,
       CASE WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) ELSE '' END AS pid
FROM events""")
def parse_syslog_lines(spark, sf):
    m, host = event_message(), F.concat(F.lit("host"), F.col("user_id") % 7)
    line = _case(F.col("event_id") % 3, [
        F.concat(F.lit("<"), F.col("user_id") % 192, F.lit(">1 "), _stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z "),
                 host, F.lit(" app 77 ID9 - "), m),
        F.concat(_stamp("MMM"), F.lit(" "), F.lpad(_stamp("d"), 2, " "), F.lit(" "), _stamp("HH:mm:ss"), F.lit(" "), host,
                 F.lit(" svc["), "user_id", F.lit("]: "), m),
        F.concat(F.lit("plain "), m),
    ])
    f = F.col("fields")
    get = lambda k: F.coalesce(f[k], F.lit("")).alias(k)
    return parse_lines(rendered(spark, sf, line), "syslog", year=2024).select(
        "line_no", micros().alias("ts_us"), "message", *[get(k) for k in ("hostname", "facility", "severity", "program", "pid")]
    )


def _trace_lines(spark, sf, header):
    """Header lines, and for errors a stack trace of four more lines, one of them blank."""
    trace = F.when(
        F.col("event_type") == "error",
        F.array(
            F.concat(F.lit("java.lang.IllegalStateException: event "), "event_id"),
            F.concat(F.lit("\tat app.Worker.run(Worker.java:"), F.col("user_id"), F.lit(")")),
            F.lit(""),
            F.lit("Caused by: \x1b[31mjava.io.IOException\x1b[0m: gone"),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return spread(table(spark, sf, "events")).select(
        F.concat(F.lit("/v/app-"), F.col("user_id") % 4, F.lit(".log")).alias("source"),
        "event_id",
        F.posexplode(F.concat(F.array(header), trace)).alias("i", "line"),
    ).select("source", (F.col("event_id") * 10 + F.col("i") + 1).alias("line_no"), "line")


_SQL_TRACE = r"""CASE WHEN event_type = 'error'
  THEN chr(10) || 'java.lang.IllegalStateException: event ' || event_id || chr(10) || chr(9) || 'at app.Worker.run(Worker.java:' || user_id || ')'
       || chr(10) || chr(10) || 'Caused by: java.io.IOException: gone' ELSE '' END"""


def _header():
    m = event_message()
    return _case(F.col("event_id") % 6, [
        F.concat(_stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO [main] app.Job - "), m),
        F.concat(_stamp("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" [w-1] WARN app.Job - "), m),
        F.concat(_stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" [w-2] DEBUG app.Job - "), m),
        F.concat(_stamp("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ERROR "), m),
        F.concat(F.lit("\x1b[32m"), _stamp("yyyy-MM-dd HH:mm:ss"), F.lit("\x1b[0m TRACE "), m),
        F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z FATAL "), m),
    ])


@query("parse_java_multiline", f"""
SELECT '/v/app-' || user_id % 4 || '.log' AS source, event_id * 10 + 1 AS line_no,
       CASE WHEN event_id % 6 IN (2, 4) THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(date_trunc('millisecond', ts)) END AS ts_us,
       ['INFO', 'WARN', 'DEBUG', 'ERROR', 'TRACE', 'FATAL'][event_id % 6 + 1] AS level,
       ['main', 'w-1', 'w-2', '', '', ''][event_id % 6 + 1] AS thread,
       CASE WHEN event_id % 6 < 3 THEN 'app.Job' ELSE '' END AS logger,
       {SQL_MESSAGE} || {_SQL_TRACE} AS message
FROM events""")
def parse_java_multiline(spark, sf):
    f = F.col("fields")
    parsed = parse_lines(_trace_lines(spark, sf, _header()), "java", chunk_lines=50_000, default_date="2020-01-01")
    return parsed.select(
        "source", "line_no", micros().alias("ts_us"),
        *[F.coalesce(f[k], F.lit("")).alias(k) for k in ("level", "thread", "logger")], "message",
    )


@query("join_multiline", f"""
SELECT '/v/app-' || user_id % 4 || '.log' AS source, event_id * 10 + 1 AS line_no,
       strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || {SQL_MESSAGE} || replace({_SQL_TRACE},
         'java.io.IOException:', chr(27) || '[31mjava.io.IOException' || chr(27) || '[0m:') AS message
FROM events""")
def join_lines(spark, sf):
    header = F.concat(_stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), event_message())
    return join_multiline(_trace_lines(spark, sf, header), is_header(F.col("line")), 20_000)


@query("reference_date_fill", """
WITH d AS (
  SELECT *, '/v/app-' || user_id % 4 || '.log' AS source FROM events
), f AS (
  SELECT *, last_value(CASE WHEN event_id % 5 = 0 THEN CAST(ts AS DATE) END IGNORE NULLS)
         OVER (PARTITION BY source ORDER BY event_id) AS day FROM d
)
SELECT event_id + 1 AS line_no,
       epoch_us(coalesce(day, DATE '2023-12-31') + CAST(date_trunc('millisecond', ts) AS TIME)) AS ts_us,
       CASE WHEN event_id % 5 = 0 THEN 'INFO' ELSE 'WARN' END AS level
FROM f""")
def reference_date_fill(spark, sf):
    line = F.when(
        F.col("event_id") % 5 == 0, F.concat(_stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO "), event_message())
    ).otherwise(F.concat(_stamp("HH:mm:ss,SSS"), F.lit(" |-WARN in "), event_message()))
    parsed = parse_lines(rendered(spark, sf, line), "java", chunk_lines=50_000, default_date="2023-12-31")
    return parsed.select("line_no", micros().alias("ts_us"), F.col("fields")["level"].alias("level"))


@query("carry_forward", """
WITH d AS (SELECT *, '/v/app-' || user_id % 4 || '.log' AS source FROM events)
SELECT event_id + 1 AS line_no, strftime(coalesce(last_value(CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END IGNORE NULLS)
       OVER (PARTITION BY source ORDER BY event_id), DATE '2023-12-31'), '%Y-%m-%d') AS filled FROM d""")
def carry_forward(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("/v/app-"), F.col("user_id") % 4, F.lit(".log")).alias("source"),
        (F.col("event_id") + 1).alias("line_no"),
        F.when(F.col("event_type") == "error", F.to_date("ts")).alias("day"),
    )
    filled = fill_reference_date(rows, "2023-12-31", 50_000)
    return filled.select("line_no", F.col("filled").cast("string").alias("filled"))


def _written_lines(spark, sf):
    """Events as text files, one per event type and day, in event order."""
    folder = fresh_folder(spark, "lines")
    (
        table(spark, sf, "events")
        .select("event_type", F.to_date("ts").alias("day"), "event_id",
                F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z "), event_message()).alias("value"))
        .repartition("event_type", "day")
        .sortWithinPartitions("event_type", "day", "event_id")
        .select("event_type", "day", "value")
        .write.partitionBy("event_type", "day").text(folder)
    )
    return folder


_FILE = "event_type=([a-z]+)/day=([0-9-]+)/"


@query("read_files", f"""
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day,
       row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS line_no,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' || {SQL_MESSAGE} AS line
FROM events""")
def read_files(spark, sf):
    lines = read_lines(spark, f"{_written_lines(spark, sf)}/*/*")
    return lines.select(
        F.regexp_extract("source", _FILE, 1).alias("event_type"), F.regexp_extract("source", _FILE, 2).alias("day"),
        "line_no", "line",
    )


@query("open_and_parse", f"""
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day,
       row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS line_no,
       epoch_us(date_trunc('millisecond', ts)) AS ts_us, {SQL_MESSAGE} AS message
FROM events""")
def open_and_parse(spark, sf):
    folder = _written_lines(spark, sf)
    source = open_source(spark, "@app", {"app": {"uri": f"{folder}/*/*", "format": "plain"}})
    return source.entries().select(
        F.regexp_extract("source", _FILE, 1).alias("event_type"), F.regexp_extract("source", _FILE, 2).alias("day"),
        "line_no", micros().alias("ts_us"), "message",
    )


@query("detect_format", """
SELECT DISTINCT '/v/u' || user_id || '.log' AS source, ['json', 'java', 'syslog', 'plain'][user_id % 4 + 1] AS format
FROM events""")
def detect(spark, sf):
    m = event_message()
    line = _case(F.col("user_id") % 4, [
        F.concat(F.lit('  {"message":"'), m, F.lit('"}')),
        F.concat(_stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO "), m),
        F.concat(_stamp("MMM"), F.lit(" "), _stamp("d"), F.lit(" "), _stamp("HH:mm:ss"), F.lit(" host "), m),
        F.concat(F.lit("note "), m),
    ])
    return detect_format(rendered(spark, sf, line, F.concat(F.lit("/v/u"), "user_id", F.lit(".log"))))


@query("field_rows", f"""
SELECT event_id AS row_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE epoch_us(date_trunc('millisecond', ts)) END AS ts_us,
       {SQL_MESSAGE} AS message, 'user-' || user_id AS stream, 'ptr-' || event_id AS ptr, event_type AS action
FROM events""")
def field_rows(spark, sf):
    stamp = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(_stamp("yyyy-MM-dd HH:mm:ss.SSS"))
    cells = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in (
                ("@timestamp", stamp), ("@message", event_message()), ("@logStream", F.concat(F.lit("user-"), "user_id")),
                ("@ptr", F.concat(F.lit("ptr-"), "event_id")), ("action", F.col("event_type")),
                ("empty", F.lit(None).cast("string")),
            )
        ])).alias("cell"),
    ).select("row_id", "cell.*")
    return from_field_rows(cells, "/app").select(
        "row_id", micros().alias("ts_us"), "message", "stream", "ptr", F.col("fields")["action"].alias("action")
    )


def _mixed(spark, sf):
    """Events as files of four formats in one folder, chosen by the user."""
    folder = fresh_folder(spark, "mixed")
    m = event_message()
    line = _case(F.col("user_id") % 4, [
        F.concat(F.lit('{"message":"'), m, F.lit('","time":'), F.unix_millis(F.col("ts").cast("timestamp")), F.lit("}")),
        F.concat(_stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO "), m),
        F.concat(_stamp("MMM"), F.lit(" "), _stamp("dd"), F.lit(" "), _stamp("HH:mm:ss"), F.lit(" host "), m),
        F.concat(F.lit("note "), m),
    ])
    rows = table(spark, sf, "events").select((F.col("user_id") % 4).alias("form"), (F.col("user_id") % 8).alias("part"), line.alias("value"))
    rows.repartition("form", "part").write.partitionBy("form", "part").text(folder)
    return f"{folder}/*/*"


@query("mixed_formats", f"""
SELECT CASE WHEN user_id % 4 = 3 THEN 'note ' ELSE '' END || {SQL_MESSAGE} AS message,
       CASE user_id % 4 WHEN 3 THEN -1 WHEN 2 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(date_trunc('millisecond', ts)) END AS ts_us
FROM events""")
def mixed_formats(spark, sf):
    found = open_source(spark, _mixed(spark, sf), year=2024).entries()
    return found.select("message", micros().alias("ts_us"))


@query("count_text_buckets", """
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, date_trunc('second', ts))) AS bucket_us, count(*) AS count
FROM events WHERE user_id % 4 <> 3 AND event_type IN ('error', 'click') GROUP BY 1""")
def count_text(spark, sf):
    logs = open_source(spark, _mixed(spark, sf), year=2024).entries(numbered=False)
    found = count_by_bucket(logs, pattern="^(error|click) ", limit=None)
    return found.select(micros("time_bucket").alias("bucket_us"), "count")


@query("read_list", """
SELECT 'part=' || user_id % 8 AS part, count(*) AS lines FROM events WHERE user_id % 8 IN (1, 3) AND user_id % 4 IN (1, 3) GROUP BY 1""")
def read_list(spark, sf):
    """A list of files, one of which does not exist."""
    folder = _mixed(spark, sf).removesuffix("/*/*")
    asked = [f"{folder}/form=1/part=1/*", f"{folder}/form=3/part=3/*", f"{folder}/form=9/gone.log"]
    found = read_lines(spark, asked, skip_missing=True)
    return found.groupBy(F.regexp_extract("source", "(part=[0-9])", 1).alias("part")).agg(F.count("*").alias("lines"))


@query("list_files", """
SELECT 'form=' || user_id % 4 || '/part=' || user_id % 8 AS file, CAST(sum(strlen(CASE user_id % 4
  WHEN 0 THEN '{"message":"' || m || '","time":' || epoch_ms(ts) || '}' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ',000 INFO ' || m
  WHEN 2 THEN strftime(ts, '%b %d %H:%M:%S') || ' host ' || m ELSE 'note ' || m END) + 1) AS BIGINT) AS size
FROM (SELECT *, """ + SQL_MESSAGE + """ AS m FROM events) GROUP BY 1""")
def list_files(spark, sf):
    name = F.regexp_extract("name", "(form=[0-9]/part=[0-9])", 1)
    return file_streams(spark, _mixed(spark, sf)).groupBy(name.alias("file")).agg(F.sum("size").cast("bigint").alias("size"))


@query("get_lines", f"""
SELECT {SQL_MESSAGE} AS message, epoch_us(date_trunc('millisecond', ts)) AS ts_us FROM events WHERE event_id < 50 AND user_id % 4 = 0""")
def lines_by_pointer(spark, sf):
    """Pointers into real files, of the first events, read back line by line."""
    rows = open_source(spark, _mixed(spark, sf), year=2024).entries()
    first = table(spark, sf, "events").filter("event_id < 50 AND user_id % 4 = 0").select(event_message().alias("message"), F.col("ts").cast("timestamp").alias("at"))
    asked = rows.join(first, "message").filter(F.date_trunc("millisecond", "at") == F.col("timestamp")).select("ptr").distinct()
    # As many as the caller lists: fifty at most.
    found = get_lines(spark, [r["ptr"] for r in asked.collect()], "json")
    return found.select("message", micros().alias("ts_us"))


@query("get_lines_indexed", f"""
SELECT {SQL_MESSAGE} AS message, epoch_us(date_trunc('millisecond', ts)) AS ts_us FROM events WHERE event_id % 500 < 2 AND user_id % 4 = 0""")
def lines_by_index(spark, sf):
    """Pointers into files of all events, read back through a stored index of line numbers."""
    folder, index = _mixed(spark, sf), fresh_folder(spark, "lines")
    write_index(spark, folder, index, split_bytes=1 << 16)
    rows = open_source(spark, folder, year=2024).entries()
    few = table(spark, sf, "events").filter("event_id % 500 < 2 AND user_id % 4 = 0").select(event_message().alias("message"), F.col("ts").cast("timestamp").alias("at"))
    asked = rows.join(few, "message").filter(F.date_trunc("millisecond", "at") == F.col("timestamp")).select("ptr").distinct()
    found = get_lines(spark, [r["ptr"] for r in asked.collect()], "json", index)
    return found.select("message", micros().alias("ts_us"))


@query("parse_json_odd_lines", """
SELECT event_id + 1 AS line_no, CASE event_id % 8 WHEN 2 THEN epoch_us(date_trunc('second', ts)) ELSE -1 END AS ts_us,
  CASE event_id % 8 WHEN 0 THEN 'big' WHEN 1 THEN 'small' WHEN 2 THEN 'odd'
    WHEN 3 THEN '{''message'': ''x'', ''ts'': 1}' WHEN 4 THEN '{"message":"n","a":NaN}' WHEN 5 THEN 'm' WHEN 6 THEN '{message:"x"}' ELSE 'tail' END AS message,
  CASE event_id % 8 WHEN 5 THEN '{"b":' || event_id || '}' ELSE '' END AS a
FROM events""")
def odd_json(spark, sf):
    n = F.col("event_id")
    line = _case(n % 8, [
        F.lit('{"ts":100000000000000000,"msg":"big"}'), F.lit('{"ts":-1000000000000000,"msg":"small"}'),
        F.concat(F.lit('{"ts":'), F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(',"msg":"odd"}')),
        F.lit("{'message': 'x', 'ts': 1}"), F.lit('{"message":"n","a":NaN}'),
        F.concat(F.lit('{"message":"m","a":{"b":1,"b":'), n, F.lit("}}")), F.lit('{message:"x"}'), F.lit('{"message":"first","message":"tail"}'),
    ])
    found = parse_lines(rendered(spark, sf, line), "json")
    return found.select("line_no", micros().alias("ts_us"), "message", F.coalesce(F.col("fields")["a"], F.lit("")).alias("a"))


@query("parse_marked_lines", """
SELECT event_id + 1 AS line_no, CASE WHEN event_id % 2 = 0 THEN 'h' || chr(1) || 'z' ELSE 't' || chr(1) || 'b' END AS part,
       event_type || chr(1) || 'end' AS message FROM events""")
def marked_lines(spark, sf):
    """Control characters inside the parts of syslog and Java lines stay where they are."""
    text = F.concat("event_type", F.lit("\x01end"))
    new = F.concat(F.lit("<14>1 "), _stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z h\x01z app 7 id "), text)
    java = F.concat(_stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO [t\x01b] com.x.Y - "), text)
    syslog = parse_lines(rendered(spark, sf, new).filter((F.col("line_no") - 1) % 2 == 0), "syslog").select("line_no", F.col("fields")["hostname"].alias("part"), "message")
    headers = parse_lines(rendered(spark, sf, java).filter((F.col("line_no") - 1) % 2 == 1), "java").select("line_no", F.col("fields")["thread"].alias("part"), "message")
    return syslog.unionByName(headers)
