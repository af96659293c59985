"""Syslog: RFC 5424, RFC 3164, else plain."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from logloom.fixed import MONTHS, SYSLOG_3164, SYSLOG_5424
from logloom.functions.times import instant, rfc3339
from logloom.parsers.rows import groups_of, parsed, worked_out

def _map(**pairs):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def parse_syslog(rows: DataFrame, year: int | None = None, tz: str = "UTC", **_) -> DataFrame:
    """P8-P10. RFC 3164 has no year: ``year`` is it, by default the current one."""
    year = year or datetime.now(timezone.utc).year
    line = F.col("line")
    kind = F.when(line.rlike(SYSLOG_5424), 5424).when(line.rlike(SYSLOG_3164), 3164)
    split = worked_out(
        rows.filter(line != "").withColumn("form", kind),
        kind=F.col("form"),
        p=F.when(F.col("form") == 5424, groups_of(line, SYSLOG_5424, range(1, 8))).when(
            F.col("form") == 3164, groups_of(line, SYSLOG_3164, range(1, 8))
        ),
    )
    p = [F.get("p", F.lit(i)) for i in range(7)]

    priority = p[0].try_cast("bigint")
    new_fields = _map(
        facility=F.floor(priority / 8).cast("string"),
        severity=(priority % 8).cast("string"),
        hostname=p[2], app=p[3], procid=p[4], msgid=p[5],
    )

    month = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), p[0]).cast("string"), 2, "0")
    day = F.lpad(p[1], 2, "0")
    date = F.concat(F.lit(f"{year:04d}-"), month, F.lit("-"), day)
    old_time = instant(F.concat(date, F.lit(" "), p[2], F.lit(":"), p[3], F.lit(":"), p[4]), tz)
    text = p[6]
    colon = F.instr(text, ":")
    tagged = colon > 1
    tag = F.left(text, colon - 1)
    bracket = F.instr(tag, "[")
    pid = F.regexp_replace(F.substr(tag, bracket + 1), F.lit(r"\]$"), F.lit(""))
    old_fields = _map(
        hostname=p[5],
        program=F.when(tagged, F.when(bracket > 1, F.left(tag, bracket - 1)).otherwise(tag)),
        pid=F.when(tagged & (bracket > 1), pid),
    )
    stripped = F.regexp_replace(F.substr(text, colon + 1), F.lit(r"^\s+|\s+$"), F.lit(""))
    old_message = F.when(tagged, stripped).otherwise(text)

    new, old = F.col("kind") == 5424, F.col("kind") == 3164
    return parsed(
        split,
        F.when(new, rfc3339(p[1])).when(old, old_time),
        F.when(new, p[6]).when(old, old_message).otherwise(line),
        F.when(new, new_fields).when(old, old_fields).otherwise(F.create_map().cast("map<string,string>")),
    )
