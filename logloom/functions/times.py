"""Times, durations and time ranges as column expressions.

Text is first matched against the exact layout, then spelled the one way Spark's
cast reads, with the zone appended. Results therefore do not depend on the
session time zone, and a bad value gives NULL, never an error.
"""

import re
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, functions as F

from logloom.fixed import EPOCH_MILLIS_ABOVE, MONTHS, PLAIN_PREFIXES, PLAIN_UNIX
from logloom.functions.text import one_decimal

_DATE = r"(\d{4}-\d{2}-\d{2})"
_CLOCK = r"(\d{2}:\d{2}:\d{2})"
_ANY_FRACTION = r"(?:([.,]\d{1,6})\d*)?"
_ZONE = r"(Z|[+-]\d{2}:\d{2})"


def zoned_instant(text: Column) -> Column:
    """Instant of normalised text that carries its own zone."""
    return F.translate(text, ",", ".").try_cast("timestamp")


def instant(text: Column, tz: str = "UTC") -> Column:
    """Instant of normalised ``yyyy-MM-dd HH:mm:ss[.frac]`` text read in ``tz``."""
    return zoned_instant(F.concat(text, F.lit(" " + tz)))


def _shaped(text: Column, pattern: str, spelled: str, tz: str | None) -> Column:
    """NULL unless the whole of ``text`` has the layout, else its instant."""
    whole = f"^{pattern}\\z"
    normal = F.regexp_replace(text, F.lit(whole), F.lit(spelled))
    return F.when(text.rlike(whole), zoned_instant(normal) if tz is None else instant(normal, tz))


def rfc3339(text: Column) -> Column:
    return _shaped(text, f"{_DATE}T{_CLOCK}{_ANY_FRACTION}{_ZONE}", "$1 $2$3$4", None)


def spaced_time(text: Column, tz: str = "UTC") -> Column:
    """``date time`` with any fraction."""
    return _shaped(text, f"{_DATE} {_CLOCK}{_ANY_FRACTION}", "$1 $2$3", tz)


def zoneless_iso(text: Column, tz: str = "UTC") -> Column:
    """``dateTtime`` without a zone, with any fraction."""
    return _shaped(text, f"{_DATE}T{_CLOCK}{_ANY_FRACTION}", "$1 $2$3", tz)


def iso8601(text: Column, tz: str = "UTC") -> Column:
    """RFC 3339, or the same without a zone."""
    return F.coalesce(rfc3339(text), zoneless_iso(text, tz))


def parse_timestamp(text: Column, tz: str = "UTC") -> Column:
    """RFC 3339 or a zone-less date and time, with ``T`` or a space."""
    return F.coalesce(iso8601(text, tz), spaced_time(text, tz))


def service_time(text: Column) -> Column:
    """Time text of a remote query row, always UTC."""
    return F.coalesce(
        spaced_time(text),
        rfc3339(text),
        _shaped(text, rf"{_DATE}T{_CLOCK}([.,]\d{{3}})", "$1 $2$3", "UTC"),
    )


def _access_log_time(text: Column) -> Column:
    pattern = rf"(\d{{2}})/([A-Za-z]{{3}})/(\d{{4}}):{_CLOCK}{_ANY_FRACTION} ([+-]\d{{2}})(\d{{2}})"
    month = reduce(
        lambda rest, im: F.when(
            F.lower(F.substring(text, 4, 3)) == im[1].lower(), F.lit(f"{im[0]:02d}")
        ).otherwise(rest),
        list(enumerate(MONTHS, start=1)),
        F.lit(None).cast("string"),
    )
    whole = f"^{pattern}\\z"
    tail = F.regexp_replace(text, F.lit(whole), F.lit("$1 $4$5$6:$7"))
    year = F.substring(text, 8, 4)
    return F.when(
        text.rlike(whole), zoned_instant(F.concat(year, F.lit("-"), month, F.lit("-"), tail))
    )


# The years 1 to 9999; a time outside has no value.
_FIRST_SECOND, _LAST_SECOND = -62_135_596_800, 253_402_300_799


def micros_time(micros: Column) -> Column:
    return F.when(micros.between(_FIRST_SECOND * 1_000_000, _LAST_SECOND * 1_000_000), F.timestamp_micros(micros))


def epoch_time(number: Column) -> Column:
    """Seconds since 1970, or milliseconds when the number is that large; NULL beyond the years 1 to 9999."""
    whole = number.try_cast("bigint")
    millis = (number > F.lit(EPOCH_MILLIS_ABOVE)) & (whole <= _LAST_SECOND * 1000)
    seconds = (number <= F.lit(EPOCH_MILLIS_ABOVE)) & (whole >= _FIRST_SECOND)
    return F.when(millis, F.timestamp_millis(whole)).when(seconds, F.timestamp_seconds(whole))


def json_text_time(text: Column) -> Column:
    """P5, text values: the accepted JSON layouts. Zone-less ``T`` is not one."""
    slashed = _shaped(text, rf"(\d{{4}})/(\d{{2}})/(\d{{2}}) {_CLOCK}{_ANY_FRACTION}", "$1-$2-$3 $4$5", "UTC")
    return F.coalesce(rfc3339(text), spaced_time(text), slashed, _access_log_time(text))


def _prefix_time(line: Column, no: int, tz: str) -> Column:
    _, pattern, spelled, zoned = PLAIN_PREFIXES[no]
    normal = F.regexp_replace(line, F.lit(f"(?s){pattern}.*$"), F.lit(spelled))
    return zoned_instant(normal) if zoned else instant(normal, tz)


_PROGRAM = [name for name, *_ in PLAIN_PREFIXES].index("program")
_LEADING = [no for no in range(len(PLAIN_PREFIXES)) if no != _PROGRAM]
_UNIX = len(PLAIN_PREFIXES)


def leading_layout(line: Column) -> Column:
    """Number of the layout that begins with its date, or NULL; no line has two of them."""
    return F.coalesce(*[F.when(line.rlike(PLAIN_PREFIXES[no][1]), F.lit(no)) for no in _LEADING])


def leading_time(line: Column, layout: Column, tz: str = "UTC") -> Column:
    ts = F.lit(None).cast("timestamp")
    for no in reversed(_LEADING):
        ts = F.when(layout == no, _prefix_time(line, no, tz)).otherwise(ts)
    return ts


def plain_time(line: Column, layout: Column, leading: Column, tz: str = "UTC") -> Column:
    """struct(layout, ts) of the first layout that both matches and parses.

    ``layout`` and ``leading`` are what the two functions above gave. A layout that
    matches and does not parse falls through, which is possible only to a program
    name before the date and from there to a bracketed number.
    """
    no_layout, no_time = F.lit(None).cast("int"), F.lit(None).cast("timestamp")
    program = F.when(line.rlike(PLAIN_PREFIXES[_PROGRAM][1]), _prefix_time(line, _PROGRAM, tz))
    unix = F.when(line.rlike(PLAIN_UNIX), epoch_time(F.regexp_extract(line, PLAIN_UNIX, 1).try_cast("bigint")))
    found = lambda no, ts: F.struct(no.alias("layout"), ts.alias("ts"))
    return (
        F.when(leading.isNotNull(), found(layout, leading))
        .when(program.isNotNull(), found(F.lit(_PROGRAM), program))
        .when(unix.isNotNull(), found(F.lit(_UNIX), unix))
        .otherwise(found(no_layout, no_time))
    )


def plain_message(line: Column, layout: Column) -> Column:
    """The line without its time prefix; the whole line where there is none."""
    patterns = [p for _, p, *_ in PLAIN_PREFIXES] + [PLAIN_UNIX]
    text = line
    for no, pattern in reversed(list(enumerate(patterns))):
        text = F.when(layout == no, F.regexp_replace(line, F.lit(pattern), F.lit(""))).otherwise(text)
    return text


def extract_plain_ts(line: Column, tz: str = "UTC") -> Column:
    """P2 as one expression: struct(ts, message)."""
    layout = leading_layout(line)
    found = plain_time(line, layout, leading_time(line, layout, tz), tz)
    return F.struct(found["ts"].alias("ts"), plain_message(line, found["layout"]).alias("message"))


# --- relative times, durations -------------------------------------------------

_GO_UNIT_MICROS = {
    "ns": 0.001, "us": 1.0, "µs": 1.0, "μs": 1.0, "ms": 1e3, "s": 1e6, "m": 60e6, "h": 3600e6,
}
_GO_PART = r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)"


def parse_time(text: Column, base: Column) -> Column:
    """Empty or ``now`` is ``base``; ``2h`` is that long before it; or RFC 3339."""
    amount = F.regexp_extract(text, r"^(\d+)[mhd]\z", 1).try_cast("bigint")
    unit = F.right(text, F.lit(1))
    micros = F.try_multiply(amount, F.when(unit == "m", 60_000_000).when(unit == "h", 3_600_000_000).otherwise(86_400_000_000))
    earlier = micros_time(F.try_subtract(F.unix_micros(base.cast("timestamp")), micros))
    return (
        F.when((text == "") | (text == "now"), base.cast("timestamp"))
        .when(text.rlike(r"^\d+[mhd]\z"), earlier)
        .otherwise(rfc3339(text))
    )


def parse_duration(text: Column) -> Column:
    """A day-time interval from ``7d`` or from ``1h30m``-style text, else NULL."""
    micros = duration_micros(text)
    return F.make_dt_interval(secs=(micros / F.lit(1_000_000)).try_cast("decimal(18,6)"))


def duration_micros(text: Column) -> Column:
    """N3 as a number of microseconds."""
    days = F.try_multiply(F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("bigint"), F.lit(86_400_000_000))
    body = F.regexp_replace(text, F.lit(r"^[+-]"), F.lit(""))
    total = F.lit(0.0)
    for unit, micros in _GO_UNIT_MICROS.items():
        numbers = F.regexp_extract_all(body, F.lit(rf"(\d+\.?\d*|\.\d+){unit}(?![a-zµμ])"), F.lit(1))
        total = total + F.aggregate(
            numbers, F.lit(0.0), lambda acc, x: acc + x.try_cast("double")
        ) * F.lit(micros)
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return (
        F.when(text.rlike(r"^[+-]?\d+[^\n]*d\z"), days)
        .when(text.rlike(r"^[+-]?0\z"), F.lit(0).cast("bigint"))
        .when(text.rlike(rf"^[+-]?(?:{_GO_PART})+\z"), F.floor(F.when(F.abs(signed) < 9.2e18, signed)).cast("bigint"))
    )


def duration_argument(text) -> timedelta:
    """N3 for a call argument."""
    if isinstance(text, timedelta):
        return text
    if text.endswith("d"):
        days = re.match(r"[+-]?\d+", text)
        if days:
            return timedelta(days=int(days.group()))
    elif re.fullmatch(r"[+-]?0", text):
        return timedelta(0)
    elif re.fullmatch(rf"[+-]?(?:{_GO_PART})+", text):
        total = sum(float(n) * _GO_UNIT_MICROS[u] for n, u in re.findall(_GO_PART, text))
        return timedelta(microseconds=-total if text.startswith("-") else total)
    raise ValueError(f"invalid duration {text!r}")


def time_argument(text, now: datetime | None = None) -> datetime:
    """N1, N2 for a call argument: ``now``, ``2h`` before now, or a date and time
    (UTC where it names no zone).
    """
    now = now or datetime.now(timezone.utc)
    if not isinstance(text, str):
        return text if text.tzinfo else text.replace(tzinfo=timezone.utc)
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    relative = re.fullmatch(r"(\d+)([mhd])", text)
    if text in ("", "now"):
        return now
    if relative:
        seconds = {"m": 60, "h": 3600, "d": 86400}[relative.group(2)]
        return now - timedelta(seconds=int(relative.group(1)) * seconds)
    if re.fullmatch(rf"{_DATE}[T ]{_CLOCK}{_ANY_FRACTION}{_ZONE}?", text):
        when = datetime.fromisoformat(text)
        return when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    raise ValueError(f"invalid time {text!r}: use 2025-12-02T06:00:00Z, or 2h, 30m, 7d")


def format_duration(seconds: Column) -> Column:
    """Whole minutes below an hour, else hours or days with one decimal."""
    hours = seconds / F.lit(3600.0)
    return (
        F.when(seconds < 3600, F.concat((seconds / 60).try_cast("bigint").cast("string"), F.lit("m")))
        .when(seconds < 86400, F.concat(one_decimal(hours), F.lit("h")))
        .otherwise(F.concat(one_decimal(hours / 24), F.lit("d")))
    )


def check_time_range(start: Column, end: Column, now: Column) -> Column:
    """Array of warning codes for a time range, empty when all is well."""
    s, e, n = (F.unix_micros(c.cast("timestamp")) for c in (start, end, now))
    minute, span = F.lit(60_000_000), e - s
    codes = F.array(
        F.when(e > n + minute, F.lit("end_in_future")),
        F.when(s > n + minute, F.lit("start_in_future")),
        F.when(span > F.lit(30 * 86_400_000_000), F.lit("range_over_30_days")),
        F.when((span < minute) & (span > 0), F.lit("range_under_1_minute")),
    )
    return F.array_compact(codes)


def valid_time_range(start: Column, end: Column) -> Column:
    """A range is usable only when it starts before it ends."""
    return start < end
