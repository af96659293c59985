"""JSON lines: one object per line."""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.fixed import JSON_MESSAGE_KEYS, JSON_TIMESTAMP_KEYS
from logloom.functions.text import double_text, is_number, json_type
from logloom.functions.times import epoch_time, json_text_time
from logloom.parsers.rows import parsed, worked_out

BLANKS = " \t\n\v\f\r\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false"}


def trimmed(line: Column) -> Column:
    """The line without white space at either end.

    A line that is an object but for spaces around it needs no search for the other characters.
    """
    spaced = F.trim(line)
    return F.when(spaced.startswith("{") & spaced.endswith("}"), spaced).otherwise(F.btrim(line, F.lit(BLANKS)))


def json_object(text: Column) -> Column:
    """The object's members as map<string,variant>; NULL when it is no valid object.

    A number beyond the range of doubles makes it invalid. Read inside brackets, so text after the object makes it invalid. Of a repeated
    key the last value counts; below the first level only where the session has
    ``spark.sql.variant.allowDuplicateKeys`` on (``local_session`` does).
    """
    boxed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,variant>>", _STRICT)
    return F.when((F.size(boxed) == 1) & ~_out_of_range(text), F.get(boxed, F.lit(0)))


def _out_of_range(text: Column) -> Column:
    """Whether some number is beyond a double. Only text that has a long run of digits or a large exponent is taken apart."""
    numbers = F.regexp_extract_all(F.regexp_replace(text, _QUOTED, '""'), F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"), 0)
    too_large = F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == float("inf"))
    return F.when(F.coalesce(text.rlike(r"[eE]\+?0*[1-9][0-9]{2}|[0-9]{200}"), F.lit(False)), too_large).otherwise(False)


def last_value_wins(members: Column) -> Column:
    keys = F.map_keys(members)
    pairs = F.map_entries(members)
    last = F.transform(
        F.array_distinct(keys),
        lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1),
    )
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(last)).otherwise(members)


def json_ts(value: Column) -> Column:
    """P5: time of a JSON value: text in one of the layouts, or a number."""
    kind = json_type(value)
    return F.when(kind == "STRING", json_text_time(value.try_cast("string"))).when(
        is_number(kind), epoch_time(value.try_cast("double"))
    )


def json_text(value: Column) -> Column:
    """Text of a JSON value."""
    kind = json_type(value)
    return (
        F.when(kind.isin("STRING", "BIGINT", "BOOLEAN") | kind.startswith("DECIMAL"), value.try_cast("string"))
        .when(kind == "DOUBLE", double_text(value))
        .otherwise(F.to_json(value))
    )


def _literals(keys: list[str]) -> Column:
    return F.array(*[F.lit(k) for k in keys])


def parse_json(rows: DataFrame, **_) -> DataFrame:
    """P4-P7. Only the keys that are present are looked at, in list order."""
    found = rows.withColumn("line", trimmed(F.col("line"))).filter(F.col("line").startswith("{"))
    read = found.withColumn("read", json_object(F.col("line")))
    members = worked_out(read, members=last_value_wins(F.col("read"))).drop("read")
    keys = F.map_keys("members")
    times = F.filter(
        F.transform(
            F.array_intersect(_literals(JSON_TIMESTAMP_KEYS), keys),
            lambda k: F.struct(k.alias("key"), json_ts(F.col("members")[k]).alias("ts")),
        ),
        lambda t: t["ts"].isNotNull(),
    )
    texts = F.filter(
        F.array_intersect(_literals(JSON_MESSAGE_KEYS), keys),
        lambda k: json_type(F.col("members")[k]) == "STRING",
    )
    picked = worked_out(members, time=F.get(times, F.lit(0)), text_key=F.get(texts, F.lit(0)))
    used = F.array(F.coalesce("time.key", F.lit("")), F.coalesce("text_key", F.lit("")))
    named = F.array(F.col("time.key").isNotNull(), F.col("text_key").isNotNull())
    rest = F.map_filter(
        "members",
        lambda k, v: ~((named[0] & (k == used[0])) | (named[1] & (k == used[1]))),
    )
    text = F.col("members")[F.col("text_key")].try_cast("string")
    message = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.col("line"))
    return parsed(picked, F.col("time.ts"), message, F.transform_values(rest, lambda k, v: json_text(v)))
