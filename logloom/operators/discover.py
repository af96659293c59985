"""Which fields the records have."""

import itertools
import re

from pyspark.sql import Column, DataFrame, functions as F

from logloom.fixed import FIELD_SAMPLE, SAMPLE_VALUE_CHARS
from logloom.functions.text import json_type, sample_value, truncate
from logloom.operators.ranking import newest
from logloom.parsers.json import json_object, last_value_wins, trimmed
from logloom.parsers.rows import worked_out

# Paths that are looked up one by one.
PATHS = 300

def _profile(found: DataFrame, order: list) -> DataFrame:
    """(name, count, sample): the sample is the first non-empty value in ``order``."""
    value = F.when(F.col("value") != "", F.col("value"))
    return found.groupBy("name").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.when(value.isNotNull(), F.struct(*order, F.col("value").alias("_value"))))["_value"].alias("value"),
    ).select("name", "count", _shown(F.col("value")))


def _shown(value: Column) -> Column:
    return F.coalesce(truncate(value, SAMPLE_VALUE_CHARS), F.lit("")).alias("sample")


def _sampled(df: DataFrame, sample: int | None) -> DataFrame:
    return newest(df, sample) if sample else df


def _ranks(df: DataFrame) -> tuple[DataFrame, list]:
    """Columns that sort like ``newest_order``, so that the least struct is the first row."""
    rest = [c for c in ("source", "line_no", "ptr") if c in df.columns]
    ranked = df.withColumn("_age", -F.coalesce(F.unix_micros("timestamp"), F.lit(-(1 << 62))))
    return ranked, [F.col("_age"), *[F.col(c).alias(f"_{c}") for c in rest]]


def discover_fields(df: DataFrame, sample: int | None = FIELD_SAMPLE) -> DataFrame:
    """(name, kind, count, sample) by name over the newest ``sample`` records.

    ``sample=None`` profiles the whole table. The exchange carries one row per
    field and task.
    """
    ranked, order = _ranks(_sampled(df, sample))
    pairs = ranked.select(*order, F.explode("fields").alias("name", "value"))
    names = [F.col(c) for c in pairs.columns[: len(order)]]
    out = _profile(pairs.filter(F.col("value").isNotNull()), names)
    kind = F.when(F.col("name").startswith("@"), F.lit("system")).otherwise(F.lit("custom"))
    return out.select("name", kind.alias("kind"), "count", "sample").orderBy("name")


class Shape:
    """What stands at one place of the records: scalars, an object with members, an array; ``mixed`` if several.

    ``plain`` says that it is scalars whose text is their own, or null.
    """

    def __init__(
        self, members: "dict[str, Shape] | None" = None, element: "Shape | None" = None, mixed: bool = False, plain: bool = False
    ):
        self.members, self.element, self.mixed, self.plain = members, element, mixed, plain

    def depth(self) -> int:
        """How deeply objects are nested in it, each array's element included."""
        inner = [m.depth() for m in (self.members or {}).values()] + ([self.element.depth()] if self.element else [])
        return max(inner, default=0) + (self.members is not None)


_TYPE = re.compile(r"\s*(OBJECT<|ARRAY<|>|,|[A-Z][A-Z0-9_]*(?:\([^)]*\))?)")
_NAME = re.compile(r"\s*(?:`((?:[^`]|``)*)`|([^:`]*)):")


def shape_of(schema: str) -> Shape:
    """The shape that a merged schema of variants, as Spark spells it, describes."""

    def read(at: int) -> tuple[Shape, int]:
        mark = _TYPE.match(schema, at)
        kind, at = mark[1], mark.end()
        if kind == "ARRAY<":
            element, at = read(at)
            return Shape(element=element), at + 1
        if kind != "OBJECT<":
            return Shape(mixed=kind == "VARIANT", plain=kind in ("STRING", "BIGINT", "BOOLEAN", "VOID")), at
        members: dict[str, Shape] = {}
        while schema[at] != ">":
            name = _NAME.match(schema, at)
            key = name[2] if name[1] is None else name[1].replace("``", "`")
            members[key], at = read(name.end())
            at += schema[at] == ","
        return Shape(members), at + 1

    return read(0)[0]


# A place in a record: a variant, and the path from there.
Place = tuple[Column, str]


def _step(place: Place, key: str) -> Place:
    """A member's place."""
    quote = "'" if "'" not in key else '"'
    if key and quote not in key and "\\" not in key:
        return place[0], f"{place[1]}[{quote}{key}{quote}]"
    # No path can spell this name.
    return _variant(place).try_cast("map<string,variant>")[F.lit(key)], "$"


def _first(place: Place) -> Place:
    return place[0], f"{place[1]}[0]"


def _variant(place: Place) -> Column:
    return place[0] if place[1] == "$" else F.try_variant_get(place[0], place[1], "variant")


def _places(shape: Shape, place: Place, name: str = ""):
    """(shape, place, name, inside) of all that is below an object; ``inside`` says that it is an array's first element."""
    for key, member in (shape.members or {}).items():
        at, called = _step(place, key), f"{name}.{key}" if name else key
        yield member, at, called, False
        yield from _places(member, at, called)
        if member.element is not None:
            yield member.element, _first(at), f"{called}[]", True
            yield from _places(member.element, _first(at), f"{called}[]")


def merged_shape(docs: DataFrame) -> Shape:
    """The shape of all ``members`` maps: one aggregate, and one more for each level at which kinds of values are mixed."""
    whole = docs.select(F.to_variant_object("members").alias("_doc"))
    schema = whole.agg(F.schema_of_variant_agg("_doc")).first()[0]
    shape = shape_of(schema) if schema and schema.startswith("OBJECT<") else Shape({})
    while open_places := [(s, at) for s, at, _, _ in _places(shape, (F.col("_doc"), "$")) if s.mixed and s.members is None]:
        asked = []
        for _, at in open_places:
            value = _variant(at)
            asked += [F.schema_of_variant_agg(F.when(json_type(value).startswith(kind), value)) for kind in ("OBJECT", "ARRAY")]
        found = whole.agg(*[a.alias(f"_{i}") for i, a in enumerate(asked)]).first()
        for i, (place, _) in enumerate(open_places):
            objects, arrays = found[2 * i], found[2 * i + 1]
            place.members = shape_of(objects).members if objects and objects.startswith("OBJECT<") else {}
            place.element = shape_of(arrays).element if arrays and arrays.startswith("ARRAY<") else None
    return shape


def _leaf_text(place: Shape, at: Place, inside: bool) -> Column:
    """Text of the leaf at a place, NULL where there is none. An array is a leaf where it is an array's first element.

    A look-up copies what it finds, so nulls are only looked for in records that spell one (``_null``).
    """
    value = _variant(at)
    null = F.when(F.col("_null") & F.is_variant_null(value), F.lit("null"))
    if place.plain:
        text = value.try_cast("string") if at[1] == "$" else F.try_variant_get(at[0], at[1], "string")
        return F.coalesce(text, null)
    if not place.mixed and (place.members is not None or place.element is not None and not inside):
        return null
    kind = json_type(value)
    is_leaf = ~kind.startswith("OBJECT") if inside else ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
    return F.when(is_leaf, sample_value(value, kind))


def profile_by_path(docs: DataFrame, keep: list[str], shape: Shape) -> DataFrame | None:
    """``_profile`` of all leaves, each path of ``shape`` looked up by itself; None if there are too many.

    Every path is counted in the one aggregate over the rows, so that no leaf becomes a row of its own
    and nothing is sorted: a task hands on one row.
    """
    places = list(itertools.islice(_places(shape, (F.col("_doc"), "$")), PATHS + 1))
    if len(places) > PATHS:
        return None
    entries = []
    for place, at, name, inside in places:
        entries.append((name, _leaf_text(place, at, inside)))
        if place.element is not None and not inside:
            value = _variant(at)
            is_array = json_type(value).startswith("ARRAY") if place.mixed else ~F.is_variant_null(value)
            empty = _variant(_first(at)).isNull() & value.isNotNull() & is_array
            entries.append((f"{name}[]", F.when(empty, F.lit("(empty array)"))))
    if not entries:
        return docs.select(F.lit("").alias("name"), F.lit(0).cast("bigint").alias("count"), F.lit("").alias("sample")).limit(0)
    rows = docs.select(*keep, F.col("text").contains("null").alias("_null"), F.to_variant_object("members").alias("_doc"))
    first = lambda text: F.min(F.when(text != "", F.struct(*keep, text.alias("_value"))))
    counted = rows.agg(F.array(*[
        F.struct(F.lit(name).alias("name"), F.count(text).alias("count"), first(text).alias("first")) for name, text in entries
    ]).alias("paths"))
    by_name = counted.select(F.inline("paths")).filter(F.col("count") > 0).groupBy("name")
    totals = by_name.agg(F.sum("count").alias("count"), F.min("first")["_value"].alias("value"))
    return totals.select("name", "count", _shown(F.col("value")))


def _members(value: Column) -> Column:
    return F.map_entries(value.try_cast("map<string,variant>"))


def json_leaves(docs: DataFrame, keep: list[str], depth: int) -> DataFrame:
    """Rows of ``members`` (map<string,variant>) to one row per leaf: (…keep, name, value).

    ``a.b`` steps into objects, ``a[]`` into the first element of an array; an empty
    array is a leaf, an empty object is nothing. Each step opens one more level of
    the same rows, so the text is read and parsed once however deep it is.
    """
    rows = docs.select(
        *keep, F.lit("").alias("name"), F.lit(None).cast("string").alias("value"), F.map_entries("members").alias("kids")
    )
    for _ in range(depth):
        opened = rows.select(*keep, "name", "value", F.explode_outer("kids").alias("kid"))
        is_kid = F.col("kid").isNotNull()
        inner = F.col("kid.value")
        is_array = json_type(inner).startswith("ARRAY")
        path = F.when(F.col("name") == "", F.col("kid.key")).otherwise(F.concat("name", F.lit("."), F.col("kid.key")))
        named = opened.select(
            *keep,
            F.when(is_kid, F.when(is_array, F.concat(path, F.lit("[]"))).otherwise(path)).otherwise(F.col("name")).alias("name"),
            "value",
            is_kid.alias("is_kid"),
            F.when(is_array, F.get(inner.try_cast("array<variant>"), F.lit(0))).otherwise(inner).alias("doc"),
        )
        typed = named.withColumn("kind", json_type(F.col("doc")))
        is_object = F.col("kind").startswith("OBJECT")
        text = F.when(F.col("doc").isNull(), F.lit("(empty array)")).when(
            ~is_object, sample_value(F.col("doc"), F.col("kind"))
        )
        rows = typed.select(
            *keep,
            "name",
            F.when(F.col("is_kid"), text).otherwise(F.col("value")).alias("value"),
            F.when(F.col("is_kid") & is_object, _members(F.col("doc"))).alias("kids"),
        )
    return rows.filter(F.col("value").isNotNull()).select(*keep, "name", "value")


def discover_json_paths(
    df: DataFrame, sample: int | None = FIELD_SAMPLE, column: str = "message"
) -> DataFrame:
    """(name, count, sample) of the JSON paths in the message, by name.

    One aggregate over the valid objects merges their schemas, which names every path; a second one
    looks each path up in the rows and counts it. Records of more than PATHS paths are opened level
    by level instead, a row for each leaf. No path is left out and no invalid line counts.
    """
    ranked, order = _ranks(_sampled(df, sample))
    text = trimmed(F.col(column))
    found = ranked.select(*order, text.alias("text")).filter(F.col("text").startswith("{"))
    read = found.withColumn("read", json_object(F.col("text")))
    docs = worked_out(read, members=last_value_wins(F.col("read"))).filter(F.col("members").isNotNull())
    keep = docs.columns[: len(order)]
    shape = merged_shape(docs)
    out = profile_by_path(docs, keep, shape)
    if out is None:
        out = _profile(json_leaves(docs, keep, max(1, shape.depth())), [F.col(c) for c in keep])
    return out.orderBy("name")
