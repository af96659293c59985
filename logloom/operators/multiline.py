"""Joining continuation lines to the line that begins their entry."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.plans.ordered import before_in_source, chunked

_KEYS = ["source", "chunk"]


def _joined(lines: Column) -> Column:
    """Text of an array of struct(pos, line), in line order."""
    return F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n")


def join_rows(rows: DataFrame, is_head: Column, marker: Column | None = None) -> DataFrame:
    """One row per entry: (source, chunk, pos, head, rest, carried).

    ``head`` is the entry's first line, ``rest`` the further lines joined (NULL when
    there is none), ``carried`` the last non-null ``marker`` (a date) of an earlier
    or the same head. The first non-empty line of a source is a head whatever it holds.

    One exchange, on (source, chunk), serves every branch below. Entries that go
    on past the end of their chunk get the missing lines from a table with at most
    one row per chunk, so the large side is not moved a second time.
    """
    marker = F.lit(None).cast("date") if marker is None else marker
    # Known keys, said once: else the joins below add it to some branches only, and
    # those would not share the exchange.
    known_keys = F.col("source").isNotNull() & F.col("chunk").isNotNull()
    base = chunked(rows).filter(known_keys).select(*_KEYS, "pos", "line", is_head.alias("is_head"), F.when(is_head, marker).alias("marker"))
    marked = base.repartition(*_KEYS)

    per_chunk = marked.groupBy(*_KEYS).agg(
        F.min(F.when(F.col("is_head"), F.col("pos"))).alias("first_head"),
        F.max(F.when(F.col("is_head"), F.col("pos"))).alias("last_head"),
        F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("pos"))).alias("last_marker"),
    )
    known = before_in_source(
        per_chunk,
        target=F.last(F.when(F.col("last_head").isNotNull(), F.col("chunk")), ignorenulls=True),
        marker_before=F.last("last_marker", ignorenulls=True),
    )

    # Lines ahead of the first head of their chunk belong to an earlier chunk's last entry.
    ahead = known.filter(F.col("first_head").isNull() | (F.col("first_head") > 0)).select(
        *_KEYS, "first_head", "target"
    )
    loose = marked.select(*_KEYS, "pos", "line", "is_head").join(ahead, _KEYS).filter(
        F.col("first_head").isNull() | (F.col("pos") < F.col("first_head"))
    )
    pieces = loose.groupBy(*_KEYS, "target").agg(
        _joined(F.collect_list(F.struct("pos", "line"))).alias("text"),
        F.min(F.when(F.col("line") != "", F.col("pos"))).alias("pos"),
    )
    gathered = pieces.groupBy("source", "target").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "text", "pos"))).alias("parts")
    )
    texts = F.array_join(F.transform("parts", lambda x: x["text"]), "\n")
    tails = gathered.filter(F.col("target").isNotNull()).select(
        "source", F.col("target").alias("chunk"), texts.alias("tail")
    )

    # Lines ahead of the first head of the whole source form an entry of their own.
    first = F.get(F.filter("parts", lambda x: x["pos"].isNotNull()), F.lit(0))
    opening = (
        gathered.filter(F.col("target").isNull())
        .select("source", first.alias("first"), F.regexp_replace(texts, F.lit("^\n+"), F.lit("")).alias("text"))
        .filter(F.col("first").isNotNull())
        .select(
            "source",
            F.col("first.chunk").alias("chunk"),
            F.col("first.pos").alias("pos"),
            F.substring_index("text", "\n", 1).alias("head"),
            F.when(F.instr("text", "\n") > 0, F.substr("text", F.instr("text", "\n") + 1)).alias("rest"),
            F.lit(None).cast("date").alias("carried"),
        )
    )

    along = Window.partitionBy(*_KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = marked.select(
        *_KEYS, "pos", "line", "is_head",
        F.sum(F.col("is_head").cast("bigint")).over(along).alias("entry"),
        F.last("marker", ignorenulls=True).over(along).alias("marker_inside"),
    )
    # Only continuation lines are gathered; most entries have none.
    head = lambda c: F.max(F.when(F.col("is_head"), F.col(c)))
    headed = running.filter(F.col("entry") > 0).groupBy(*_KEYS, "entry").agg(
        head("pos").alias("pos"), head("line").alias("head"), head("marker_inside").alias("marker_inside"),
        F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "line"))).alias("later"),
    ).select(*_KEYS, "pos", "head", F.when(F.size("later") > 0, _joined(F.col("later"))).alias("rest"), "marker_inside")
    across = known.select(*_KEYS, "last_head", "marker_before").join(tails, _KEYS, "left")
    whole = headed.join(across, _KEYS).select(
        *_KEYS, "pos", "head",
        F.when(F.col("tail").isNull() | (F.col("pos") != F.col("last_head")), F.col("rest"))
        .when(F.col("rest").isNull(), F.col("tail"))
        .otherwise(F.concat(F.col("rest"), F.lit("\n"), F.col("tail"))).alias("rest"),
        F.coalesce("marker_inside", "marker_before").alias("carried"),
    )
    return whole.unionByName(opening)


def join_multiline(lines: DataFrame, is_head: Column, chunk_lines: int | None = None) -> DataFrame:
    """P17, W3 for LINES rows and any rule: (source, line_no, message)."""
    rows = chunked(lines) if chunk_lines is None else chunked(lines, chunk_lines)
    joined = join_rows(rows, is_head)
    return joined.select(
        "source", F.col("pos").alias("line_no"), F.concat_ws("\n", "head", "rest").alias("message")
    )


def fill_reference_date(rows: DataFrame, default_date, chunk_lines: int | None = None) -> DataFrame:
    """``day`` (NULL where a line has none) filled from the lines before.

    Takes (source, line_no, day, …) rows and adds ``filled``.
    """
    size = chunk_lines or 250_000
    first = F.floor((F.col("line_no") - 1) / F.lit(size)).cast("bigint")
    base = rows.filter(F.col("source").isNotNull()).withColumn("chunk", first).repartition(*_KEYS)
    per_chunk = base.groupBy(*_KEYS).agg(
        F.max_by("day", F.when(F.col("day").isNotNull(), F.col("line_no"))).alias("last_day")
    )
    known = before_in_source(per_chunk, day_before=F.last("last_day", ignorenulls=True)).drop("last_day")
    along = Window.partitionBy(*_KEYS).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = base.withColumn("inside", F.last("day", ignorenulls=True).over(along))
    return inside.join(known, _KEYS).select(
        *rows.columns, F.coalesce("inside", "day_before", F.lit(default_date).cast(rows.schema["day"].dataType)).alias("filled")
    )
