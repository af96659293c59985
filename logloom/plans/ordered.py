"""Ordered work within a source, without ever putting one source in one task.

A source (file, stream, case) may hold a third of all rows, so nothing here opens
a window over a whole source. Rows carry a ``chunk``: a bounded, ordered piece of
their source (a file split, or a fixed number of lines). Windows run inside a
chunk; what has to cross chunks goes through a table with one row per chunk.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_LINES = 250_000
# Ranges that one order is cut into at most, and the values drawn for each to find its bounds.
RANGES, DRAWN = 10_000, 100


def chunked(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """LINES rows as (source, chunk, pos, line); rows already chunked pass."""
    if {"chunk", "pos"} <= set(lines.columns):
        return lines
    first = F.floor((F.col("line_no") - 1) / F.lit(chunk_lines)).cast("bigint")
    return lines.select("source", first.alias("chunk"), F.col("line_no").alias("pos"), "line")


def before_in_source(per_chunk: DataFrame, key="source", **totals: Column) -> DataFrame:
    """Adds, per chunk row, each aggregate taken over the earlier chunks of its key."""
    keys = [key] if isinstance(key, str) else list(key)
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select("*", *[total.over(earlier).alias(name) for name, total in totals.items()])


def range_of(bounds: list, value: Column, kind: str) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, found in two steps of a square root each."""
    step = max(1, int(len(bounds) ** 0.5))
    typed = lambda values, t: F.lit(values).cast(t) if values else F.array().cast(t)
    coarse = typed(bounds[step - 1 :: step], f"array<{kind}>")
    groups = F.array(*[typed(bounds[i : i + step], f"array<{kind}>") for i in range(0, len(bounds) + 1, step)])
    whole = F.size(F.filter(coarse, lambda b: b < value))
    return F.transform(F.array(whole), lambda g: g * step + F.size(F.filter(F.get(groups, g), lambda b: b < value)))[0]


def range_cuts(df: DataFrame, order: str, chunk_rows: int) -> list:
    """Sorted values of ``order`` that cut the rows into ranges of about ``chunk_rows``, RANGES of them at most.

    Rows are counted, and only if they are too many for one range a sample of the column is
    drawn: DRAWN values a range, whatever the rows. The cuts need not be exact, so no ranking of all values is.
    """
    values = df.select(order).filter(F.col(order).isNotNull())
    rows = values.count()
    wanted = min(RANGES, -(-rows // chunk_rows))
    if wanted <= 1:
        return []
    share = min(1.0, DRAWN * wanted / rows)
    drawn = sorted(r[0] for r in values.sample(share, seed=7).collect())
    return sorted({drawn[i * len(drawn) // wanted] for i in range(1, wanted)}) if drawn else []


def number_rows(df: DataFrame, keys: list[str], order: str, name: str = "n", chunk_rows: int = CHUNK_LINES) -> DataFrame:
    """1, 2, 3 … per key in the order of an integer column, two-level.

    ``order`` values must be unique per key. Chunks are ranges of ``order`` that hold
    about as many rows each, however far its values lie apart, so the only exchange of
    rows is on (keys, chunk) and a hot key spreads over many tasks.
    """
    cuts = range_cuts(df, order, chunk_rows)
    if not cuts:
        # One range holds all rows: no key needs to be cut.
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint"))
    rows = df.withColumn("chunk", range_of(cuts, F.col(order), df.schema[order].dataType.simpleString()).cast("bigint"))
    sizes = rows.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("_size"))
    offsets = before_in_source(sizes, keys, _before=F.sum("_size")).drop("_size")
    inside = Window.partitionBy(*keys, "chunk").orderBy(order)
    numbered = rows.withColumn("_in", F.row_number().over(inside)).join(offsets, [*keys, "chunk"])
    total = F.col("_in") + F.coalesce(F.col("_before"), F.lit(0))
    return numbered.withColumn(name, total.cast("bigint")).drop("_in", "_before", "chunk").select(*df.columns, name)
