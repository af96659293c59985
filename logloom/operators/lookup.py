"""Lookups by record pointer."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logloom.fixed import FULL_PTR_CHARS
from logloom.functions.pointers import parse_ptr
from logloom.parsers.registry import parse_lines
from logloom.plans.ordered import CHUNK_LINES, before_in_source, range_cuts, range_of
from logloom.plans.sizing import small_side
from logloom.session import cut_lineage
from logloom.sources.lineindex import indexed_lines
from logloom.sources.lines import literal_path, read_lines

# Pointers that are looked up by a pushed-down list instead of a join.
_NAMED_PTRS = 1_000


def _ptr_table(spark, ptrs) -> tuple[DataFrame, int | None]:
    if isinstance(ptrs, DataFrame):
        return ptrs.select("ptr").distinct(), None
    ptrs = list(dict.fromkeys(ptrs))
    return spark.createDataFrame([(p,) for p in ptrs], "ptr string"), len(ptrs)


def get_records(entries: DataFrame, ptrs) -> DataFrame:
    """The entries with these pointers. ``ptrs``: a list, or rows with ``ptr``."""
    if not isinstance(ptrs, DataFrame) and len(set(ptrs)) <= _NAMED_PTRS:
        return entries.filter(F.col("ptr").isin(sorted(set(ptrs))))  # reaches the scan of a table
    wanted, bound = _ptr_table(entries.sparkSession, ptrs)
    return entries.join(small_side(wanted, bound), "ptr", "left_semi")


def missing_ptrs(entries: DataFrame, ptrs) -> DataFrame:
    """The pointers no entry has."""
    wanted, _ = _ptr_table(entries.sparkSession, ptrs)
    return wanted.join(get_records(entries, ptrs).select("ptr"), "ptr", "left_anti")


def get_lines(spark: SparkSession, ptrs: list[str], fmt: str | None = None, index: str | None = None, **options) -> DataFrame:
    """J1, one physical line per pointer; only the files named are read.

    With the path of an ``index`` (``lineindex.write_index``) a file is read from the split that holds the
    line up to the line; without, it is numbered from its beginning. Adds ``raw``. A line its parser skips (blank, or no JSON) comes back as it is.
    """
    asked, bound = _ptr_table(spark, ptrs)
    parsed = asked.select("ptr", parse_ptr(F.col("ptr")).alias("p"))
    rows = parsed.collect()  # as many as the caller listed
    bad = [r["ptr"] for r in rows if r["p"] is None]
    if bad:
        raise ValueError(f"invalid local pointer: {', '.join(bad)}")
    files = sorted({r["p"]["path"] for r in rows})
    wanted = spark.createDataFrame(
        [(r["ptr"], r["p"]["path"], r["p"]["line"]) for r in rows], "ptr string, source string, line_no bigint"
    )
    if index is None:
        lines = read_lines(spark, [literal_path(f) for f in files], skip_missing=True)
    else:
        lines = indexed_lines(spark, [(r["p"]["path"], r["p"]["line"]) for r in rows], index)
    lines = lines.join(small_side(wanted, bound), ["source", "line_no"])
    # Each asked line stands alone, so every one is parsed as if it began its file.
    alone = lines.select(F.col("ptr").alias("source"), F.lit(1).cast("bigint").alias("line_no"), "line")
    entries = parse_lines(alone, fmt or "plain", **options).select(
        F.col("source").alias("ptr"), "timestamp", "message", "fields"
    )
    joined = lines.join(entries, "ptr", "left")
    return joined.select(
        "timestamp",
        F.coalesce("message", "line").alias("message"),
        F.substring_index("source", "/", -1).alias("stream"),
        "source", "line_no", "ptr", "fields",
        F.col("line").alias("raw"),
    )


def lookup_provenance(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with the provenance of their pointer, or NULLs."""
    known = index.select("ptr", "source_uri", "source_type", "profile", "account_id").dropDuplicates(["ptr"])
    return df.join(known, "ptr", "left")


def _matches(terms: DataFrame, index: DataFrame, pieces) -> DataFrame:
    """Per term: how many pointers hold it, and the least of them.

    Pointers are cut into pieces of every length a term may have, so that a term is
    met by equality. Pieces are counted before they meet the terms: an ending that
    half of the index has is then one row.
    """
    lengths = F.sequence(F.lit(1), F.least(F.lit(FULL_PTR_CHARS), F.length("ptr")))
    cut = (
        index.select("ptr").filter(F.length("ptr") > 0).distinct()
        .select("ptr", F.explode(lengths).alias("n"))
        .select("ptr", F.explode(pieces(F.col("ptr"), F.col("n"))).alias("term"))
    )
    counted = cut.groupBy("term").agg(F.count(F.lit(1)).alias("matches"), F.min("ptr").alias("found"))
    return terms.select("term").distinct().join(counted, "term")


# Sorts after every character that text holds.
_LAST = "\U0010ffff"


def _ending(terms: DataFrame, index: DataFrame, chunk_rows: int) -> DataFrame:
    """Per term (not empty): how many pointers end with it, and the only one if there is just one.

    Read backwards, the pointers that end with a term stand together in sorted order, between the
    term and the term with the last character after it. Each pointer is one row, each term
    two; sorted inside ranges, a row counts the pointers before it, and a table with one row for each
    range carries what crosses them.
    """
    # Written once, as finding the ranges takes passes of its own.
    backwards = cut_lineage(index.select("ptr").filter(F.length("ptr") > 0).distinct().withColumn("_at", F.reverse("ptr")))
    cuts = range_cuts(backwards, "_at", chunk_rows)
    none = F.lit(None).cast("string")
    marks = terms.select("term").distinct().filter(F.col("term") != "")
    low, high = F.reverse("term"), F.concat(F.reverse("term"), F.lit(_LAST))
    rows = (
        backwards.select("_at", F.lit(1).alias("kind"), "ptr", none.alias("term"))
        .unionByName(marks.select(low.alias("_at"), F.lit(0).alias("kind"), none.alias("ptr"), "term"))
        .unionByName(marks.select(high.alias("_at"), F.lit(2).alias("kind"), none.alias("ptr"), "term"))
    )
    rows = rows.withColumn("chunk", range_of(cuts, F.col("_at"), "string").cast("bigint") if cuts else F.lit(0).cast("bigint"))
    # At most one row a range.
    ranges = rows.groupBy("chunk").agg(F.count("ptr").alias("_held"), F.min_by("ptr", F.when(F.col("ptr").isNotNull(), F.col("_at"))).alias("_own")).withColumn("_all", F.lit(0))
    ranges = before_in_source(ranges, "_all", _before=F.sum("_held")).withColumn("_after", F.expr("lead(_own) IGNORE NULLS OVER (PARTITION BY _all ORDER BY chunk)"))
    order = Window.partitionBy("chunk").orderBy("_at", "kind")
    counted = rows.select(
        "chunk", "kind", "term",
        F.count("ptr").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_in"),
        F.expr("lead(ptr) IGNORE NULLS OVER (PARTITION BY chunk ORDER BY _at, kind)").alias("_next"),
    ).filter("term IS NOT NULL").join(F.broadcast(ranges.select("chunk", "_before", "_after")), "chunk")
    place = F.col("_in") + F.coalesce("_before", F.lit(0))
    is_low = F.col("kind") == 0
    found = counted.groupBy("term").agg(
        (F.max(F.when(~is_low, place)) - F.max(F.when(is_low, place))).alias("matches"), F.max(F.when(is_low, F.coalesce("_next", "_after"))).alias("found")
    )
    return found.filter(F.col("matches") > 0)


def resolve_ptrs(refs: DataFrame, index: DataFrame, legacy: bool = False, chunk_rows: int = CHUNK_LINES) -> DataFrame:
    """Short references to full pointers: (ref, ptr, status, matches).

    ``refs`` has ``ref``, ``index`` is a result index (idx, ptr). More than fifty
    characters are a full pointer; a number is a place in the index; other text,
    without its ``@``, must be the end of exactly one pointer. ``legacy`` also
    takes text from anywhere in the pointer when none ends with it. ``status`` is
    full, index, resolved, ambiguous or missing.
    """
    # Each branch below asks it again.
    asked = refs.select("ref").distinct().select(
        "ref",
        (F.length("ref") > FULL_PTR_CHARS).alias("full"),
        F.when(F.col("ref").rlike(r"^\+?\d+\z"), F.col("ref").try_cast("int")).alias("idx"),
        F.regexp_replace("ref", "^@", "").alias("term"),
    )
    asked = cut_lineage(asked)
    placed = asked.filter(~F.col("full") & (F.col("idx") > 0)).select("ref", "idx").join(
        index.select("idx", F.col("ptr").alias("placed")), "idx"
    ).select("ref", "placed")
    terms = asked.filter(~F.col("full")).select("ref", "term")
    ends = _ending(terms, index, chunk_rows)
    found = terms.join(ends, "term", "left").select("ref", "matches", "found")
    if legacy:
        unmatched = found.filter(F.col("matches").isNull()).select("ref").join(terms, "ref")
        inside = _matches(
            unmatched, index,
            lambda p, n: F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substr(p, i, n))
            ),
        )
        more = unmatched.join(inside, "term").select(
            "ref", F.col("matches").alias("more"), F.col("found").alias("inner")
        )
        found = found.join(more, "ref", "left").select(
            "ref", F.coalesce("matches", "more").alias("matches"), F.coalesce("found", "inner").alias("found")
        )
    joined = asked.join(placed, "ref", "left").join(found, "ref", "left")
    matched = F.coalesce("matches", F.lit(0))
    status = (
        F.when(F.col("full"), F.lit("full"))
        .when(F.col("placed").isNotNull(), F.lit("index"))
        .when(matched == 1, F.lit("resolved"))
        .when(matched > 1, F.lit("ambiguous"))
        .otherwise(F.lit("missing"))
    )
    return joined.withColumn("status", status).select(
        "ref",
        F.when(F.col("status") == "full", F.col("ref"))
        .when(F.col("status") == "index", F.col("placed"))
        .when(F.col("status") == "resolved", F.col("found")).alias("ptr"),
        "status",
        F.when(F.col("status").isin("full", "index"), F.lit(1)).otherwise(matched).cast("bigint").alias("matches"),
    )


def ptr_candidates(ref: str, index: DataFrame, legacy: bool = False) -> DataFrame:
    """The index rows an ambiguous reference could mean."""
    term = ref.removeprefix("@")
    hit = F.endswith("ptr", F.lit(term))
    return index.filter((hit | F.col("ptr").contains(term)) if legacy else hit)
