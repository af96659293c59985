"""Investigation tables: cases, their timeline and their evidence.

A case may hold a large part of a table, so per-case results are aggregates that
merge in each task, or joins on a unique key; nothing gathers a case in one row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.pointers import parse_ptr, ptr_type
from logloom.functions.text import split_log_field
from logloom.functions.times import format_duration
from logloom.operators.filters import report_filter, status_filter
from logloom.operators.lookup import lookup_provenance
from logloom.plans.ordered import number_rows
from logloom.schemas import EVIDENCE, TIMELINE
from logloom.session import cut_lineage


def case_stats(timeline: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts, first and last action and time span per case.

    The first and last actions are those at the ends of the timeline.
    """
    is_query = F.col("type") == "query"
    actions = timeline.groupBy("case_id").agg(
        F.count_if(is_query).alias("queries"),
        F.count_if(is_query & F.col("marked")).alias("marked"),
        F.count_if(F.col("type") == "note").alias("notes"),
        F.min_by("ts", "seq").alias("first_action"),
        F.max_by("ts", "seq").alias("last_action"),
    )
    kept = evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("evidence"))
    seconds = (F.unix_micros("last_action") - F.unix_micros("first_action")) / F.lit(1_000_000)
    zero = F.lit(0).cast("bigint")
    return actions.join(kept, "case_id", "full").select(
        "case_id",
        *[F.coalesce(c, zero).alias(c) for c in ("queries", "marked", "notes", "evidence")],
        "first_action",
        "last_action",
        F.when(F.col("first_action").isNotNull(), format_duration(seconds)).alias("time_span"),
    )


def case_list(cases: DataFrame, timeline: DataFrame, evidence: DataFrame, status: str = "all") -> DataFrame:
    """Cases with their counts, last updated first."""
    counts = case_stats(timeline, evidence).select(F.col("case_id").alias("id"), "queries", "notes", "evidence")
    zero = F.lit(0).cast("bigint")
    return (
        status_filter(cases, status)
        .join(counts, "id", "left")
        .select("id", "status", "title", "updated", *[F.coalesce(c, zero).alias(c) for c in ("queries", "notes", "evidence")])
        .orderBy(F.col("updated").desc(), "id")
    )


def mark_last(timeline: DataFrame, cases: list[str] | None = None) -> DataFrame:
    """The timeline with the last query of each case (or of these cases) marked."""
    last = timeline.filter(F.col("type") == "query")
    if cases is not None:
        last = last.filter(F.col("case_id").isin(cases))
    last = last.groupBy("case_id").agg(F.max("seq").alias("seq")).withColumn("_last", F.lit(True))
    joined = timeline.join(last, ["case_id", "seq"], "left")
    marked = F.coalesce("marked", F.lit(False)) | F.coalesce("_last", F.lit(False))
    return joined.withColumn("marked", marked).select(*timeline.columns)


def cases_without_query(cases: DataFrame, timeline: DataFrame) -> DataFrame:
    """Cases where there is nothing to mark."""
    asked = timeline.filter(F.col("type") == "query").select(F.col("case_id").alias("id")).distinct()
    return cases.join(asked, "id", "left_anti")


def report_rows(timeline: DataFrame, full: bool = False) -> DataFrame:
    """What a report shows, numbered per case."""
    return number_rows(report_filter(timeline, full), ["case_id"], "seq", "number")


def numbered_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence with its number in the case."""
    return number_rows(evidence, ["case_id"], "seq", "number")


def source_address(entries_source: Column, ptr: Column, fields: Column) -> Column:
    """Where a record comes from: its file, or the group its own fields name."""
    log = F.try_element_at(fields, F.lit("@log"))
    group = F.coalesce(
        F.when(entries_source != "", entries_source),
        F.try_element_at(fields, F.lit("@logGroup")),
        split_log_field(log),
    )
    return F.when(ptr_type(ptr) == "local", F.concat(F.lit("file://"), parse_ptr(ptr)["path"])).when(
        group.isNotNull(), F.concat(F.lit("cloudwatch:///"), F.regexp_replace(group, F.lit("^/"), F.lit("")))
    )


def _shape(df: DataFrame, schema, **columns) -> DataFrame:
    """Exactly the columns of a schema; those not given are NULL."""
    return df.select(
        *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def _next_seq(rows: DataFrame, table: DataFrame) -> tuple[DataFrame, Column]:
    """Rows (with a per-case ``number``) to sequence numbers after those in use."""
    used = table.groupBy("case_id").agg(F.max("seq").alias("_used"))
    joined = rows.join(used, "case_id", "left")
    return joined, F.coalesce("_used", F.lit(0)) + F.col("number")


def collect_evidence(
    entries: DataFrame, picks: DataFrame, evidence: DataFrame, timeline: DataFrame, collected_at,
    index: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new evidence rows, their timeline rows) for picked pointers.

    ``picks`` has (case_id, ptr, annotation) and a ``seq`` that orders them per case.
    A pointer the case already holds, and a second pick of one, add nothing.
    ``index`` gives provenance of opaque pointers.
    """
    fresh = picks.join(evidence.select("case_id", "ptr"), ["case_id", "ptr"], "left_anti")
    first = fresh.groupBy("case_id", "ptr").agg(F.min_by(F.struct("seq", "annotation"), "seq").alias("_first"))
    wanted = first.select("case_id", "ptr", "_first.seq", "_first.annotation")
    records = entries.join(wanted.select("ptr").distinct(), "ptr", "left_semi").select(
        "ptr", "message", "timestamp", "stream", F.col("source").alias("_source"), "fields"
    )
    full = wanted.join(records, "ptr")
    if index is not None:
        full = lookup_provenance(full, index)
    else:
        full = full.withColumns({c: F.lit(None).cast("string") for c in ("source_uri", "source_type", "profile", "account_id")})
    # Numbers take passes of their own and serve two results: the joins above run once.
    numbered = number_rows(cut_lineage(full), ["case_id"], "seq", "number")
    own = source_address(F.col("_source"), F.col("ptr"), F.col("fields"))
    known = F.when(
        F.coalesce("source_uri", F.lit("")) != "",
        F.concat(F.lit("cloudwatch:///"), F.regexp_replace("source_uri", F.lit("^/"), F.lit(""))),
    )
    uri = F.when(ptr_type(F.col("ptr")) == "local", own).otherwise(F.coalesce(known, own))
    at = F.lit(collected_at).cast("timestamp")

    placed, seq = _next_seq(numbered, evidence)
    new_evidence = _shape(
        placed, EVIDENCE,
        case_id=F.col("case_id"), seq=seq, ptr=F.col("ptr"), message=F.col("message"),
        timestamp=F.col("timestamp"), source_uri=uri, source_type=ptr_type(F.col("ptr")),
        stream=F.col("stream"), profile=F.col("profile"), account_id=F.col("account_id"),
        collected_at=at, annotation=F.col("annotation"), raw_fields=F.col("fields"),
    )
    placed, seq = _next_seq(numbered, timeline)
    new_actions = _shape(
        placed, TIMELINE,
        case_id=F.col("case_id"), seq=seq, ts=at, type=F.lit("evidence"), marked=F.lit(False),
        content=F.col("message"), source=uri,
    )
    return new_evidence, new_actions


def annotate(evidence: DataFrame, updates: DataFrame) -> DataFrame:
    """Evidence with the annotations of ``updates`` (case_id, ptr, annotation)."""
    new = updates.select("case_id", "ptr", F.col("annotation").alias("_new"))
    return evidence.join(new, ["case_id", "ptr"], "left").withColumn(
        "annotation", F.coalesce("_new", "annotation")
    ).select(*evidence.columns)


def unknown_evidence(evidence: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates no evidence answers to."""
    return updates.join(evidence.select("case_id", "ptr"), ["case_id", "ptr"], "left_anti")


def audit_rows(runs: DataFrame, timeline: DataFrame) -> DataFrame:
    """K9: timeline rows of query runs and notes, numbered after those in use.

    ``runs`` has case_id, seq (their order), ts, and any other timeline column;
    rows with ``content`` and no type are notes, others queries.
    """
    given = set(runs.columns)
    numbered = number_rows(runs, ["case_id"], "seq", "number")
    placed, seq = _next_seq(numbered, timeline)
    has_content = F.col("content").isNotNull() if "content" in given else F.lit(False)
    kind = F.when(has_content, F.lit("note")).otherwise(F.lit("query"))
    columns = {c: F.col(c) for c in TIMELINE.fieldNames() if c in given}
    columns["seq"] = seq
    columns["type"] = F.coalesce("type", kind) if "type" in given else kind
    columns["marked"] = F.coalesce("marked", F.lit(False)) if "marked" in given else F.lit(False)
    return _shape(placed, TIMELINE, **columns)


def case_report(cases: DataFrame, timeline: DataFrame, evidence: DataFrame, full: bool = False) -> DataFrame:
    """K7: a case's report as rows: its header, then evidence, then actions.

    (case_id, section, number, at, body): ``body`` is the JSON of the item. A report
    of any length is rows to be written by many tasks, not one document.
    """
    header = cases.select(
        F.col("id").alias("case_id"), F.lit("case").alias("section"), F.lit(1).cast("bigint").alias("number"),
        F.col("created").alias("at"),
        F.to_json(F.struct("id", "title", "status", "created", "updated", F.nullif("summary", F.lit("")).alias("summary"))).alias("body"),
    )
    kept = numbered_evidence(evidence)
    items = kept.select(
        "case_id", F.lit("evidence").alias("section"), "number", F.col("collected_at").alias("at"),
        F.to_json(F.struct(*[c for c in evidence.columns if c not in ("case_id", "seq")])).alias("body"),
    )
    shown = report_rows(timeline, full)
    actions = shown.select(
        "case_id", F.lit("timeline").alias("section"), "number", F.col("ts").alias("at"),
        F.to_json(F.struct(*[c for c in timeline.columns if c not in ("case_id", "seq")])).alias("body"),
    )
    return header.unionByName(items).unionByName(actions)
