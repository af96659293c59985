"""Results of a remote query service, as rows of (row_id, field, value)."""

from pyspark.sql import DataFrame, functions as F

from logloom.functions.times import service_time


def from_field_rows(cells: DataFrame, source: str | None = None, order: str | None = None) -> DataFrame:
    """(row_id, field, value) cells to entries; cells without name or value drop out.

    ``order`` names the column that says which of a repeated field comes last (by
    default the greatest value counts, so the result does not depend on the run).
    A row has a few fields, so a group is never large.
    """
    rank = F.col(order) if order else F.col("value")
    last = (
        cells.filter(F.col("field").isNotNull() & F.col("value").isNotNull())
        .groupBy("row_id", "field")
        .agg(F.max(F.struct(rank.alias("rank"), "value"))["value"].alias("value"))
    )
    rows = last.groupBy("row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields")
    )
    # A row whose cells were all dropped is still a row.
    all_rows = cells.select("row_id").distinct().join(rows, "row_id", "left")
    return from_records(all_rows, source)


def from_records(rows: DataFrame, source: str | None = None) -> DataFrame:
    """Rows with a ``fields`` map (one per record) to entries, other columns kept."""
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    rest = [c for c in rows.columns if c != "fields"]
    return rows.select(
        *rest,
        service_time(F.try_element_at(fields, F.lit("@timestamp"))).alias("timestamp"),
        F.coalesce(F.try_element_at(fields, F.lit("@message")), F.lit("")).alias("message"),
        F.coalesce(F.try_element_at(fields, F.lit("@logStream")), F.lit("")).alias("stream"),
        F.lit(source).cast("string").alias("source"),
        F.lit(None).cast("bigint").alias("line_no"),
        F.coalesce(F.try_element_at(fields, F.lit("@ptr")), F.lit("")).alias("ptr"),
        fields.alias("fields"),
    )
