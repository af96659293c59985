"""Log records made from the given tables, whole tables always."""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.pointers import make_ptr
from logloom.plans.ordered import number_rows


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores, on all cores; a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cents() -> Column:
    return F.round(F.col("value") * 100).cast("bigint")


def event_message() -> Column:
    return F.concat(F.col("event_type"), F.lit(" user="), F.col("user_id"), F.lit(" cents="), cents())


SQL_MESSAGE = "event_type || ' user=' || user_id || ' cents=' || CAST(round(value * 100) AS BIGINT)"


def entries(spark, sf: str) -> DataFrame:
    """Events as ENTRY rows: a stream per user, a source per event type."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        event_message().alias("message"),
        F.concat(F.lit("user-"), "user_id").alias("stream"),
        F.concat(F.lit("/events/"), "event_type").alias("source"),
        F.col("event_id").cast("bigint").alias("line_no"),
        make_ptr(F.concat(F.lit("/events/"), "event_type"), F.col("event_id")).alias("ptr"),
        F.create_map(F.lit("action"), F.col("event_type"), F.lit("k"), k).alias("fields"),
    )


def with_event_id(df: DataFrame) -> DataFrame:
    return df.withColumn("event_id", F.col("line_no"))


def micros(column="timestamp") -> Column:
    """Epoch microseconds, -1 for an unknown time."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(-1).cast("bigint"))


def rendered(spark, sf: str, line: Column, source: Column | None = None) -> DataFrame:
    """One LINES row per event; the line number rises along the source."""
    source = F.concat(F.lit("/v/app-"), F.col("user_id") % 4, F.lit(".log")) if source is None else source
    return spread(table(spark, sf, "events")).select(
        source.alias("source"), (F.col("event_id") + 1).alias("line_no"), line.alias("line")
    )


def numbered_lines(spark, sf: str) -> DataFrame:
    """Events as the lines of eight files, numbered 1, 2, 3 … in each."""
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("/v/part-"), F.col("user_id") % 8, F.lit(".log")).alias("source"),
        "event_id",
        event_message().alias("line"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    return number_rows(rows, ["source"], "event_id", "line_no")


def timeline(spark, sf: str) -> DataFrame:
    """Events as the actions of one case per user."""
    kind = (
        F.when(F.col("event_type").isin("click", "view"), "query")
        .when(F.col("event_type") == "signup", "note")
        .otherwise("evidence")
    )
    no = F.lit(None).cast("string")
    return table(spark, sf, "events").select(
        F.concat(F.lit("case-"), "user_id").alias("case_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("type"),
        F.concat(F.lit("file:///events/"), "event_type").alias("source_uri"),
        F.lit("local").alias("source_type"),
        no.alias("profile"), no.alias("account_id"), no.alias("command"),
        F.col("event_type").alias("filter"), no.alias("query"),
        F.lit(None).cast("timestamp").alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"),
        cents().cast("int").alias("results"),
        (F.col("event_type") == "view").alias("marked"),
        event_message().alias("content"), no.alias("source"),
    )


def evidence(spark, sf: str) -> DataFrame:
    """Purchases as the evidence their users' cases hold."""
    no = F.lit(None).cast("string")
    return entries(spark, sf).filter(F.col("source") == "/events/purchase").select(
        F.concat(F.lit("case-"), F.substring_index("stream", "-", -1)).alias("case_id"),
        F.col("line_no").alias("seq"), "ptr", "message", "timestamp",
        F.concat(F.lit("file://"), "source").alias("source_uri"), F.lit("local").alias("source_type"), "stream",
        no.alias("profile"), no.alias("account_id"),
        F.col("timestamp").alias("collected_at"), no.alias("annotation"), F.col("fields").alias("raw_fields"),
    )


def cases(spark, sf: str) -> DataFrame:
    """A case per user: opened at the first event, last updated at the last one."""
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.min("ts").cast("timestamp").alias("created"), F.max("ts").cast("timestamp").alias("updated")
    ).select(
        F.concat(F.lit("case-"), "user_id").alias("id"),
        F.concat(F.lit("User "), "user_id").alias("title"),
        "created", "updated",
        F.when(F.col("user_id") % 3 == 0, "closed").otherwise("active").alias("status"),
        F.lit("").alias("summary"),
    )


def metrics(spark, sf: str) -> DataFrame:
    """Events as points: a metric per event type, with the low digit of the user as dimension."""
    from logloom.sources.metrics import read_metrics

    return read_metrics(
        table(spark, sf, "events"), F.lit("app/events"), "event_type", "value", "ts",
        F.create_map(F.lit("shard"), (F.col("user_id") % 3).cast("string")), F.lit("None"),
    )
