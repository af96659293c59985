"""Order, limits and positions."""

from pyspark.sql import DataFrame, Window, functions as F

from logloom.fixed import HISTORY_KEEP, QUERY_LIMIT, REMOTE_QUERY_LIMIT


def _tie_break(df: DataFrame) -> list:
    named = [c for c in ("source", "chunk", "pos", "line_no", "ptr") if c in df.columns]
    return [F.col(c) for c in (named or [c for c in ("message", "stream") if c in df.columns])]


def newest_order(df: DataFrame) -> list:
    """Newest first, unknown times last, ties in source order."""
    return [F.col("timestamp").desc_nulls_last(), *_tie_break(df)]


def newest(df: DataFrame, limit: int | None = QUERY_LIMIT) -> DataFrame:
    """Newest first, then cut; no limit (or one below 1) keeps all rows."""
    ordered = df.orderBy(*newest_order(df))
    return ordered.limit(limit) if limit and limit > 0 else ordered


def remote_limit(limit: int) -> int:
    """What a remote query's limit means; none given is not no limit there."""
    return limit if limit > 0 else REMOTE_QUERY_LIMIT


def top_by(df: DataFrame, column: str, limit: int | None, *ties: str) -> DataFrame:
    """T5: greatest first."""
    ordered = df.orderBy(F.col(column).desc_nulls_last(), *[F.col(t) for t in ties])
    return ordered.limit(limit) if limit and limit > 0 else ordered


def result_index(results: DataFrame, limit: int = QUERY_LIMIT, provenance: dict | None = None) -> DataFrame:
    """1, 2, 3 … along the newest ``limit`` results, with where they come from.

    The numbering is one sorted run, so it takes a limit; rows without a pointer
    have no place in the index.
    """
    if not limit or limit <= 0:
        raise ValueError("a result index needs a limit")
    kept = newest(results, limit).filter(F.coalesce("ptr", F.lit("")) != "")
    order = Window.orderBy(*newest_order(kept))
    meta = provenance or {}
    return kept.select(
        F.row_number().over(order).alias("idx"),
        "ptr",
        F.lit(meta.get("uri")).cast("string").alias("source_uri") if "uri" in meta else F.col("source").alias("source_uri"),
        F.lit(meta.get("type")).cast("string").alias("source_type"),
        "stream",
        F.lit(meta.get("profile")).cast("string").alias("profile"),
        F.lit(meta.get("account_id")).cast("string").alias("account_id"),
    )


def keep_latest(df: DataFrame, key, order: str, n: int = HISTORY_KEEP, *ties: str) -> DataFrame:
    """The newest ``n`` rows per key; each task first drops what cannot be kept."""
    keys = [key] if isinstance(key, str) else list(key)
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *[F.col(t).desc() for t in ties])
    return df.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= n).drop("_rank")


def dedup_events(df: DataFrame, keys=("timestamp", "message"), first: str | None = None) -> DataFrame:
    """One row per key. ``first`` names the column whose least value is kept.

    Copies are merged in each task before the exchange, so many copies of one
    event cost one row per task.
    """
    if first is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys and c != first]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(first, *rest), first).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)
