"""Broadcast only what is known to be small."""

from pyspark.sql import DataFrame, functions as F

# Rows of a few short columns that may be broadcast: at most some 200 MB.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, row_bound: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when its row count is proven to be small.

    ``row_bound`` is an upper bound that holds whatever the data is (a limit, the
    length of an argument list, the number of file splits). Without one, or above
    ``limit``, the join is left to Spark, which measures both sides as it runs.
    """
    if row_bound is not None and row_bound <= limit:
        return F.broadcast(df)
    return df


def byte_conf(spark, name: str, default: int) -> int:
    """A byte-size setting as a number (``128MB``, ``134217728b`` or plain)."""
    text = str(spark.conf.get(name, str(default))).strip().lower()
    digits = "".join(c for c in text if c.isdigit())
    unit = text[len(digits):].strip().rstrip("b") or ""
    return int(digits) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[unit]
