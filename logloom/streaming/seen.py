"""De-duplication that remembers a number of keys, not a span of time."""

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

SEEN_KEYS = 10_000


def dedup_newest(events: DataFrame, keys=("timestamp", "message"), capacity: int = SEEN_KEYS, parts: int = 1) -> DataFrame:
    """Drops events whose key is among the last ``capacity`` different ones.

    Keys are forgotten in the order in which they first came, whatever their age; a repeated key does
    not make it younger. ``parts`` shares the keys out by hash: each part remembers ``capacity`` keys of its
    own and is one task's, so one part remembers exactly as many as asked, and many scale. No event with a
    key that is not remembered is dropped. State is ``capacity`` numbers of 64 bits a part; keys
    are told apart by them. Null key columns are values like others. Events keep the order in which they arrive in a part.
    """
    names, schema = events.columns, events.schema
    number = F.xxhash64(*[F.col(k).isNull() for k in keys], *keys)
    dealt = events.withColumn("_key", number).withColumn("_part", F.pmod(F.col("_key"), F.lit(parts)).cast("int"))

    def keep(part: tuple, chunks: Iterator, state) -> Iterator:
        seen = OrderedDict.fromkeys(state.get[0] if state.exists else [])
        for rows in chunks:
            fresh = []
            for key in rows["_key"].tolist():
                new = key not in seen
                fresh.append(new)
                if new and capacity > 0:
                    if len(seen) >= capacity:
                        seen.popitem(last=False)
                    seen[key] = None
            yield rows.loc[fresh, names]
        state.update((list(seen),))

    return dealt.groupBy("_part").applyInPandasWithState(keep, schema, "seen array<bigint>", "append", "NoTimeout")
