"""Names that are spelled nearly alike."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.fixed import SIMILAR_DISTANCE, SIMILAR_KEEP
from logloom.session import cut_lineage


def _shorter(spellings: Column) -> Column:
    """Every spelling, and every one with one more character left out."""
    cut = F.transform(
        spellings,
        lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
            lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)),
        ),
    )
    return F.array_distinct(F.concat(spellings, F.flatten(cut)))


def _exploded(words: DataFrame, left_out: int) -> DataFrame:
    """A row per spelling of ``low``; in steps, so that each is worked out once."""
    rows = words.withColumn("_cut", F.array("low"))
    for _ in range(left_out):
        rows = rows.withColumn("_cut", _shorter(F.col("_cut")))
    # Equal spellings have equal hashes; what merely collides fails the distance test.
    return rows.withColumn("spelling", F.explode(F.transform("_cut", lambda s: F.xxhash64(s)))).drop("_cut")


def _pairs(names: DataFrame, words: DataFrame, distance: int) -> DataFrame:
    """(target, name) that lie exactly so far apart, some of them repeated."""
    left = _exploded(names, distance).select("name", "spelling")
    right = _exploded(words, distance).select("target", "spelling")
    # Sizes are estimated before the rows are multiplied; without the hint a side would be broadcast.
    met = right.join(left.hint("merge"), "spelling")
    return met.filter(F.levenshtein(F.lower("target"), F.lower("name"), distance) == distance).select("target", "name")


def similar_names(
    candidates: DataFrame, targets: DataFrame, max_distance: int = SIMILAR_DISTANCE, keep: int = SIMILAR_KEEP
) -> DataFrame:
    """(target, name, distance, rank): per target the nearest names, ties by name.

    Two words at distance d become equal after leaving out at most d characters of
    each, so an equality join on such spellings finds every pair. It is tried for
    distance 0, then 1, … and a target that has enough names goes no further: dense
    neighbourhoods are settled by the few spellings of the first steps, and the many
    spellings of the last serve only words with few neighbours.
    """
    # Cutting spellings is much work on few bytes: keep it on all cores.
    tasks = candidates.sparkSession.sparkContext.defaultParallelism
    names = candidates.select("name").filter(F.col("name").isNotNull()).repartition(tasks, "name").distinct()
    names = names.withColumn("low", F.lower("name"))
    words = targets.select("target").filter(F.col("target").isNotNull()).repartition(tasks, "target").distinct()
    words = words.withColumn("low", F.lower("target"))
    found, open_words = None, words
    for d in range(max_distance + 1):
        nearest = Window.partitionBy("target").orderBy("name")
        step = (
            _pairs(names, open_words, d).distinct()
            .withColumn("_rank", F.row_number().over(nearest))
            .filter(F.col("_rank") <= keep)
            .select("target", "name", F.lit(d).alias("distance"))
        )
        # The next step asks what this one found: at most ``keep`` rows per target.
        step = cut_lineage(step)
        found = step if found is None else found.unionByName(step)
        settled = found.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= keep)
        open_words = words.join(settled, "target", "left_anti")
        if open_words.isEmpty():
            break
    best = Window.partitionBy("target").orderBy("distance", "name")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
