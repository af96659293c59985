"""F2 over stored text: which files can hold a match, by the letter triples that each file has.

Every run of three characters of a file's messages is hashed to one of BITS places; the index
has one row a file, its places. A pattern names triples that all its matches have; files
without them are not opened. Hashes collide now and then, which opens a file for nothing.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.literals import required_triples
from logloom.operators.filters import grep
from logloom.sources.address import LogSource
from logloom.sources.lines import source_name

BITS = 1 << 18
# Letters that some ASCII letter matches in any case though they do not become one in lower case.
_ODD, _EVEN = "İıſK", "iisk"


def _folded(text: Column) -> Column:
    return F.lower(F.translate(text, _ODD, _EVEN))


def _place(triple: Column) -> Column:
    return F.pmod(F.xxhash64(triple), F.lit(BITS)).cast("int")


def write_text_index(source: LogSource, path: str, mode: str = "overwrite") -> None:
    """(source, places) of every file of a text source, from the messages that its entries have.

    One pass; each task drops the triples that it has seen already, so what is exchanged is at most BITS
    small rows a file and task, and a row of the index has at most BITS numbers, however large its file is.
    """
    low = _folded(F.col("message"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("low") - 2, F.lit(1)))
    messages = source.entries(numbered=False).select("source", low.alias("low")).filter(F.length("low") > 2)
    triples = messages.select("source", F.explode(F.array_distinct(F.transform(starts, lambda i: _place(F.substr("low", i, F.lit(3)))))).alias("place"))
    places = triples.distinct().groupBy("source").agg(F.sort_array(F.collect_list("place")).alias("places"))
    places.write.mode(mode).parquet(path)


def files_with(source: LogSource, path: str, pattern: str) -> list[str]:
    """The files of the source that may hold a match; those that the index does not know are among them."""
    spark = source.scan.spark
    clauses = required_triples(pattern)
    files = [source_name(f) for f in source.scan.raw.inputFiles()]
    if not clauses:
        return files
    index = spark.read.schema("source string, places array<int>").parquet(path)

    def has(triples: frozenset) -> Column:
        wanted = F.array_distinct(F.array(*[_place(F.lit(t)) for t in sorted(triples)]))
        return F.size(F.array_intersect(wanted, "places")) == F.size(wanted)

    may = reduce(Column.__and__, [reduce(Column.__or__, map(has, choice)) for choice in clauses])
    # Names are as many as the listing, which the driver holds in any case.
    without = {r["source"] for r in index.filter(~may).select("source").collect()}
    return [f for f in files if f not in without]


def search_indexed(source: LogSource, path: str, pattern: str, numbered: bool = True) -> DataFrame:
    """the entries of a text source whose message has a match; files that cannot hold one are not opened.

    The same rows as ``grep`` of its entries, also where files came after the index was written. A file that
    was changed since must be indexed anew.
    """
    files = files_with(source, path, pattern)
    if not files:
        return source.entries(numbered).limit(0)
    few = LogSource(source.kind, source.uri, scan=source.scan.only(files), format=source.format, scope=source.scope, options=source.options)
    return grep(few.entries(numbered), pattern)
