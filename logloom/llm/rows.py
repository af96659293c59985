"""Row plumbing the text operators share: Arrow batches in, Arrow rows out."""

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Texts of one working block, in bytes; bounds what a task holds besides the Arrow batch.
BLOCK_BYTES = 1 << 20
# Rows worked on together, in bytes.
PIECE_BYTES = 8 << 20


def text_frame(df: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """Only the id and the text, under names of our own, whatever else ``df`` carries."""
    return df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def reach_code(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, however it was started."""
    here = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about PIECE_BYTES, so that what is made of one stays small."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, PIECE_BYTES))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows or more, but for the last one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Hand memory that is free in this worker back to the system: idle workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_kept: dict[tuple, object] = {}
_asked: set[tuple] = set()


def kept(build: Callable) -> Callable:
    """One value for each Python worker and its arguments, with what it remembers from earlier tasks.

    It goes when the worker, which lives on between stages, takes up work that did not ask for it.
    """

    @wraps(build)
    def get(*args):
        key = (build.__module__, build.__qualname__, *args)
        if key not in _kept:
            _kept[key] = build(*args)
        _asked.add(key)
        return _kept[key]

    return get


def made(make: Callable) -> Callable:
    """What ``make()`` returns; this worker then keeps only what that has asked for."""
    _asked.clear()
    work = make()
    if gone := _kept.keys() - _asked:
        for key in gone:
            del _kept[key]
        gc.collect()
        give_back()
    return work


def map_rows(df: DataFrame, make: Callable, schema: str, rows: int = 0, last: bool = False) -> DataFrame:
    """Run ``make()`` once a task, then the function it returns on each Arrow batch.

    ``make`` builds what is costly (automata, tables) and returns ``batch -> dict of
    columns``; the columns must be those of ``schema``. ``rows`` joins small batches,
    ``last`` asks for a last call with None at the end of the task.
    """
    reach_code(df.sparkSession)
    # Pickled with the function; Arrow schemas keep field order and types.
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = made(make)

        def answer(batch):
            columns = work(batch)
            own = [columns[f.name] for f in arrow]
            own = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(own, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(own, schema=arrow)

        for batch in gathered(batches, rows) if rows else pieces(batches):
            if batch.num_rows:
                yield answer(batch)
        if last:
            yield answer(None)
        batch = None
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name="text") -> list[str]:
    """The batch's texts; a null text is an empty one."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def filter_rows(df: DataFrame, make: Callable) -> DataFrame:
    """Rows of ``df``, all columns, for which the function that ``make()`` returns says True (batch -> list of bool)."""
    reach_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = made(make)
        for batch in pieces(batches):
            if batch.num_rows:
                yield batch.filter(pa.array(work(batch), pa.bool_()))
        batch = None
        give_back()

    return df.mapInArrow(run, df.schema)


def rewrite_texts(df: DataFrame, make: Callable, text_column="text", length_column="n_chars") -> DataFrame:
    """``df`` with new texts where the function that ``make()`` returns has one (batch -> list of text or None).

    The length column, where there is one, follows the changed texts.
    """
    reach_code(df.sparkSession)
    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = made(make)
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            new = work(batch)
            columns = list(batch.columns)
            for name, value in ((text_column, lambda t: t), (length_column, len)):
                if name in names:
                    i = names.index(name)
                    old = columns[i].to_pylist()
                    columns[i] = pa.array([o if t is None else value(t) for o, t in zip(old, new, strict=True)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        batch = columns = new = old = None
        give_back()

    return df.mapInArrow(run, schema)
