"""Operator 6: token counts by source, language and tokenizer version, kept up by deltas.

A batch of changes becomes signed sums: an insert adds, a delete takes away, a revision
takes the old count away and adds the new one. A batch is written under its own id and
counts once its commit file is there, so a batch run again, or a job that died half-way
and was restarted, changes nothing twice. Totals are sums over committed batches; those of
many are folded into one table, whose list of batches decides what is counted from where.
"""

import hashlib

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.llm.chat import ChatCodec
from logloom.llm.pretoken import encode_text
from logloom.llm.rows import BLOCK_BYTES, map_rows
from logloom.llm.words import ALPHANUMERIC, SPACED, text_blocks, utf8, word_spans
from logloom.session import drop_folder, folders_in

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens"]
DELTAS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


class TokenRollup:
    """Totals below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ``open/<batch>`` has the sums of a batch, ``committed/<batch>`` says that it counts. ``folded/<n>`` has the sums of
    # many batches and the names of those that its making took in; it holds from when its own ``committed`` is there.

    @staticmethod
    def _name(batch: str) -> str:
        return hashlib.sha256(batch.encode("utf-8")).hexdigest()[:32]

    def _folder(self, batch: str) -> str:
        return f"{self.path}/open/{self._name(batch)}"

    def _there(self, path: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{path}"))

    def _create(self, path: str, text: str = "") -> None:
        out = self._fs.create(self._at(f"{self.path}/{path}"), True)
        out.write(bytearray(text.encode("ascii")))
        out.close()

    def is_committed(self, batch: str) -> bool:
        return self._there(f"committed/{self._name(batch)}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Count a batch in; False, and nothing done, if it is counted already.

        ``changes``: op (``insert``, ``delete`` or ``revise``), source, lang, tokenizer,
        n_tokens, and old_tokens for revisions. Null sources, languages and tokenizers
        are groups of their own; a null count is 0; another or no op is an error. An
        empty batch is a batch. One writer at a time for a batch.
        """
        if self.is_committed(batch):
            return False
        old, new, op = F.coalesce("old_tokens", F.lit(0)), F.coalesce("n_tokens", F.lit(0)), F.col("op")
        wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null"))))
        docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong.cast("int"))
        tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old)
        # Summed in each task before the exchange, so a source of any size is a row for each task.
        deltas = changes.groupBy(*KEYS).agg(F.sum(docs).cast("bigint").alias("n_docs"), F.sum(tokens).cast("bigint").alias("n_tokens"))
        deltas.write.mode("overwrite").parquet(f"{self._folder(batch)}/deltas")
        self._create(f"committed/{self._name(batch)}")
        return True

    def _folded(self) -> tuple[int, set[str]]:
        """The number of the table that holds, 0 for none, and the batches it took in last."""
        done = [int(n) for n in folders_in(self.spark, f"{self.path}/folded") if self._there(f"folded/{n}/committed")]
        if not done:
            return 0, set()
        file = self._fs.open(self._at(f"{self.path}/folded/{max(done)}/batches"))
        try:
            return max(done), set(bytes(file.readAllBytes()).decode("ascii").split())
        finally:
            file.close()

    def _open(self, folded: set[str]) -> list[str]:
        """Committed batches that no table holds. Batches of earlier tables have no sums of their own any more."""
        return sorted(n for n in folders_in(self.spark, f"{self.path}/open") if n not in folded and self._there(f"committed/{n}"))

    def deltas(self) -> DataFrame:
        """Sums of all committed batches, many of them together where they are folded."""
        at, folded = self._folded()
        done = [f"{self.path}/open/{n}/deltas" for n in self._open(folded)] + [f"{self.path}/folded/{at}/sums"] * (at > 0)
        return self.spark.read.schema(DELTAS).parquet(*done) if done else self.spark.createDataFrame([], DELTAS)

    def compact(self) -> int:
        """Fold all committed batches into one table; how many there were. Totals do not change.

        A job that dies half-way leaves what held before or the new table, never both: the table's commit decides. What is
        folded is removed after that, at the latest by the next call. One caller at a time; batches may be committed meanwhile.
        """
        at, folded = self._folded()
        # What an earlier call has left.
        for n in folders_in(self.spark, f"{self.path}/open"):
            if n in folded:
                drop_folder(self.spark, f"{self.path}/open/{n}")
        fresh = self._open(folded)
        if fresh:
            tables = [f"{self.path}/open/{n}/deltas" for n in fresh] + [f"{self.path}/folded/{at}/sums"] * (at > 0)
            sums = self.spark.read.schema(DELTAS).parquet(*tables).groupBy(*KEYS).agg(*[F.sum(s).cast("bigint").alias(s) for s in SUMS])
            sums.write.mode("overwrite").parquet(f"{self.path}/folded/{at + 1}/sums")
            self._create(f"folded/{at + 1}/batches", "\n".join(fresh))
            self._create(f"folded/{at + 1}/committed")
            for n in fresh:
                drop_folder(self.spark, f"{self.path}/open/{n}")
            if at:
                drop_folder(self.spark, f"{self.path}/folded/{at}")
        return len(fresh)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups that came to nothing are left out."""
        sums = self.deltas().groupBy(*KEYS).agg(*[F.sum(s).cast("bigint").alias(s) for s in SUMS])
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")


def change(counts: DataFrame, op: str, tokenizer: str, tokens: Column | str, old: Column | str | None = None) -> DataFrame:
    """Rows of one kind of change, from a table with source and lang."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    none = F.lit(None).cast("bigint")
    return counts.select(
        F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"),
        col(tokens).alias("n_tokens"), (none if old is None else col(old)).alias("old_tokens"),
    )


@lru_cache(maxsize=1)
def counter_of(path: str, pattern: str) -> ChatCodec:
    return ChatCodec(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, text_column="text") -> DataFrame:
    """source, lang and three counts of every whole text: spaced (runs without white space),
    words (runs of letters, digits and everything beyond ASCII) and pieces (of a rank
    vocabulary). A null text has 0 of each; repeated rows each give a row."""
    frame = docs.select("source", "lang", F.col(f"`{text_column}`").cast("string").alias("text"))

    def make():
        codec = counter_of(path, pattern)

        def work(batch):
            out = {"source": batch.column("source"), "lang": batch.column("lang"), "spaced": [], "words": [], "pieces": []}
            raw, offsets = utf8(batch.column("text"))
            for a, b in text_blocks(offsets, BLOCK_BYTES):
                part, starts = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for name, kind in (("spaced", SPACED), ("words", ALPHANUMERIC)):
                    out[name] += np.diff(word_spans(part, starts, kind)[3]).tolist()
                for x, y in zip(starts[:-1], starts[1:], strict=True):
                    out["pieces"].append(len(encode_text(codec.plain, part[x:y].tobytes().decode("utf-8"))))
            return out

        return work

    return map_rows(frame, make, "source string, lang string, spaced bigint, words bigint, pieces bigint")
