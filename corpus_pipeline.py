"""Documents to training tokens: every stage works on all that the one before has kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import bpe, decontaminate, neardup, secrets, toxicity
from logloom.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Similarity of near-duplicates: shingles of five words, 80 in 100 of the joint ones shared.
SHINGLE, PERCENT = 5, 80
VOCABULARY = "word_bpe_49k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, does not call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{str(sf_dir).rstrip('/')}/labels.parquet"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows one: that of the least id (rows without an id come last), then of the
    least text hash; of equal rows the one numbered first. Texts without words all stay."""
    # Numbers are written before they are used, so that every reader sees the same ones.
    rows = cut_lineage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), "row")
    kept = neardup.near_duplicates(rows.select(order.alias("row"), "text"), "row", size=SHINGLE, percent=PERCENT).filter("kept")
    return rows.join(kept.select("doc_id.row"), "row", "left_semi").select(*COLUMNS)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a benchmark window covers."""
    benchmark = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/benchmark.parquet")
    return decontaminate.clean_documents(docs, benchmark).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return secrets.redact_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), decoded=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_copy),
    ("decontamination", cut_benchmarks),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

# A trained classifier, suffix orders and token ids have no SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
