"""The pipeline's stages against plain versions, and the registered queries on the smallest tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from logloom.llm import bpe  # noqa: E402
from logloom.llm.decontaminate import WINDOW  # noqa: E402
from logloom.llm.rows import made, map_rows  # noqa: E402
from logloom.llm.secrets import find_secrets  # noqa: E402
from logloom.session import cut_lineage  # noqa: E402
from test_corpus_ops import plain_components  # noqa: E402
from test_text_scans import WORD, brute_hits, lowered  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture
def corpus(spark, tmp_path):
    random.seed(21)
    vocab = ["word%d" % i for i in range(150)]
    prose = lambda n: " ".join(random.choices(vocab, k=n))
    rows, labels = [], []
    for i in range(400):
        text = ". ".join(prose(random.randint(5, 12)) for _ in range(random.randint(1, 6)))
        if i % 4 == 0:
            text += ". you vile wretch."
        rows.append((i, text))
        labels.append((i, i % 4 == 0))
    items = [(1, prose(25)), (2, prose(6)), (3, None)]
    base = prose(60)
    rows += [(1000, base), (1001, base), (1002, base + " tail"), (1003, prose(60)), (1004, None), (1005, ""), (1006, None)]
    rows += [(1010 + k, prose(20) + " " + items[k % 2][1].upper() + " " + prose(20)) for k in range(4)]
    rows += [(1020, prose(10) + " password=abcdefabcdef0123456789 " + prose(10)), (1021, "vile wretch")]
    docs = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(t)) for i, t in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def test_stages(spark, corpus):
    sf, rows, items = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = cut_lineage(stage(spark, docs, sf))
        seen[name] = before.collect(), docs.collect()
        if name != "encoding":
            assert docs.columns == pipeline.COLUMNS
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]

    old, new = seen["toxicity"]
    gone = {r["doc_id"] for r in old} - {r["doc_id"] for r in new}
    assert gone == {i for i, t in rows if t and "wretch" in t}

    old, new = seen["near_duplicates"]
    want = [i for i, _, _, kept in plain_components([(r["doc_id"], r["text"]) for r in old], 5, 80) if kept]
    assert sorted(r["doc_id"] for r in new) == sorted(want) and 1001 not in want and 1004 in want and 1006 in want

    old, new = seen["decontamination"]
    hits = {h[0]: h for h in brute_hits([(r["doc_id"], r["text"]) for r in old], items, WINDOW)}
    assert sum(h[5] for h in hits.values()) >= 4
    was = {r["doc_id"]: r for r in old}
    for r in new:
        if hits[r["doc_id"]][5]:
            assert len(WORD.findall(lowered(r["text"]))) == hits[r["doc_id"]][1] - hits[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
        else:
            assert r == was[r["doc_id"]]
    assert not any(h[5] for h in brute_hits([(r["doc_id"], r["text"]) for r in new], items, WINDOW)) and len(new) == len(old)

    old, new = seen["secrets"]
    was = {r["doc_id"]: r for r in old}
    assert len(new) == len(old) and not any(find_secrets(r["text"] or "") for r in new)
    assert [r["doc_id"] for r in new if r != was[r["doc_id"]]] == [1020]

    old, new = seen["encoding"]
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path(pipeline.VOCABULARY))
    was = {r["doc_id"]: r["text"] or "" for r in old}
    assert len(new) == len(old) and all(r["ids"] == theirs.encode(was[r["doc_id"]], add_special_tokens=False).ids for r in new)
    whole = pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in whole) == sorted((r["doc_id"], r["n_tokens"]) for r in new)


def test_one_row_of_each_group_stays(spark):
    random.seed(5)
    a, b, c, d = (" ".join(random.choices(["w%d" % i for i in range(200)], k=60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " tail"), (7, b), (None, b), (3, c), (3, c), (3, c), (9, d), (5, d), (5, a), (None, "alone of its kind here"), (None, None), (None, None), (4, ""), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.keep_one_copy(spark, docs, "").collect()), key=str)
    want = [(5, a), (7, b), (3, c), (5, d), (None, "alone of its kind here"), (None, None), (None, None), (4, ""), (2, None)]
    assert got == sorted(want, key=str)


def test_a_worker_keeps_nothing_that_its_work_does_not_ask_for(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text")).repartition(8)
    path = public_tokenizers.path(pipeline.VOCABULARY)
    assert bpe.encode_documents(docs, path).count() == 400

    def make():
        import gc

        return lambda batch: {"n": [sum(type(o).__name__ == "WordEncoder" for o in gc.get_objects())] * batch.num_rows}

    assert {r["n"] for r in map_rows(docs, make, "n int").distinct().collect()} == {0}
    bpe.encoder_of(path)
    again = bpe.encoder_of(path)
    assert made(lambda: bpe.encoder_of(path)) is again and made(lambda: None) is None and bpe.encoder_of(path) is not again


def test_stages_of_an_empty_table(spark, corpus):
    sf, _, _ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_queries_give_a_row_for_each_document(spark):
    from logloom.llm.queries import QUERIES

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    n = documents.count()
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == list(QUERIES_IN_ORDER)
    for name in ("op2_licenses", "op3_secrets", "op5_bpe", "op7_decontaminate"):
        rows = QUERIES[name](spark, SF)
        assert rows.count() == n and rows.select("doc_id").distinct().count() == n
    totals = QUERIES["op6_token_counts"](spark, SF).groupBy("tokenizer").agg(F.sum("n_docs").alias("n"), F.sum("n_tokens").alias("t")).collect()
    assert {r["tokenizer"]: r["n"] for r in totals} == {"words": n, "byte_bpe_50k": n}
    words = sum(len(WORD.findall(lowered(r["text"]))) for r in documents.select("text").collect())
    assert {r["tokenizer"]: r["t"] for r in totals}["words"] == words


QUERIES_IN_ORDER = (
    "op1_toxicity", "op2_licenses", "op3_secrets", "op4_chat", "op5_bpe", "op6_token_counts", "op7_decontaminate", "op8_fingerprints", "op9_lm_scores", "op10_neardup",
    "op11_whitening", "op12_alignment", "op13_quality",
)
