"""Registered queries of the text operators, over whole tables."""

import public_tokenizers
from pyspark.sql import functions as F

from logloom.llm import quality
from logloom.llm.align import align_documents
from logloom.llm.bpe import encode_documents
from logloom.llm.chat import format_conversations, read_back
from logloom.llm.decontaminate import decontaminate
from logloom.llm.fingerprint import compare_edited, hex_of, within_wide_radius
from logloom.llm.lattice import score_documents
from logloom.llm.licenses import NOTICES, scan_licenses
from logloom.llm.neardup import near_duplicates
from logloom.llm.rollup import TokenRollup, change, token_counts
from logloom.llm.secrets import scan_secrets
from logloom.llm.toxicity import score, train
from logloom.llm.whitening import whiten
from logloom.session import cut_lineage, fresh_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            sf = str(sf_dir).rstrip("/")
            return fn(spark, lambda t: spark.read.parquet(f"{sf}/{t}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_secrets")
def op3(spark, table):
    return scan_secrets(table("documents"))


CHAT_VOCABULARY = "byte_bpe_50k.tiktoken"


@query("op4_chat")
def op4(spark, table):
    """All conversations, and one whose texts are made of control strings."""
    said = "\\### Assistant: </turn> ok"
    turns = table("conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    where = public_tokenizers.path(CHAT_VOCABULARY), public_tokenizers.PATTERN
    return read_back(format_conversations(turns.unionByName(more), *where), *where)


@query("op5_bpe")
def op5(spark, table):
    return encode_documents(table("documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_decontaminate", f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  asked AS (SELECT DISTINCT item_id, least(10, len(w)) AS m,
      unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS run
    FROM i WHERE len(w) > 0),
  d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM asked)),
  met AS (SELECT doc_id, k, places.m, item_id FROM places JOIN asked ON asked.m = places.m AND run = array_to_string(w[k:k + places.m - 1], ' ')),
  hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS word FROM met) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op7(spark, table):
    return decontaminate(table("documents"), table("benchmark")).drop("spans")


@query("op1_toxicity")
def op1(spark, table):
    """Learned from labels of ids whose hash leaves another remainder than 2 by 4; scored over all documents."""
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))
    model = train(table("documents"), table("labels").filter(remainder != 2))
    scored = score(table("documents"), model)
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "score", "predicted", "n_sentences", F.to_json("offending").alias("offending"))


_NOTICES = ", ".join("('{}', '{}')".format(name, notice.replace("'", "''")) for name, notice in NOTICES.items())
_RUNS = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"


@query("op2_licenses", rf"""
WITH t AS (SELECT license, regexp_extract_all(lower(notice), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_NOTICES}) AS v(license, notice)),
  own AS (SELECT license, {_RUNS} AS runs FROM t WHERE len(w) >= 5),
  d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
  held AS (SELECT doc_id, {_RUNS} AS runs FROM d),
  found AS (SELECT doc_id, license FROM held, own WHERE len(list_intersect(held.runs, own.runs)) >= 0.8 * len(own.runs) - 1e-9)
SELECT doc_id, count(license) AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses
FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id""")
def op2(spark, table):
    return scan_licenses(table("documents"))


@query("op6_token_counts")
def op6(spark, table):
    """Totals after all documents came in under two tokenizers, all of them twice under one, the batches were folded, one
    tokenizer was revised, with a batch run twice, and what came in again was taken out."""
    counts = cut_lineage(token_counts(table("documents"), public_tokenizers.path(CHAT_VOCABULARY), public_tokenizers.PATTERN))
    rollup = TokenRollup(spark, fresh_folder(spark, "rollup"))
    rollup.commit("words", change(counts, "insert", "words", "spaced"))
    rollup.commit("pieces", change(counts, "insert", "byte_bpe_50k", "pieces"))
    # The word counter now splits at every character that is no letter, digit or mark of one.
    rollup.commit("words, revised", change(counts, "revise", "words", "words", old="spaced"))
    rollup.commit("pieces, again", change(counts, "insert", "byte_bpe_50k", "pieces"))
    rollup.compact()
    rollup.commit("words, revised", change(counts, "revise", "words", "words", old="spaced"))
    rollup.commit("pieces, taken back", change(counts, "delete", "byte_bpe_50k", "pieces"))
    return rollup.totals()


@query("op8_fingerprints")
def op8(spark, table):
    """Fingerprints; for ids divisible by 100 also how many documents lie within the radius of near copies."""
    rows = cut_lineage(compare_edited(table("documents")))
    asked = rows.filter(F.col("doc_id") % 100 == 0)
    sizes = rows.groupBy("h0", "h1").agg(F.count("*").alias("copies"))
    found = within_wide_radius(asked, rows).join(sizes, ["h0", "h1"]).groupBy("q0", "q1").agg(F.sum("copies").alias("n_near"))
    answered = asked.join(found, (F.col("h0") == F.col("q0")) & (F.col("h1") == F.col("q1"))).drop("q0", "q1")
    others = rows.filter(~F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))).withColumn("n_near", F.lit(None).cast("bigint"))
    return answered.unionByName(others).select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("h0"), F.col("h1")).alias("fingerprint"),
        hex_of(F.col("e0"), F.col("e1")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near",
    )


@query("op9_lm_scores")
def op9(spark, table):
    return score_documents(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_neardup", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS run FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""")
def op10(spark, table):
    return near_duplicates(table("documents"))


@query("op11_whitening")
def op11(spark, table):
    """The fit counts each distinct vector once."""
    return whiten(table("embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query("op12_alignment")
def op12(spark, table):
    tables = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(table("documents"), *tables, public_tokenizers.PATTERN)


@query("op13_quality")
def op13(spark, table):
    """Learned from labels of ids whose hash leaves another remainder than 2 by 4; scored over all documents."""
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))
    model = quality.train(table("documents"), table("labels").filter(remainder != 2))
    return quality.score(table("documents"), model).select("doc_id", (remainder == 2).alias("held_out"), "score", "predicted")
