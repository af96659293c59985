"""Operator 1: toxicity, learned from document labels as a bag of sentences.

A document is toxic if some sentence is: P(toxic) = 1 - (1 - leak) prod(1 - p(sentence)), a
noisy or. Each p is a logistic function of which words and word beginnings the sentence has,
and only document labels train it; the sentences with a high p are then the offending ones.
Sentences without evidence have no part in it: what toxic documents without any have in
common is the leak, fitted once for a document, so a text's length is no evidence.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from logloom.llm.rows import BLOCK_BYTES, filter_rows, map_rows
from logloom.llm.words import byte_class, code_points, text_blocks, utf8, word_spans
from logloom.session import cut_lineage

# At most about so many labelled documents are fitted on: those whose ids hash lowest.
SAMPLE = 40_000
# Words and beginnings are counted in 2**BUCKETS bins. At most WEIGHTS bins get a weight:
# those whose rates in toxic and clean texts lie GAP deviations or more apart, one LIFT
# times the other or more (common words stand out in whichever texts are longer).
BUCKETS, WEIGHTS, GAP, LIFT = 20, 5_000, 4.0, 2.0
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
# A sentence that is toxic with a chance below this is none: any number of them adds up to nothing.
FLOOR = 0.05
# Characters of the sampled documents, at most; of more, a part of the sample is taken, by hash.
SAMPLE_CHARS = 400_000_000
ENDS = np.isin(np.arange(256), list(b".!?\n"))
# Letters, digits, apostrophes and everything beyond ASCII.
WORDS = byte_class(bytes(b for b in range(128) if not chr(b).isalnum() and b != 39))


class Sentences:
    """Sentences of some texts and the bins each has, from the raw bytes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        numbers, first, _, bounds = word_spans(raw, offsets, WORDS, BEGINNINGS)
        n = len(offsets) - 1
        ends = np.flatnonzero(ENDS[raw])
        # A sentence is what lies between ends; texts without a word have none.
        text = np.repeat(np.arange(n), np.diff(bounds))
        serial = np.searchsorted(ends, first) + text
        fresh = np.ones(len(first), bool)
        fresh[1:] = serial[1:] != serial[:-1]
        self.of_word = np.cumsum(fresh) - 1
        self.text = text[fresh]
        at = first[fresh]
        # Where the sentence begins and, up to the next end or the text's, where it stops.
        self.begin = at
        stop = np.append(ends, len(raw))[np.searchsorted(ends, at)] if len(at) else at
        self.stop = np.minimum(stop, offsets[self.text + 1]) if len(at) else at
        self.bins = (numbers >> np.uint64(64 - BUCKETS)).astype(np.int64)
        self.bins[numbers == 0] = -1

    def present(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (sentence, bin) pairs with ``wanted`` bins (a table over all bins, the last for none)."""
        word, column = np.nonzero(wanted[self.bins])
        pair = np.unique((self.of_word[word] << BUCKETS) | self.bins[word, column])
        return pair >> BUCKETS, pair & ((1 << BUCKETS) - 1)


def log_rest(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0, z)


class Model:
    """Weights over bins, a bias, and the chance of toxicity without any evidence."""

    def __init__(self, bins: np.ndarray, weights: np.ndarray, bias: float, leak: float = 0.0):
        self.bins, self.weights, self.bias, self.leak = bins, weights, bias, leak

    def table(self) -> np.ndarray:
        out = np.zeros((1 << BUCKETS) + 1)
        out[self.bins] = self.weights
        return out


def fit(label, doc, sentence, entry, bins: np.ndarray, rounds=400, rate=0.3, shrink=2e-3) -> Model:
    """Noisy-or likelihood by Adam.

    Of each document its label; of each entry its document, in their order, its sentence
    there, and its bin. Sentences without an entry do not count.
    """
    place = np.full(1 << BUCKETS, -1)
    place[bins] = np.arange(len(bins))
    label = np.asarray(label, float)
    entry_bin = place[np.asarray(entry, np.int64)]
    pair, entry_sentence = np.unique((np.asarray(doc, np.int64) << 32) | np.asarray(sentence, np.int64), return_inverse=True)
    doc, total = pair >> 32, len(pair)
    # The weights, then the bias of a sentence and that of a document.
    w = np.concatenate([np.zeros(len(bins)), [-5.0, -5.0]])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = w[-2] + np.bincount(entry_sentence, w[entry_bin], minlength=total)
        p, leak = 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 / (1 + np.exp(-w[-1]))
        rest = np.minimum(np.bincount(doc, log_rest(z), minlength=len(label)) + log_rest(w[-1]), -1e-9)
        # d loss / d z of a sentence is p for a clean text, -p * rest / (1 - rest) for a toxic one.
        pull = np.where(label > 0, -np.exp(rest) / -np.expm1(rest), 1.0)
        g_z = pull[doc] * p
        g = np.concatenate([np.bincount(entry_bin, g_z[entry_sentence], minlength=len(bins)) + shrink * w[:-2] * len(label) / 100, [g_z.sum(), pull.sum() * leak]]) / len(label)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) * (1 - 0.9 * step / rounds)
    return Model(bins, w[:-2], float(w[-2]), float(1 / (1 + np.exp(-w[-1]))))


def train(docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label_column="toxic", sample=SAMPLE) -> Model | None:
    """A model from a bounded sample of the labelled documents; None without a label of each kind.

    The ids of the sample (about ``sample`` at most, by hash) are broadcast, so no text
    is exchanged to find it. Counts of bins in toxic and clean documents choose the
    WEIGHTS bins that tell most; what reaches the driver is, for each sampled document,
    the places of these bins, of SAMPLE_CHARS characters of text at most. Of several labels of an id the greatest counts; null
    labels, ids and texts are left out.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("y"))
    count = known.count()
    share = min(1.0, sample / max(count, 1))
    chosen = known.filter((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    text = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).filter("text IS NOT NULL")
    # Bounded by SAMPLE rows of two numbers.
    fitted = cut_lineage(text.join(F.broadcast(chosen), "id").select("id", "text", "y"))
    # So is what reaches the driver of the sample, however long its texts are.
    chars = fitted.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > SAMPLE_CHARS:
        fitted = fitted.filter(F.pmod(F.xxhash64(F.lit("chars"), "id"), F.lit(1_000_000)) < int(SAMPLE_CHARS / chars * 1_000_000))
    fitted = fitted.select("text", "y")

    def counts():
        def work(batch):
            tables = np.zeros((2, 1 << BUCKETS), np.int64)
            label = batch.column("y").to_numpy(zero_copy_only=False)
            raw, offsets = utf8(batch.column("text"))
            for a, b in text_blocks(offsets, BLOCK_BYTES):
                s = Sentences(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                kept = s.bins >= 0
                text_of = np.broadcast_to(s.text[s.of_word][:, None], s.bins.shape)[kept] if len(s.of_word) else np.zeros(0, np.int64)
                pair = np.unique((text_of << BUCKETS) | s.bins[kept])
                y = label[a:b][pair >> BUCKETS]
                for k in (0, 1):
                    tables[k] += np.bincount(pair[y == k] & ((1 << BUCKETS) - 1), minlength=1 << BUCKETS)
            some = np.flatnonzero(tables.sum(0))
            return {"bin": some, "clean": tables[0][some], "toxic": tables[1][some]}

        return work

    size = {r["y"]: r["n"] for r in fitted.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return None
    a, b, no, yes = F.col("toxic"), F.col("clean"), float(size[0]), float(size[1])
    # How far the bin's rate among toxic texts stands out from that among clean ones, in deviations.
    rate = (a + b) / (no + yes)
    gap = (a / yes - b / no) / F.sqrt(rate * (1 - rate) * (1 / yes + 1 / no) + 1e-12)
    stats = map_rows(fitted, counts, "bin bigint, clean bigint, toxic bigint").groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = stats.filter("clean + toxic >= 3").withColumn("gap", F.abs(gap)).filter((F.col("gap") >= GAP) & (F.greatest(a / yes, b / no) >= LIFT * F.least(a / yes, b / no))).orderBy(F.desc("gap"), "bin").limit(WEIGHTS)
    bins = np.sort(np.array([r["bin"] for r in best.select("bin").collect()], np.int64))
    wanted = np.zeros((1 << BUCKETS) + 1, bool)
    wanted[bins] = True

    def places():
        def work(batch):
            out = {"y": batch.column("y"), "sentence": [], "bin": []}
            raw, offsets = utf8(batch.column("text"))
            for a, b in text_blocks(offsets, BLOCK_BYTES):
                s = Sentences(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sentence, entry = s.present(wanted)
                cut = np.searchsorted(s.text[sentence], np.arange(b - a + 1))
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    out["sentence"].append(sentence[x:y])
                    out["bin"].append(entry[x:y])
            return out

        return work

    rows = map_rows(fitted, places, "y int, sentence array<int>, bin array<int>").toArrow().combine_chunks()
    lists = {c: rows[c].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("sentence", "bin")}
    doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists["bin"]).to_numpy(zero_copy_only=False))
    return fit(rows["y"].to_numpy(), doc, pc.list_flatten(lists["sentence"]).to_numpy(), pc.list_flatten(lists["bin"]).to_numpy(), bins)


def scorer(model: Model | None, threshold: float, text_column="text"):
    """The function that scores an Arrow batch; without a model every text scores 0."""
    model = model or Model(np.zeros(0, np.int64), np.zeros(0), -1000.0)
    bias = model.bias
    table = model.table()
    wanted = table != 0

    def work(batch):
        out = {"score": [], "predicted": [], "n_sentences": [], "offending": []}
        raw, offsets = utf8(batch.column(text_column))
        for a, b in text_blocks(offsets, BLOCK_BYTES):
            part, starts = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            s = Sentences(part, starts)
            sentence, entry = s.present(wanted)
            z = bias + np.bincount(sentence, table[entry], minlength=len(s.text))
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            # Sentences that have none of the bins, and those that are hardly suspect, count for nothing.
            told = np.bincount(sentence, minlength=len(s.text)) > 0
            some = np.flatnonzero(told & (p >= FLOOR))
            rest = np.bincount(s.text[some], log_rest(z[some]), minlength=b - a)
            spoken = np.bincount(s.text, minlength=b - a)
            value = np.where(spoken > 0, 1 - (1 - model.leak) * np.exp(rest), 0.0)
            value = np.clip(value, 0, 1)
            out["score"].append(value)
            out["predicted"].append(value >= threshold)
            out["n_sentences"].append(spoken)
            bad = some[p[some] >= threshold]
            spans: list[list] = [[] for _ in range(b - a)]
            for i in bad.tolist():
                t = int(s.text[i])
                x, y = code_points(part[starts[t] : starts[t + 1]], np.array([s.begin[i], s.stop[i]]) - starts[t])
                spans[t].append({"start": int(x), "end": int(y), "p": float(p[i])})
            out["offending"] += spans
        for n in ("score", "predicted", "n_sentences"):
            out[n] = np.concatenate(out[n]) if out[n] else []
        out["predicted"] = np.asarray(out["predicted"], np.int32)
        return out

    return work


def score(docs: DataFrame, model: Model | None, id_column="doc_id", text_column="text", threshold=THRESHOLD) -> DataFrame:
    """Score of every whole text: doc_id, score, predicted, n_sentences, offending.

    ``offending`` lists the sentences with p >= threshold as (start, end, p), code
    points, end exclusive. A null or empty text, or one without words, scores 0, as does
    every text without a model. Repeated rows each give a row, a null id stays null,
    other columns are left behind. No exchange.
    """
    frame = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    id_type = frame.schema["doc_id"].dataType.simpleString()

    def make():
        judge = scorer(model, threshold)
        return lambda batch: judge(batch) | {"doc_id": batch.column("doc_id")}

    return map_rows(frame, make, f"doc_id {id_type}, score double, predicted int, n_sentences bigint, offending array<struct<start:bigint,end:bigint,p:double>>")


def keep_clean(docs: DataFrame, model: Model | None, text_column="text", threshold=THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more."""

    def make():
        judge = scorer(model, threshold, text_column)
        return lambda batch: [not p for p in judge(batch)["predicted"]]

    return filter_rows(docs, make)
