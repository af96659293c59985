"""Operator 13: document quality, by random-indexing word vectors and a small network.

Every word has a fixed sparse index vector; the sum of those of its neighbours in all
documents is its context vector. A document is the mean and spread of its words' vectors
and the likeness of neighbouring ones. A two-layer network, trained on labelled documents
and calibrated on others of them, gives the probability.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logloom.llm.multiplicity import sum_vectors
from logloom.llm.rows import map_rows
from logloom.llm.words import ALPHANUMERIC, byte_class, scramble, text_blocks, utf8, word_spans
from logloom.session import cut_lineage

# At most about so many labelled documents are fitted on: those whose ids hash lowest.
SAMPLE = 40_000
# Words are told apart in 2**BINS_LOG bins. An index vector has two entries of 1 and two of -1 in DIM places.
BINS_LOG, DIM, SIGNS = 16, 64, (1, 1, -1, -1)
# Words on either side that count as neighbours.
WINDOW = 2
# Words up to so many places apart are compared: repeated ones stand out.
LAGS = 4
FEATURES = 2 * DIM + LAGS + 1
BLOCK = 1 << 20
# Words whose vectors are gathered at a time, few enough for a core's cache.
PART = 1 << 12
THRESHOLD = 0.7
# Runs of ASCII characters that are neither letters, digits nor white space.
MARKS = byte_class(bytes(b for b in range(256) if not (33 <= b < 127 and not chr(b).isalnum())))
CAPITAL = np.zeros(256, np.uint64)
CAPITAL[65:91] = 1


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all words and marks in order, and where each text's begin. A word's first and last letter
    tell by their case: "the", "The" and "THE" are three words."""
    number, first, last, _ = word_spans(raw, offsets, ALPHANUMERIC)
    number = scramble(number + CAPITAL[raw[first]] + np.uint64(2) * CAPITAL[raw[last - 1]])
    mark, at, _, _ = word_spans(raw, offsets, MARKS)
    begin = np.concatenate([first, at])
    order = np.argsort(begin, kind="stable")
    bins = (np.concatenate([number, mark])[order] >> np.uint64(64 - BINS_LOG)).astype(np.int64)
    return bins, np.searchsorted(begin[order], offsets)


def index_places() -> np.ndarray:
    """For each bin the places of its index vector's entries; equal places add up."""
    seeds = scramble(np.arange(1, (1 << BINS_LOG) + 1, dtype=np.uint64))
    shifts = np.uint64(13) * np.arange(len(SIGNS), dtype=np.uint64)
    return ((seeds[:, None] >> shifts) % np.uint64(DIM)).astype(np.int64)


def index_vectors() -> np.ndarray:
    out = np.zeros((1 << BINS_LOG, DIM), np.float32)
    for column, sign in zip(index_places().T, SIGNS, strict=True):
        np.add.at(out, (np.arange(len(out)), column), sign)
    return out


def add_contexts(sums: np.ndarray, places: np.ndarray, bins: np.ndarray, bounds: np.ndarray) -> None:
    """Add to each word's row of ``sums`` the index vectors of its neighbours in the same text, and at the end their number."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    near = [(gap, np.flatnonzero(text[gap:] == text[:-gap])) for gap in range(1, WINDOW + 1)]
    # Pairs of words that follow each other more than once are added once, times their number. Each is added where it
    # belongs, so a block costs by its words, not by the size of the table.
    pair, times = np.unique(np.concatenate([(bins[i] << BINS_LOG) | bins[i + gap] for gap, i in near]), return_counts=True)
    one, two, times = pair >> BINS_LOG, pair & ((1 << BINS_LOG) - 1), times.astype(sums.dtype)
    for word, other in ((one, two), (two, one)):
        at = word * (DIM + 1)
        for column, sign in zip(places.T, SIGNS, strict=True):
            np.add.at(sums, at + column[other], sign * times)
        np.add.at(sums, at + DIM, times)


class Vectors:
    """Word vectors of all bins from the summed contexts."""

    def __init__(self, sums: np.ndarray):
        count = sums[:, DIM]
        mean = sums[:, :DIM].sum(0) / max(count.sum(), 1)
        # What a word's neighbours have more, or less, than all words' neighbours; its own index vector tells rare words.
        context = sums[:, :DIM] / np.maximum(count, 1)[:, None] - mean * (count > 0)[:, None]
        size = np.linalg.norm(context, axis=1, keepdims=True)
        self.table = (context / np.maximum(size, 1e-12) + 0.5 * index_vectors()).astype(np.float32)
        self.size = np.maximum(np.linalg.norm(self.table, axis=1), 1e-6)

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the mean and spread of its words' vectors, how alike words are that stand 1 to LAGS places
        apart (mean cosine), and the log of their number; zeros for a text without words."""
        bins, bounds = tokens_of(raw, offsets)
        n = np.diff(bounds)
        out = np.zeros((len(n), FEATURES))
        for a, b in text_blocks(bounds, PART):
            # Only a text that is a block of its own has more than one part; each sees the words just after it too.
            stop = int(bounds[b])
            for at in range(int(bounds[a]), stop, PART):
                end = min(at + PART, stop)
                texts = a + np.flatnonzero(n[a:b])
                starts = np.maximum(bounds[texts], at) - at
                # The distinct words of each text, and how often it has them.
                of_word = np.repeat(texts, np.diff(starts, append=end - at))
                pair, times = np.unique((of_word << BINS_LOG) | bins[at:end], return_counts=True)
                first = np.searchsorted(pair >> BINS_LOG, texts)
                v = self.table.take(pair & ((1 << BINS_LOG) - 1), axis=0).astype(np.float64)
                weighted = v * times[:, None]
                out[texts, :DIM] += np.add.reduceat(weighted, first)
                out[texts, DIM : 2 * DIM] += np.add.reduceat(weighted * v, first)
                some = bins[at : min(end + LAGS, stop)]
                unit = self.table.take(some, axis=0) / self.size.take(some)[:, None]
                for gap in range(1, min(LAGS, len(some) - 1) + 1):
                    likeness = np.einsum("ij,ij->i", unit[:-gap], unit[gap:])
                    total = np.concatenate([[0.0], np.cumsum(likeness, dtype=np.float64)])
                    # Pairs that begin in this part and end in the same text.
                    begin = np.minimum(starts, len(total) - 1)
                    stops = np.maximum(np.minimum(bounds[texts + 1] - gap, end) - at, begin)
                    out[texts, 2 * DIM + gap - 1] += total[stops] - total[begin]
        full = n > 0
        out[full, : 2 * DIM] /= n[full, None]
        out[:, DIM : 2 * DIM] = np.sqrt(np.maximum(out[:, DIM : 2 * DIM] - out[:, :DIM] ** 2, 0))
        out[:, 2 * DIM : -1] /= np.maximum(n[:, None] - np.arange(1, LAGS + 1), 1)
        out[:, -1] = np.log1p(n)
        return out.astype(np.float32)


def context_sums(docs: DataFrame, text_column="text") -> np.ndarray:
    """Summed neighbours of every bin over all whole texts: 2**BINS_LOG rows, whatever the corpus."""
    bins = 1 << BINS_LOG

    def make():
        places, sums = index_places(), np.zeros(bins * (DIM + 1))

        def work(batch):
            if batch is None:
                table = sums.reshape(bins, DIM + 1).astype(np.int32)
                some = np.flatnonzero(table[:, DIM])
                cuts = pa.array(np.arange(len(some) + 1) * (DIM + 1), pa.int32())
                return {"bin": pa.array(some, pa.int64()), "row": pa.ListArray.from_arrays(cuts, pa.array(table[some].ravel(), pa.int32()))}
            raw, offsets = utf8(batch.column("text"))
            for a, b in text_blocks(offsets, BLOCK):
                add_contexts(sums, places, *tokens_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            return {"bin": pa.array([], pa.int64()), "row": pa.array([], pa.list_(pa.int32()))}

        return work

    texts = docs.select(F.col(f"`{text_column}`").cast("string").alias("text")).filter("text IS NOT NULL")
    out = np.zeros((bins, DIM + 1))
    found = sum_vectors(map_rows(texts, make, "bin bigint, row array<int>", last=True), ["bin"], "bigint").toArrow().combine_chunks()
    if found.num_rows:
        rows = found["row"].combine_chunks()
        out[found["bin"].to_numpy()] = rows.flatten().to_numpy().reshape(-1, DIM + 1)
    return out


class Network:
    """Standardised features, one layer of tanh, one logit over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden=24, rounds=600, rate=0.01, shrink=3e-3, seed=7):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.temperature = 1.0
        rng, z = np.random.default_rng(seed), self.standard(x)
        # Weights of the second layer begin small, its bias at the base rate.
        rate_of_one = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.parts = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.array(np.log(rate_of_one / (1 - rate_of_one)))]
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        for step in range(1, rounds + 1):
            # Batches go through the rows in turn.
            pick = rng.integers(0, len(z), min(len(z), 2048))
            w, b, v, c = self.parts
            h = np.tanh(z[pick] @ w + b)
            off = (1 / (1 + np.exp(-np.clip(h @ v + c, -40, 40))) - y[pick]) / len(pick)
            back = off[:, None] * v * (1 - h * h)
            slopes = [z[pick].T @ back + shrink * w, back.sum(0), h.T @ off + shrink * v, off.sum()]
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                move = rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                self.parts[i] = self.parts[i] - move * (1 - 0.9 * step / rounds)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parts
        return (np.tanh(self.standard(x) @ w + b) @ v + c) / self.temperature

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature under which documents the weights were not fitted on are likeliest.

        The targets stand off 0 and 1 by one document more of either kind, so a few that are told apart
        without a fault do not make the network certain."""
        logits, grid = self.logits(x) * self.temperature, np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        ones = y.sum()
        target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
        loss = [(np.logaddexp(0, logits / t) - target * logits / t).sum() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(y) else 1.0


class Model:
    """Vectors and a network, or, where labels of both kinds are missing, one probability for all."""

    def __init__(self, vectors: Vectors | None, network: Network | None, constant=0.5):
        self.vectors, self.network, self.constant = vectors, network, constant

    def probability(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.constant)
        return self.network.probability(self.vectors.features(raw, offsets))


def train(docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label_column="quality", sample=SAMPLE) -> Model:
    """Word vectors from all documents, a network from a bounded sample of the labelled ones.

    Of the sample (about ``sample`` ids at most, by hash; they are broadcast, so no text is exchanged) four
    in five documents fit the weights, the others the temperature; the driver gets FEATURES numbers for each.
    Of several labels of an id the greatest counts; null labels, ids and texts are left out. With labels
    of one kind only, the model's probability is theirs; without any it is 0.5.
    """
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("y"))
    share = min(1.0, sample / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    text = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).filter("text IS NOT NULL")
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(5)).cast("int").alias("part")
    # Bounded by ``sample`` ids; equal ids may bring several texts.
    fitted = cut_lineage(text.join(F.broadcast(chosen), "id").select("text", "y", part))
    seen = [r["y"] for r in fitted.select("y").distinct().collect()]
    if len(seen) < 2:
        return Model(None, None, float(min(seen[0], 1)) if seen else 0.5)
    vectors = Vectors(context_sums(docs, text_column))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        table = shared.value

        def work(batch):
            raw, offsets = utf8(batch.column("text"))
            rows = [table.features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in text_blocks(offsets, BLOCK)]
            x = np.concatenate(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))
            return {"y": batch.column("y"), "part": batch.column("part"), "x": lists}

        return work

    rows = map_rows(fitted, make, "y int, part int, x array<float>").toArrow().combine_chunks()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    y, part = rows["y"].to_numpy().astype(float), rows["part"].to_numpy()
    # Rows come in any order; the fit must not depend on it.
    order = np.lexsort((*x[:, :4].T, y, part))
    x, y, part = x[order], y[order], part[order]
    own = part > 0 if len(set(y[part > 0].tolist())) > 1 else np.ones(len(y), bool)
    network = Network(x[own], y[own])
    network.calibrate(x[~own], y[~own])
    return Model(vectors, network)


def score(docs: DataFrame, model: Model, id_column="doc_id", text_column="text", threshold=THRESHOLD) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted (1 if score >= threshold) of every whole text.

    A null text counts as empty; a text without words or marks is scored as such. Repeated rows each give a
    row, a null id stays null, an empty table gives none, other columns are left behind. No exchange.
    """
    frame = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    id_type = frame.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        judge = shared.value

        def work(batch):
            raw, offsets = utf8(batch.column("text"))
            parts = [judge.probability(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in text_blocks(offsets, BLOCK)]
            value = np.concatenate(parts)
            return {"doc_id": batch.column("doc_id"), "score": value, "predicted": (value >= threshold).astype(np.int32)}

        return work

    return map_rows(frame, make, f"doc_id {id_type}, score double, predicted int")
