"""Operator 9: log probability of documents under a subword lattice.

The pieces of an existing vocabulary are the arcs of a lattice over each word; the
probability of a word is the sum over all its segmentations, by forward recursion in log
space. Piece probabilities start from the vocabulary's scores and are re-estimated from
the training documents (expected counts over all segmentations, EM). Words seen in
training have an arc of their own with absolute discounting; what the discount frees
goes to the pieces, so the model is one distribution over all words.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logloom.llm.rows import map_rows
from logloom.llm.words import SPACED, spelled, text_blocks, utf8, word_spans
from logloom.session import cut_lineage

# The token after the last word; no word holds a space.
END = " "
# Most frequent words of the corpus, at most so many, that every task knows; the others are joined.
HEAD = 200_000
# Words that the lattice works on together: enough of each length for long arrays.
AT_ONCE = 100_000
# Words of more code points go one by one, with arrays along the word: work and memory grow with its length.
LONG = 48
ROUNDS = 2
# Text whose distinct words are counted and looked up together: each gives a row.
COUNTED_BYTES = 4 << 20
# Weight of the vocabulary's own scores against the corpus, in words.
PRIOR = 1000.0


class Pieces:
    """Pieces of a vocabulary file, word-initial ones marked by U+2581, with hashed look-up."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            (model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        plain = [(p, s) for p, s in plain if s > -1e6 and p]
        self.names = [p for p, _ in plain]
        self.size = len(plain) + 2
        # The file's scores are minus the order of merging: a rank, whose weight falls off as frequencies do.
        rank = np.array([-s for _, s in plain])
        weight = 1.0 / (rank - rank.min() + 10.0)
        # Then one share for all bytes (256 alike) and one for the end of the document.
        self.start = np.concatenate([weight / weight.sum() * 0.97, [0.02, 0.01]])
        self.byte, self.end = len(plain), len(plain) + 1
        self.longest = max(map(len, self.names))
        # Polynomial hashes of the pieces in an open table.
        self.bits = (4 * len(plain) - 1).bit_length()
        self.some = np.zeros(1 << SIEVE, bool)
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.id = np.full(1 << self.bits, -1, np.int32)
        for i, name in enumerate(self.names):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in name:
                    h = h * _STEP + np.uint64(ord(c) + 1)
            at = self._slot(np.array([h]))[0]
            while self.id[at] >= 0:
                at = (at + 1) % len(self.id)
            self.key[at], self.id[at] = h, i
            self.some[h >> np.uint64(64 - SIEVE)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        at = self._slot(h)
        out = np.full(len(h), -1, np.int32)
        open_ = np.arange(len(h))
        while len(open_):
            spot = at[open_]
            same = self.key[spot] == h[open_]
            out[open_[same]] = self.id[spot[same]]
            open_ = open_[~same & (self.id[spot] >= 0)]
            at[open_] = (at[open_] + 1) % len(self.id)
        return out

    def arcs(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Lattice arcs of words of one length, a line of code points each, by where they begin.

        (from, to, which words have the arc, its piece in each). A character that is no
        piece has an arc of piece ``byte``.
        """
        n, width = codes.shape
        out = []
        for a in range(width):
            h = np.zeros(n, np.uint64)
            for b in range(a, min(width, a + self.longest)):
                h = h * _STEP + codes[:, b].astype(np.uint64) + np.uint64(1)
                maybe = np.flatnonzero(self.some[h >> np.uint64(64 - SIEVE)])
                found = self.find(h[maybe])
                if b == a:
                    piece = np.full(n, self.byte, np.int32)
                    piece[maybe[found >= 0]] = found[found >= 0]
                    out.append((a, b + 1, np.arange(n), piece))
                elif (known := found >= 0).any():
                    out.append((a, b + 1, maybe[known], found[known]))
        return out


    def arcs_along(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of every arc of one word, by where they end."""
        n = len(codes)
        h, own = np.zeros(n, np.uint64), codes.astype(np.uint64) + np.uint64(1)
        first, last, pieces = [], [], []
        for size in range(1, min(self.longest, n) + 1):
            h = h[: n - size + 1] * _STEP + own[size - 1 :]
            maybe = np.flatnonzero(self.some[h >> np.uint64(64 - SIEVE)])
            found = self.find(h[maybe])
            at, piece = maybe[found >= 0], found[found >= 0]
            if size == 1:
                every = np.full(n, self.byte, np.int32)
                every[at] = piece
                at, piece = np.arange(n), every
            first.append(at)
            last.append(at + size)
            pieces.append(piece)
        first, last, piece = map(np.concatenate, (first, last, pieces))
        order = np.argsort(last, kind="stable")
        return first[order], last[order], piece[order]


# Bits of the table that tells at once that a hash is no piece's.
SIEVE = 20
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str], block=4096):
    """(places, code points) of the words up to LONG, word-initial mark in front, in blocks of one length."""
    marked = ["▁" + w for w in words]
    order = sorted((i for i in range(len(words)) if len(marked[i]) <= LONG), key=lambda i: len(marked[i]))
    at = 0
    while at < len(order):
        size = len(marked[order[at]])
        end, most = at, block * 16 // max(16, size)
        while end < len(order) and end - at < most and len(marked[order[end]]) == size:
            end += 1
        own = order[at:end]
        text = "".join(marked[i] for i in own)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), size)
        yield np.array(own), codes
        at = end


def utf8_bytes(c: np.ndarray) -> np.ndarray:
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


def arc_weights(pieces: Pieces, codes, arcs, logs) -> list[np.ndarray]:
    """Log weight of every arc; a character without a piece goes by its UTF-8 bytes."""
    out = []
    for a, b, which, piece in arcs:
        w = logs[piece]
        if b == a + 1 and len(raw := np.flatnonzero(piece == pieces.byte)):
            w[raw] = (logs[pieces.byte] - math.log(256)) * utf8_bytes(codes[which[raw], a])
        out.append(w)
    return out


def log_add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log(exp(x) + exp(y)); x may be minus infinity."""
    high = np.maximum(x, y)
    return high + np.log1p(np.exp(np.minimum(x, y) - high))


def forward(n: int, width: int, arcs, weights) -> np.ndarray:
    """Log of the summed probability of all paths to each place: a line for each place."""
    alpha = np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    for (a, b, which, _), w in zip(arcs, weights, strict=True):
        alpha[b, which] = log_add(alpha[b, which], alpha[a, which] + w)
    return alpha


def long_words(words: list[str]):
    """(place, code points) of each word beyond LONG."""
    for i, word in enumerate(words):
        if len(word) >= LONG:
            yield i, np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), np.uint32)


def weights_along(pieces: Pieces, codes: np.ndarray, first: np.ndarray, piece: np.ndarray, logs: np.ndarray) -> np.ndarray:
    raw = (logs[pieces.byte] - math.log(256)) * utf8_bytes(codes[first])
    return np.where(piece == pieces.byte, raw, logs[piece])


def forward_along(n: int, first: np.ndarray, last: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all paths to each place of one word; the arcs come by where they end."""
    alpha, exp, log = [0.0] * (n + 1), math.exp, math.log
    bounds = np.searchsorted(last, np.arange(1, n + 2)).tolist()
    # Blocks of plain numbers: the whole word's would take many times its size.
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        shift = bounds[at]
        own = list(zip(first[shift : bounds[stop]].tolist(), weights[shift : bounds[stop]].tolist(), strict=True))
        for b in range(at, stop):
            terms = [alpha[a] + w for a, w in own[bounds[b] - shift : bounds[b + 1] - shift]]
            if len(terms) == 1:
                alpha[b + 1] = terms[0]
            else:
                high = max(terms)
                alpha[b + 1] = high + log(sum([exp(t - high) for t in terms]))
    return np.array(alpha)


def word_logs(pieces: Pieces, words: list[str], logs: np.ndarray) -> np.ndarray:
    """Natural log of the marginal probability of each word over all its segmentations."""
    out = np.empty(len(words))
    for places, codes in by_length(words):
        arcs = pieces.arcs(codes)
        out[places] = forward(*codes.shape, arcs, arc_weights(pieces, codes, arcs, logs))[-1]
    for place, codes in long_words(words):
        first, last, piece = pieces.arcs_along(codes)
        out[place] = forward_along(len(codes), first, last, weights_along(pieces, codes, first, piece, logs))[-1]
    return out


def expected(pieces: Pieces, words: list[str], logs: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of the words, each word once."""
    counts = np.zeros(pieces.size)
    for _, codes in by_length(words):
        n, width = codes.shape
        arcs = pieces.arcs(codes)
        weights = arc_weights(pieces, codes, arcs, logs)
        alpha = forward(n, width, arcs, weights)
        beta = np.full((width + 1, n), -np.inf)
        beta[width] = 0
        for (a, b, which, _), w in zip(reversed(arcs), reversed(weights), strict=True):
            beta[a, which] = log_add(beta[a, which], beta[b, which] + w)
        for (a, b, which, piece), w in zip(arcs, weights, strict=True):
            share = np.exp(alpha[a, which] + w + beta[b, which] - alpha[width, which])
            if b == a + 1:
                share = np.where(piece == pieces.byte, share * utf8_bytes(codes[which, a]), share)
            counts += np.bincount(piece, share, minlength=pieces.size)
    for _, codes in long_words(words):
        n = len(codes)
        first, last, piece = pieces.arcs_along(codes)
        weights = weights_along(pieces, codes, first, piece, logs)
        alpha = forward_along(n, first, last, weights)
        # Backwards it is the same recursion along the mirrored word.
        order = np.argsort(n - first, kind="stable")
        beta = forward_along(n, (n - last)[order], (n - first)[order], weights[order])[::-1]
        share = np.exp(alpha[first] + weights + beta[last] - alpha[n])
        counts += np.bincount(piece, np.where(piece == pieces.byte, share * utf8_bytes(codes[first]), share), minlength=pieces.size)
    return counts


def word_counts(frame: DataFrame) -> DataFrame:
    """word, n (in training documents), m (in all); the end of a document is the word END.

    Words of a block of text are told apart by their 64-bit numbers.
    """

    def make():
        def work(batch):
            words, n, m = [pa.array([END])], [], []
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            raw, offsets = utf8(batch.column("text"))
            for a, b in text_blocks(offsets, COUNTED_BYTES):
                part, starts = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                numbers, first, last, bounds = word_spans(part, starts, SPACED)
                _, at, place = np.unique(numbers, return_index=True, return_inverse=True)
                words.append(spelled(part, first[at], last[at]))
                m.append(np.bincount(place, minlength=len(at)))
                n.append(np.bincount(place, np.repeat(train[a:b], np.diff(bounds)), minlength=len(at)).astype(np.int64))
            return {"word": pa.concat_arrays(words), "n": np.concatenate([[int(train.sum())], *n]), "m": np.concatenate([[len(train)], *m])}

        return work

    return map_rows(frame, make, "word string, n bigint, m bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def training(id_column) -> F.Column:
    """Rows the model learns from; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(5)) != 1


def score_documents(docs: DataFrame, path: str, id_column="doc_id", text_column="text", train=None, head=HEAD, rounds=ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every whole text.

    Tokens are runs of anything but spaces and tab to carriage return, A-Z in lower
    case, then one end. ``base_score`` is the additive unigram baseline, ``score`` the
    log10 probability under the lattice model; both learn from the rows where ``train``
    (a condition over the id) holds. A null or empty text is its end token. Repeated
    rows each give a row, a null id stays null, other columns are left behind. Without
    training rows every count is 0 and the pieces keep the vocabulary's weights.

    The word table is as large as the corpus makes it: the most frequent words, at most
    ``head``, are broadcast, every other (document, word) is joined with it by an exchange.
    None of those is a hot key: words are taken into the head by count, so one that is left
    out has hardly more than 1/head of all tokens.
    """
    spark = docs.sparkSession
    doc_id = F.col(f"`{id_column}`")
    frame = docs.select(doc_id.alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"), (training(doc_id) if train is None else train).alias("train"))
    id_type = frame.schema["doc_id"].dataType.simpleString()
    table = cut_lineage(word_counts(frame))
    seen = F.col("n") > 0
    total = table.agg(
        F.sum("n").alias("tokens"), F.count_if(seen).alias("types"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")
    ).first()
    tokens, types = total["tokens"] or 0, total["types"] or 0
    ends = table.filter(F.col("word") == END).first()
    end_share = ((ends["n"] if ends else 0) + 0.5) / (tokens + 1.0)
    # Share of a word's count that goes to words not seen, by the usual estimate; kept within bounds.
    discount = min(0.95, max(0.05, total["once"] / max(1, total["once"] + 2 * total["twice"])))
    word_tokens, word_types = tokens - (ends["n"] if ends else 0), types - (1 if ends and ends["n"] else 0)
    freed = discount * word_types / word_tokens if word_tokens else 1.0

    start = pieces_of(path).start
    share = start.copy()
    learned = table.filter(seen & (F.col("word") != END)).select("word")
    for _ in range(rounds if word_types else 0):
        logs = np.log(share)

        def expect(logs=logs):
            pieces = pieces_of(path)

            def work(batch):
                counts = expected(pieces, batch.column("word").to_pylist(), logs)
                some = np.flatnonzero(counts)
                return {"piece": some, "uses": counts[some]}

            return work

        # At most a row for each piece of the vocabulary.
        uses = map_rows(learned, expect, "piece bigint, uses double", AT_ONCE).groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        counts = PRIOR * start
        for r in uses:
            counts[r["piece"]] += r["uses"]
        # Words end where a piece is followed by a word-initial one, so a word's end has a share like a piece.
        counts[len(counts) - 1] = 0.0
        share = np.maximum(counts / counts.sum(), 1e-300)
    logs = np.log(share)
    base_log = lambda n: np.log10((n + 0.5) / (tokens + 0.5 * (types + 1)))
    model = {"logs": logs, "freed": freed, "discount": discount, "word_tokens": word_tokens, "word_share": 1.0 - end_share}

    def scored(frame: DataFrame) -> DataFrame:
        """The word table with the log10 of both models."""

        def make():
            pieces = pieces_of(path)

            def work(batch):
                words = batch.column("word").to_pylist()
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                own = np.where(n > 0, np.maximum(n - model["discount"], 0) / max(1, model["word_tokens"]), 0)
                with np.errstate(divide="ignore"):
                    both = np.logaddexp(np.log(own), np.log(model["freed"]) + word_logs(pieces, words, model["logs"]))
                value = (both + np.log(model["word_share"])) / np.log(10)
                # A word of the table has no separator, so each is one word again; the end is none.
                raw, offsets = utf8(batch.column("word"))
                return {"word": words, "number": word_spans(raw, offsets, SPACED)[0].view(np.int64), "known": n > 0, "base": base_log(n), "lattice": value}

            return work

        return map_rows(frame, make, "word string, number bigint, known boolean, base double, lattice double", AT_ONCE)

    # Words of a count class and above, as many classes as have no more than ``head`` words.
    rank = F.floor(F.log2("m") * 4)
    classes = table.filter(F.col("word") != END).groupBy(rank.alias("rank")).agg(F.count("*").alias("words")).orderBy(F.desc("rank")).collect()
    least, held = None, 0
    for r in classes:
        held += r["words"]
        if held > head:
            break
        least = r["rank"]
    frequent = F.lit(False) if least is None else (rank >= least) & (F.col("word") != END)
    # Numbers only, so its size is that of ``head`` rows however long the words are.
    top = scored(table.filter(frequent).select("word", "n")).drop("word").toPandas()
    numbers = top["number"].to_numpy().view(np.uint64)
    order = np.argsort(numbers)
    ahead = spark.sparkContext.broadcast((numbers[order], *(top[c].to_numpy()[order].astype(float) for c in ("known", "base", "lattice"))))
    end_n = ends["n"] if ends else 0
    end = int(end_n > 0), float(base_log(end_n)), math.log10(end_share)

    def make():
        from pyspark import TaskContext

        serial = [TaskContext.get().partitionId() << 33]

        def work(batch):
            numbers, known, base, lattice = ahead.value
            out: dict = {c: [] for c in ("row_id", "word", "uses", "n_tokens", "n_known", "base", "lattice")}
            docs, trained = [], []
            raw, offsets = utf8(batch.column("text"))
            for a, b in text_blocks(offsets, COUNTED_BYTES):
                part, starts = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                own, first, last, bounds = word_spans(part, starts, SPACED)
                doc = np.repeat(np.arange(b - a), np.diff(bounds))
                if len(numbers):
                    at = np.minimum(np.searchsorted(numbers, own), len(numbers) - 1)
                    hit = numbers[at] == own
                else:
                    at, hit = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
                sums = [np.bincount(doc[hit], v[at[hit]], minlength=b - a) + e if len(v) else np.full(b - a, float(e)) for v, e in zip((known, base, lattice), end, strict=True)]
                # Of the others a row for each document and word.
                missed = np.flatnonzero(~hit)
                kinds, kind = np.unique(own[missed], return_inverse=True)
                _, some, uses = np.unique(doc[missed] * len(kinds) + kind, return_index=True, return_counts=True)
                rows = serial[0] + np.arange(b - a)
                serial[0] += b - a
                none = np.zeros(len(some))
                # The document's own row meets no word of the table, as no word holds a space.
                out["row_id"] += [rows, rows[doc[missed[some]]]]
                out["word"] += [pa.array([f" {r}" for r in rows], pa.string()), spelled(part, first[missed[some]], last[missed[some]])]
                out["uses"] += [np.zeros(b - a, np.int64), uses]
                out["n_tokens"] += [np.diff(bounds) + 1, none.astype(np.int64)]
                out["n_known"] += [sums[0].astype(np.int64), none.astype(np.int64)]
                out["base"] += [sums[1], none]
                out["lattice"] += [sums[2], none]
                for name, held in (("doc_id", docs), ("train", trained)):
                    column = batch.column(name)
                    held += [column.slice(a, b - a), pa.nulls(len(some), column.type)]
            made = {c: pa.concat_arrays(v) if c == "word" else np.concatenate(v) for c, v in out.items()}
            return made | {"doc_id": pa.concat_arrays(docs), "train": pa.concat_arrays(trained)}

        return work

    # Written before they meet: a task that is run again must not number its rows anew.
    parts = cut_lineage(map_rows(frame, make, f"row_id bigint, doc_id {id_type}, train boolean, word string, uses bigint, n_tokens bigint, n_known bigint, base double, lattice double"))
    others = scored(table.filter(~frequent & (F.col("word") != END)).select("word", "n")).drop("number").withColumnRenamed("base", "word_base").withColumnRenamed("lattice", "word_lattice")
    uses = F.col("uses")
    joined = parts.join(others, "word", "left").groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.bool_or("train").alias("train"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("known"), uses).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(uses * F.col("word_base"), F.lit(0.0))).alias("base_score"),
        F.sum(F.col("lattice") + F.coalesce(uses * F.col("word_lattice"), F.lit(0.0))).alias("score"),
    )
    return joined.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
