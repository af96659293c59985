"""Operator 7: benchmark passages in documents, by an FM-index over each shard of text.

A shard is a few megabytes of whole documents. Words that no benchmark item has are
closing marks of the index, and stretches too short for any window are left out, so the
index holds just the words a window could match. All windows are searched backward
through the wavelet ranks at once, occurrences are located from sampled suffix places,
and the words they cover are merged to spans.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logloom.llm.fmindex import WordIndex
from logloom.llm.rows import map_rows, rewrite_texts, text_frame
from logloom.llm.words import ALPHANUMERIC, code_points, text_blocks, utf8, word_spans
from logloom.session import cut_lineage

WINDOW = 10
# Text of one shard: an index over less is searched more often, one over more takes more memory.
SHARD_BYTES = 2 << 20
# Characters of benchmark text searched at a time; a larger benchmark is several blocks.
BLOCK_CHARS = 4 << 20
# Blocks that one pass over the documents searches, and the longest piece of an item.
BLOCKS_AT_ONCE, PIECE_CHARS = 8, 1 << 20
# Words an index is built over at a time, and occurrences located at a time.
SHARD_WORDS, AT_ONCE = 900_000, 500_000


class Phrases:
    """The windows of a block of benchmark items, as arrays."""

    def __init__(self, items: list[tuple], window: int):
        self.names = sorted({"null" if i is None else str(i) for i, _ in items})
        place = {n: k for k, n in enumerate(self.names)}
        raw, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        numbers, _, _, bounds = word_spans(raw, offsets, ALPHANUMERIC)
        self.words = np.unique(numbers)
        ids = np.searchsorted(self.words, numbers) + 1
        by_size: dict[int, tuple[list, list]] = {}
        for k, (i, _) in enumerate(items):
            own = ids[bounds[k] : bounds[k + 1]]
            if len(own):
                size = min(window, len(own))
                lines = np.lib.stride_tricks.sliding_window_view(own, size)
                texts, owners = by_size.setdefault(size, ([], []))
                texts.append(lines)
                owners.append(np.full(len(lines), place["null" if i is None else str(i)]))
        # By length: the windows, and the items of window w in owner[first[w]:first[w + 1]].
        self.groups = []
        for size, (texts, owners) in sorted(by_size.items()):
            lines, inverse = np.unique(np.concatenate(texts), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([inverse.ravel(), np.concatenate(owners)], 1), axis=0)
            self.groups.append((size, lines, np.searchsorted(pairs[:, 0], np.arange(len(lines) + 1)), pairs[:, 1]))

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(numbers), np.int64)
        at = np.minimum(np.searchsorted(self.words, numbers), len(self.words) - 1)
        return np.where(self.words[at] == numbers, at + 1, 0)


def stretches(ids: np.ndarray, bounds: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each run of known words within a text, of ``least`` words or more.

    Runs of over SHARD_WORDS are cut, with an overlap of ``most`` - 1 words.
    """
    known = np.concatenate([[False], ids > 0, [False]])
    border = np.zeros(len(ids) + 1, bool)
    border[bounds[bounds <= len(ids)]] = True
    begins = np.flatnonzero(known[1:-1] & (~known[:-2] | border[:-1]))
    ends = np.flatnonzero(known[1:-1] & (~known[2:] | border[1:])) + 1
    long_enough = ends - begins >= least
    begins, ends = begins[long_enough], ends[long_enough]
    if len(begins) and (ends - begins).max() > SHARD_WORDS:
        cut = [(a, min(b, a + SHARD_WORDS)) for x, b in zip(begins, ends, strict=True) for a in range(x, max(x + 1, b - most + 1), SHARD_WORDS - most + 1)]
        begins, ends = np.array(cut).T
    return begins, ends


def search_block(phrases: Phrases, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hit, and the distinct (text, item) pairs."""
    hit = np.zeros(len(numbers), bool)
    pairs = [np.zeros((0, 2), np.int64)]
    if not phrases.groups or not len(numbers):
        return hit, pairs[0][:, 0], pairs[0][:, 1]
    ids = phrases.ids(numbers)
    begins, ends = stretches(ids, bounds, phrases.groups[0][0], phrases.groups[-1][0])
    sizes = ends - begins + 1
    shard = (np.cumsum(sizes) - sizes) // SHARD_WORDS if len(sizes) else sizes
    for s in np.unique(shard):
        a, size = begins[shard == s], sizes[shard == s]
        first = np.cumsum(size) - size
        origin = np.arange(size.sum()) + np.repeat(a - first, size)
        symbols = np.where(np.arange(len(origin)) == np.repeat(first + size - 1, size), 0, ids[np.minimum(origin, len(ids) - 1)])
        index = WordIndex(symbols, len(phrases.words) + 1)
        for width, lines, first_owner, owner in phrases.groups:
            low, high = index.search(lines)
            found = np.flatnonzero(high > low)
            counts = (high - low)[found]
            total = np.cumsum(counts)
            at = 0
            while at < (total[-1] if len(total) else 0):
                # Occurrences at .. stop of all windows in a row.
                stop = min(int(total[-1]), at + AT_ONCE)
                nth = np.arange(at, stop)
                which = np.searchsorted(total, nth, "right")
                words = origin[index.locate(low[found[which]] + nth - (total[which] - counts[which]))]
                for k in range(width):
                    hit[words + k] = True
                text = np.searchsorted(bounds, words, "right") - 1
                seen = np.unique(text * len(lines) + found[which])
                window = seen % len(lines)
                many = first_owner[window + 1] - first_owner[window]
                spot = np.repeat(first_owner[window] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                pairs.append(np.unique(np.stack([np.repeat(seen // len(lines), many), owner[spot]], 1), axis=0))
                at = stop
    pairs = np.unique(np.concatenate(pairs), axis=0)
    return hit, pairs[:, 0], pairs[:, 1]


def item_pieces(frame: DataFrame, window: int) -> DataFrame:
    """(item_id, text) with long texts cut into pieces that share ``window`` - 1 words, so every window is in one."""
    id_type = frame.schema["item_id"].dataType.simpleString()

    def make():
        def work(batch):
            names, texts = [], []
            ids = batch.column("item_id").to_pylist()
            for name, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                if text is None or len(text) <= PIECE_CHARS:
                    names.append(name)
                    texts.append(text)
                    continue
                raw, offsets = utf8(pa.array([text]))
                _, first, last, _ = word_spans(raw, offsets, ALPHANUMERIC)
                at = 0
                while at < len(first):
                    # As many words as fill a piece, and enough for one window at least.
                    stop = min(len(first), max(at + window, int(np.searchsorted(first, first[at] + PIECE_CHARS))))
                    names.append(name)
                    texts.append(raw[first[at] : last[stop - 1]].tobytes().decode("utf-8"))
                    at = len(first) if stop == len(first) else stop - window + 1
            return {"item_id": pa.array(names, batch.column("item_id").type), "text": texts}

        return work

    return map_rows(frame, make, f"item_id {id_type}, text string")


def benchmark_blocks(benchmark: DataFrame, item_column: str, text_column: str, window: int) -> tuple[DataFrame, int]:
    """The benchmark as rows (block, item_id, text) of a written table, and the number of its blocks.

    A block has about BLOCK_CHARS characters: pieces are at most a quarter of that, and are dealt by hash.
    """
    frame = text_frame(benchmark, item_column, text_column).withColumnRenamed("doc_id", "item_id")
    pieces = cut_lineage(item_pieces(frame, window))
    chars = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    return pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), blocks


class Blocks:
    """The blocks of one pass, each broadcast; there are BLOCKS_AT_ONCE of them at most."""

    def __init__(self, table: DataFrame, numbers: range, window: int):
        context = table.sparkSession.sparkContext
        self.shared = [
            context.broadcast(Phrases([tuple(r) for r in table.filter(F.col("block") == k).select("item_id", "text").collect()], window)) for k in numbers
        ]


class Texts:
    """Some texts of an Arrow batch: their words, and which of them are hit."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        self.numbers, self.first, self.last, self.bounds = word_spans(raw, offsets, ALPHANUMERIC)
        self.hit = np.zeros(len(self.numbers), bool)
        self.items: list[set[str]] = [set() for _ in range(len(offsets) - 1)]

    @staticmethod
    def of(batch, text_column="text"):
        """(first text, end) and the texts, in blocks of bounded size."""
        raw, offsets = utf8(batch.column(text_column))
        for a, b in text_blocks(offsets, SHARD_BYTES):
            own = offsets[a : b + 1]
            yield a, b, Texts(raw[own[0] : own[-1]], own - own[0])

    def search(self, blocks: Blocks) -> None:
        for block in blocks.shared:
            found, text, item = search_block(block.value, self.numbers, self.bounds)
            self.hit |= found
            for t, i in zip(text.tolist(), item.tolist(), strict=True):
                self.items[t].add(block.value.names[i])

    def runs(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end word, counted from the text's first, of each run of hit words."""
        marks = np.diff(np.concatenate([[0], self.hit[self.bounds[t] : self.bounds[t + 1]].astype(np.int8), [0]]))
        return np.flatnonzero(marks == 1), np.flatnonzero(marks == -1)

    def spans(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Those runs as bytes of the text."""
        begin, end = self.runs(t)
        x, start = self.bounds[t], self.offsets[t]
        return self.first[x + begin] - start, self.last[x + end - 1] - start

    def body(self, t: int) -> np.ndarray:
        return self.raw[self.offsets[t] : self.offsets[t + 1]]

    def cleaned(self, t: int) -> str:
        begin, end = self.spans(t)
        body = self.body(t)
        keep = np.concatenate([[0], end]), np.concatenate([begin, [len(body)]])
        return b"".join(body[p:q].tobytes() for p, q in zip(*keep, strict=True)).decode("utf-8")

    def report(self, out: dict, cleaned: bool) -> None:
        total = np.concatenate([[0], np.cumsum(self.hit)])
        for t, own in enumerate(self.items):
            x, y = self.bounds[t], self.bounds[t + 1]
            n_hit, spans = int(total[y] - total[x]), []
            if n_hit:
                places = [code_points(self.body(t), p).tolist() for p in self.spans(t)]
                spans = [{"start": p, "end": q} for p, q in zip(*places, strict=True)]
            out["n_words"].append(int(y - x))
            out["n_hit"].append(n_hit)
            out["n_items"].append(len(own))
            out["items_sha256"].append(hashlib.sha256(",".join(sorted(own)).encode("utf-8")).hexdigest())
            out["contaminated"].append(n_hit > 0)
            out["spans"].append(spans)
            out["cleaned"].append(self.cleaned(t) if cleaned else None)


def hits_by_row(rows: DataFrame, table: DataFrame, numbers: range, window: int, text_column="text") -> DataFrame:
    """row, runs (first and end word of hit stretches) and items of the rows that some block of these hits; written."""
    blocks = Blocks(table, numbers, window)

    def make():
        def work(batch):
            out: dict = {"row": [], "runs": [], "items": []}
            names = batch.column("row").to_pylist()
            for a, b, texts in Texts.of(batch, text_column):
                texts.search(blocks)
                for t in range(b - a):
                    if texts.items[t]:
                        out["row"].append(names[a + t])
                        out["runs"].append([{"first": p, "end": q} for p, q in zip(*(x.tolist() for x in texts.runs(t)), strict=True)])
                        out["items"].append(sorted(texts.items[t]))
            return out

        return work

    found = cut_lineage(map_rows(rows.select("row", text_column), make, "row bigint, runs array<struct<first:bigint,end:bigint>>, items array<string>"))
    for block in blocks.shared:
        block.destroy()
    return found


def with_hits(frame: DataFrame, table: DataFrame, blocks: int, window: int, text_column="text") -> DataFrame:
    """``frame`` with the runs and items of all blocks, found pass by pass: only one pass's blocks exist at a time."""
    rows = cut_lineage(frame.withColumn("row", F.monotonically_increasing_id()))
    passes = [hits_by_row(rows, table, range(k, min(blocks, k + BLOCKS_AT_ONCE)), window, text_column) for k in range(0, blocks, BLOCKS_AT_ONCE)]
    every = reduce(DataFrame.unionByName, passes)
    # A row's runs and items are at most as many as its words allow, for each pass.
    merged = every.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"))
    return rows.join(merged, "row", "left").drop("row")


def taken(batch, text_column="text"):
    """Texts of a batch that ``with_hits`` made, their hits as found."""
    runs, items = batch.column("_runs").to_pylist(), batch.column("_items").to_pylist()
    for a, b, texts in Texts.of(batch, text_column):
        for t in range(b - a):
            for run in runs[a + t] or []:
                texts.hit[texts.bounds[t] + run["first"] : texts.bounds[t] + run["end"]] = True
            texts.items[t] = set(items[a + t] or [])
        yield a, b, texts


def searched(blocks: Blocks, text_column="text"):
    """The same for a batch that is searched here, where one pass is enough."""

    def find(batch):
        for a, b, texts in Texts.of(batch, text_column):
            texts.search(blocks)
            yield a, b, texts

    return find


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_column="doc_id", text_column="text", item_column="item_id",
    item_text="text", window=WINDOW, cleaned=False,
) -> DataFrame:
    """Words of every whole text that lie in a benchmark window.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 (SHA-256 of the item ids,
    sorted as text, joined by commas), contaminated, spans (merged, in code points, end
    exclusive), and with ``cleaned`` the text without these spans. The benchmark is the
    query set: it is searched in blocks of BLOCK_CHARS characters, every block against
    every document, BLOCKS_AT_ONCE in each pass over the documents; what the driver and
    a task hold of it is bounded by that. A null text has no words; a null item id is named ``null``; repeated
    rows each give a row; rows of one item id are one item; an empty benchmark hits
    nothing; other columns are left behind. No exchange, where one pass is enough: a document is searched where
    it is read, and a task holds one Arrow batch and one shard's index.
    """
    frame = text_frame(docs, id_column, text_column)
    id_type = frame.schema["doc_id"].dataType.simpleString()
    table, blocks = benchmark_blocks(benchmark, item_column, item_text, window)
    one_pass = blocks <= BLOCKS_AT_ONCE
    found = searched(Blocks(table, range(blocks), window)) if one_pass else taken
    frame = frame if one_pass else with_hits(frame, table, blocks, window)

    def make():
        def work(batch):
            out: dict = {n: [] for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "cleaned")}
            for _, _, texts in found(batch):
                texts.report(out, cleaned)
            return out | {"doc_id": batch.column("doc_id")}

        return work

    schema = f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>"
    return map_rows(frame, make, schema + ", cleaned string" * cleaned)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_column="text", item_column="item_id", item_text="text", window=WINDOW, length_column="n_chars") -> DataFrame:
    """``docs``, all columns, with the hit spans cut from its texts; texts without a hit stay as they are, nulls too."""
    table, blocks = benchmark_blocks(benchmark, item_column, item_text, window)
    one_pass = blocks <= BLOCKS_AT_ONCE
    found = searched(Blocks(table, range(blocks), window), text_column) if one_pass else lambda batch: taken(batch, text_column)

    def make():
        def work(batch):
            return [texts.cleaned(t) if texts.items[t] else None for a, b, texts in found(batch) for t in range(b - a)]

        return work

    frame = docs if one_pass else with_hits(docs, table, blocks, window, text_column)
    return rewrite_texts(frame, make, text_column, length_column).select(*docs.columns)
