"""Operator 12: how two tokenizers cut the same texts.

Equal texts are brought together by a shuffle on the full text; each distinct text is
tokenised and aligned once, its pairs of ids count as often as the text occurs, and what
was measured on it is joined to all rows that have it.
"""

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from logloom.llm.multiplicity import join_back
from logloom.llm.pretoken import encode_text, from_json, sizes, token_bytes
from logloom.llm.rows import map_rows
from logloom.llm.words import text_blocks, utf8
from logloom.session import cut_lineage

# Texts tokenised and aligned together, in bytes.
BLOCK = 2 << 20
# At most so many pairs, the most frequent ones, are broadcast; links of rarer pairs are joined.
HEAD = 1_000_000
# Frequencies are told apart by powers of 2**(1/4) to find those pairs.
STEPS = 4
ID_BITS = 20
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: those of a byte piece, else its text with the word mark as a space."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))
    return out


class Aligner:
    """Both tokenizers, and what their ids stand for."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        self.a = from_json(path_a, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes = token_bytes(self.a), piece_bytes(self.b)
        self.sizes = tuple(map(sizes, self.bytes))
        if max(map(len, self.bytes)) >> ID_BITS:
            raise ValueError(f"ids beyond {ID_BITS} bits")
        # How each id is written: inside its group, last of it for A, last for B.
        n = [len(t) for t in self.bytes]
        written = [*[f"{i},".encode() for i in range(n[0])], *[f"{i}|".encode() for i in range(n[0])]]
        written += [*[f"{i},".encode() for i in range(n[1])], *[f"{i};".encode() for i in range(n[1])]]
        self.written = np.array(written, object)

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B; None without a text and where the tokens' bytes are not those of a space and the text."""
        if not text:
            return None
        raw = b" " + text.encode("utf-8")
        a, b = encode_text(self.a, " " + text), self.b.encode(text)
        same = all(b"".join(map(t.__getitem__, ids)) == raw for t, ids in zip(self.bytes, (a, b), strict=True))
        return (a, b) if same else None

    def align(self, texts: list[str]) -> dict:
        """Measures of each text, and its distinct pairs of ids with the number of links of each."""
        found = [self.tokens(t) for t in texts]
        at = [i for i, f in enumerate(found) if f]
        n = len(texts)
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n}
        cuts = np.zeros(n + 1, np.int64)
        if not at:
            return out | {"pair": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "cuts": cuts}
        ids = [np.fromiter((i for k in at for i in found[k][side]), np.int64) for side in (0, 1)]
        for side, name in enumerate(("n_a", "n_b")):
            out[name][at] = [len(found[k][side]) for k in at]
        # Bytes counted through all the texts: both sides have the same ones, so ends are comparable.
        ends = [np.cumsum(self.sizes[side][ids[side]]) for side in (0, 1)]
        own = np.cumsum(out["n_a"][at])
        text_ends = ends[0][own - 1]
        common = np.intersect1d(*ends, assume_unique=True)
        out["n_groups"][at] = np.diff(np.searchsorted(common, text_ends, "right"), prepend=0)
        # Between two neighbouring ends lies one stretch, of one token of A and one of B: a link.
        stretch = np.union1d(*ends)
        pair = (ids[0][np.searchsorted(ends[0], stretch)] << ID_BITS) | ids[1][np.searchsorted(ends[1], stretch)]
        text = np.searchsorted(text_ends, stretch)
        out["n_links"][at] = np.bincount(text, minlength=len(at))
        distinct, count = np.unique((text << 2 * ID_BITS) | pair, return_counts=True)
        cuts[np.array(at) + 1] = np.bincount(distinct >> 2 * ID_BITS, minlength=len(at))
        # Groups one after the other, A's ids before B's.
        until = [np.searchsorted(e, common, "right") for e in ends]
        group = [np.searchsorted(common, e) for e in ends]
        place = [
            np.arange(len(ids[0])) + np.concatenate([[0], until[1]])[group[0]],
            np.arange(len(ids[1])) + until[0][group[1]],
        ]
        symbol = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
        shift = 0
        for side in (0, 1):
            last = np.zeros(len(ids[side]), bool)
            last[until[side] - 1] = True
            symbol[place[side]] = ids[side] + shift + last * len(self.bytes[side])
            shift += 2 * len(self.bytes[side])
        written = self.written[symbol]
        bounds = np.concatenate([[0], np.cumsum(out["n_a"][at] + out["n_b"][at])]).tolist()
        for k, x, y in zip(at, bounds[:-1], bounds[1:], strict=True):
            out["groups_sha256"][k] = hashlib.sha256(b"".join(written[x:y])[:-1]).hexdigest()
        return out | {"pair": distinct & ((1 << 2 * ID_BITS) - 1), "n": count, "cuts": np.cumsum(cuts)}


@lru_cache(maxsize=1)
def aligner_of(path_a: str, path_b: str, pattern: str) -> Aligner:
    return Aligner(path_a, path_b, pattern)


def int_lists(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))


def align_texts(texts: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """Of each row (key, copies, text) the measures of its text and its pairs: a, b and links of each, as arrays."""

    def make():
        aligner = aligner_of(path_a, path_b, pattern)

        def work(batch):
            _, offsets = utf8(batch.column("text"))
            parts = [aligner.align(batch.column("text")[x:y].to_pylist()) for x, y in text_blocks(offsets, BLOCK)]
            out = {n: batch.column(n) for n in ("key", "copies")}
            out |= {n: np.concatenate([p[n] for p in parts]) for n in ("n_a", "n_b", "n_groups", "n_links")}
            pair, n = (np.concatenate([p[k] for p in parts]) for k in ("pair", "n"))
            sizes = np.concatenate([np.diff(p["cuts"]) for p in parts])
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            out["groups_sha256"] = [s for p in parts for s in p["groups_sha256"]]
            return out | {"a": int_lists(cuts, pair >> ID_BITS), "b": int_lists(cuts, pair & ((1 << ID_BITS) - 1)), "links": int_lists(cuts, n)}

        return work

    numbers = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
    return map_rows(texts, make, f"key binary, copies bigint, {numbers}, groups_sha256 string, a array<int>, b array<int>, links array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n (links of the pair in the whole corpus) and best (no pair with the same b has more)."""
    each = aligned.select("copies", F.inline(F.arrays_zip("a", "b", "links")))
    counts = cut_lineage(each.groupBy("a", "b").agg(F.sum(F.col("links") * F.col("copies")).alias("n")))
    # One row for each id of B's vocabulary.
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"), F.floor(F.log2("n") * STEPS).alias("step"))


def measure(aligned: DataFrame, pairs: DataFrame, head: int) -> DataFrame:
    """``aligned`` with n_best and count_sum, without its pairs.

    The most frequent pairs, ``head`` at most, are broadcast; links of the others are joined with them by
    pair. No such pair is frequent, so no key of that join is hot.
    """
    spark = aligned.sparkSession
    steps = pairs.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, held, total = None, 0, sum(r["n"] for r in steps)
    for r in steps:
        if held + r["n"] > head:
            break
        held, least = held + r["n"], r["step"]
    top = pairs.filter(F.col("step") >= least if least is not None else F.lit(False)).select("a", "b", "n", "best").toArrow()
    code = (top["a"].to_numpy().astype(np.int64) << ID_BITS) | top["b"].to_numpy()
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((code[order], top["n"].to_numpy()[order], top["best"].to_numpy()[order]))

    def make():
        known, frequency, best = shared.value

        def work(batch):
            a, b, links = (batch.column(n) for n in ("a", "b", "links"))
            starts = a.offsets.to_numpy().astype(np.int64)
            flat = [c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in (a, b, links)]
            starts = starts - starts[0]
            wanted = (flat[0].astype(np.int64) << ID_BITS) | flat[1]
            at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
            hit = known[at] == wanted if len(known) else np.zeros(len(wanted), bool)
            count = np.where(hit, frequency[at], 0) if len(known) else np.zeros(len(wanted), np.int64)
            first = np.where(hit, best[at], False) if len(known) else hit
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (flat[2] * count, flat[2] * first.astype(np.int64), ~hit)]
            out = {n: batch.column(n) for n in ("key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            out |= {n: s[starts[1:]] - s[starts[:-1]] for n, s in zip(("count_sum", "n_best"), sums, strict=False)}
            cuts = sums[2][starts]
            return out | {n: int_lists(cuts, f[~hit]) for n, f in zip(("a", "b", "links"), flat, strict=True)}

        return work

    numbers = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
    schema = f"key binary, copies bigint, {numbers}, groups_sha256 string, count_sum bigint, n_best bigint, a array<int>, b array<int>, links array<int>"
    measured = cut_lineage(map_rows(aligned, make, schema))
    if held == total:
        return measured.select("key", "copies", *MEASURES)
    rare = measured.select("key", F.inline(F.arrays_zip("a", "b", "links"))).join(pairs.filter(F.col("step") < least if least is not None else F.lit(True)), ["a", "b"])
    more = rare.groupBy("key").agg(F.sum(F.col("links") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    joined = measured.drop("a", "b", "links").join(more, "key", "left")
    return joined.withColumns({"count_sum": plus("count_sum", "more_sum"), "n_best": plus("n_best", "more_best")}).select("key", "copies", *MEASURES)


def align_documents(docs: DataFrame, path_a: str, path_b: str, pattern: str, id_column="doc_id", text_column="text", head=HEAD) -> DataFrame:
    """How a byte-level BPE (A, a ``tokenizers`` file) and a SentencePiece model (B) cut every whole text.

    Returns doc_id, n_a and n_b (tokens), n_groups (runs between places where tokens of both end), n_links
    (overlapping tokens of A and B), n_best (links whose pair of ids is the corpus's most frequent one for
    its id of B, ties included), count_sum (over links, how many links of the corpus have the pair) and
    groups_sha256 of the groups' ids, ``a1,a2|b1;a3|b2,b3``. A encodes a space and the text. A null or empty
    text, and one whose tokens do not spell a space and the text, has no tokens: zeros and ''. Repeated rows
    each give a row, a null id stays null, an empty table gives none, other columns are left behind.
    """
    text = F.col(f"`{text_column}`").cast("string")
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.when(F.length(text) > 0, text).alias("text"))
    keyed = lambda df: F.unhex(F.sha2("text", 256))
    ids = cut_lineage(rows.select("doc_id", keyed(rows).alias("key")))
    # Copies are counted in each task before the exchange by text.
    texts = rows.filter("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("copies"))
    aligned = cut_lineage(align_texts(texts.select(keyed(texts).alias("key"), "copies", "text"), path_a, path_b, pattern))
    measured = cut_lineage(measure(aligned, cut_lineage(pair_counts(aligned)), head))
    total = ids.count()
    found = join_back(ids.filter("key IS NOT NULL"), measured, ["key"], total).select("doc_id", *MEASURES)
    none = [F.lit("" if n == "groups_sha256" else 0).cast("string" if n == "groups_sha256" else "bigint").alias(n) for n in MEASURES]
    return found.unionByName(ids.filter("key IS NULL").select("doc_id", *none))
