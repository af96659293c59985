"""Operator 8: SimHash fingerprints and all pairs of them within a Hamming radius.

DataFrame functions only. Every five-word shingle of a text is hashed and votes on each
of 128 bits, once for each time it occurs (so terms weigh by frequency). The votes are
counted as sums of two 32-bit fields at a time, which no text can overflow. Fingerprints within the radius
are found through permuted block tables: cut into more blocks than bits may differ, two
such fingerprints agree in some choice of blocks; each choice is a table keyed by them.
Near copies are further apart (``WIDE``) than there are blocks: there each block is a
table, asked with a few bits turned over. Both find every pair, and no other.
"""

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.plans.ordered import range_of

SHINGLE = 5
RADIUS = 3
# 128 bits in blocks of these widths; a pair within RADIUS = 3 agrees in 2 of 5 blocks.
BLOCKS = (26, 26, 26, 25, 25)
# Texts whose shingle sets have this Jaccard similarity are near copies.
SIMILARITY = 0.8
# Their vectors have the cosine 2J / (1 + J), so each bit differs with this chance: 19.4 of 128, with a deviation of 4.06.
TURNED = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
# 29: 2.4 deviations more. 99.4 % of pairs at 0.8 are within it; of unrelated texts (64 bits) some 3e-10.
WIDE = int(128 * TURNED + 2.4 * math.sqrt(128 * TURNED * (1 - TURNED)))
# Each half in blocks of these widths; of all ten, a pair within WIDE = 29 has one that differs in 2 bits at most.
WIDE_BLOCKS = (13, 13, 13, 13, 12)
FIELDS = 0x0000000100000001
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def terms(text: Column, size=SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words, lower case; a shorter text is one run, a wordless one none."""
    words = F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")
    runs = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size))
    )
    # The words are bound to a variable so that they are split once.
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<bigint>")))
    return made[0]


def votes(term="term") -> list[Column]:
    """64 sums, each of two 32-bit counts, over the bits of both 64-bit hashes of a term."""
    # The second hash is a scramble of the first.
    halves = (F.col(term), F.when(F.col(term).isNotNull(), F.xxhash64(F.col(term), F.lit(7))))
    return [
        F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(FIELDS))).alias(f"v{i}_{k}") for i, h in enumerate(halves) for k in range(32)
    ]


def words_of_votes() -> list[Column]:
    """The two 64-bit halves: a bit is set if more than half of the ``n`` terms have it."""
    out = []
    for i in range(2):
        bits = []
        for k in range(32):
            low = F.col(f"v{i}_{k}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(F.col(f"v{i}_{k}"), 32)
            bits.append(F.when(low * 2 > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0)))
            top = (1 << (k + 32)) - ((1 << 64) if k == 31 else 0)
            bits.append(F.when(high * 2 > F.col("n"), F.lit(top)).otherwise(F.lit(0)))
        word = bits[0].cast("bigint")
        for b in bits[1:]:
            word = word.bitwiseOR(b.cast("bigint"))
        out.append(word)
    return out


def simhash(rows: DataFrame, keys: list[str], text="text", size=SHINGLE) -> DataFrame:
    """``keys`` (which tell rows apart) and the fingerprint as two numbers, h0 and h1.

    A text without words has the fingerprint 0, 0. Grouping needs no exchange if the
    rows are partitioned by some of the keys.
    """
    each = rows.select(*keys, F.explode_outer(terms(F.col(text), size)).alias("term"))
    counted = each.groupBy(*keys).agg(F.count("term").alias("n"), *votes())
    h0, h1 = words_of_votes()
    return counted.select(*keys, F.coalesce(h0, F.lit(0)).alias("h0"), F.coalesce(h1, F.lit(0)).alias("h1"))


def likeness(a0, a1, b0, b1) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))) / 128


def hex_of(h0: Column, h1: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h0), 16, "0"), F.lpad(F.hex(h1), 16, "0")))


def block_keys(h0: Column, h1: Column) -> Column:
    """A key for each table: the number of the table and its two blocks, permuted to the front."""
    whole, at, cut = 128, 0, []
    for width in BLOCKS:
        end = at + width
        # Bits at .. end of the 128, h0 first.
        if end <= 64:
            cut.append(F.shiftrightunsigned(h0, 64 - end).bitwiseAND(F.lit((1 << width) - 1)))
        elif at >= 64:
            cut.append(F.shiftrightunsigned(h1, whole - end).bitwiseAND(F.lit((1 << width) - 1)))
        else:
            left = h0.bitwiseAND(F.lit((1 << (64 - at)) - 1))
            cut.append(F.shiftleft(left, end - 64).bitwiseOR(F.shiftrightunsigned(h1, whole - end)))
        at = end
    # Two blocks are 52 bits at most; the table's number stands above them.
    tables = [
        F.shiftleft(cut[a], 26).bitwiseOR(cut[b]).bitwiseOR(F.lit(t << 53)) for t, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    return F.array(*tables)


def within_radius(queries: DataFrame, prints: DataFrame, radius=RADIUS) -> DataFrame:
    """All pairs of distinct fingerprints (q0, q1) of ``queries`` and (h0, h1) of ``prints`` that differ in at most ``radius`` (3 at most) bits.

    Both are reduced to distinct fingerprints first, so copies make no pairs. Exact: two
    fingerprints at such a distance agree in at least two of the five blocks.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the block tables find distances up to {RADIUS}")
    q = queries.select(F.col("h0").alias("q0"), F.col("h1").alias("q1")).distinct().select("q0", "q1", F.explode(block_keys(F.col("q0"), F.col("q1"))).alias("block"))
    p = prints.select("h0", "h1").distinct().select("h0", "h1", F.explode(block_keys(F.col("h0"), F.col("h1"))).alias("other"))
    near = F.bit_count(F.col("q0").bitwiseXOR(F.col("h0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("h1"))) <= radius
    return q.join(p, (q["block"] == p["other"]) & near).select("q0", "q1", "h0", "h1").distinct()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def turned_blocks(width: int, turned: int) -> list[int]:
    """The ways to turn over up to ``turned`` bits of a block, as numbers to XOR it with; the first turns none."""
    return [sum(1 << i for i in bits) for k in range(turned + 1) for bits in combinations(range(width), k)]


def wide_blocks(h0: Column, h1: Column) -> list[Column]:
    """The blocks of WIDE_BLOCKS, half of them of either number, each with its number above its bits."""
    out = []
    for half in (h0, h1):
        at = 64
        for width in WIDE_BLOCKS:
            at -= width
            out.append(F.shiftrightunsigned(half, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int").bitwiseOR(F.lit(len(out) << 16)))
    return out


def within_wide_radius(queries: DataFrame, prints: DataFrame, radius=WIDE) -> DataFrame:
    """All pairs of distinct fingerprints (q0, q1) of ``queries`` and (h0, h1) of ``prints`` that differ in at most ``radius`` bits.

    Exact: of the ten blocks of two such fingerprints one differs in at most a tenth of the
    radius, rounded down. Each block is a table; ``queries`` ask it with up to so many bits
    turned over. Each fingerprint of ``prints`` is sent 10 times, each of ``queries`` 894
    times at radius 29. Unrelated fingerprints meet with a chance of 0.13; each pair that
    meets is verified by its distance.
    """
    turned = radius // (2 * len(WIDE_BLOCKS))
    p = prints.select("h0", "h1").distinct().select("h0", "h1", F.explode(F.array(*wide_blocks(F.col("h0"), F.col("h1")))).alias("other"))
    q = queries.select(F.col("h0").alias("q0"), F.col("h1").alias("q1")).distinct()
    ways = [F.struct(b.alias("own"), F.lit(turned_blocks(w, turned)).alias("turns")) for w, b in zip(2 * WIDE_BLOCKS, wide_blocks(F.col("q0"), F.col("q1")), strict=True)]
    q = q.select("q0", "q1", F.inline(F.array(*ways))).select("q0", "q1", "own", F.explode("turns").alias("turn"))
    q = q.select("q0", "q1", F.col("own").bitwiseXOR(F.col("turn")).alias("block"))
    x0, x1 = F.col("q0").bitwiseXOR(F.col("h0")), F.col("q1").bitwiseXOR(F.col("h1"))
    near = F.bit_count(x0) + F.bit_count(x1) <= radius
    # Only the first table that holds a pair gives it.
    apart = [b.bitwiseAND(F.lit(0xFFFF)) for b in wide_blocks(x0, x1)]
    first = F.coalesce(*[F.when(F.bit_count(b) <= turned, F.lit(t)) for t, b in enumerate(apart)])
    # Sizes are estimated before the rows are multiplied; without the hint a side could be broadcast.
    return q.join(p.hint("merge"), (q["block"] == p["other"]) & near & (first == F.shiftright("block", 16))).select("q0", "q1", "h0", "h1")


def neighbours(docs: DataFrame, id_column="doc_id", text_column="text", chunks: int | None = None) -> DataFrame:
    """Each text with the next one in descending order of id (after the last: the first), by one exchange.

    Ids are cut into ranges at ids that occur, so that each holds about as many rows;
    the rows of a cut, which come first in their own chunk, also go to the chunk above
    as guests. Returns chunk, place (in the chunk), guest, doc_id, text, next_text. Null
    texts are empty; null ids come last; equal ids are ordered by text.
    """
    frame = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    if chunks is None:
        chunks = 4 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = [i / chunks for i in range(1, max(2, chunks))]
    # An array of fewer than ``chunks`` ids, whatever the table's size.
    found = frame.agg(F.percentile_approx("doc_id", share, 100 * chunks).alias("cuts"), F.max("doc_id").alias("top")).first()
    top = found["top"]
    # Chunk k holds the ids above cut k - 1, up to cut k; the last cut is the greatest id.
    cuts = [] if top is None else [*sorted(set(found["cuts"]) - {top}), top]
    doc_id = F.col("doc_id")
    known = F.when(doc_id.isNull(), 0).otherwise(F.least(range_of(cuts, doc_id, kind), F.lit(max(0, len(cuts) - 1))))
    placed = frame.select("doc_id", "text", known.cast("int").alias("own"))
    if cuts:
        is_cut = doc_id == F.element_at(F.lit(cuts).cast(f"array<{kind}>"), F.col("own") + 1)
        above = F.when(F.col("own") == len(cuts) - 1, 0).otherwise(F.col("own") + 1)
    else:
        is_cut, above = F.lit(False), F.lit(0)
    home = F.struct(F.col("own").alias("chunk"), F.lit(0).alias("guest"))
    away = F.struct(above.cast("int").alias("chunk"), F.lit(1).alias("guest"))
    dealt = placed.select("doc_id", "text", F.explode(F.when(is_cut, F.array(home, away)).otherwise(F.array(home))).alias("h"))
    order = Window.partitionBy("chunk").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    after = F.lead("text").over(order)
    if not cuts:  # only null ids, all in one chunk without guests
        after = F.coalesce(after, F.first("text").over(order))
    return dealt.select("h.chunk", "h.guest", "doc_id", "text").select(
        "chunk", "guest", "doc_id", "text", F.row_number().over(order).alias("place"), after.alias("next_text")
    )


def compare_edited(docs: DataFrame, id_column="doc_id", text_column="text", size=SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last half replaced by the first half of the next document's
    (``neighbours``). Returns doc_id, n_chars, edited_sha256, h0, h1, e0, e1,
    near_edited, near_next. A null text is empty; a wordless text has the fingerprint
    0, 0; repeated rows each give a row; other columns are left behind. Texts move in one
    exchange; all else stays in its chunk.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = neighbours(docs, id_column, text_column).select("chunk", "guest", "place", "doc_id", "text", n.cast("bigint").alias("n_chars"), F.when(F.col("guest") == 0, edited).alias("edited"))
    digest = F.sha2("edited", 256)
    rows = rows.select("chunk", "guest", "place", "doc_id", "n_chars", "text", "edited", digest.alias("edited_sha256"))
    both = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))
    keys = ["chunk", "guest", "place", "doc_id", "n_chars", "edited_sha256", "version"]
    each = rows.select(*keys[:-1], F.explode(both).alias("v")).select(*keys[:-1], "v.version", "v.body")
    each = each.filter((F.col("guest") == 0) | (F.col("version") == 0))
    prints = simhash(each, keys, "body", size)
    order = Window.partitionBy("chunk").orderBy("place", "version")
    # After a text's own row comes its edited one, then the next text's.
    ahead = [F.lead(h, k).over(order).alias(name) for k, names in ((1, ("e0", "e1")), (2, ("x0", "x1"))) for h, name in zip(("h0", "h1"), names, strict=True)]
    c = F.col
    out = prints.select(*keys, "h0", "h1", *ahead).filter("guest = 0 AND version = 0")
    # A lone row of no id, or the last row where no chunk has guests, is compared with the first.
    next0, next1 = F.coalesce("x0", c("h0")), F.coalesce("x1", c("h1"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "h0", "h1", "e0", "e1",
        likeness(c("h0"), c("h1"), c("e0"), c("e1")).alias("near_edited"), likeness(c("h0"), c("h1"), next0, next1).alias("near_next"),
    )
