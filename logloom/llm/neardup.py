"""Operator 10: near-duplicate texts by MinHash bands, odd sketches and exact sets.

Texts of equal shingle sets are one class. Classes that agree in a band meet in a
bucket; each is paired with the bucket's lead, the member that meets most others (never
with every other member), an odd sketch of the MinHash values drops pairs that are far
from similar, and the full sets of what is left are compared exactly. That joins nearly
all there is to join. Two more steps see to it that no link of the bands is lost to the
star shape: nodes near the same lead that are still in different components are compared
in blocks, and so are members of a bucket that belong to different leads. Nothing but
stages in the shared folder is kept; no link or component reaches the driver.
"""

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from logloom.llm.multiplicity import join_back
from logloom.llm.rows import BLOCK_BYTES, map_rows
from logloom.llm.words import SPACED, scramble, shingles, text_blocks, utf8, word_spans
from logloom.session import cut_lineage

# At most VALUES minima, in bands of ROWS or fewer. A pair at the similarity asked for meets in no band
# with a chance of MISS at most: at 0.8 that takes 30 bands of 4, 1 - (1 - 0.8**4)**30 = 1 - 1.4e-7.
VALUES, ROWS, MISS = 120, 4, 1.5e-7
SKETCH_BITS = 512
# Of a pair at the similarity more minima differ than the bound of bits allows for with a chance of TAIL: at 0.8
# more than 46 of 120, where 24 are expected; 46 come to 78 bits, of which SPARE more are let pass.
TAIL, SPARE = 2e-6, 2
# Nodes that one part of a group compares with the same other node.
PARTNERS = 1000
# Nodes and shingles of a part of a group; two parts at most are in memory together.
BLOCK_NODES, BLOCK_SHINGLES = 1000, 500_000


class Bands:
    """How many bands of how many minima a similarity needs, and in how many bits its sketches may differ."""

    def __init__(self, percent: int):
        s = min(percent, 100) / 100
        for rows in range(ROWS, 0, -1):
            bands = int(np.ceil(np.log(MISS) / np.log1p(-(s**rows)))) if 0 < s < 1 else 1 if s == 1 else VALUES + 1
            if bands * rows <= VALUES:
                break
        else:
            raise ValueError(f"percent={percent}: {VALUES} minima cannot promise to find pairs of so little in common")
        self.bands, self.rows, self.values = bands, rows, bands * rows
        # The number of minima that differ is binomial. Each toggles two of the n bits; some toggles meet.
        chance = [math.comb(self.values, d) * (1 - s) ** d * s ** (self.values - d) for d in range(self.values + 1)]
        differ = next(d for d in range(self.values + 1) if math.fsum(chance[d + 1 :]) <= TAIL)
        self.bits = math.ceil(SKETCH_BITS / 2 * -math.expm1(-4 * differ / SKETCH_BITS)) + SPARE * (differ > 0)


_ROUND = scramble(np.arange(1, VALUES + 1, dtype=np.uint64))
_FACTOR, _ADD = _ROUND | np.uint64(1), scramble(_ROUND)


def minhashes(sets: list[np.ndarray], values=VALUES) -> np.ndarray:
    """A line of minima for each set; sets are not empty."""
    out = np.empty((len(sets), values), np.uint64)
    for i, s in enumerate(sets):
        low = None
        for at in range(0, len(s), 512):
            part = (s[at : at + 512, None] * _FACTOR[:values] + _ADD[:values]).min(0)
            low = part if low is None else np.minimum(low, part)
        out[i] = low
    return out


def band_keys(mins: np.ndarray, rows=ROWS) -> np.ndarray:
    bands = mins.shape[1] // rows
    total = np.zeros((len(mins), bands), np.uint64)
    for r in range(rows):
        total = scramble(total * np.uint64(31) + mins[:, r::rows])
    return scramble(total + _ROUND[:bands]).view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity of how many of the numbered minima fall on each of SKETCH_BITS places, as 64-bit words."""
    spot = (scramble(mins + _ROUND[: mins.shape[1]]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = (np.arange(len(mins))[:, None] * SKETCH_BITS + spot).ravel()
    parity = np.bincount(flat, minlength=len(mins) * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(mins), SKETCH_BITS // 64)


def sets_of(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle numbers of each text."""
    numbers, _, _, bounds = word_spans(raw, offsets, SPACED)
    return [np.unique(shingles(numbers[a:b], size)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(frame: DataFrame, size: int, plan: Bands) -> DataFrame:
    """doc_id, row_key, n_shingles, node (the class of the set; null for an empty one), bands, odd."""
    id_type = frame.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch):
            out = {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "n_shingles": [], "node": [], "bands": [], "odd": []}
            raw, offsets = utf8(batch.column("text"))
            for a, b in text_blocks(offsets, BLOCK_BYTES):
                sets = sets_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                mins = minhashes([s for s in sets if len(s)], plan.values)
                keys, odd, at = band_keys(mins, plan.rows), odd_sketches(mins), 0
                for s in sets:
                    full = len(s) > 0
                    out["n_shingles"].append(len(s))
                    out["node"].append(class_of(s) if full else None)
                    out["bands"].append(keys[at] if full else None)
                    out["odd"].append(odd[at] if full else None)
                    at += full
            return out

        return work

    return map_rows(frame, make, f"doc_id {id_type}, row_key bigint, n_shingles bigint, node binary, bands array<bigint>, odd array<bigint>")


def exact_links(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity.

    ``groups`` has rows (b, part, a, text), in the order of (b, part, a): first the text of
    b itself, with a NULL a, then those of the nodes to be compared with it. One set of a
    b is in memory at a time.
    """

    def make():
        lead: dict = {}

        def work(batch):
            out = {"a": [], "b": []}
            raw, offsets = utf8(batch.column("text"))
            nodes, leads = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for x, y in text_blocks(offsets, BLOCK_BYTES):
                for i, own in enumerate(sets_of(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], size), start=x):
                    # A text of another class is another row of a repeated id.
                    if nodes[i] is None:
                        if class_of(own) == leads[i]:
                            lead.update(node=leads[i], set=own)
                    elif lead.get("node") == leads[i] and class_of(own) == nodes[i]:
                        both = len(np.intersect1d(own, lead["set"], assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(lead["set"]) - both):
                            out["a"].append(nodes[i])
                            out["b"].append(leads[i])
            return out

        return work

    return map_rows(groups, make, "a binary, b binary")


class Block:
    """Nodes of one or two parts of a group, and the links between them that join components."""

    def __init__(self):
        self.nodes, self.sets, self.labels, self.parts, self.odd = [], [], [], [], []

    def add(self, node, own, label, part, odd):
        self.nodes.append(node)
        self.sets.append(own)
        self.labels.append(label)
        self.parts.append(part)
        self.odd.append(odd)

    def links(self, percent: int, bound: int) -> list[tuple[bytes, bytes]]:
        """Every pair of different components is compared, by sketch and then exactly, but
        for pairs that the links found so far have joined."""
        number = {x: i for i, x in enumerate(dict.fromkeys(self.labels))}
        root = np.array([number[x] for x in self.labels])
        part, size, odd = np.array(self.parts), np.array([len(s) for s in self.sets]), np.array(self.odd).view(np.uint64)
        two, out = len(set(self.parts)) > 1, []
        for x in range(1, len(self.nodes)):
            other = root[:x] != root[x]
            if two:  # pairs within a part are another block's
                other &= part[:x] != part[x]
            y = np.flatnonzero(other & (100 * np.minimum(size[:x], size[x]) >= percent * np.maximum(size[:x], size[x])))
            y = y[np.bitwise_count(odd[y] ^ odd[x]).sum(1) <= bound]
            if not len(y):
                continue
            own, many = self.sets[x], np.concatenate([self.sets[i] for i in y])
            at = np.minimum(np.searchsorted(own, many), len(own) - 1)
            both = np.add.reduceat(own[at] == many, np.concatenate([[0], np.cumsum(size[y])[:-1]]))
            for i in y[100 * both >= percent * (size[y] + size[x] - both)]:
                if root[i] != root[x]:
                    out.append((self.nodes[x], self.nodes[i]))
                    root[root == root[i]] = root[x]
        return out


def block_links(rows: DataFrame, size: int, percent: int, bound: int) -> DataFrame:
    """Links (a, b) within blocks: ``rows`` (hub, i, j, part, node, label, odd, text) come in the order of (hub, i, j)."""

    def make():
        now: dict = {"key": None, "block": None}

        def work(batch):
            out: list = []

            def close():
                if now["block"] is not None:
                    out.extend(now["block"].links(percent, bound))

            if batch is None:
                close()
                return {"a": [p[0] for p in out], "b": [p[1] for p in out]}
            raw, offsets = utf8(batch.column("text"))
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("hub", "i", "j")), strict=True))
            nodes, labels, parts = (batch.column(c).to_pylist() for c in ("node", "label", "part"))
            odd = np.array(batch.column("odd").to_pylist(), np.int64).reshape(len(nodes), -1)
            for x, y in text_blocks(offsets, BLOCK_BYTES):
                for k, own in enumerate(sets_of(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], size), start=x):
                    if class_of(own) != nodes[k]:
                        continue  # another text of a repeated id
                    if keys[k] != now["key"]:
                        close()
                        now.update(key=keys[k], block=Block())
                    now["block"].add(nodes[k], own, labels[k], parts[k], odd[k])
            return {"a": [p[0] for p in out], "b": [p[1] for p in out]}

        return work

    return map_rows(rows, make, "a binary, b binary", last=True)


def keeper(spark, rows: int):
    """``cut_lineage`` with no more tasks than two for each core, or ``share`` for every million of ``rows``.

    Small tables would else be written as one tiny file for each shuffle partition.
    """
    least = 2 * spark.sparkContext.defaultParallelism
    return lambda df, share=3: cut_lineage(df.coalesce(max(least, -(-rows * share // 1_000_000))))


def components(links: DataFrame, keep=cut_lineage) -> DataFrame:
    """node, label: the least node that each linked node can reach over links (a, b).

    Each round takes the least label among a node's neighbours, then that label's own
    label, so the distance still to go at least halves on chains. Labels are written to
    the shared folder each round.
    """
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("of")).agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["of"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("of"), F.col("label").alias("far"))
        new = low.join(jump, low["label"] == jump["of"], "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label"))
        step = keep(new)
        if step.filter(F.col("was") != F.col("label")).isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def near_duplicates(docs: DataFrame, id_column="doc_id", text_column="text", size=4, percent=80) -> DataFrame:
    """Links texts whose sets of ``size``-word shingles have 100 |a and b| >= percent |a or b|.

    Returns a row per document: doc_id, n_shingles, component_id (the least doc_id
    that links reach), kept (doc_id = component_id). Words are runs of anything but
    spaces and tab to carriage return, A-Z in lower case; a text with fewer words than
    ``size`` is one shingle. A null or wordless text has an empty set and is linked with
    nothing. Repeated rows each give a row; null ids are carried along but never name a
    component (a component of null ids only has a null one, and its rows are kept).
    Bands and sketches follow from ``percent``; one too low for them is an error. Other columns are left behind. Intermediate tables are written to the shared folder.
    """
    plan = Bands(percent)
    doc_id = F.col(f"`{id_column}`")
    text = F.col(f"`{text_column}`").cast("string")
    # Finds a text again; the class of its set tells it from others of the same key.
    key = F.xxhash64(F.coalesce(doc_id.cast("string"), text))
    frame = docs.select(doc_id.alias("doc_id"), key.alias("row_key"), text.alias("text"))
    rows = cut_lineage(sketch(frame, size, plan))
    full = rows.filter("node IS NOT NULL")
    keep = keeper(docs.sparkSession, rows.count())
    classes = keep(full.groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")
    ), 10)
    spots = classes.select("node", F.explode("bands").alias("band"))
    crowded = spots.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    # A band that a large group of near copies has in common is not dealt to one task.
    total = classes.count() * plan.bands
    shared = keep(join_back(spots, crowded, ["band"], total, "members"), 30)
    # The member that meets most others leads its buckets: the text that the others were made from, if there is one.
    degrees = keep(shared.groupBy("node").agg(F.sum("members").alias("degree")))
    leads = shared.join(degrees, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("top"), F.count("*").alias("members"))
    met = keep(join_back(shared.select("band", "node"), leads, ["band"], total, "members").select("band", "node", F.col("top.node").alias("lead"), F.col("top.degree").alias("degree")), 30)
    light = classes.select("node", "n", "odd")
    marked = classes.select("node", "n", "odd", "bands")
    near = sum((F.bit_count(F.col("x_odd")[i].bitwiseXOR(F.col("y_odd")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0)) <= plan.bits
    sized = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    side = lambda s, name: light.select(F.col("node").alias(name), F.col("n").alias(f"{s}_n"), F.col("odd").alias(f"{s}_odd"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass sketch, size and the exact comparison."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = classes.join(nodes, "node", "left_semi").select(F.col("row_key").alias("wanted_key"), "node")
        # Repeated rows of a key are the same text or are told apart by their class.
        texts = keep(frame.join(wanted, frame["row_key"] == wanted["wanted_key"]).select("node", "text"), 30)
        # A node with many partners is compared with them in several parts, each with its text once.
        parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
        leads = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        members = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "text")
        first = leads.join(texts.withColumnRenamed("node", "b"), "b").select("b", "part", F.lit(None).cast("binary").alias("a"), "text")
        groups = first.union(members).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
        return keep(exact_links(groups, size, percent).distinct(), 30)

    pairs = met.filter("node <> lead").groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(F.max("degree").alias("degree"))
    stars = keep(pairs.join(side("x", "a"), "a").join(side("y", "b"), "b").filter(sized & near).select("a", "b", "degree"))
    links = confirmed(stars.select("a", "b"))
    labels = components(links, keep)

    # Each node belongs to the greatest lead it is near, or leads itself. Within such a group
    # all nodes of different components are compared, in blocks of bounded size.
    best = stars.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("degree", F.col("b").alias("hub"))).alias("top"))
    own = F.struct("degree", F.col("node").alias("hub"))
    hubs = degrees.join(best, "node", "left").select("node", F.greatest(own, F.coalesce("top", own))["hub"].alias("hub"))
    members = keep(hubs.join(labels, "node", "left").join(light, "node").select("hub", "node", F.coalesce("label", "node").alias("label"), "n", "odd"))
    split = members.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    split = split.filter("low <> high").select("hub", F.ceil(F.greatest(F.col("nodes") / BLOCK_NODES, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    dealt = members.join(split, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    wanted = classes.join(dealt.select("node").distinct(), "node", "left_semi").select(F.col("row_key").alias("wanted_key"), F.col("node").alias("text_node"))
    texts = frame.join(wanted, frame["row_key"] == wanted["wanted_key"]).select("text_node", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    placed = dealt.join(texts, dealt["node"] == texts["text_node"]).select("hub", "part", "node", "label", "odd", "text", other).select(
        "hub", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "label", "odd", "text"
    )
    blocks = placed.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    links = keep(links.union(block_links(blocks, size, percent, plan.bits)), 30)
    labels = components(links, keep)

    # Buckets that still hold several components: their members against those of other groups.
    placed = met.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    open_spots = keep(placed.join(mixed, "band").join(marked, "node").join(hubs, "node"), 30)
    x = open_spots.select("band", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", "n", "odd", "bands", "hub")])
    y = open_spots.select(F.col("band").alias("y_band"), *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "n", "odd", "bands", "hub")])
    # Of the buckets that two nodes share only the least makes the pair.
    least = F.array_min(F.array_intersect("x_bands", "y_bands")) == F.col("band")
    rest = x.join(y, (x["band"] == y["y_band"]) & (F.col("x_label") < F.col("y_label")) & (F.col("x_hub") != F.col("y_hub")) & sized & near & least)
    rest = rest.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = keep(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = confirmed(rest)
        if not more.isEmpty():
            labels = components(links.union(more), keep)

    named = classes.select("node", "low").join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    found = named.join(lowest, "label").select("node", "component_id")
    linked = full.join(found, "node").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
