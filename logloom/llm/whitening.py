"""Operator 11: whitening of embeddings, each distinct vector once.

Vectors become whole numbers, so equal ones group exactly. The covariance is taken over
the distinct vectors, each counting once or as often as it occurs, centred before it is
multiplied; each distinct vector is projected once and joined back to the rows that have it.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logloom.llm.multiplicity import join_back, sum_vectors
from logloom.llm.rows import map_rows
from logloom.session import cut_lineage

COMPONENTS = 16
# An entry c becomes floor(SCALE * c) + SHIFT; beyond 2**61 it is held at that.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**61
DECIMAL_DIGITS = 38


class Space:
    """Vectors of one length: how many, their sums, and the components once the covariance is known."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        # The whole part of the mean and what is left of it.
        self.base = np.array([s // n for s in sums], np.int64)
        self.left = np.array([s % n for s in sums], object)
        self.mean_left = np.array([int(r) / n for r in self.left])
        self.values = self.vectors = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.mean_left

    def set_covariance(self, covariance: np.ndarray, most: int) -> None:
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(values)[::-1][:most]
        self.trace = float(np.trace(covariance))
        self.values, self.vectors = values[order], vectors[:, order]
        # What rounding alone can leave of an eigenvalue is no variance.
        self.real = self.values > max(float(values.max(initial=0.0)), 0.0) * len(values) * np.finfo(float).eps * 4
        self.explained = [float(v) / self.trace if self.trace > 0 else None for v in self.values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the deviations; NaN along components without variance."""
        scale = np.where(self.real, 1 / np.sqrt(np.where(self.real, self.values, 1.0)), np.nan)
        return self.centred(x) @ (self.vectors * scale)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)**2, exact."""
        y = x - self.base
        high, n = int(np.abs(y).max(initial=0)) + 1, self.n
        if y.shape[1] * high * high >= 1 << 62 or y.shape[1] * high * n >= 1 << 62:
            y = y.astype(object)
            left = self.left
        else:
            left = self.left.astype(np.int64)
        squares, mixed, rest = (y * y).sum(1), (y * left).sum(1), sum(int(r) ** 2 for r in self.left)
        return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, mixed, strict=True)]


def matrices(batch: pa.RecordBatch):
    """(length, row numbers, matrix of those rows) for each length of vector in the batch."""
    lists = batch.column("x")
    sizes = np.diff(lists.offsets.to_numpy())
    starts = lists.offsets.to_numpy()[:-1]
    flat = lists.values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, flat[starts[rows][:, None] + np.arange(size)]


def weights_of(batch: pa.RecordBatch, rows: np.ndarray, weighted: bool) -> np.ndarray:
    return batch.column("copies").to_numpy()[rows] if weighted else np.ones(len(rows), np.int64)


def no_rows() -> dict:
    return {"size": pa.array([], pa.int64()), "i": pa.array([], pa.int64()), "row": pa.array([], pa.list_(pa.int64()))}


def fit_sums(distinct: DataFrame, weighted: bool) -> dict[int, Space]:
    """The number of fitted vectors and their sums, exact, for each length."""

    def make():
        held: dict[int, np.ndarray] = {}

        def work(batch):
            if batch is None:
                keys = [(size, i) for size, t in held.items() for i in range(len(t))]
                return {
                    "size": pa.array([k[0] for k in keys], pa.int64()), "i": pa.array([k[1] for k in keys], pa.int64()),
                    "row": pa.array([held[s][i] for s, i in keys], pa.list_(pa.int64())),
                }
            for size, rows, x in matrices(batch):
                w = weights_of(batch, rows, weighted)[:, None]
                # In two halves, whose sums fit 64 bits.
                part = np.stack([np.full(size, w.sum()), ((x >> 32) * w).sum(0), ((x & 0xFFFFFFFF) * w).sum(0)], 1)
                held[size] = held[size] + part if size in held else part
            return no_rows()

        return work

    found = sum_vectors(map_rows(distinct, make, "size bigint, i bigint, row array<bigint>", last=True), ["size", "i"], "bigint").collect()
    sums: dict[int, dict[int, list[int]]] = {}
    for r in found:
        sums.setdefault(r["size"], {})[r["i"]] = r["row"]
    return {size: Space(t[0][0], [(t[i][1] << 32) + t[i][2] for i in range(size)]) for size, t in sums.items()}


def summed_products(distinct: DataFrame, spaces: dict[int, Space], weighted: bool, of) -> dict[int, np.ndarray]:
    """Weighted Z'Z of the rows Z = of(space, x) for each length: one matrix a task, summed row by row."""

    def make():
        held: dict[int, np.ndarray] = {}

        def work(batch):
            if batch is None:
                keys = [(size, i) for size, t in held.items() for i in range(len(t))]
                return {
                    "size": pa.array([k[0] for k in keys], pa.int64()), "i": pa.array([k[1] for k in keys], pa.int64()),
                    "row": pa.array([held[s][i] for s, i in keys], pa.list_(pa.float64())),
                }
            for size, rows, x in matrices(batch):
                if size == 0:
                    continue
                z = of(spaces[size], x)
                product = (z * weights_of(batch, rows, weighted)[:, None]).T @ z
                held[size] = held[size] + product if size in held else product
            return no_rows()

        return work

    found = sum_vectors(map_rows(distinct, make, "size bigint, i bigint, row array<double>", last=True), ["size", "i"]).collect()
    out: dict[int, dict[int, list[float]]] = {}
    for r in found:
        out.setdefault(r["size"], {})[r["i"]] = r["row"]
    return {size: np.array([t[i] for i in range(len(t))]) for size, t in out.items()}


def with_ones(space: Space, x: np.ndarray) -> np.ndarray:
    """Whitened vectors, components without variance left at 0, and a column of ones, whose products are sums."""
    return np.hstack([np.nan_to_num(space.whitened(x)), np.ones((len(x), 1))])


def whiten(vectors: DataFrame, id_column="vec_id", vector_column="embedding", weighted=False, components=COMPONENTS) -> DataFrame:
    """Whitened coordinates: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has null or non-finite entries are left out. Entries become whole numbers
    x = floor(64 * c) + 1000000. The covariance is taken over the distinct x vectors, of which ``weighted``
    counts each as often as it occurs, else once; n is their (weighted) number. For each remaining row and
    component, numbered from 1 by falling eigenvalue, up to ``components``: ``whitened`` is the centred x
    projected on the component over the root of its eigenvalue, null where the component has no variance
    (of a single vector, say); ``explained`` the eigenvalue's share, null where there is no variance at all;
    ``deviation`` (decimal) the exact sum of (n * x - S)**2, null beyond 38 digits; ``identity_error`` the largest
    entry of the whitened covariance less the identity, measured on the whitened vectors, over the components
    with variance. Vectors of each length are a space of their own; empty vectors have no components. Equal
    rows each give their rows, a null id stays null, an empty table gives none, other columns are left behind.

    To the driver come, for each length d, d sums and the d x d covariance.
    """
    entry = lambda e: e.cast("double")
    c = F.col(f"`{vector_column}`")
    sound = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & (F.abs(entry(e)) < float("inf")))
    x = F.transform(c, lambda e: F.floor(F.greatest(F.least(entry(e) * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + SHIFT)
    rows = vectors.filter(sound).select(F.col(f"`{id_column}`").alias("vec_id"), x.alias("x"))
    rows = cut_lineage(rows.select("vec_id", "x", F.xxhash64("x").alias("h0"), F.xxhash64(F.lit(SCALE), "x").alias("h1")))
    distinct = cut_lineage(rows.groupBy("h0", "h1", "x").agg(F.count("*").alias("copies")))
    spaces = fit_sums(distinct, weighted)
    for size, products in summed_products(distinct, spaces, weighted, Space.centred).items():
        spaces[size].set_covariance(products / spaces[size].n, components)

    def make():
        def work(batch):
            values: list = [None] * batch.num_rows
            spread: list = [None] * batch.num_rows
            sizes = np.zeros(batch.num_rows, np.int64)
            for size, at, x in matrices(batch):
                sizes[at] = size
                if size == 0:
                    continue
                for i, w, d in zip(at.tolist(), spaces[size].whitened(x), spaces[size].deviations(x), strict=True):
                    values[i], spread[i] = w, Decimal(d) if d < 10**DECIMAL_DIGITS else None
            return {n: batch.column(n) for n in ("h0", "h1", "copies")} | {"size": sizes, "deviation": spread, "values": values}

        return work

    answers = cut_lineage(map_rows(distinct, make, f"h0 bigint, h1 bigint, copies bigint, size bigint, deviation decimal({DECIMAL_DIGITS},0), values array<double>"))
    spark, about = vectors.sparkSession, []
    for size, products in summed_products(distinct, spaces, weighted, with_ones).items():
        space, k = spaces[size], len(spaces[size].values)
        mean = products[:k, k] / space.n
        off = products[:k, :k] / space.n - np.outer(mean, mean) - np.eye(k)
        off = off[np.ix_(space.real, space.real)]
        about.append((size, space.n, space.explained, float(np.abs(off).max()) if off.size else None))
    # One row for each length of vector.
    about = spark.createDataFrame(about, "size bigint, n bigint, shares array<double>, identity_error double")
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    joined = join_back(rows.select("vec_id", "h0", "h1"), answers, ["h0", "h1"], total).join(F.broadcast(about), "size")
    each = joined.select("vec_id", "n", "deviation", "identity_error", "shares", F.posexplode("values").alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.nanvl("value", F.lit(None).cast("double")).alias("whitened"),
        F.get("shares", F.col("at")).alias("explained"), "identity_error",
    )
