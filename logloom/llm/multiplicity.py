"""Work done once for each distinct value, and its answers joined back to every row that has the value."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logloom.llm.rows import map_rows

# Values that more than one row in so many has are answered from a broadcast: fewer than HOT_SHARE values can be.
HOT_SHARE = 1000


def join_back(rows: DataFrame, answers: DataFrame, key: list[str], total: int, copies="copies") -> DataFrame:
    """Inner join of ``rows`` with the one answer of each key; ``copies`` counts the rows of a key, ``total`` all.

    Rows of a hot key are not exchanged: there are fewer than HOT_SHARE such keys, whatever the size, and
    their answers are broadcast. No key of the exchanged rest has more than one row in HOT_SHARE.
    """
    is_hot = F.col(copies) * HOT_SHARE > total
    hot, rest = F.broadcast(answers.filter(is_hot)), answers.filter(~is_hot)
    few = rows.join(hot, key)
    many = rows.join(F.broadcast(answers.filter(is_hot).select(key)), key, "left_anti").join(rest, key)
    return few.unionByName(many)


def sum_vectors(df: DataFrame, key: list[str], kind="double") -> DataFrame:
    """Sums of the array column ``row`` for each key (integer columns), element by element.

    The rows of a key are streamed to one task, which holds one sum for each of its keys; a key gets
    at most one row from each task that made ``df``.
    """
    dtype = {"double": np.float64, "bigint": np.int64}[kind]

    def make():
        sums: dict[tuple, np.ndarray] = {}

        def work(batch):
            if batch is None:
                out = {k: pa.array([x[i] for x in sums], pa.int64()) for i, k in enumerate(key)}
                return out | {"row": pa.array(list(sums.values()), pa.list_(pa.from_numpy_dtype(dtype)))}
            names = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            lists = batch.column("row")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            for name, a, b in zip(names, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                held = sums.get(name)
                if held is None:
                    sums[name] = flat[a:b].astype(dtype)
                else:
                    held += flat[a:b]
            return {k: pa.array([], pa.int64()) for k in [*key]} | {"row": pa.array([], pa.list_(pa.from_numpy_dtype(dtype)))}

        return work

    return map_rows(df.select(*key, "row").repartition(*key), make, ", ".join(f"{k} bigint" for k in key) + f", row array<{kind}>", last=True)
