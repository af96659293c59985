"""Whitened vectors against plain numpy over all rows."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from logloom.llm.whitening import whiten  # noqa: E402


def plain(rows, weighted=False, most=16):
    """(n, deviation, whitened, explained) of each remaining row, by its place."""
    kept = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, (_, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = [x for x in kept.values()] if weighted else sorted(set(kept.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([s / n for s in sums])
    z = np.array([[c - s // n for c, s in zip(x, sums, strict=True)] for x in fit], float) - [s % n / n for s in sums]
    cov = z.T @ z / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    out = {}
    for i, x in kept.items():
        d = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        out[i] = n, d, ((np.array(x) - mean) @ v) / np.sqrt(e), e / np.trace(cov)
    return out


def made(spark, rows):
    table = spark.createDataFrame([(i, v, "x") for i, (_, v) in enumerate(rows)], "vec_id bigint, embedding array<float>, component string")
    return table.selectExpr("*", "0 AS n", "array(1L) AS x", "1 AS copies")


def corpus(size=20, count=300):
    random.seed(5)
    rows = [(i, [random.gauss(0, 1 + 3 / (j + 1)) for j in range(size)]) for i in range(count)]
    rows += [(count + i, rows[0][1]) for i in range(count // 2)]  # a third of all rows hold one vector
    return rows + [(9000, None), (9001, [None] * size), (9002, [math.nan] * size), (9003, [math.inf] * size)]


@pytest.mark.parametrize("weighted", [False, True])
def test_whitening_is_that_of_the_distinct_vectors(spark, weighted):
    rows = corpus()
    want = plain(rows, weighted)
    got = whiten(made(spark, rows), weighted=weighted).collect()
    assert len(got) == 16 * len(want)
    sign = {}
    for r in got:
        n, deviation, values, shares = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert r["explained"] == pytest.approx(shares[k], rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
        if abs(values[k]) > 1e-6:
            # Either sign, the same for all rows.
            assert sign.setdefault(k, np.sign(values[k]) * np.sign(r["whitened"])) == np.sign(values[k]) * np.sign(r["whitened"])
        assert abs(r["whitened"]) == pytest.approx(abs(values[k]), rel=1e-6, abs=1e-6)


def test_few_vectors_lengths_and_extremes(spark):
    assert whiten(made(spark, [])).collect() == []
    one = whiten(made(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    # Lengths are spaces of their own; an empty vector has no component; along a line one component has variance.
    rows = [(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [5.0]), (4, [7.0]), (5, [])]
    got = {(r["vec_id"], r["component"]): r for r in whiten(made(spark, rows)).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)}
    assert got[0, 1]["n"] == 3 and got[3, 1]["n"] == 2
    assert abs(got[0, 1]["whitened"]) == pytest.approx(math.sqrt(1.5)) and got[0, 2]["whitened"] is None
    assert abs(got[3, 1]["whitened"]) == pytest.approx(1.0) and got[3, 1]["deviation"] == 128**2
    # Huge entries: exact beyond 64 bits.
    far = whiten(made(spark, [(0, [2.0**50]), (1, [-(2.0**50)]), (2, [3e38])])).collect()
    assert {int(r["deviation"]) for r in far if r["vec_id"] < 2} == {(3 * x - s) ** 2 for x in (2**56 + 10**6, 10**6 - 2**56) for s in [2**61 + 3 * 10**6]}


def test_null_ids_and_repeated_rows_each_answer(spark):
    table = spark.createDataFrame([(None, [1.0]), (None, [3.0]), (7, [1.0]), (7, [1.0])], "vec_id bigint, embedding array<double>")
    got = whiten(table).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["7", "7", "None", "None"] and {r["n"] for r in got} == {2}
