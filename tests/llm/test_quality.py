"""Word vectors and pooled features against plain loops, held-out accuracy, and odd tables."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from logloom.llm import quality  # noqa: E402


def plain_words(text):
    """Words and marks in order, with the case of the first and last letter told apart."""
    found = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", text or "")
    fold = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    return [(fold(w), "A" <= w[0] <= "Z", "A" <= w[-1] <= "Z") for w in found]


def arrow(texts):
    import pyarrow as pa

    return quality.utf8(pa.array(texts, pa.string()))


TEXTS = ["The cat, the CAT!! sat.", "", "a", " ", "été -- Été 12", "a b a b a b a b", "x" * 300 + " y", "?!", "THe the"]


def test_words_and_marks():
    bins, bounds = quality.tokens_of(*arrow(TEXTS))
    words = [plain_words(t) for t in TEXTS]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(bins.tolist(), flat, strict=True))) == len(set(flat)) == len(set(bins.tolist()))


def test_contexts_are_sums_over_neighbours():
    raw, offsets = arrow(TEXTS)
    bins, bounds = quality.tokens_of(raw, offsets)
    sums = np.zeros((1 << quality.BINS_LOG) * (quality.DIM + 1))
    quality.add_contexts(sums, quality.index_places(), bins, bounds)
    index, want = quality.index_vectors(), np.zeros((1 << quality.BINS_LOG, quality.DIM + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(a, b):
            for j in range(max(a, i - quality.WINDOW), min(b, i + quality.WINDOW + 1)):
                if j != i:
                    want[bins[i], :-1] += index[bins[j]]
                    want[bins[i], -1] += 1
    assert (sums.reshape(want.shape) == want).all() and want[:, -1].sum() > 0


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_features_are_plain_means(block, monkeypatch):
    """Also where a long text is gathered in parts of two words."""
    monkeypatch.setattr(quality, "BLOCK", block)
    rng = np.random.default_rng(1)
    vectors = quality.Vectors(np.abs(rng.normal(size=(1 << quality.BINS_LOG, quality.DIM + 1))))
    raw, offsets = arrow(TEXTS)
    bins, bounds = quality.tokens_of(raw, offsets)
    got = vectors.features(raw, offsets)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        v = vectors.table[bins[a:b]].astype(float)
        want = np.zeros(quality.FEATURES)
        if len(v):
            want[: quality.DIM], want[quality.DIM : 2 * quality.DIM] = v.mean(0), v.std(0)
            for gap in range(1, quality.LAGS + 1):
                pairs = [x @ y / np.linalg.norm(x) / np.linalg.norm(y) for x, y in zip(v[:-gap], v[gap:], strict=True)]
                want[2 * quality.DIM + gap - 1] = np.mean(pairs) if pairs else 0
            want[-1] = np.log1p(len(v))
        assert got[k] == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("part", [1, 2, 5])
def test_texts_gathered_in_parts_have_the_features_of_whole_ones(part, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("w%d" % i for i in rng.integers(0, 9, n)) for n in (1, 2, 3, 4, 5, 11, 40)] + ["", "one", "same same same same same"]
    vectors = quality.Vectors(rng.normal(size=(1 << quality.BINS_LOG, quality.DIM + 1)))
    whole = vectors.features(*arrow(texts))
    monkeypatch.setattr(quality, "PART", part)
    assert vectors.features(*arrow(texts)) == pytest.approx(whole, abs=1e-5)


def test_work_grows_with_the_words_not_with_the_table():
    """Adding the contexts of few words makes no array of the table's size, pooling none of a vector for each word."""
    import tracemalloc

    words = 1 << 16
    raw, offsets = arrow([" ".join(["some", "few", "words", "again"] * (words // 4))])
    places, vectors = quality.index_places(), quality.Vectors(np.ones((1 << quality.BINS_LOG, quality.DIM + 1)))
    few = quality.tokens_of(*arrow(["some few words"]))
    sums = np.zeros((1 << quality.BINS_LOG) * (quality.DIM + 1))
    for work, most in ((lambda: quality.add_contexts(sums, places, *few), 1 << 20), (lambda: vectors.features(raw, offsets), words * quality.DIM * 4)):
        work()
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def corpus(count=900):
    random.seed(2)
    words = ["".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(300)]
    rows, marks = [], []
    for i in range(count):
        text = " ".join(random.choices(words, k=random.randint(5, 120)))
        bad = i % 4 == 0
        if bad:
            kind = random.randrange(3)
            text = [text.upper() + "!!", " ".join(w + "$$$" for w in text.split()), " ".join(w for w in text.split() for _ in range(6))][kind]
        rows.append((i, text))
        marks.append((i, int(not bad)))
    return rows, marks


def test_held_out_documents_are_told_apart(spark, docs):
    rows, marks = corpus()
    labels = spark.createDataFrame([*marks[:600], (None, 1), (3, None), (10_000, 1)], "doc_id bigint, quality int").selectExpr("*", "0 AS y", "'t' AS text", "9 AS part")
    model = quality.train(docs(rows), labels)
    extra = [(5000, None), (5001, ""), (None, "abc abc"), (5003, "xyz " * 100_000), (7, "cab")]
    out = quality.score(docs(rows + extra), model).collect()
    assert len(out) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    got = {r["doc_id"]: r for r in out[: len(rows)]}
    right = sum(got[i]["predicted"] == y for i, y in marks[600:])
    assert right >= 0.95 * len(marks[600:])
    # Calibrated: on documents not learned from the mean probability is near the share of label 1.
    held = [(got[i]["score"], y) for i, y in marks[600:]]
    assert abs(np.mean([p for p, _ in held]) - np.mean([y for _, y in held])) < 0.05
    by_id = {r["doc_id"]: r["score"] for r in out if r["doc_id"] in (5000, 5001)}
    assert by_id[5000] == by_id[5001]


def test_temperature_lowers_the_loss_on_documents_not_fitted_on():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    network = quality.Network(x[:60], y[:60], rounds=1500, shrink=0)
    loss = lambda: -np.log(np.where(y[60:] > 0, network.probability(x[60:]), 1 - network.probability(x[60:]))).mean()
    sure = loss()
    network.calibrate(x[60:], y[60:])
    assert network.temperature > 1.2 and loss() < sure


def test_tables_without_labels_of_both_kinds(spark, docs):
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    ones = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    for labels, want in ((empty, 0.5), (ones, 1.0)):
        model = quality.train(docs([(1, "a b"), (2, None)]), labels)
        assert [r["score"] for r in quality.score(docs([(1, "a b"), (2, None)]), model).collect()] == [want, want]
    assert quality.score(docs([]), quality.train(docs([]), ones)).collect() == []
