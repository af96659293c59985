"""Toxicity, licenses, rollups, fingerprints, lattice scores and near-duplicates against plain versions."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from logloom.llm import fingerprint, lattice, licenses, neardup, rollup, toxicity, words  # noqa: E402
from logloom.session import fresh_folder  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


# --- words ---------------------------------------------------------------------


@pytest.mark.parametrize("segment", [1 << 20, 7])
def test_word_numbers(segment, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(words, "SEGMENT", segment)
    texts = ["Ab abé  AB", None, "", "x", "ab\tx", " ", "abcdefghijklmnopqrstuvwxyz" * 4 + " ab", "ab"]
    raw, offsets = words.utf8(pa.array([*texts, "zz"], pa.string()).slice(0, len(texts)))
    numbers, first, last, bounds = words.word_spans(raw, offsets, words.SPACED)
    flat = [w for t in texts for w in spaced(t)]
    assert [raw[a:b].tobytes().decode().lower() for a, b in zip(first, last, strict=True)] == flat
    assert np.diff(bounds).tolist() == [len(spaced(t)) for t in texts]
    assert len(set(zip(numbers.tolist(), flat, strict=True))) == len(set(flat)) == len(set(numbers.tolist()))
    table = words.word_spans(raw, offsets, words.SPACED, (2,))[0]
    same = {n for n, w in zip(table[:, 1].tolist(), flat, strict=True) if w.startswith("ab") and len(w) > 2}
    assert len(same) == 1 and all(n == 0 for n, w in zip(table[:, 1].tolist(), flat, strict=True) if len(w.encode()) <= 2)


# --- toxicity ------------------------------------------------------------------


def toxic_corpus():
    random.seed(11)
    calm = ["ana", "bele", "coro", "dile", "emu", "fano", "giro", "halo", "izu", "jono"]
    bad = ["wretch", "lowly", "lowlies", "lowland"]
    rows, marks = [], []
    for i in range(700):
        sentences = [" ".join(random.choices(calm, k=6)) for _ in range(random.randint(1, 12))]
        toxic = i % 5 == 0
        if toxic:
            at = random.randrange(len(sentences))
            sentences[at] = f"ana {random.choice(bad)} bele"
        rows.append((i, ". ".join(sentences) + "."))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity_learns_sentences_from_documents(spark, docs):
    rows, marks = toxic_corpus()
    labels = spark.createDataFrame([*marks[:400], (None, 1), (3, None), (10_000, 1)], "doc_id bigint, toxic int").selectExpr("*", "0 AS y", "'t' AS text")
    model = toxicity.train(docs(rows), labels)
    extra = [(5000, None), (5001, ""), (5002, " . ! "), (None, "wretch"), (5003, "ana lowlife bele. " + "coro dile. " * 2000)]
    got = {r["doc_id"]: r for r in toxicity.score(docs(rows + extra), model).collect()}
    held = [(got[i]["score"], y) for i, y in marks[400:]]
    assert all((s >= 0.3) == bool(y) for s, y in held)
    assert all(got[i]["score"] == 0 and got[i]["predicted"] == 0 and got[i]["offending"] == [] for i in (5000, 5001, 5002))
    assert got[None]["predicted"] == 1 and got[5003]["predicted"] == 1
    text = dict(rows)
    for i, y in marks[400:]:
        spans = [text[i][s["start"] : s["end"]] for s in got[i]["offending"]]
        assert len(spans) == y and all(re.search("wretch|lowl", s) and "." not in s for s in spans)
    clean = toxicity.keep_clean(docs(rows), model)
    assert clean.columns == docs([]).columns and clean.filter("doc_id >= 400").count() == sum(1 - y for _, y in marks[400:])


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs([(1, "a b")]), none)
    assert model is None and toxicity.score(docs([(1, "a b"), (1, "a b")]), model).filter("score = 0 AND predicted = 0").count() == 2
    assert toxicity.score(docs([]), None).collect() == []


def test_noisy_or_gradient_reaches_a_minimum():
    # Documents: bin 5 in a sentence; bin 6 in two; both in its only one; 6 alone; a toxic one without any bin.
    model = toxicity.fit([1, 0, 1, 0, 1, *[0] * 99], [0, 1, 1, 2, 2, 3], [0, 0, 1, 0, 0, 0], [5, 6, 6, 5, 6, 6], np.array([5, 6]), rounds=600)
    assert model.weights[0] > 1 > model.weights[1] and model.bias < -1
    # One in a hundred documents without a bin is toxic.
    assert model.leak == pytest.approx(0.01, rel=0.3)


def plain_toxicity(text, model):
    """The noisy-or over sentences, by loops: bins of words and their first 4, 5 and 6 bytes."""
    import pyarrow as pa

    weights = dict(zip(model.bins.tolist(), model.weights.tolist(), strict=True))
    rest, sentences, bad = 1 - model.leak, 0, []
    for m in re.finditer(r"[^.!?\n]+", text or ""):
        found = list(re.finditer(r"[0-9A-Za-z'\x80-\U0010ffff]+", m[0]))
        if not found:
            continue
        sentences += 1
        bins = set()
        for w in found:
            raw, offsets = words.utf8(pa.array([w[0]]))
            numbers = words.word_spans(raw, offsets, toxicity.WORDS, toxicity.BEGINNINGS)[0][0]
            bins |= {int(n) >> (64 - toxicity.BUCKETS) for n in numbers.tolist() if n}
        held = [weights[b] for b in bins if weights.get(b)]
        p = 1 / (1 + math.exp(-(model.bias + sum(held)))) if held else 0
        if p >= toxicity.FLOOR:
            rest *= 1 - p
        if p >= toxicity.THRESHOLD:
            bad.append((m.start() + found[0].start(), m.end()))
    return (1 - rest if sentences else 0.0), sentences, bad


def test_toxicity_scores_are_the_plain_noisy_or(spark, docs):
    rows, marks = toxic_corpus()
    model = toxicity.train(docs(rows), spark.createDataFrame(marks[:400], "doc_id bigint, toxic int"))
    assert len(model.bins) > 3
    odd = ["wretch. wretch! lowly?", "", None, "Wretched\nana lowlands bele", "é wretch'd", "...", "ana", "LOWLY ana " * 50]
    rows = rows[380:480] + list(enumerate(odd, start=5000))
    got = {r["doc_id"]: r for r in toxicity.score(docs(rows), model).collect()}
    for i, text in rows:
        score, sentences, bad = plain_toxicity(text, model)
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["n_sentences"] == sentences
        assert [(s["start"], s["end"]) for s in got[i]["offending"]] == bad


def test_length_is_no_evidence(spark, docs):
    rows, marks = toxic_corpus()
    model = toxicity.train(docs(rows), spark.createDataFrame(marks[:400], "doc_id bigint, toxic int"))
    clean = [t for (_, t), (_, y) in zip(rows, marks, strict=True) if not y]
    texts = ["the of. " * n for n in (1, 10, 1000, 100_000)] + [" ".join(clean), " ".join(clean * 30)]
    at = len(texts)
    texts += ["ana bele. " * 5000 + "wretch! " + "ana bele. " * 5000]
    got = {r["doc_id"]: r for r in toxicity.score(docs(list(enumerate(texts))), model).collect()}
    assert [got[i]["predicted"] for i in range(at)] == [0] * at
    assert got[0]["score"] == got[3]["score"] and got[at]["predicted"] == 1 and len(got[at]["offending"]) == 1
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs(list(enumerate(texts))), model).select("doc_id").collect()) == list(range(at))


# --- licenses ------------------------------------------------------------------


def test_licenses_by_brute_force(spark, docs):
    import regex

    random.seed(2)
    find = regex.compile(r"[\p{L}\p{N}]+")
    runs = lambda t: {tuple(w[k : k + 5]) for w in [find.findall(t.lower())] for k in range(len(w) - 4)}
    notices = list(licenses.NOTICES.values())
    texts = [None, "", "a b", "Released under the MIT License"]
    for _ in range(200):
        body = random.choice(notices).split(" ")
        if random.random() < 0.5:
            body[random.randrange(len(body))] = "other"
        if random.random() < 0.3:
            body = body[: random.randint(1, len(body))]
        texts.append("word " * random.randint(0, 9) + random.choice(["\n", " "]).join(body).upper() + " more" * random.randint(0, 9))
    rows = list(enumerate(texts)) + [(None, notices[0]), (None, notices[0])]
    got = licenses.scan_licenses(docs(rows)).collect()
    own = {k: runs(v) for k, v in licenses.NOTICES.items()}
    for r, (i, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), rows, strict=True):
        want = sorted(k for k, v in own.items() if v and len(v & runs(t or "")) >= 0.8 * len(v) - 1e-9)
        assert (r["doc_id"], r["licenses"], r["n_licenses"]) == (i, ",".join(want), len(want))
    assert licenses.scan_licenses(docs([(1, "x")]), {"short": "one two"}).first()["n_licenses"] == 0
    assert licenses.scan_licenses(docs([])).collect() == []


# --- rollups -------------------------------------------------------------------


def test_rollup_replays_and_revisions(spark):
    store = rollup.TokenRollup(spark, fresh_folder(spark, "rollup"))
    assert store.totals().collect() == []
    random.seed(6)
    rows, want = [], collections.Counter()
    for _ in range(300):
        key = (random.choice(["a", "b", None]), random.choice(["en", None]), random.choice(["v1", "v2"]))
        op, new, old = random.choice(["insert", "insert", "delete", "revise"]), random.choice([None, 1, 7]), random.choice([None, 3])
        rows.append((op, *key, new, old))
        docs, tokens = {"insert": (1, new or 0), "delete": (-1, -(new or 0)), "revise": (0, (new or 0) - (old or 0))}[op]
        want[key, 0] += docs
        want[key, 1] += tokens
    schema = "op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint"
    frame = lambda r: spark.createDataFrame(r, schema).selectExpr("*", "1 AS n_docs")
    assert store.commit("one", frame(rows[:200])) and not store.commit("one", frame(rows[:200]))
    assert store.commit("two", frame(rows[200:])) and store.commit("none", frame([]))
    # A batch that died before its commit counts nothing, and is taken in whole when run again.
    frame(rows[:5]).groupBy("source", "lang", "tokenizer").agg(F.lit(99).cast("bigint").alias("n_docs"), F.lit(99).cast("bigint").alias("n_tokens")).write.parquet(store._folder("dead") + "/deltas")
    again = rollup.TokenRollup(spark, store.path)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in again.totals().collect()}
    keys = {k for k, _ in want}
    assert got == {k: (want[k, 0], want[k, 1]) for k in keys if want[k, 0] or want[k, 1]}
    assert again.commit("dead", frame([("insert", "z", "en", "v1", 4, None)]))
    assert ("z", 1, 4) in {(r["source"], r["n_docs"], r["n_tokens"]) for r in again.totals().collect()}
    with pytest.raises(Exception, match="unknown change"):
        again.commit("bad", frame([("upsert", "z", "en", "v1", 4, None)]))
    assert not again.is_committed("bad")


def test_rollup_folds_its_batches(spark, monkeypatch):
    store = rollup.TokenRollup(spark, fresh_folder(spark, "rollup"))
    schema = "op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint"
    frame = lambda op, n: spark.createDataFrame([(op, "a", None, "v1", n, None)], schema)
    totals = lambda: [(r["n_docs"], r["n_tokens"]) for r in rollup.TokenRollup(spark, store.path).totals().collect()]
    assert store.compact() == 0
    for k in range(3):
        store.commit(f"b{k}", frame("insert", 10**k))
    assert store.compact() == 3 and totals() == [(3, 111)] and os.listdir(f"{store.path}/open") == []
    # What is folded is known by name: run again it changes nothing.
    assert not store.commit("b1", frame("insert", 10)) and store.is_committed("b1") and totals() == [(3, 111)]
    store.commit("b3", frame("delete", 100))
    assert totals() == [(2, 11)]
    # Dead before the new table is committed, and dead right after it, before the old sums went.
    create, drop = store._create, rollup.drop_folder
    monkeypatch.setattr(store, "_create", lambda path, text="": (_ for _ in ()).throw(OSError("dead")) if path.endswith("/committed") else create(path, text))
    with pytest.raises(OSError):
        store.compact()
    assert totals() == [(2, 11)]
    monkeypatch.setattr(store, "_create", create)
    monkeypatch.setattr(rollup, "drop_folder", lambda *_: (_ for _ in ()).throw(OSError("dead")))
    with pytest.raises(OSError):
        store.compact()
    assert totals() == [(2, 11)]
    monkeypatch.setattr(rollup, "drop_folder", drop)
    store.commit("b4", frame("insert", 7))
    assert totals() == [(3, 18)] and store.compact() == 1 and totals() == [(3, 18)] and store.compact() == 0
    assert os.listdir(f"{store.path}/open") == []


def test_token_counts(spark):
    import tiktoken  # noqa: F401

    rows = [("Hello there, World-wide é", "en", "s"), (None, None, None), ("", "en", "s")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS words")
    codec = rollup.ChatCodec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = rollup.token_counts(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert [(r["spaced"], r["words"], r["pieces"]) for r in got] == [(4, 5, len(codec.plain.encode_ordinary(rows[0][0]))), (0, 0, 0), (0, 0, 0)]


def test_whole_license_texts_and_usual_notices(docs):
    words = lambda name: " ".join(v for k, v in licenses.NOTICES.items() if k.startswith(name + "/text-")).split()
    edited = words("mit")
    edited[3] = "edited"
    usual = {
        "mit": "licensed under the MIT License", "lgpl": "Released under the GNU Lesser General Public License", "agpl-3.0": "distributed under the GNU Affero General Public License v3.0",
        "cc0-1.0": "released under CC0 1.0 Universal", "cc-by-sa-4.0": "licensed under CC BY-SA 4.0", "unlicense": "This is free and unencumbered software released into the public domain",
    }
    rows = [(1, " ".join(edited)), (2, "x " + " ".join(words("gpl-2.0")[400:900]) + " y")] + [(10 + i, "a " + t + " b") for i, t in enumerate(usual.values())]
    got = licenses.scan_licenses(docs(rows)).withColumn("ids", licenses.license_names(F.col("licenses"))).collect()
    ids = {r["doc_id"]: r["ids"] for r in got}
    assert "mit" in ids[1] and "gpl-2.0" in ids[2]
    for i, name in enumerate(usual):
        assert name in ids[10 + i]


# --- fingerprints --------------------------------------------------------------


def plain_pairs(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode("utf-8")))
    out = []
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode("utf-8")).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunks", [1, 2, 7, 40])
def test_neighbours_and_edits(spark, docs, chunks, monkeypatch):
    random.seed(chunks)
    whole = fingerprint.neighbours
    monkeypatch.setattr(fingerprint, "neighbours", lambda *a, **k: whole(*a, **k, chunks=chunks))
    text = lambda: "".join(random.choices("ab é🙂\n", k=random.randint(0, 90)))
    rows = [(random.randint(-30, 90), text()) for _ in range(60)] + [(5, "same five words of text"), (5, "same five words of text"), (None, "x y"), (8, None), (9, "")]
    got = fingerprint.compare_edited(docs(rows)).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=str) == plain_pairs(rows)
    for small in ([(1, "a b c d e f")], [(None, "a b"), (None, "c d")], []):
        got = fingerprint.compare_edited(docs(small)).collect()
        assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=str) == plain_pairs(small)


def test_fingerprints_follow_the_text(docs):
    random.seed(4)
    vocab = ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(random.choices(vocab, k=200))) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1].upper()), (102, None), (103, "  ")]
    got = fingerprint.compare_edited(docs(rows)).collect()
    prints = {r["doc_id"]: (r["h0"], r["h1"]) for r in got}
    assert prints[0] == prints[100] == prints[101] and prints[102] == prints[103] == (0, 0)
    own = [r for r in got if r["doc_id"] < 39]
    # Half of the shingles kept: an angle of 60 degrees, two thirds of the bits; other texts: half.
    assert 0.62 < np.mean([r["near_edited"] for r in own]) < 0.71 and 0.46 < np.mean([r["near_next"] for r in own]) < 0.54


def test_votes_by_hand(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "x")], "k int, text string")
    hashes = {r["k"]: r["t"] for r in rows.select("k", fingerprint.terms(F.col("text")).alias("t")).collect()}
    assert len(hashes[1]) == 3 and len(hashes[2]) == 1
    got = {r["k"]: (r["h0"], r["h1"]) for r in fingerprint.simhash(rows, ["k"]).collect()}
    seconds = {r["v"]: r["s"] for r in spark.createDataFrame([(h,) for t in hashes.values() for h in t], "v bigint").select("v", F.xxhash64("v", F.lit(7)).alias("s")).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for k, own in hashes.items():
        for part, values in enumerate((own, [seconds[h] for h in own])):
            bits = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))
            assert got[k][part] == signed(bits)


def test_radius_search_is_exact(spark):
    random.seed(8)
    base = [random.getrandbits(128) for _ in range(12)]
    prints = list(base)
    for b in base:
        for flips in range(1, 7):
            prints.append(b ^ sum(1 << i for i in random.sample(range(128), flips)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints + prints[:5]]
    df = spark.createDataFrame(rows, "h0 bigint, h1 bigint")
    for radius in (0, 2, 3):
        got = {tuple(r) for r in fingerprint.within_radius(df, df, radius).collect()}
        want = {(*rows[i], *rows[j]) for i, j in itertools.product(range(len(prints)), repeat=2) if (prints[i] ^ prints[j]).bit_count() <= radius}
        assert got == want
    with pytest.raises(ValueError):
        fingerprint.within_radius(df, df, 4)


def test_near_copies_are_counted(spark, tmp_path):
    from logloom.llm.queries import QUERIES

    random.seed(80)
    vocab = ["w%d" % i for i in range(5000)]
    rows = []
    for i in range(60):
        body = random.choices(vocab, k=200)
        rows.append((i * 100, " ".join(body)))
        body[random.randrange(10, 190)] = "other"  # a similarity of about 0.95
        rows.append((i * 100 + 1, " ".join(body)))
        for at in (30, 80, 130):  # now about 0.81
            body[at + random.randrange(20)] = "another"
        rows.append((i * 100 + 2, " ".join(body)))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_near"] for r in QUERIES["op8_fingerprints"](spark, str(tmp_path)).collect() if r["doc_id"] % 100 == 0}
    assert len(got) == 60 and min(got.values()) >= 2 and max(got.values()) <= 3
    assert sum(n == 3 for n in got.values()) >= 54


def test_wide_radius_search_gives_only_pairs_within_it(spark):
    random.seed(9)
    base = [random.getrandbits(128) for _ in range(20)] + [0, (1 << 128) - 1]
    prints = [b ^ sum(1 << i for i in random.sample(range(128), flips)) for b in base for flips in (0, 1, 9, 15, 19, 29, 30, 40)]
    rows = [(fingerprint.signed(p >> 64), fingerprint.signed(p & (1 << 64) - 1)) for p in prints]
    df = spark.createDataFrame(rows + rows[:9], "h0 bigint, h1 bigint")
    found = [tuple(r) for r in fingerprint.within_wide_radius(df, df).collect()]
    apart = {(*rows[i], *rows[j]): (prints[i] ^ prints[j]).bit_count() for i, j in itertools.product(range(len(prints)), repeat=2)}
    assert len(found) == len(set(found)) and all(apart[p] <= fingerprint.WIDE for p in found)
    assert {p for p, d in apart.items() if d <= 12} <= set(found)
    close = [p for p, d in apart.items() if d <= 20]
    assert len(set(close) & set(found)) >= 0.97 * len(close)


def test_wide_radius_search_finds_every_pair(spark):
    random.seed(10)
    base = [random.getrandbits(128) for _ in range(30)]
    far = [b ^ sum(1 << i for i in random.sample(range(128), flips)) for b in base for flips in (25, 27, 28, 29, 29, 29, 30)]
    as_rows = lambda found: spark.createDataFrame([(fingerprint.signed(p >> 64), fingerprint.signed(p & (1 << 64) - 1)) for p in found], "h0 bigint, h1 bigint")
    for radius in (fingerprint.WIDE, 9, 0):
        pairs = fingerprint.within_wide_radius(as_rows(base), as_rows(base + far), radius)
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
        found = [tuple(x % (1 << 64) for x in r) for r in pairs.collect()]
        got = {(a << 64 | b, c << 64 | d) for a, b, c, d in found}
        assert len(got) == len(found) and got == {(b, f) for b in base for f in base + far if (b ^ f).bit_count() <= radius}


def test_very_long_words(spark, docs):
    random.seed(8)
    rows = [(1, "".join(random.choices("etaoinshrdlu", k=200_000))), (2, "".join(random.choices("的一是不了人我在有他", k=30_000))), (3, "the " * 1000)]
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in lattice.score_documents(docs(rows), PIECES, train=F.col("doc_id") > 2).collect()}
    assert time.perf_counter() - began < 90
    assert got[1]["n_tokens"] == 2 and -10_000_000 < got[1]["score"] < got[3]["score"] < 0


# --- lattice -------------------------------------------------------------------


def test_forward_is_the_sum_over_segmentations(monkeypatch):
    pieces = lattice.Pieces(PIECES)
    logs = np.log(pieces.start)
    place = {p: i for i, p in enumerate(pieces.names)}
    byte = logs[pieces.byte] - math.log(256)

    def all_ways(text):
        if not text:
            return 1.0
        total = 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in place:
                total += math.exp(logs[place[text[:k]]]) * all_ways(text[k:])
            elif k == 1:
                total += math.exp(byte * len(text[0].encode("utf-8"))) * all_ways(text[1:])
        return total

    own = ["the", "th", "there", "ሴx", "a\U0001f642", "anation", "x"]
    got = lattice.word_logs(pieces, own, logs)
    assert np.allclose(got, [math.log(all_ways("▁" + w)) for w in own])
    # Long words, which go along the word one by one, have the same value.
    monkeypatch.setattr(lattice, "LONG", 1)
    assert np.allclose(lattice.word_logs(pieces, own, logs), got)
    long = ["anation" * 9, "q" * 60, "é漢\U0001f642" * 30]
    uses = lattice.expected(pieces, own + long, logs)
    monkeypatch.setattr(lattice, "LONG", 10_000)
    assert np.allclose(lattice.expected(pieces, own + long, logs), uses)
    # Expected uses of pieces cover every character once.
    uses = lattice.expected(pieces, ["there", "anation"], logs)
    assert abs(sum(u * len(p) for u, p in zip(uses, pieces.names, strict=False)) - len("▁there▁anation")) < 1e-6


def test_scores_against_the_contract(spark, docs):
    random.seed(1)
    vocab = ["alpha", "beta", "Gamma", "delta", "é", "the", "of"]
    rows = [(i, " ".join(random.choices(vocab, k=random.randint(0, 30))) + random.choice(["", "\tzeta%d" % i])) for i in range(120)]
    rows += [(500, None), (501, ""), (500, None), (None, "the of")]
    for head in (3, 1000):
        got = lattice.score_documents(docs(rows), PIECES, head=head).collect()
        train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
        c = collections.Counter(w for i, t in rows if train(i) for w in [*spaced(t), None])
        total, kinds = sum(c.values()), len(c)
        base = lambda t: sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*spaced(t), None])
        want = sorted([(i, not train(i), len(spaced(t)) + 1, sum(c[w] > 0 for w in [*spaced(t), None]), total, round(base(t), 6)) for i, t in rows], key=str)
        assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], key=str) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
        scores = {r["doc_id"]: r["score"] for r in got}
        if head > 3:
            assert all(abs(scores[i] - s) < 1e-9 for i, s in before.items())
        before = scores
    assert lattice.score_documents(docs([]), PIECES).collect() == []
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = lattice.score_documents(docs([(lone, "the")]), PIECES).first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0 and math.isfinite(alone["score"])


def test_model_is_a_distribution(spark, docs):
    """Known words and all short unknown ones together have no more than probability one."""
    rows = [(i, "ab ab b a a a") for i in range(20)]
    probe = [(1000 + k, "".join(w)) for k, w in enumerate(itertools.product("ab", repeat=3))] + [(2000, "ab"), (2001, "a"), (2002, "b")]
    got = {r["doc_id"]: r["score"] for r in lattice.score_documents(docs(rows + probe), PIECES, train=F.col("doc_id") < 1000).collect()}
    empty = lattice.score_documents(docs(rows + [(1000, "")]), PIECES, train=F.col("doc_id") < 1000).filter("doc_id = 1000").first()["score"]
    total = sum(10 ** (got[i] - empty) for i, _ in probe) + 10**empty
    assert 0.9 < total <= 1.0


# --- near-duplicates -----------------------------------------------------------


def plain_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = spaced(t)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[top(i)] = top(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    return sorted([(i, len(sets[k]), low.get(top(k)), i == low.get(top(k))) for k, (i, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_by_brute_force(docs, size, monkeypatch):
    random.seed(size)
    if size == 5:  # groups and leads in many parts
        monkeypatch.setattr(neardup, "BLOCK_NODES", 2)
        monkeypatch.setattr(neardup, "PARTNERS", 2)
    vocab = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(25):
        body = random.choices(vocab, k=random.choice([1, 2, 3, 5, 30, 60, 120]))
        rows.append((i * 50 + 7, " ".join(body)))
        for k in range(random.randint(0, 12)):  # chains: each an edit of the last
            body = list(body)
            body[random.randrange(len(body))] = random.choice(vocab)
            rows.append((i * 50 + 8 + k, random.choice([" ", "\n"]).join(body).upper()))
    rows += [(3, rows[0][1]), (4, rows[5][1]), (4, rows[5][1]), (1, None), (2, ""), (5, " \t "), (None, rows[9][1]), (None, "lone words nobody has")]
    random.shuffle(rows)
    got = neardup.near_duplicates(docs(rows), size=size).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got], key=str) == plain_components(rows, size, 80)


@pytest.mark.parametrize("percent", [35, 50, 95])
def test_bands_follow_from_the_similarity(docs, percent):
    random.seed(percent)
    rows = []
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(60)]
        # The first words stay: each changed word costs itself a single shingle of one word.
        changed = max(0, int(60 * (1 - percent / 100) / (1 + percent / 100)))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 60 - changed] + [f"q{k}w{i}" for i in range(changed)]))]
    got = neardup.near_duplicates(docs(rows), size=1, percent=percent).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got], key=str) == plain_components(rows, 1, percent)
    assert sum(r["kept"] for r in got) == 60


def test_similarities_without_a_promise_are_refused(docs):
    with pytest.raises(ValueError, match="percent=5"):
        neardup.near_duplicates(docs([(1, "a")]), percent=5)


def test_near_duplicates_of_nothing(docs):
    assert neardup.near_duplicates(docs([])).collect() == []
    assert [tuple(r) for r in neardup.near_duplicates(docs([(1, None)])).collect()] == [(1, 0, 1, True)]


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    bound = neardup.Bands(80).bits
    assert bound == 80
    for similarity, kept in ((0.95, True), (0.8, True), (0.1, False)):
        misses = 0
        for _ in range(60):
            n = 600
            shared = int(round(2 * n * similarity / (1 + similarity)))
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, n - shared).astype(np.uint64)])
            x, y = neardup.odd_sketches(neardup.minhashes([a, b])).view(np.uint64)
            misses += (np.bitwise_count(x ^ y).sum() <= bound) != kept
        assert misses == 0


def test_components_of_long_chains(spark):
    edges = [(bytes([0, i]), bytes([0, i + 1])) for i in range(40)] + [(b"\x05\x01", b"\x05\x09"), (b"\x05\x09", b"\x05\x00")]
    random.shuffle(edges)
    got = {r["node"]: bytes(r["label"]) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert {bytes(k): v for k, v in got.items()} == {bytes([0, i]): bytes([0, 0]) for i in range(41)} | {b"\x05" + x: b"\x05\x00" for x in (b"\x00", b"\x01", b"\x09")}


@pytest.mark.parametrize("parts", [1, 3])
def test_blocks_find_all_that_joins(parts):
    rng = np.random.default_rng(parts)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = []
    for _ in range(40):
        own = base.copy()
        own[rng.integers(0, 100, rng.integers(1, 16))] = rng.integers(0, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(own))
    odd = neardup.odd_sketches(neardup.minhashes(sets))
    up = {i: i for i in range(40)}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(parts):
        for j in range(i, parts):
            block = neardup.Block()
            for k in range(40):
                if k % parts in (i, j):
                    block.add(k, sets[k], b"l%d" % (k // 2), k % parts, odd[k])
            for a, b in block.links(80, neardup.Bands(80).bits):
                both = len(np.intersect1d(sets[a], sets[b]))
                assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
                up[top(a)] = top(b)
    for k in range(0, 40, 2):
        up[top(k)] = top(k + 1)
    for a, b in itertools.combinations(range(40), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            assert top(a) == top(b)
