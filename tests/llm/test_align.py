"""Alignment of two tokenizers against the libraries and plain loops."""

import collections
import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from logloom.llm import pretoken  # noqa: E402
from logloom.llm.align import MEASURES, align_documents  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """The measures of each text, by loops over the libraries' tokens."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = pretoken.byte_letters()
    rows, counts = [], collections.Counter()
    for text in texts:
        groups, links = [], []
        if text:
            raw = b" " + text.encode()
            ours = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            theirs = []
            for i in b.encode(text):
                p = b.id_to_piece(i)
                theirs.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
            if all(b"".join(t for _, t in side) == raw for side in (ours, theirs)):
                spans = []
                for side in (ours, theirs):
                    at, out = 0, []
                    for i, t in side:
                        out.append((i, at, at + len(t)))
                        at += len(t)
                    spans.append(out)
                cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
                start = 0
                for cut in cuts:
                    groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in spans))
                    start = cut
                links = [(i, j) for i, s, e in spans[0] for j, x, y in spans[1] if s < y and x < e]
                n = [len(side) for side in spans]
        counts.update(links)
        rows.append((n if links else [0, 0], len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if links else ""))
    most = collections.Counter()
    for (_, j), c in counts.items():
        most[j] = max(most[j], c)
    return [
        (*n, groups, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha) for n, groups, links, sha in rows
    ]


def hard_texts():
    random.seed(3)
    parts = ["a", "the", " cat", "  ", "\n", "\t", "'s", "1", "2345", "é", "▁", "<|endoftext|>", "<s>", "😀", "漢", "\r", "\x85", " ", "...", "\x00", "ﬁ", "̈"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(120)]
    return texts + ["the cat sat on the mat. " * 30, None, "", " ", "\n"] + ["one text of a third of all rows"] * 60


@pytest.mark.parametrize("head", [1_000_000, 40, 0])
def test_alignment_is_that_of_the_libraries(spark, docs, head):
    texts = hard_texts()
    got = align_documents(docs(list(enumerate(texts))), A, B, public_tokenizers.PATTERN, head=head).collect()
    want = plain(texts)
    assert len(got) == len(texts)
    assert any(not w[0] for t, w in zip(texts, want, strict=True) if t), "a text that B changes"
    for r in got:
        assert tuple(r[m] for m in MEASURES) == want[r["doc_id"]], repr(texts[r["doc_id"]])


def test_alignment_of_empty_tables_null_ids_and_repeated_rows(spark, docs):
    assert align_documents(docs([]), A, B, public_tokenizers.PATTERN).collect() == []
    got = align_documents(docs([(None, "a b"), (None, None), (3, "a b"), (3, "a b")]), A, B, public_tokenizers.PATTERN).collect()
    # Three rows of " a", " b": two links each, each pair held by three links.
    assert sorted((str(r["doc_id"]), r["n_links"], r["n_best"], r["count_sum"]) for r in got) == [("3", 2, 2, 6)] * 2 + [("None", 0, 0, 0), ("None", 2, 2, 6)]


def test_very_long_texts(spark, docs):
    texts = [" " * 2_000_000, "\n" * 300_000 + "x", "a" * 300_000, "word " * 100_000 + "\n" * 5000 + "end"]
    got = {r["doc_id"]: r for r in align_documents(docs(list(enumerate(texts))), A, B, public_tokenizers.PATTERN).collect()}
    assert all(got[i]["n_a"] and got[i]["n_b"] and max(got[i]["n_a"], got[i]["n_b"]) <= got[i]["n_links"] <= got[i]["n_a"] + got[i]["n_b"] for i in got)


def test_long_blank_runs_are_encoded_as_in_the_whole_text():
    encoding = pretoken.from_json(A, public_tokenizers.PATTERN)
    random.seed(4)
    # Short enough for the library to take whole, with runs cut out from 5 characters on.
    for _ in range(300):
        text = "".join(random.choice(["x", "don't", " ", "\n", "\t", "é1"]) * random.choice([1, 1, 4, 5, 6, 30]) for _ in range(12))
        pieces = list(pretoken.long_pieces(text.replace("\u0000", "")))
        assert "".join(p for p, _ in pieces) == text
        assert pretoken.encode_text(encoding, text) == encoding.encode_ordinary(text)
    text = "x" + " " * 3000 + "y" + "\n" * 2000 + "z" + " \t" * 1500
    assert pretoken.encode_text(encoding, text) == encoding.encode_ordinary(text)
    assert len(list(pretoken.long_pieces(text))) == 6
