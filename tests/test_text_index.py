"""Letters that a pattern requires, and searches that open only the files that have them."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.functions.literals import required_triples
from logloom.operators.filters import grep
from logloom.sources.address import open_source
from logloom.sources.textindex import files_with, search_indexed, write_text_index


def may_match(clauses, text):
    low = text.lower()
    held = {low[i : i + 3] for i in range(len(low) - 2)}
    return all(any(triples <= held for triples in choice) for choice in clauses)


@pytest.mark.parametrize("pattern, triples", [
    ("error", [{"err", "rro", "ror"}]), ("ab+cde", [{"bcd", "cde"}]), ("abc?de", []), ("ab{2}cd", [{"bcd"}]), ("abcx*def", [{"abc", "def"}]),
    ("timeout|refused", [{"tim", "ime", "meo", "eou", "out"}, {"ref", "efu", "fus", "use", "sed"}]), ("abc|de", []), (r"\Qa.b*\Ec", [{"a.b", ".b*", "b*c"}]),
    (r"\x41\x42C", [{"abc"}]), ("É123", [{"123"}]), ("(?i)ABC(?:d|e)", [{"abc"}]), ("(abc)?d", []), (r"ab\bcd", []), ("[abc]def", [{"def"}]),
])
def test_required_triples(pattern, triples):
    clauses = required_triples(pattern)
    assert [set(t) for choice in clauses for t in choice] == triples


def test_no_match_is_without_its_triples():
    """Random patterns over random texts, with Python's engine for those that both spell alike."""
    random.seed(21)
    atoms = ["a", "b", "c", "ab", "abc", "bca", ".", "[ab]", "[^c]", "(?:ab|ca)", "(abc|bca|b)", "(?:cab)+", "(ca)?", r"\x61", r"\.", "(?:a(bc|ca)b)"]
    checked = 0
    for _ in range(12_000):
        parts = [random.choice(atoms) + random.choice(["", "", "", "+", "*", "?", "{2}", "{0,2}", "{1,3}"]) for _ in range(random.randint(1, 5))]
        pattern = "|".join("".join(p) for p in itertools.batched(parts, random.randint(1, 5)))
        text = "".join(random.choices(["abc", "bca", "cab", "ab", "ca", "aab", "A", "B", "c."], k=random.randint(1, 9)))
        try:
            clauses = required_triples(pattern)
        except ValueError:
            continue
        if re.search(pattern, text, re.IGNORECASE):
            checked += bool(clauses)
            assert may_match(clauses, text), (pattern, text)
    assert checked > 100


def test_only_files_that_may_match_are_opened(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    words = ["timeout", "refused", "accepted", "closed", "opened"]
    for k, word in enumerate(words):
        (logs / f"{word}.log").write_text("".join(f"line {i} the peer {word} it\n" for i in range(k, 40)))
    (logs / "odd.log").write_text("the linK is ſlow, İstanbul\n\n12\n")
    (logs / "empty.log").write_text("")
    source = open_source(spark, f"{logs}/*.log", format="plain")
    index = str(tmp_path / "index")
    write_text_index(source, index)
    named = lambda pattern: sorted(f.rsplit("/", 1)[1].removesuffix(".log") for f in files_with(source, index, pattern))
    # A file without a message has no row in the index.
    assert named("peer (timeout|REFUSED)") == ["empty", "refused", "timeout"] and named("a|b") == sorted([*words, "odd", "empty"])
    for pattern in ("peer (timeout|REFUSED)", "slow", "link", "istanbul", "line 3[0-9]", "nothing like it", "a|b", "opened it$"):
        whole = sorted((r["source"], r["line_no"], r["message"]) for r in grep(source.entries(), pattern).collect())
        assert sorted((r["source"], r["line_no"], r["message"]) for r in search_indexed(source, index, pattern).collect()) == whole, pattern
    # A file that came later is not known, so it is opened.
    (logs / "late.log").write_text("a late timeout\n")
    later = open_source(spark, f"{logs}/*.log", format="plain")
    assert search_indexed(later, index, "late timeout").select(F.col("message")).first()["message"] == "a late timeout"
