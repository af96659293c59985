"""Byte-level BPE of whole texts, blank runs of any length included.

The pattern that cuts a text before BPE tries every place of a blank run anew and gives up on very long
ones. Such a run is cut out first: its last character goes with what follows, the rest is one piece.
"""

import json
import re

import numpy as np
import tiktoken

# A run longer than this is cut out. The characters that \s stands for in the pattern's engine.
LONG_RUN = 1000
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
RUNS = re.compile(f"[{BLANK}]{{{LONG_RUN},}}")


def long_pieces(text: str):
    """(piece, whether it is one blank run) in order; the pieces encoded apart give the ids of the whole."""
    at = 0
    for run in RUNS.finditer(text):
        # Before anything but the end, the pattern leaves the run's last character to the next piece.
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


def encode_text(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of ``text``, strings of special tokens in it read as plain text."""
    if len(text) < LONG_RUN or not RUNS.search(text):
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for piece, blank in long_pieces(text):
        ids += encoding._encode_single_piece(piece) if blank else encoding.encode_ordinary(piece)
    return ids


def byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}


def from_json(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a ``tokenizers`` file with a byte-level BPE model, whose merges must stand in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if made != sorted(made) or len(made) != len(ranks) - 256:
        raise ValueError(f"{path}: ids do not follow the order of the merges")
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_bytes(encoding: tiktoken.Encoding) -> list[bytes]:
    """The bytes of each id, empty where there is no token."""
    out = [b""] * encoding.n_vocab
    for token, i in encoding._mergeable_ranks.items():
        out[i] = token
    return out


def sizes(table: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in table], np.int64)
