"""Operator 5: exact BPE token ids by dynamic programming over prefixes.

Every prefix of a word has one last token in its BPE encoding. A vocabulary automaton
with suffix links lists the tokens that end at a place; the one that is compatible with
the last token of what stands before it is the last token there. Following these back
from the end of the word gives the ids, without replaying the merges.
"""

import gc
import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from logloom.llm.rows import BLOCK_BYTES, kept, map_rows, text_frame, texts_of

# Words whose encoding a task remembers; beyond it, those not met again in the last half are forgotten.
WORDS_KEPT = 200_000
# Words that are encoded at once, and the most bytes of such a word.
WORDS_AT_ONCE, LETTERS = 20_000, 64
# Steps of the automaton and pairs of tokens that are remembered; beyond it the memory is begun anew.
STEPS_KEPT = 1_000_000

# Code points that a regular expression's \s stands for in the tokenizer's engine (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones themselves, the rest counted up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class PairRules:
    """The vocabulary as merges: which tokens may follow each other, which tokens are ever made."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]]):
        self.made: dict[str, tuple[str, str, int]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        for r, (a, b) in enumerate(merges):
            self.rank[a, b] = r
            self.made.setdefault(a + b, (a, b, r))
        self.tokens = tokens
        self.real: dict[str, bool] = {}

    def edge(self, token: str, side: int) -> list[tuple[str, int, float]]:
        """The pieces that stand at one edge of ``token`` while it is put together, smallest
        first: (piece, rank at which it came about, rank at which it was merged)."""
        out, dies = [], float("inf")
        while token in self.made:
            parts = self.made[token]
            out.append((token, parts[2], dies))
            token, dies = parts[side], parts[2]
        out.append((token, -1, dies))
        return out[::-1]

    def joined(self, a: str, b: str, below: float = float("inf")) -> bool:
        """Whether some merge of a rank under ``below`` reaches over the border of ``a`` and ``b``."""
        left, right, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            x, _, x_dies = left[i]
            y, _, y_dies = right[j]
            r = self.rank.get((x, y))
            # Of equal pairs in a row the left one is merged first.
            if r is not None and r < below and r < x_dies and r <= y_dies:
                return True
            if x_dies == y_dies == float("inf"):
                return False
            if x_dies <= y_dies:
                i += 1
            else:
                j += 1

    def is_made(self, token: str) -> bool:
        """Whether encoding the token's own text gives the token."""
        known = self.real.get(token)
        if known is None:
            if token not in self.made:
                known = True
            else:
                a, b, r = self.made[token]
                known = self.is_made(a) and self.is_made(b) and not self.joined(a, b, r)
            self.real[token] = known
        return known


class Automaton:
    """Lists the tokens that end at each place of a row of symbols (numbers under 512), by suffix links.

    A step is one look-up in a table that is filled as steps are met, however many symbols may follow.
    """

    def __init__(self, tokens: list[tuple[list[int], tuple]]):
        self.edges: dict[int, int] = {}
        self.ends: list[tuple] = [()]
        self.suffix = [0]
        self.steps: dict[int, int] = {}
        before, symbol_of = [0], [0]
        for symbols, found in tokens:
            state = 0
            for c in symbols:
                key = state << 9 | c
                state = self.edges.get(key)
                if state is None:
                    state = self.edges[key] = len(self.ends)
                    self.ends.append(())
                    self.suffix.append(0)
                    before.append(key >> 9)
                    symbol_of.append(c)
            self.ends[state] = (found,)
        depth = [0] * len(self.ends)
        for state in range(1, len(self.ends)):
            depth[state] = depth[before[state]] + 1
        # A state's suffix link leads to a state nearer to the root, so that one is complete before.
        for state in sorted(range(1, len(self.ends)), key=depth.__getitem__):
            if depth[state] > 1:
                self.suffix[state] = self._follow(self.suffix[before[state]], symbol_of[state])
            self.ends[state] += self.ends[self.suffix[state]]
        # By state: the id and size of its longest token, and the state of the next shorter one (0: none).
        self.ids = np.array([e[0][2] if e else -1 for e in self.ends], np.int64)
        self.sizes = np.array([e[0][1] if e else 0 for e in self.ends], np.int64)
        shorter = np.zeros(len(self.ends), np.int64)
        for state in range(1, len(self.ends)):
            there = state
            while there and self.sizes[there] == self.sizes[state]:
                there = self.suffix[there]
            shorter[state] = there
        self.shorter = shorter

    def _follow(self, state: int, symbol: int) -> int:
        while True:
            there = self.edges.get(state << 9 | symbol)
            if there is not None:
                return there
            if state == 0:
                return 0
            state = self.suffix[state]

    def step(self, state: int, symbol: int) -> int:
        """The next state, kept for ``steps``."""
        if len(self.steps) >= STEPS_KEPT:
            self.steps.clear()
        there = self.steps[state << 9 | symbol] = self._follow(state, symbol)
        return there


class NumberTable:
    """Small numbers by 63-bit keys, asked for by whole arrays; what is missing is worked out once for each key."""

    def __init__(self, bits: int = 12):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while left.size:
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there, asked = self.keys[at[left]], keys[left]
            hit = there == asked
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in it."""
        if self.count + len(keys) > STEPS_KEPT:
            self.__init__()
        if 2 * (self.count + len(keys)) > len(self.keys):
            had = self.keys != -1
            keys, values = np.concatenate([self.keys[had], keys]), np.concatenate([self.values[had], values])
            self.__init__(max(12, (4 * len(keys)).bit_length()))
        self.count += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & (len(self.keys) - 1)

    def asked(self, keys: np.ndarray, work) -> np.ndarray:
        """The values, ``work(key)`` for those that are missing."""
        out = self.get(keys)
        missing = np.flatnonzero(out < 0)
        if missing.size:
            new, place = np.unique(keys[missing], return_inverse=True)
            values = np.array([work(k) for k in new.tolist()], np.int32)
            self.put(new, values)
            out[missing] = values[place]
        return out


class Remembered:
    """At most ``most`` values by key in two halves; what is asked for again outlives the older half."""

    def __init__(self, most: int):
        self.half, self.new, self.old = max(1, most // 2), {}, {}

    def get(self, key):
        known = self.new.get(key)
        if known is None:
            known = self.old.get(key)
            if known is not None:
                self.put(key, known)
        return known

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordEncoder:
    """Encodes texts as the tokenizer of a ``tokenizers`` file with a BPE model with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", WHITE), regex.V0)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # A letter that ends a word is another symbol than the same letter inside one.
        letters = byte_letters()
        self.inner = [letters[b] for b in range(256)]
        self.last = [chr(0x1000 + ord(c)) for c in self.inner]
        vocab = {self._symbols(t): i for t, i in model["vocab"].items()}
        self.rules = PairRules(vocab, [(self._symbols(a), self._symbols(b)) for a, b in map(self._pair, model["merges"])])
        numbers = {c: b for b, c in enumerate(self.inner)} | {c: 256 + b for b, c in enumerate(self.last)}
        self.automaton = Automaton([
            ([numbers[c] for c in token], (token, len(token), i))
            for token, i in vocab.items()
            if token and all(c in numbers for c in token) and self.rules.is_made(token)
        ])
        self.spelled = {i: t for t, i in vocab.items()}
        self.pairs: dict[int, bool] = {}
        self.steps, self.fitting = NumberTable(), NumberTable()
        self.words = Remembered(WORDS_KEPT)
        self.parts = Remembered(WORDS_KEPT)

    @staticmethod
    def _pair(merge):
        return merge if isinstance(merge, list) else merge.split(" ")

    def _symbols(self, token: str) -> str:
        if self.end and token.endswith(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(0x1000 + ord(token[-1]))
        return token

    def ids_of_words(self, words: list[str]) -> list[list[int]]:
        """``ids_of_word`` of each, letter by letter for many words at once; few or long words one by one."""
        raw = [w.encode("utf-8") for w in words]
        short = sorted((k for k, r in enumerate(raw) if len(r) <= LETTERS), key=lambda k: -len(raw[k]))
        if len(short) < 50:
            return [self.ids_of_word(w) for w in words]
        out: list = [None if len(r) <= LETTERS else self.ids_of_word(w) for w, r in zip(words, raw)]
        for at in range(0, len(short), WORDS_AT_ONCE):
            some = short[at : at + WORDS_AT_ONCE]
            for k, ids in zip(some, self._at_once([raw[k] for k in some])):
                out[k] = ids
        return out

    def _at_once(self, raw: list[bytes]) -> list[list[int]]:
        """Words of falling size: those that reach a letter stand before the others."""
        auto, size = self.automaton, np.array([len(r) for r in raw])
        symbols = np.zeros((len(raw), size[0]), np.int64)
        symbols[np.arange(size[0]) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        symbols[np.arange(len(raw)), size - 1] += 256
        # The state of the last token of each prefix; -1 where no token ends.
        last = np.full((size[0] + 1, len(raw)), -1, np.int64)
        state = np.zeros(len(raw), np.int64)
        for end in range(1, size[0] + 1):
            n = int(np.searchsorted(-size, -end, side="right"))
            state = self.steps.asked(state[:n] << 9 | symbols[:n, end - 1], lambda k: auto.step(k >> 9, k & 511)).astype(np.int64)
            row, there = np.arange(n), np.where(auto.ids[state] >= 0, state, 0)
            while row.size:
                row, there = row[there > 0], there[there > 0]
                start = end - auto.sizes[there]
                before = last[start, row]
                fits, asked = start == 0, np.flatnonzero((start > 0) & (before >= 0))
                pairs = auto.ids[before[asked]] << 32 | auto.ids[there[asked]]
                fits[asked] = self.fitting.asked(pairs, lambda k: self._follows(k >> 32, k & 0xFFFFFFFF)) > 0
                last[end, row[fits]] = there[fits]
                row, there = row[~fits], auto.shorter[there[~fits]]
        ids: list[list[int]] = [[] for _ in raw]
        row, at = np.arange(len(raw)), size.copy()
        while row.size:
            there = last[at, row]
            for k, i in zip(row.tolist(), auto.ids[there].tolist()):
                ids[k].append(i)
            at = at - auto.sizes[there]
            row, at = row[at > 0], at[at > 0]
        return [i[::-1] for i in ids]

    def ids_of_word(self, word: str) -> list[int]:
        """Ids of one word that the tokenizer's split has left."""
        symbols = [*word.encode("utf-8")]
        symbols[-1] += 256
        n, state, pairs, ends, steps = len(symbols), 0, self.pairs, self.automaton.ends, self.automaton.steps
        last: list = [None] * (n + 1)
        for end, symbol in enumerate(symbols, 1):
            there = steps.get(state << 9 | symbol)
            state = self.automaton.step(state, symbol) if there is None else there
            for found in ends[state]:
                start = end - found[1]
                if start == 0:
                    last[end] = found
                    break
                before = last[start]
                if before is not None:
                    known = pairs.get(before[2] << 32 | found[2])
                    if self._follows(before[2], found[2]) if known is None else known:
                        last[end] = found
                        break
        ids, at = [], n
        while at:
            _, size, i = last[at]
            ids.append(i)
            at -= size
        return ids[::-1]

    def _follows(self, before: int, found: int) -> bool:
        """Whether the encoding of the two tokens' texts together is these two; kept for ``pairs``."""
        if len(self.pairs) >= STEPS_KEPT:
            self.pairs.clear()
        known = self.pairs[before << 32 | found] = not self.rules.joined(self.spelled[before], self.spelled[found])
        return known

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # The tokenizer has no rule for a sigma at the end of a word, the only letter whose neighbours count.
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        return self.pieces.findall(text)

    def pieces_of_chunk(self, chunk: str) -> list:
        """Words of text without spaces and line breaks, special tokens in it as their ids."""
        if self.specials is None or "<|" not in chunk:
            return self._plain(chunk)
        out: list = []
        for k, part in enumerate(self.specials.split(chunk)):
            out += [self.special[part]] if k % 2 else self._plain(part)
        return out

    def _learn(self, chunks: list[str]) -> dict[str, tuple[str, int, str]]:
        """Decimal ids, their number and the decoded text of chunks that are not known."""
        cut = {c: self.pieces_of_chunk(c) for c in chunks}
        ids = {p: self.parts.get(p) for pieces in cut.values() for p in pieces if type(p) is str}
        new = [p for p, i in ids.items() if i is None]
        for piece, found in zip(new, self.ids_of_words(new)):
            ids[piece] = found
            if len(piece) <= 64:
                self.parts.put(piece, found)
        out = {}
        for chunk, pieces in cut.items():
            all_ids = [i for p in pieces for i in (ids[p] if type(p) is str else (p,))]
            known = out[chunk] = " ".join(map(str, all_ids)), len(all_ids), " ".join([self.names[i] for i in all_ids])
            if len(chunk) <= 64:
                self.words.put(chunk, known)
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """Decimal ids joined by a space, their number, and the decoded text of each text.

        The many small objects have no cycles: the search for such is put off until the texts are done.
        """
        searched = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if searched:
                gc.enable()

    def _encoded(self, texts: list[str]) -> list[tuple[str, int, str]]:
        split = [text.replace("\n", " ").replace("\t", " ").split(" ") for text in texts]
        known = {c: self.words.get(c) for c in set().union(*split) if c}
        known.update(self._learn([c for c, k in known.items() if k is None]))
        known[""] = "", 0, ""
        out = []
        for chunks in split:
            found = [x for x in map(known.__getitem__, chunks) if x[1]]
            out.append((" ".join([x[0] for x in found]), sum([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out

    def encode(self, text: str) -> tuple[str, int, str]:
        return self.encode_all([text])[0]


def blocks(texts: list[str]):
    """The texts in order, in lists of about BLOCK_BYTES characters."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text)
        if held >= BLOCK_BYTES:
            yield some
            some, held = [], 0
    if some:
        yield some


@kept
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_documents(docs: DataFrame, path: str, id_column="doc_id", text_column="text", digests=False, decoded=True) -> DataFrame:
    """Token ids of every text, and the text decoded from them.

    ``path`` names a tokenizer file that exists on every executor. Returns doc_id,
    n_tokens, and either ids (array of int) and, if asked for, decoded, or with ``digests``
    the SHA-256 of both in hex. A null text counts as empty: no ids, empty decoded text. Repeated
    rows each give a row, a null id stays null, other columns are left behind. Words are
    encoded once and remembered, so memory is bounded by one batch and WORDS_KEPT words.
    """
    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>" + ", decoded string" * decoded

    def make():
        encoder = encoder_of(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

        def work(batch):
            out = {"doc_id": batch.column("doc_id"), "n_tokens": []}
            a, b = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
            out[a], out[b] = [], []
            for texts in blocks(texts_of(batch)):
                for ids, n, back in encoder.encode_all(texts):
                    out["n_tokens"].append(n)
                    out[a].append(sha(ids) if digests else np.array(ids.split(), np.int32))
                    out[b].append(sha(back) if digests else back if decoded else None)
            return out

        return work

    frame = text_frame(docs, id_column, text_column)
    id_type = frame.schema["doc_id"].dataType.simpleString()
    return map_rows(frame, make, f"doc_id {id_type}, n_tokens bigint, {kind}")
