"""Operator 4: conversations to training tokens, put together token by token.

Control strings are ids beyond the vocabulary, spliced between separately encoded
segments, so no text can become one. The same holds in the written form: a control
string inside a text, and every backslash, has a backslash in front.
"""

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F

from logloom.llm.pretoken import encode_text
from logloom.llm.rows import arrow_schema, map_rows

# Roles with a mark of their own; any other role is written between ROLE and ROLE_END.
MARKS = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
ROLE, ROLE_END, END = "### Role:", "</role>", "</turn>"
CONTROLS = [*MARKS.values(), ROLE, ROLE_END, END]
LEARNED = "assistant"

_NEEDS = re.compile("|".join(map(re.escape, ["\\", *CONTROLS])))
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _NEEDS.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


class ChatCodec:
    """A rank vocabulary with the control strings as the ids after its last one."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = max(ranks.values()) + 1
        self.plain = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.control = {c: first + i for i, c in enumerate(CONTROLS)}
        self.names = {i: c for c, i in self.control.items()}
        self.first = first

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn."""
        body = encode_text(self.plain, escape(text))
        if role in MARKS:
            segments = [[self.control[MARKS[role]]], body, [self.control[END]]]
            learned = 1
        else:
            name = encode_text(self.plain, escape(role))
            segments = [[self.control[ROLE]], name, [self.control[ROLE_END]], body, [self.control[END]]]
            learned = 3
        bounds = np.cumsum([0, *map(len, segments)])
        # +1 where a learned segment begins, -1 where it ends; their running sum is the mask.
        change = np.zeros(bounds[-1] + 1, np.int8)
        if role == LEARNED:
            np.add.at(change, [bounds[learned], bounds[learned + 1]], [1, -1])
        return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(change[:-1], dtype=np.int8)

    def segments(self, ids) -> Iterator[tuple[str | None, str]]:
        """(control string, "") and (None, text) parts of a token sequence."""
        ids = np.asarray(ids)
        cuts = np.flatnonzero(ids >= self.first)
        at = 0
        for c in [*cuts, len(ids)]:
            if c > at:
                yield None, self.plain.decode(ids[at:c].tolist())
            if c < len(ids):
                yield self.names[int(ids[c])], ""
            at = c + 1

    def read(self, ids) -> tuple[str, str, str]:
        """Role, text and written form of one turn's tokens."""
        parts, written = [""], []
        role = ""
        for control, text in self.segments(ids):
            written.append(control or text)
            if control == ROLE_END:
                role, parts = unescape("".join(parts)), [""]
            elif control in MARKS.values():
                role = next(r for r, c in MARKS.items() if c == control)
            elif control is None:
                parts.append(text)
        return role, unescape("".join(parts)), "".join(written)


@lru_cache(maxsize=1)
def codec_of(path: str, pattern: str) -> ChatCodec:
    return ChatCodec(path, pattern)


def format_conversations(turns: DataFrame, path: str, pattern: str, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row a turn, in the order of the conversation: conv_id, turn, seq, first_token, ids, loss_mask.

    ``seq`` counts turns and ``first_token`` tokens from the conversation's start, so the
    sequence of a conversation is its rows' ids one after the other (``assemble`` gives
    it as one row). Every turn is encoded where it is read; the exchange on conv_id
    carries tokens, and a sorted stream gives the positions, one turn in memory at a
    time, however long a conversation is. Null role or text counts as empty; null turns
    come first; equal turns are ordered by role, then tokens; rows without conv_id are
    one conversation. An empty table gives no rows; other columns are left behind.
    """
    frame = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}

    def encode():
        codec = codec_of(path, pattern)

        def work(batch):
            rows = [codec.turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            return {n: batch.column(n) for n in ("conv_id", "turn", "role")} | {"ids": [r[0] for r in rows], "loss_mask": [r[1] for r in rows]}

        return work

    tokens = map_rows(frame, encode, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, ids array<int>, loss_mask array<tinyint>")

    def place():
        state = {"at": None, "seq": 0, "token": 0, "begun": False}

        def work(batch):
            seqs, firsts = [], []
            sizes = batch.column("ids")
            for key, size in zip(batch.column("conv_id").to_pylist(), pc.list_value_length(sizes).to_pylist(), strict=True):
                if not state["begun"] or key != state["at"]:
                    state.update(at=key, seq=0, token=0, begun=True)
                seqs.append(state["seq"])
                firsts.append(state["token"])
                state["seq"] += 1
                state["token"] += size
            return {n: batch.column(n) for n in ("conv_id", "turn", "ids", "loss_mask")} | {"seq": seqs, "first_token": firsts}

        return work

    ordered = tokens.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return map_rows(ordered, place, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, seq bigint, first_token bigint, ids array<int>, loss_mask array<tinyint>")


def assemble(formatted: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, ids, loss_mask. For conversations that fit in a row."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "ids", "loss_mask")))
    return formatted.groupBy("conv_id").agg(rows.alias("r")).select(
        "conv_id", F.flatten("r.ids").alias("ids"), F.flatten("r.loss_mask").alias("loss_mask")
    )


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """What the tokens of ``format_conversations`` say: a digest row for each conversation.

    Goes through the rows as they stand (they are sorted within their partitions), with
    running digests only in memory. Columns: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_tokens.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    spark_schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    arrow = arrow_schema(spark_schema)

    def run(batches):
        codec, now, done = codec_of(path, pattern), None, []

        def close():
            done.append([now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]])

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], arrow.field(i).type) for i in range(len(names))], schema=arrow)
            done.clear()
            return out

        for batch in batches:
            ids = batch.column("ids")
            mask = batch.column("loss_mask")
            for i, (key, seq) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("seq").to_pylist(), strict=True)):
                if seq == 0:
                    if now is not None:
                        close()
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                tokens = ids[i].values.to_numpy(zero_copy_only=False)
                role, text, written = codec.read(tokens)
                learned = tokens[mask[i].values.to_numpy(zero_copy_only=False) > 0]
                loss = unescape(codec.plain.decode(learned.tolist()))
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8"))
                now[3] += len(loss)
                now[4].update(loss.encode("utf-8"))
                now[5] += len(written)
                now[6] += len(tokens)
            if done:
                yield rows()
        if now is not None:
            close()
            yield rows()

    return formatted.mapInArrow(run, spark_schema)
