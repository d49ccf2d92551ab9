"""Chat formatting with offset-aligned loss masks.

A conversation's turns are rendered as one text, ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn, and
encoded once with offsets. The three marks are added tokens, so no token crosses from a mark into a text;
the sorted spans of the turns are intersected with the sorted token spans by binary search, and the tokens
inside assistant texts get loss. Inside roles and texts ``<|`` becomes ``<\\|`` (and ``<\\|`` becomes ``<\\\\|``,
and so on), so marks in a text stay text and reading back restores every character.

Defined results: a null role or text is empty; turns of one conversation are ordered by turn (null first),
then role, then text, so repeated rows repeat turns; rows without a conversation id are one conversation of
null id; a conversation is one cell of the result and is held whole by one task; extra columns are ignored;
an empty table stays empty.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"

RESULT = "formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<tinyint>"
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
_ESCAPE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_LOADED: dict[int, Tokenizer] = {}


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The whole text and the sorted spans (start, end, role) of the turns' texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{SEP}", escaped(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body), role))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


def loss_text(formatted: str, starts: list[int], ends: list[int], mask: list[int]) -> str:
    """All text under the mask, unescaped turn by turn."""
    out, at = [], 0
    piece: list[str] = []
    for s, e, m in zip(starts, ends, mask, strict=True):
        if m:
            piece.append(formatted[max(s, at) : e])  # bytes of one character share its place
            at = max(at, e)
        elif piece:
            out.append(unescaped("".join(piece)))
            piece = []
    return "".join([*out, unescaped("".join(piece))])


def tokenizer_of(definition: str) -> Tokenizer:
    """A public tokenizer with the marks as added tokens and offsets that keep blanks."""
    key = hash(definition)
    if key not in _LOADED:
        tok = Tokenizer.from_str(definition)
        tok.post_processor = processors.ByteLevel(trim_offsets=False)
        tok.add_special_tokens([START, SEP, END])
        _LOADED[key] = tok
    return _LOADED[key]


def encode(turns: list[list[tuple[str, str]]], tok: Tokenizer) -> list[tuple]:
    """Rows of RESULT."""
    out = []
    for t in turns:  # one at a time: an encoding takes some hundred times the room of its text
        text, spans = rendered(t)
        e = tok.encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
        mask = np.zeros(len(offsets), np.int8)
        for start, end, role in spans:
            if role == LOSS_ROLE and end > start:
                # first token that ends behind the start, first that starts at or behind the end
                a = np.searchsorted(offsets[:, 1], start, side="right")
                b = np.searchsorted(offsets[:, 0], end, side="left")
                mask[a:b] = 1
        out.append((text, np.array(e.ids, np.int32), offsets[:, 0], offsets[:, 1], mask))
    return out


def conversations_of(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its turns in order."""
    each = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.groupBy(F.col(id).alias(id)).agg(F.sort_array(F.collect_list(each)).alias("turns"))


def formatted(turns: Column, definition: str) -> Column:
    """The struct RESULT of array<struct<turn,role,text>>; ``definition`` is a tokenizer's JSON (its size is fixed)."""

    kinds = [("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("token_starts", pa.list_(pa.int32())),
             ("token_ends", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))]

    @F.arrow_udf(returnType=RESULT)
    def encoded(values: pa.Array) -> pa.Array:
        tok = tokenizer_of(definition)
        turns = [[(t["role"], t["text"]) for t in v.as_py()] for v in values]
        columns = list(zip(*encode(turns, tok), strict=True)) if turns else [[] for _ in kinds]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return encoded.asNondeterministic()(turns)


def format_conversations(rows: DataFrame, tokenizer: str, **columns) -> DataFrame:
    """Per conversation: its id, n_turns and the fields of RESULT. ``tokenizer``: path of a public tokenizer's JSON file."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = json.dumps(json.load(f))
    id = columns.get("id", "conv_id")
    table = conversations_of(rows, **columns)
    return table.select(id, F.size("turns").cast("bigint").alias("n_turns"), formatted(F.col("turns"), definition).alias("f")).select(id, "n_turns", "f.*")


def digests(table: DataFrame) -> Column:
    """Struct read back from the output: turns_sha256, loss_chars, loss_sha256, formatted_chars, n_read."""
    import hashlib

    kinds = [("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_read", pa.int64())]

    @F.arrow_udf(returnType="turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_read bigint")
    def read(texts: pa.Array, starts: pa.Array, ends: pa.Array, masks: pa.Array) -> pa.Array:
        out = []
        for t, s, e, m in zip(texts, starts, ends, masks, strict=True):
            text = t.as_py()
            turns = read_back(text)
            loss = loss_text(text, s.as_py(), e.as_py(), m.as_py())
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(turns)))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return read("formatted", "token_starts", "token_ends", "loss_mask")
