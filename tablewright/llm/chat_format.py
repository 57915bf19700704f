"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets. The spans of the turns and those of
the tokens are both sorted, so binary search finds the tokens of each assistant text. The template's
markers are special tokens of the tokenizer: no token straddles one, and the tokens of a text cover it
exactly. In roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so that no text holds a
marker (or the tokenizer's own special string), and unescaping gives the text back.

A conversation of more than ``SEGMENT`` code points is rendered and encoded in segments of whole turns,
which are numbered; as markers always end tokens, the segments' ids put together are those of the whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored, table

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
MASKED_ROLE = "assistant"
SEGMENT = 1_000_000
_TURN = re.compile(re.escape(ROLE) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
FORMATTED = "conv_id long, segment long, formatted string, ids array<int>, loss_tokens array<struct<first:int,end:int>>, loss_spans array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns, and the spans of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = ROLE + escape(role) + TEXT, escape(text)
        parts += [head, body, END]
        at += len(head)
        if role == MASKED_ROLE and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
    return "".join(parts), spans


def loss_runs(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span, the run [first, end) of tokens that meet it. Both lists are sorted."""
    at = np.array(offsets, np.int64).reshape(-1, 2)
    s = np.array(spans, np.int64).reshape(-1, 2)
    return list(zip(np.searchsorted(at[:, 1], s[:, 0], "right").tolist(), np.searchsorted(at[:, 0], s[:, 1], "left").tolist(), strict=True))


class Formatter:
    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.add_special_tokens([ROLE, TEXT, END])

    def segment(self, conv_id: int | None, number: int, turns: list[tuple[str, str]]) -> dict:
        formatted, spans = render(turns)
        found = self.tokenizer.encode(formatted, add_special_tokens=False)
        offsets = found.offsets
        runs = loss_runs(offsets, spans)
        under = [(offsets[i][0], offsets[j - 1][1]) for i, j in runs]
        return {"conv_id": conv_id, "segment": number, "formatted": formatted, "ids": found.ids, "loss_tokens": [{"first": i, "end": j} for i, j in runs], "loss_spans": [{"start": i, "end": j} for i, j in under]}


def format_chats(conversations: DataFrame, tokenizer_path: str, segment: int = SEGMENT) -> DataFrame:
    """A row for each segment of a conversation: conv_id, segment, formatted, ids, loss_tokens, loss_spans.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Turns go in order of
    ``turn``, nulls first, ties by role and text; repeated rows are turns of their own. A null role or
    text is an empty one; rows without conv_id make one conversation. ``loss_tokens`` are runs of
    tokens under the loss, ``loss_spans`` the same in code points of ``formatted``. An empty table gives an
    empty result. Rows stream through a task in order of (conv_id, turn), a segment at a time, so that very long
    conversations are never in memory whole; a very long text is a segment of its own.
    """
    bound_batches(conversations.sparkSession)
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").select("conv_id", "role", "text")

    def run(batches):
        formatter, now, number, held, size = Formatter(tokenizer_path), object(), 0, [], 0
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (conv_id != now or size >= segment):
                    rows.append(formatter.segment(now, number, held))
                    number, held, size = (number + 1 if conv_id == now else 0), [], 0
                now = conv_id
                held.append((role, text))
                size += len(text)
            if rows:
                yield _rows(rows)
        if held:
            yield _rows([formatter.segment(now, number, held)])

    return ordered.mapInArrow(run, FORMATTED)


_SPAN = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_tokens", _SPAN("first", "end")), ("loss_spans", _SPAN("start", "end"))])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def digests(formatted: DataFrame) -> DataFrame:
    """Of the output of :func:`format_chats`, a row for each conversation: what it says and what is learnt."""
    bound_batches(formatted.sparkSession)
    ordered = formatted.select("conv_id", "segment", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment").select("conv_id", "formatted", "loss_spans")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        state = None
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv_id:
                    rows += [state] if state else []
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in _TURN.findall(text):
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for span in spans:
                    learnt = unescape(text[span["start"] : span["end"]])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            if rows:
                yield _digest_rows(rows, names)
        if state:
            yield _digest_rows([state], names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_rows(rows: list[list], names: list[str]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    hexes = lambda column: pa.array([h.hexdigest() for h in column])
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), hexes(c[2]), pa.array(c[3], pa.int64()), hexes(c[4]), pa.array(c[5], pa.int64())], names)


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and a planted one, from the stored output."""
    from .registry import BYTE_BPE

    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, MASKED_ROLE, control)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return digests(stored(format_chats(chats, BYTE_BPE), "chats"))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
