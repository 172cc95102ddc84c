"""Chat formatting in budgeted windows.

A turn is written as `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside texts and roles get a backslash
after their first character (one more where some stand there already), which parsing takes away again. A conversation
is cut into windows of whole turns: prefix sums of the turns' tokens give the furthest turn within the budget; each
window repeats the system turn and as many of the last turns as the history limit allows. The loss mask covers the
assistant texts of a window's new turns, so repeated targets are masked and every target is learnt once.

Defined cases: null texts and roles are empty; turns go by turn number (nulls first), ties by role and text; a turn
above the budget stands in a window of its own; rows without conv_id are one conversation; repeated rows are turns of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, rows_of
from .tokens import rank_file

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other common templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
_CONTROL = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("loss_spans", pa.list_(pa.list_(pa.int64())))])
WINDOW_DDL = "conv_id long, window long, text string, n_repeated int, n_turns int, n_tokens long, loss_spans array<array<long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def write_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    return [(read_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


Turn = tuple[str, int, str, int]  # as written, where its text begins, role, tokens


def latest(turns: list[Turn], limit: int) -> list[Turn]:
    """The longest run of last turns of at most `limit` tokens, by sums from the end."""
    sums = list(accumulate(t[3] for t in reversed(turns)))
    return turns[len(turns) - bisect_right(sums, limit) :]


def window(lead: list[Turn], new: list[Turn]) -> tuple[str, int, int, int, list[list[int]]]:
    """(text, repeated turns, turns, tokens, loss spans in code points)."""
    at, spans = sum(len(t[0]) for t in lead), []
    for whole, start, role, _ in new:
        if role == "assistant":
            spans.append([at + start, at + len(whole) - len(END)])
        at += len(whole)
    return "".join(t[0] for t in lead + new), len(lead), len(lead) + len(new), sum(t[3] for t in lead + new), spans


def windows(turns: Iterable[tuple[str, str]], count, budget: int, history: int) -> Iterator[tuple[str, int, int, int, list[list[int]]]]:
    """The windows of a conversation; no more turns are held than a window and its history have."""
    system: list[Turn] = []
    lead: list[Turn] = []
    new: list[Turn] = []
    recent: list[Turn] = []
    prefix = 0  # tokens of the open window
    for i, (role, text) in enumerate(turns):
        whole = f"{START}{write_role(role)}\n"
        start = len(whole)
        whole += escape(text) + END
        turn = whole, start, role, count(whole)
        if new and prefix + turn[3] > budget:
            yield window(lead, new)
            recent = latest([t for t in recent + new if t not in system], history)
            fixed = sum(t[3] for t in system)
            lead = system + latest(recent, min(history, budget - fixed - turn[3]))
            new, prefix = [], sum(t[3] for t in lead)
        if i == 0 and role == "system":
            system = [turn]
        new.append(turn)
        prefix += turn[3]
    if new:
        yield window(lead, new)


def format_conversations(rows: DataFrame, ranks: str, pattern: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """rows (conv_id, turn, role, text) → windows (conv_id, window, text, n_repeated, n_turns, n_tokens, loss_spans).

    loss_spans are half-open ranges of code points of the formatted text. Rows of a conversation stream through a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = rank_file(ranks, pattern).count

        def made() -> Iterator[tuple]:
            for conv_id, part in groupby(rows_of(batches), key=lambda r: r[0]):
                for n, w in enumerate(windows(((role or "", text or "") for _, role, text in part), count, budget, history)):
                    yield conv_id, n, *w

        yield from batches_of(made(), WINDOW, 500)

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, WINDOW_DDL)


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows say of each conversation: turns without repeats, text under the loss mask, both unescaped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for conv_id, part in groupby(rows_of(batches), key=lambda r: r[0]):
                n_turns = loss_chars = chars = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
                for _, text, n_repeated, spans in part:
                    chars += len(text)
                    for role, said in parse(text)[n_repeated:]:
                        turns.update(f"{role}\n{said}\n".encode())
                        n_turns += 1
                    for a, b in spans:
                        target = unescape(text[a:b])
                        loss.update(target.encode())
                        loss_chars += len(target)
                yield conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from batches_of(read(), READ)

    ordered = formatted.select("conv_id", "window", "text", "n_repeated", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.drop("window").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
