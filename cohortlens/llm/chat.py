"""Chat formatting in budgeted windows: turn-aligned spans, the system turn and some history repeated, targets masked once."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts, tokens

BUDGET = 1_024  # tokens of a window
HISTORY = 256  # tokens of earlier turns repeated at the start of a window
OVERHEAD = 8  # tokens counted for the marks around a turn

READ = 1_000  # turns a task turns into Python values at once
WRITE_CHARS = 2_000_000  # characters of windows a task gathers before it hands them on

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"

# Inside roles and texts a backslash is doubled and the bar of a control string is parted from its bracket by one, so no mark can
# appear there; a line feed in a role is written as \n.
_ESCAPE = re.compile(r"\\|<\|")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _escaped_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def render(role: str, text: str) -> str:
    return f"{START}{_escaped_role(role)}\n{escape(text)}{END}\n"


@dataclass
class FormattedWindow:
    """A formatted window: ``repeated`` leading turns were shown before; ``spans`` are the code points under the loss."""

    text: str
    first_turn: int
    repeated: int
    n_turns: int
    spans: list[tuple[int, int]]


def stream(turns: Iterable[tuple[str, str, int]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[FormattedWindow]:
    """Windows over the turns (role, text, tokens) of one conversation, one after the other.

    Running sums of the turns' tokens place every window's end at the last turn that still fits the budget, so windows hold
    whole turns; a turn over the budget has a window of its own that exceeds it.  A leading system turn heads every later
    window, followed by the latest earlier turns that fit ``history`` tokens and leave room for at least one new turn.
    Each assistant text is under the loss mask in the one window where it is new.

    Only the system turn, the turns that may be history and those up to the end of the budget are held, however long the
    conversation is.
    """
    turns = iter(turns)
    held: list[tuple[str, str]] = []  # turns from number ``base`` on
    sums = [0]  # tokens before each held turn, and after the last
    base = new = 0
    first: tuple[str, str, int] | None = None
    more = True
    while True:
        while more and (base + len(held) <= new or sums[-1] - sums[new - base] <= budget):
            turn = next(turns, None)
            if turn is None:
                more = False
                break
            role, body, size = turn
            if base + len(held) == 0:
                first = turn
            held.append((role, body))
            sums.append(sums[-1] + size)
        n = base + len(held)
        if new >= n:
            return
        fixed = 1 if new > 0 and first[0] == "system" else 0
        room = budget - (first[2] if fixed else 0)
        at = new - base
        spare = min(history, room - (sums[at + 1] - sums[at]))
        back = base + bisect.bisect_left(sums, sums[at] - spare) if spare > 0 else new
        back = min(max(back, fixed), new) if new > 0 else new
        end = base + bisect.bisect_right(sums, sums[back - base] + room) - 1
        end = min(max(end, new + 1), n)
        shown = [(0, *first[:2])] * fixed + [(i, *held[i - base]) for i in range(back, end)]
        parts, spans, place = [], [], 0
        for turn, role, body in shown:
            part = render(role, body)
            if turn >= new and role == "assistant":
                start = place + len(START) + len(_escaped_role(role)) + 1
                spans.append((start, place + len(part) - len(END) - 1))
            parts.append(part)
            place += len(part)
        yield FormattedWindow("".join(parts), new, len(shown) - (end - new), len(shown), spans)
        new = end
        # turns before this one are over the history of every later window
        drop = min(bisect.bisect_left(sums, sums[new - base] - max(history, 0)), new - base)
        held, sums, base = held[drop:], sums[drop:], base + drop


def windows(roles: list[str], bodies: list[str], sizes: list[int], budget: int = BUDGET, history: int = HISTORY) -> list[FormattedWindow]:
    """All windows of one conversation, see ``stream``."""
    return list(stream(zip(roles, bodies, sizes), budget, history))


def read_back(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(window)]


def format_conversations(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY,
    json_path: str = tokens.JSON_PATH, ranks_path: str = tokens.RANKS_PATH,
) -> DataFrame:
    """conv_id, window, text, first_turn, repeated, n_turns, span_starts, span_ends of every conversation's windows.

    Turns are ordered by turn (nulls first), ties by role and text.  Null role and null text count as empty.  Repeated rows are turns of
    their own.  Rows without conv_id are one conversation without id.  Other columns are ignored; an empty table gives an
    empty result.  Turns are tokenised where they lie, then dealt by conversation and sorted; a task holds the turns of a
    window and its history at a time, so a conversation of any length passes, one task after the other through its turns.
    """

    def sized(batch: pa.RecordBatch) -> Iterator[dict]:
        bodies = pa.array([escape(b or "") for b in batch.column(3).to_pylist()], pa.string())
        encoded = tokens.encoder(json_path, ranks_path).encode(bodies)
        columns = {name: batch.column(i) for i, name in enumerate(("conv_id", "turn", "role", "text"))}
        yield columns | {"size": [len(ids) + OVERHEAD for ids in encoded]}

    names = ("conv_id", "window", "text", "first_turn", "repeated", "n_turns", "span_starts", "span_ends")
    schema = "conv_id long, window int, text string, first_turn int, repeated int, n_turns int, span_starts array<int>, span_ends array<int>"
    spark_schema, arrow = texts.schemas(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, READ):
                part = batch.slice(at, READ)
                yield from zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {name: [] for name in names}
        size = 0
        for conv, turns in itertools.groupby(rows(batches), key=lambda r: r[0]):
            for i, w in enumerate(stream(((role or "", body or "", n) for _, role, body, n in turns), budget, history)):
                values = (conv, i, w.text, w.first_turn, w.repeated, w.n_turns, [s for s, _ in w.spans], [e for _, e in w.spans])
                for name, value in zip(names, values):
                    out[name].append(value)
                size += len(w.text)
                if size > WRITE_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                    out, size = {name: [] for name in names}, 0
        if out["conv_id"]:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    turns = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    kind = turns.schema["turn"].dataType.simpleString()
    counted = texts.map_batches(turns, sized, f"conv_id long, turn {kind}, role string, text string, size long")
    dealt = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, spark_schema)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, what is under the loss mask, and their size.

    Windows carry their place, so a conversation is put together again from its new turns, window by window.
    """

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    spark_schema, arrow = texts.schemas(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        done: list[tuple] = []

        def close():
            turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
            done.append((current, state["n"], turns, state["loss_chars"], loss, state["chars"]))

        for batch in batches:
            for conv, text, repeated, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if state is None or conv != current:
                    if state is not None:
                        close()
                    current = conv
                    state = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0}
                for role, body in read_back(text)[repeated:]:
                    state["turns"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    state["n"] += 1
                for start, end in zip(starts, ends):
                    target = unescape(text[start:end])
                    state["loss"].update(target.encode("utf-8", "surrogatepass"))
                    state["loss_chars"] += len(target)
                state["chars"] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    rows = formatted.select("conv_id", "text", "repeated", "span_starts", "span_ends", "window")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, spark_schema)
