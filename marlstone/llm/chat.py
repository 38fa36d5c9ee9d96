"""Chat formatting in budgeted windows.

A conversation's turns are written as `<|im_start|>role`, a line feed, the text and `<|im_end|>`, and a line feed.
Inside roles and texts, a control string is escaped by one more backslash between `<` and `|`, and a role's own line
feeds as backslash-n; both are undone exactly.

A conversation that exceeds the token budget is cut into windows at turns: prefix sums of the turns' tokens choose the
longest run of new turns that fits. Every window begins with the conversation's system turn, if its first turn is one,
then repeats as much recent history as fits `history` tokens, then has its new turns. Repeated turns are marked in
number, and a loss mask (spans of the formatted text) covers the new assistant texts only, so each is learned once. A
turn that alone exceeds the budget has a window of its own and is not cut.

Rows come in order of turn from a sort within partitions and are formatted one at a time, so a conversation of any
length needs memory for one window and its repeated turns only. The last window stays open until the next one
starts, so memory does not grow with a conversation.

Nulls: a null text or role is empty, a null turn comes first, rows with a null conv_id are one conversation. Equal
turns are ordered by role and text. Repeated rows are turns of their own. An empty table gives no window. Other columns
are ignored, whatever their names; a turn of any length is kept whole.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts, ship
from ._words import words

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = regex.compile(r"<(\\*)\|")
_ESCAPED = regex.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string is left: `<`, any backslashes and `|` get one more backslash."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def count_words(text: str) -> int:
    """The default measure of tokens."""
    return len(words(text))


#: Tokens that a turn's marks count for.
MARKS = 4
#: Characters of formatted text that are sent on together.
TOGETHER = 1 << 20


class Window:
    """A formatted window: text, spans (start, end) of the loss mask, and how many leading turns repeat earlier ones."""

    def __init__(self, repeats: list[tuple[str, str]]):
        self.pieces: list[str] = []
        self.size, self.spans, self.repeats = 0, [], len(repeats)
        for role, text in repeats:
            self.add(role, text, False)

    def add(self, role: str, text: str, learn: bool) -> None:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        self.pieces += [head, body, END, "\n"]
        if learn:
            self.spans.append((self.size + len(head), self.size + len(head) + len(body)))
        self.size += len(head) + len(body) + len(END) + 1

    def text(self) -> str:
        return "".join(self.pieces)


def windows(turns: Iterator[tuple[str, str]], budget: int, history: int, target: str, tokens: Callable[[str], int]) -> Iterator[Window]:
    """The windows of one conversation, each as soon as it is complete."""
    system: tuple[str, str] | None = None
    system_cost = used = 0
    now: Window | None = None
    recent: deque[tuple[str, str, int]] = deque()  # turns that the next window may repeat
    recent_cost = 0
    fresh = False  # whether the open window has a turn of its own besides repeats
    for k, (role, text) in enumerate(turns):
        cost = tokens(text) + MARKS
        if now is not None and fresh and used + cost > budget:
            yield now
            repeats = [(r, t) for r, t, _ in recent]
            base = system_cost + recent_cost
            while repeats and base + cost > budget:  # history makes room for the new turn
                base -= recent.popleft()[2]
                repeats.pop(0)
            recent_cost = base - system_cost
            now, used, fresh = Window(([system] if system else []) + repeats), base, False
        if now is None:
            now = Window([])
        now.add(role, text, role == target)
        used += cost
        if k == 0 and role == "system":
            system, system_cost = (role, text), cost
            fresh = False
            continue
        fresh = True
        recent.append((role, text, cost))
        recent_cost += cost
        while recent and recent_cost > history:
            recent_cost -= recent.popleft()[2]
    if now is not None:
        yield now


def read(text: str, spans: list[tuple[int, int]], repeats: int) -> Iterator[tuple[str, str, bool]]:
    """(role, text, learned) of the turns of one formatted window that do not repeat earlier ones; the inverse of Window."""
    at, k = 0, 0
    learned = {tuple(s) for s in spans}
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = text.index("\n", at)
        end = text.index(END, line)
        if k >= repeats:
            yield unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end]), (line + 1, end) in learned
        at, k = end + len(END) + 1, k + 1


FORMATTED = "conv_id long, window int, text string, spans array<struct<start:int,end:int>>, repeats int"


def format_windows(conversations: DataFrame, budget: int = 2048, history: int = 256, target: str = "assistant", tokens: Callable[[str], int] = count_words) -> DataFrame:
    """(conv_id, window, text, spans, repeats) for conversations (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    ship(spark)
    src = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = src.repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("repeats", pa.int32())])

    def packed(some):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True))
        ahead = next(rows, None)
        done, size = [], 0
        while ahead is not None:
            conv = ahead[0]

            def own():
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    yield ahead[1:]
                    ahead = next(rows, None)

            for k, w in enumerate(windows(own(), budget, history, target, tokens)):
                done.append((conv, k, w.text(), [{"start": a, "end": b} for a, b in w.spans], w.repeats))
                size += len(done[-1][2])
                if size >= TOGETHER:
                    yield packed(done)
                    done, size = [], 0
        if done:
            yield packed(done)

    return dealt.mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted windows say, read back from them: one row per conversation.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows)
    """
    spark = formatted.sparkSession
    ship(spark)
    dealt = formatted.repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "window")
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches):
        conv, state, done = None, None, []
        for b in batches:
            for c, text, spans, repeats in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append(_row(conv, state))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[4] += len(text)
                state[5] += 1
                for role, own, learned in read(text, [(s["start"], s["end"]) for s in spans], repeats):
                    state[0] += 1
                    state[1].update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
                    if learned:
                        state[2] += len(own)
                        state[3].update(own.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_pylist(done, out)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([_row(conv, state)], out)

    def _row(conv, s):
        return {"conv_id": conv, "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2], "loss_sha256": s[3].hexdigest(), "formatted_chars": s[4], "n_windows": s[5]}

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

