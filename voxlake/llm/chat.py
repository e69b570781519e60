"""Chat formatting in budgeted windows.

Turns of a conversation are cut where running sums of their tokens reach the budget, always between
turns.  Each window starts with the conversation's system turn and repeats the latest turns before it
as long as they fit the history budget; then come its new turns.  Losses count on the new assistant
texts alone, so every assistant text is a target exactly once.

A turn is written as ``<|turn|>role``, a line end, the text, ``<|end|>`` and a line end.  Inside roles and
texts a backslash is doubled and control strings, these and those of common other templates, get a
backslash after their first character; unescaping drops each backslash and takes the next character.

Turns are counted in order, by a sort over ranges of (conversation, turn) and sums of the ranges' counts.
A conversation is dealt out by spans of ``CHUNK`` turns, so a conversation of any length is formatted by
many tasks: a span gets copies of the system turn and of as many turns before it as can fit the history,
so that history runs on over spans.  Windows end with their span.  Tasks stream; they hold one window and
its history.

Defined cases: null text or role is empty; turns are ordered by number, null first, then role and text;
repeated rows are turns of their own; a null conversation id is a conversation; a turn over the budget
has a window of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .scratch import Scratch, bounded, small

BUDGET = 1024
HISTORY = 256
CHUNK = 512
#: Tokens that a turn's marks count for.
MARKS = 3

#: Strings that steer a chat model; they never stand in an escaped text.
CONTROLS = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    out = _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))
    return out.replace("\n", "\\\n") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """(the turn as written, start and stop of its text in it)."""
    head = f"<|turn|>{escape(role, True)}\n"
    body = escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) of all turns written."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


class _Windows:
    """Windows of one span, as its turns come in."""

    def __init__(self, budget: int, history: int):
        self.budget, self.limit = budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: deque = deque()
        self.past_tokens = self.number = 0
        self.turns: list[tuple[str, str, int]] = []
        self.repeated, self.tokens = 0, 0

    def _remember(self, turn) -> None:
        if turn is self.system:
            return
        self.past.append(turn)
        self.past_tokens += turn[2]
        while self.past and self.past_tokens > self.limit:
            self.past_tokens -= self.past.popleft()[2]

    def carry(self, role: str, text: str, tokens: int, system: bool) -> None:
        turn = (role, text, tokens)
        if system:
            self.system = turn
        else:
            self._remember(turn)

    def _open(self) -> None:
        self.turns = ([self.system] if self.system else []) + list(self.past)
        self.repeated, self.tokens = len(self.turns), sum(t[2] for t in self.turns)

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        turn, done = (role, text, tokens), None
        if not self.turns:
            self._open()
        if self.tokens + tokens > self.budget and len(self.turns) > self.repeated:
            done = self.close()
            self._open()
        while self.tokens + tokens > self.budget and self.past and self.repeated == len(self.turns) and self.repeated > bool(self.system):
            self.tokens -= self.turns.pop(int(bool(self.system)))[2]  # a long new turn: less history before it
            self.repeated -= 1
        self.turns.append(turn)
        self.tokens += tokens
        if role == "system" and self.system is None:
            self.system = turn
        return done

    def close(self) -> tuple | None:
        """(number, repeated turns, text, spans of the loss) of the window at hand."""
        if len(self.turns) == self.repeated:
            return None
        parts, spans, at = [], [], 0
        for i, turn in enumerate(self.turns):
            part, a, b = write_turn(turn[0], turn[1])
            if i >= self.repeated:
                if turn[0] == "assistant":
                    spans.append({"start": at + a, "stop": at + b})
                self._remember(turn)
            parts.append(part)
            at += len(part)
        out = (self.number, self.repeated, "".join(parts), spans)
        self.number += 1
        self.turns = []
        return out


_OUT = "conv_id long, span long, window int, n_repeated int, text string, loss array<struct<start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _format(budget: int, history: int):
    """(conv_id, span, kind, role, text), each span's rows together: kind 0 system copy, 1 history copy, 2 own turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            rows = []
            conv, span, kind, role = (batch.column(i).to_pylist() for i in range(4))
            text = batch.column(4).to_pylist()
            tokens = np.concatenate([np.diff(tb.words(off, data, tb.NOT_SPACE, None).first) for _, _, off, data in tb.slices(batch.column(4))] or [np.zeros(0, int)]) + MARKS
            for c, s, k, r, x, n in zip(conv, span, kind, role, text, tokens.tolist()):
                if at != (c, s):
                    if now and (w := now.close()):
                        rows.append((*at, *w))
                    at, now = (c, s), _Windows(budget, history)
                if k < 2:
                    now.carry(r, x, n, k == 0)
                elif w := now.add(r, x, n):
                    rows.append((*at, *w))
            if rows:
                yield _batch(rows)
        if now and (w := now.close()):
            yield _batch([(*at, *w)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), _SPANS)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "span", "window", "n_repeated", "text", "loss"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, role, text) in order -> the same with the task and the row's place among the task's rows of its conversation."""
    part, last, run = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        conv = batch.column(0)
        if not len(conv):
            continue
        ids, none = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        new = np.concatenate(([(ids[0], none[0]) != last], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])))
        at = np.arange(len(ids))
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        place[: int(np.argmax(new)) if new.any() else len(ids)] += run
        last, run = (ids[-1], none[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])


def _counted(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, text, nth): turns counted from 0 in each conversation."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.write(rows.mapInArrow(_places, "conv_id long, turn long, role string, text string, part int, place long"), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).filter("offset > 0")
    parts = scratch.write(parts, "offsets")
    rows = rows.join(small(parts, parts.count()), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return rows.select(*order, (F.col("place") + F.coalesce("offset", F.lit(0))).alias("nth"))


def format_chat(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, turn, role, text) -> windows: conv_id, span, window, n_repeated, text and the loss mask as spans of characters."""
    scratch = Scratch(turns.sparkSession, "turns")
    rows = _counted(turns, scratch).withColumn("span", F.floor(F.col("nth") / CHUNK).cast("long"))
    reach = history // MARKS + 1  # more turns can't fit the history
    if reach > CHUNK:
        raise ValueError(f"the history is over {CHUNK * MARKS} tokens")
    own = rows.withColumn("kind", F.lit(2))
    later = rows.filter(f"nth % {CHUNK} = 0 and nth > 0").select("conv_id", "span")
    # the last turns of a span, before the next; only where there is a next span
    tail = rows.filter(f"nth % {CHUNK} >= {CHUNK - reach}").withColumn("span", F.col("span") + 1).withColumn("kind", F.lit(1))
    next_ = later.select(F.col("conv_id").alias("c"), F.col("span").alias("s"))
    tail = tail.join(next_, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")), "left_semi")
    system = rows.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("nth", "turn", "role", "text", "span")).alias("s"))
    copies = later.join(system.select(F.col("conv_id").alias("c"), "s"), F.col("conv_id").eqNullSafe(F.col("c"))).filter("span > s.span")
    copies = copies.select("conv_id", "s.turn", "s.role", "s.text", "s.nth", "span", F.lit(0).alias("kind"))
    every = own.unionByName(tail).unionByName(copies)
    every = every.repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "kind", "nth")
    return every.select("conv_id", "span", "kind", "role", "text").mapInArrow(_format(budget, history), _OUT)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order -> one row for each conversation, from the windows' text and masks alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    at, state, rows = object(), None, []

    def done():
        if state:
            rows.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def pack():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        for conv, repeated, text, loss in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if conv != at:
                done()
                at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for s in loss:
                part = unescape(text[s["start"] : s["stop"]])
                state[2] += len(part)
                state[3].update(part.encode())
            state[4] += len(text)
        if rows:
            yield pack()
            rows = []
    done()
    if rows:
        yield pack()


def read_chat(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted windows."""
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "span", "window").select("conv_id", "n_repeated", "text", "loss")
    return rows.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_and_read(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Write the windows to the shared folder and read the digests back from there."""
    return read_chat(Scratch(turns.sparkSession, "chat").write(format_chat(turns, budget, history), "windows"))
