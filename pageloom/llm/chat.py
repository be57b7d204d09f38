"""Chat formatting by columnar byte assembly: lengths, offsets and scatter indices in numpy, one Arrow buffer for a batch."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bound_batches, stored

# The template. Every turn is HEAD + escaped role + COLON + escaped text + TAIL.
HEAD, COLON, TAIL, ESCAPE = "### ", ": ", "</turn>\n", "\\"
#: What gets ESCAPE before it inside texts (the first three) and roles (all); ESCAPE itself first.
CONTROL = (ESCAPE, HEAD, "</turn>", COLON)
_ESCAPED = re.compile("\\\\(" + "|".join(re.escape(c) for c in CONTROL) + ")")
_TURN = re.compile(r"### ((?:\\.|[^\\:]|:(?!\x20))*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.S)
SCHEMA = "conv_id long, seg long, n_turns long, formatted string, loss_start array<int>, loss_length array<int>"


def escape(column: pa.Array, control: tuple[str, ...] = CONTROL[:3]) -> pa.Array:
    for c in control:
        column = pc.replace_substring(column, c, ESCAPE + c)
    return column


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], raw


def assemble(pieces: list[pa.Array], starts: np.ndarray) -> pa.Array:
    """One string for each run of rows (runs begin at `starts`): the rows' pieces, one after another.

    Lengths of all segments give their offsets in the output by one cumulative sum; each piece column is then scattered into
    the preallocated buffer by its destination indices.
    """
    cols = [_buffers(p) for p in pieces]
    lengths = np.stack([np.diff(at) for at, _ in cols], axis=1)
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, (at, raw) in enumerate(cols):
        out[np.repeat(begins[:, k] - at[:-1], lengths[:, k]) + np.arange(len(raw))] = raw
    edges = np.append(begins[starts, 0], len(out)).astype("<i8")
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(out)).cast(pa.string())


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of conversations: the turns of one conversation in one batch; a long one goes on in the next segment."""
    seg = TaskContext.get().partitionId() << 32  # tasks hold ranges in order
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv, role, text = (b.column(i) for i in range(3))
        role, text = pc.fill_null(role, ""), pc.fill_null(text, "")
        ids = conv.dictionary_encode("encode").indices.to_numpy()  # exact, with a place for null
        starts = np.nonzero(np.diff(ids, prepend=-1))[0]
        keys = conv.take(pa.array(starts))
        segs = seg + np.arange(len(starts))
        seg += len(starts)
        names, bodies = escape(role, CONTROL), escape(text)
        const = lambda s: pa.array([s] * n, pa.string())
        pieces = [const(HEAD), names, const(COLON), bodies, const(TAIL)]
        chars = np.stack([pc.utf8_length(p).to_numpy(zero_copy_only=False) for p in pieces], axis=1)
        ends = np.cumsum(chars.sum(1))
        counts = np.diff(np.append(starts, n))
        base = np.repeat((ends - chars.sum(1))[starts], counts)
        begin = ends - chars[:, 4] - chars[:, 3] - base
        mine = pc.equal(role, "assistant").to_numpy(zero_copy_only=False)
        edges = np.append(np.concatenate([[0], np.cumsum(mine)])[starts], mine.sum()).astype("<i4")
        lists = lambda x: pa.ListArray.from_arrays(pa.array(edges), pa.array(x[mine].astype("<i4")))
        yield pa.RecordBatch.from_arrays(
            [keys.cast(pa.int64()), pa.array(segs), pa.array(counts, pa.int64()), assemble(pieces, starts), lists(begin), lists(chars[:, 3])],
            ["conv_id", "seg", "n_turns", "formatted", "loss_start", "loss_length"],
        )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Segments (conv_id, seg, n_turns, formatted, loss_start, loss_length) of every conversation, by turn.

    Rows are dealt by ranges of (conv_id, turn, role), sorted, and stream through their tasks, so a conversation with very
    many turns is spread over tasks and leaves as segments whose numbers follow its turns. A null role or text is an empty
    one. Turns with equal numbers follow by role and text; null conv_ids are one conversation. loss_start and loss_length are
    code points in `formatted`: the escaped text of each assistant turn, without its header and end mark. Other columns are
    ignored; an empty table gives an empty one.
    """
    bound_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "role", "text", "turn").repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read from the formatted text alone."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, done = None, None, []
    blank = lambda: {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
    row = lambda k, s: (k, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"])
    batch = lambda d: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*d, strict=True), _REPORT.types, strict=True)], schema=_REPORT)
    for b in batches:
        for conv, text, starts, lengths in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")), strict=True):
            if state is None or conv != key:
                if state is not None:
                    done.append(row(key, state))
                key, state = conv, blank()
            for role, body in parse(text):
                state["n"] += 1
                state["turns"].update(f"{role}\n{body}\n".encode())
            for a, n in zip(starts, lengths, strict=True):
                part = unescape(text[a : a + n])
                state["loss_chars"] += len(part)
                state["loss"].update(part.encode())
            state["chars"] += len(text)
        if done:
            yield batch(done)
            done = []
    if state is not None:
        yield batch([row(key, state)])


_REPORT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def chat_report(conversations: DataFrame) -> DataFrame:
    """Write the formatted segments, read them back, and digest what they hold, one row for each conversation (null conv_ids
    are one). A digest runs over a conversation's turns in order, so its segments stream through one task; texts that are
    null or empty count as empty turns, repeated rows as turns of their own. An empty table gives an empty one."""
    written = stored(format_chats(conversations), "chats")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    dealt = written.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(_report, schema)
