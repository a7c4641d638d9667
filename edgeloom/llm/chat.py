"""Chat formatting by columnar byte assembly.

Each turn becomes ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and texts get a backslash after their
bracket (``<\\s>``), one more if they have some already; removing one brings the text back. Texts of ``assistant`` turns
are under the loss mask. The pieces of a slice of turns are laid out in one buffer by lengths, offsets and scatter
indices. The turns of a conversation stream through one task in order, in bounded memory, since its digests are taken in
that order.

Null roles and texts are empty, texts of any length are taken whole; only the four columns named are read. Turns are ordered by (turn, role, text), null first; repeated rows are all kept. A null
conv_id is one conversation. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as c
from .units import spread_out

SLICE = 1 << 20
OPEN, MID, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
SCHEMA = "conv_id long, formatted string, mask_start long, mask_end long"


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and the byte range of each turn's text in its turn.

    Lengths of the five segments of a turn and their running sum say where each goes; fixed parts and contents are
    scattered there, into one buffer that becomes the column.
    """
    n = len(texts)
    contents = [c.utf8(pc.replace_substring_regex(pc.fill_null(col, ""), CONTROL, r"\1\\\2")) for col in (roles, texts)]
    size = np.empty((n, 5), np.int64)
    size[:, 0], size[:, 2], size[:, 4] = len(OPEN), len(MID), len(CLOSE)
    size[:, 1], size[:, 3] = (np.diff(offs) for _, offs in contents)
    ends = np.cumsum(size.reshape(-1)).reshape(n, 5)
    begin = ends - size
    buffer = pa.allocate_buffer(int(ends[-1, -1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    for j, fixed in ((0, OPEN), (2, MID), (4, CLOSE)):
        out[begin[:, j, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for j, (data, _) in ((1, contents[0]), (3, contents[1])):
        out[spread_out(begin[:, j], size[:, j])] = data
    row = np.concatenate([np.zeros(1, np.int64), ends[:, 4]])
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(row), buffer)
    return made.cast(pa.string()), begin[:, 3] - begin[:, 0], ends[:, 3] - begin[:, 0]


def format(conversations: DataFrame) -> DataFrame:
    """One row per turn in order: the formatted turn and the byte range under the loss mask (null: none)."""
    c.bounded_batches(conversations.sparkSession)
    cols = conversations.selectExpr(f"coalesce(cast(conv_id as long), {c.NO_ID}) conv_id", "turn", "role", "text")
    ordered = cols.repartition(c.partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def rows(batches):
        for batch in batches:
            sizes = pc.add(pc.fill_null(pc.binary_length(c.column(batch, "text")), 0), pc.fill_null(pc.binary_length(c.column(batch, "role")), 0))
            for lo, hi in c.slices(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))]), SLICE):
                part = batch.slice(lo, hi - lo)
                roles = c.column(part, "role")
                made, s, e = assemble(roles, c.column(part, "text"))
                off = ~np.array([r == "assistant" for r in roles.to_pylist()], bool)
                yield pa.RecordBatch.from_arrays([c.column(part, "conv_id"), made, pa.array(s, mask=off), pa.array(e, mask=off)], names=["conv_id", "formatted", "mask_start", "mask_end"])

    return ordered.mapInArrow(rows, SCHEMA)


def plain(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, parsed from the formatted turns (rows in format()'s order)."""

    def rows(batches):
        key, have = None, None

        def done():
            return pa.RecordBatch.from_pylist([{"conv_id": key, "n_turns": have[0], "turns_sha256": have[1].hexdigest(), "loss_chars": have[2], "loss_sha256": have[3].hexdigest(), "formatted_chars": have[4]}], OUT)

        for batch in batches:
            for conv, text, a, b in zip(*(c.column(batch, x).to_pylist() for x in ("conv_id", "formatted", "mask_start", "mask_end"))):
                if have is None or conv != key:
                    if have is not None:
                        yield done()
                    key, have = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                have[4] += len(text)
                for role, said in TURN.findall(text):
                    have[0] += 1
                    have[1].update(f"{plain(role)}\n{plain(said)}\n".encode())
                if a is not None:
                    loss = plain(text.encode()[a:b].decode())
                    have[2] += len(loss)
                    have[3].update(loss.encode())
        if have is not None:
            yield done()

    OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return c.own_id(formatted.mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"), "conv_id")
