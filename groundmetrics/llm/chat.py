r"""Chat formatting by columnar byte assembly, and reading back.

A turn is ``### <role>:\n<text></turn>\n``. Inside roles and texts a backslash goes before every backslash, ``###`` and
``</turn>`` (and a newline in a role), so an unescaped marker is always the template's own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmetrics.llm.common import map_batches

HEAD, COLON, END = b"### ", b":\n", b"</turn>\n"
_CONTROL = re.compile(rb"\\|###|</turn>")
_ROLE = re.compile(rb"\\|###|</turn>|\n|:")
_OPEN = re.compile(rb"### ((?:[^\\\n:]|\\.)*):\n", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)


def escape(data: bytes, role: bool = False) -> bytes:
    return (_ROLE if role else _CONTROL).sub(rb"\\\g<0>", data)


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data)


def assemble(roles: list[bytes], texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted segments as one Arrow binary array, with the byte offset and length of each text inside its segment.

    Lengths of the five parts of a segment give cumulative offsets; template bytes are scattered with numpy index arrays and
    the contents copied into one buffer allocated beforehand.
    """
    n = len(roles)
    role_n, text_n = np.array([len(r) for r in roles], np.int64), np.array([len(t) for t in texts], np.int64)
    text_at = len(HEAD) + role_n + len(COLON)
    size = text_at + text_n + len(END)
    offset = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=offset[1:])
    out = np.empty(int(offset[-1]), np.uint8)
    for part, at in ((HEAD, offset[:-1]), (COLON, offset[:-1] + len(HEAD) + role_n), (END, offset[:-1] + text_at + text_n)):
        out[at[:, None] + np.arange(len(part))] = np.frombuffer(part, np.uint8)
    for at, lengths, content in ((offset[:-1] + len(HEAD), role_n, roles), (offset[:-1] + text_at, text_n, texts)):
        flat = np.frombuffer(b"".join(content), np.uint8)
        first = np.cumsum(lengths) - lengths
        out[np.repeat(at - first, lengths) + np.arange(len(flat))] = flat
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offset), pa.py_buffer(out)]), text_at, text_n


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, loss_at, loss_bytes): a row per turn, a conversation's rows together and in order.

    Null roles and texts are empty; equal turns are ordered by role and text and all kept. The loss mask covers the texts
    of assistant turns. Turns stay rows, so a conversation of any length streams through its task.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        for b in batches:
            roles = [r.encode() for r in b.column("role").to_pylist()]
            texts = [escape(t.encode()) for t in b.column("text").to_pylist()]
            segments, at, n = assemble([escape(r, True) for r in roles], texts)
            loss = np.array([r == b"assistant" for r in roles], bool)
            yield pa.RecordBatch.from_arrays([b.column("conv_id").cast(pa.int64()), segments.cast(pa.binary()), pa.array(at), pa.array(np.where(loss, n, -1))],
                                             ["conv_id", "segment", "loss_at", "loss_bytes"])

    return map_batches(rows, run, "conv_id long, segment binary, loss_at long, loss_bytes long")


def parse(segment: bytes) -> tuple[bytes, bytes]:
    """(role, text) of a formatted turn."""
    m = _OPEN.match(segment)
    if not m or not segment.endswith(END):
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(segment[m.end() : -len(END)])


def read_back(segments: DataFrame) -> DataFrame:
    """A row per conversation from the formatted turns: counts and digests of turns and of the text under the loss mask.

    Needs the rows of a conversation together and in order, as ``format_turns`` leaves them; keeps running digests only.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        open_: list | None = None  # conv_id, turns, digest, loss chars, loss digest, chars

        def batch(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        def closed(x):
            return (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5])

        for b in batches:
            rows = []
            for conv, seg, at, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_at", "loss_bytes")), strict=True):
                if open_ is None or open_[0] != conv:
                    if open_:
                        rows.append(closed(open_))
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(seg)
                open_[1] += 1
                open_[2].update(role + b"\n" + text + b"\n")
                if n >= 0:
                    plain = unescape(seg[at : at + n])
                    open_[3] += len(plain.decode())
                    open_[4].update(plain)
                open_[5] += len(seg.decode())
            yield batch(rows)
        yield batch([closed(open_)] if open_ else [])

    return map_batches(segments, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
