"""Harmonic packing of token sequences.

A document's ids are cut into full sequences and a remainder; the remainder is cut into pieces of capacity // j and a
short tail. A piece of length in (capacity / (j + 1), capacity / j] belongs to class j, and a bin of class j takes exactly j
pieces. Every task fills the bins of its own partition; at its end it joins the few bins that are not full, largest
piece first. No shuffle; open bins hold fewer than j pieces of each class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from groundmetrics.llm.common import documents, map_batches
from groundmetrics.llm.tokens import Encoder, read_tokenizer

CAPACITY, TAIL = 1024, 32


def pieces(total: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids: each id in exactly one."""
    out = [(s, capacity) for s in range(0, total - capacity + 1, capacity)]
    at = len(out) * capacity
    while at < total:
        rest = total - at
        size = rest if rest <= tail else min(rest, capacity // -(-capacity // rest))
        out.append((at, size))
        at += size
    return out


class Packer:
    """Open bins of one task. ``add`` and ``finish`` give closed bins as lists of (piece, length)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open = capacity, {}

    def add(self, piece, length: int) -> list | None:
        j = self.capacity // length
        held = self.open.setdefault(j, [])
        held.append((piece, length))
        return self.open.pop(j) if len(held) == j else None

    def finish(self) -> list[list]:
        bins: list[list] = []
        room: list[int] = []
        for piece, length in sorted((x for held in self.open.values() for x in held), key=lambda x: -x[1]):
            at = next((i for i, r in enumerate(room) if r >= length), None)
            if at is None:
                at = len(bins)
                bins.append([])
                room.append(self.capacity)
            bins[at].append((piece, length))
            room[at] -= length
        self.open = {}
        return bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    An empty or null text is the one id ``end_id``. Repeated rows are packed as often as they occur. Sequences of a power
    of two need no padding; all others are padded to ``capacity`` by the reader. sequence_id is unique: the partition
    number in the upper bits, a counter below.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{n} long" for n in names) + (", ids array<int>" if with_ids else "")

    source, end = read_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, packer = Encoder.shared(source), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def batch():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) + with_ids)
            out = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.list_(pa.int32()))] if with_ids else [])
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)

        def close(bin_):
            nonlocal sequence
            at = 0
            for (doc, start, crc, total, ids), length in bin_:
                rows.append((doc, start, length, crc, total, sequence, at, *((ids,) if with_ids else ())))
                at += length
            sequence += 1

        for b in batches:
            coded = encoder.encode(b.column("text").to_pylist())
            for doc, code in zip(b.column("doc_id").to_pylist(), coded, strict=True):
                ids = np.frombuffer(code + end, "<u4")
                for start, length in pieces(len(ids), capacity):
                    part = ids[start : start + length]
                    done = packer.add((doc, start, zlib.crc32(part.tobytes()), len(ids), part.tolist() if with_ids else None), length)
                    if done:
                        close(done)
            yield batch()
        for bin_ in packer.finish():
            close(bin_)
        yield batch()

    return map_batches(documents(docs), run, schema)
