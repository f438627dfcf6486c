"""Conversation structure repair: one streaming pass over rows that are sorted by conversation and turn.

Each row has at most one fault, its first of: blank (no character but ASCII white space), duplicate (role and text seen earlier in
the conversation), truncated (its last other character is none of ``.!?``). The repair is the cheapest sequence of edits after
which the roles' first letters read ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 1, Delete 2 (the only choice for blank and
duplicate rows), Insert an empty user or assistant turn 5; a truncated row that stays adds 5. Of equally cheap sequences the one
whose letters (D, I, K, R) come first in ASCII is taken.

The pattern is an automaton of four states (nothing yet, after s, after u, after a). The pass carries, for each state, the cost, the
rank of its edit letters among the states and a running digest of the repaired turns, across Arrow batches. Costs relative to
the cheapest state and ranks take few values, so a step is looked up once it has been seen. A row leaves four bytes of
backpointers; beyond SPILL_ROWS rows of one conversation they go to an unnamed scratch file of the task.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPACES, STOPS = " \t\n\x0b\x0c\r", ".!?"
COST = {"K": 0, "R": 1, "D": 2, "I": 5, "truncated": 5}
SPILL_ROWS = 1 << 20
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
# Where a role's letter leads from each state; other letters lead nowhere.
STEP = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
NAMES = {"u": "user", "a": "assistant"}
ACCEPTS = (NOTHING, AFTER_A)


def _forced(state: int) -> tuple[int, str]:
    """The one turn that an insertion or a new role can be: (state after it, role)."""
    letter = next(x for x in "ua" if (state, x) in STEP)
    return STEP[state, letter], NAMES[letter]


def _moves(fault: str, letter: str) -> list[tuple]:
    """(state, edits, next state, cost, insertions, edit) for a row: any useful insertions before it, then its own edit."""
    out = []
    for start in range(4):
        state, cost = start, 0
        for inserted in range(3):
            before = "I" * inserted
            out.append((start, before + "D", state, cost + COST["D"], inserted, 0))
            if fault not in ("blank", "duplicate"):
                late = COST["truncated"] if fault == "truncated" else 0
                if (state, letter) in STEP:
                    out.append((start, before + "K", STEP[state, letter], cost + COST["K"] + late, inserted, 1))
                out.append((start, before + "R", _forced(state)[0], cost + COST["R"] + late, inserted, 2))
            state, cost = _forced(state)[0], cost + COST["I"]
    return out


class Repair:
    """The state of one conversation. ``add`` takes its rows in order; ``finish`` gives (cost, audit, digest)."""

    _tables: dict[tuple, tuple] = {}

    def __init__(self):
        self.base, self.costs, self.ranks = 0, (0, None, None, None), (0, None, None, None)
        self.digests = [hashlib.sha256(), None, None, None]
        self.some = [False] * 4
        self.back, self.rows, self.scratch = bytearray(), 0, None

    @classmethod
    def _table(cls, costs: tuple, ranks: tuple, fault: str, letter: str) -> tuple:
        key = (costs, ranks, fault, letter if letter in ("s", "u", "a") else "")
        found = cls._tables.get(key)
        if found is None:
            best: dict[int, tuple] = {}
            for start, edits, state, cost, inserted, edit in _moves(fault, letter):
                if costs[start] is not None:
                    new = (costs[start] + cost, ranks[start], edits, start, inserted, edit)
                    best[state] = min(best.get(state, new), new)
            low = min(x[0] for x in best.values())
            order = sorted(best, key=lambda s: best[s][1:3])
            found = cls._tables[key] = (
                low, tuple(best[s][0] - low if s in best else None for s in range(4)), tuple(order.index(s) if s in best else None for s in range(4)),
                bytes(best[s][3] | best[s][4] << 2 | best[s][5] << 4 if s in best else 0xFF for s in range(4)),
                [(s, best[s][3], best[s][4], best[s][5]) for s in best])
        return found

    def _say(self, digest, some: bool, state: int, role: str, text: bytes) -> None:
        digest.update((("\n" if some else "") + role + ":").encode())
        digest.update(text)

    def add(self, role: str, text: str, fault: str) -> None:
        low, costs, ranks, back, moves = self._table(self.costs, self.ranks, fault, role[:1])
        digests, some, data = [None] * 4, [False] * 4, None
        for state, start, inserted, edit in moves:
            d, s, at = self.digests[start].copy(), self.some[start], start
            for _ in range(inserted):
                at, name = _forced(at)
                self._say(d, s, at, name, b"")
                s = True
            if edit:
                data = text.encode() if data is None else data
                self._say(d, s, at, role if edit == 1 else _forced(at)[1], data)
                s = True
            digests[state], some[state] = d, s
        self.base, self.costs, self.ranks, self.digests, self.some = self.base + low, costs, ranks, digests, some
        self.back += back
        self.rows += 1
        if len(self.back) >= 4 * SPILL_ROWS:
            if self.scratch is None:
                self.scratch = tempfile.TemporaryFile()
            self.scratch.write(self.back)
            self.back = bytearray()

    def _blocks(self):
        """Backpointers from the last row to the first, a block at a time."""
        yield np.frombuffer(bytes(self.back), np.uint8).reshape(-1, 4)
        if self.scratch is not None:
            for block in reversed(range(self.scratch.tell() // (4 * SPILL_ROWS))):
                self.scratch.seek(block * 4 * SPILL_ROWS)
                yield np.frombuffer(self.scratch.read(4 * SPILL_ROWS), np.uint8).reshape(-1, 4)
            self.scratch.close()

    def finish(self) -> tuple[int, str, str]:
        ends = []
        for state in range(4):
            if self.costs[state] is not None:
                at, more = state, 0
                while at not in ACCEPTS:
                    at, more = _forced(at)[0], more + 1
                ends.append((self.costs[state] + COST["I"] * more, self.ranks[state], more, state))
        cost, _, more, state = min(ends)
        digest, some, at = self.digests[state].copy(), self.some[state], state
        for _ in range(more):
            at, name = _forced(at)
            self._say(digest, some, at, name, b"")
            some = True
        letters = bytearray(b"I" * more)
        for block in self._blocks():
            for row in reversed(block.tolist()):
                code = row[state]
                letters += b"DKR"[code >> 4 : (code >> 4) + 1] + b"I" * (code >> 2 & 3)
                state = code & 3
        letters.reverse()
        return self.base + cost, letters.decode(), digest.hexdigest()


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class _Stream:
    """Counters and repair of the conversation that is being read."""

    def __init__(self, conv: str | None):
        self.conv, self.repair = conv, Repair()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.letter = 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: str | None, role: str, text: str, fault: str) -> None:
        if fault:
            self.counts[fault] += 1
        letter = role[:1]
        if self.letter is not None and self.letter + letter not in ("su", "ua", "au"):
            self.illegal += 1
        self.letter = letter
        if turn is not None:
            n = int(turn)
            if n != self.last:
                self.turns += 1
            self.first, self.last = n if self.first is None else self.first, n
        self.repair.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, *self.repair.finish())


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space; a null conv_id is a conversation of its own; null turns come first and count for no gap.
    Rows of equal turn are taken by role, then text. A conversation whose rows are all marked in an optional boolean column
    ``dropped`` is still listed, with zeros, an empty audit and the digest of nothing. An empty table gives no rows.
    Other columns are not read. A conversation is read by one task, which holds one batch and the backpointers.
    """
    gone = F.coalesce("dropped", F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    said = lambda c: F.when(~gone, F.coalesce(F.col(c), F.lit(" ")))
    rows = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), said("role").alias("role"), said("text").alias("text"), gone.alias("gone"))
    bare = F.rtrim("text", F.lit(SPACES))
    # One exchange serves the earlier-row test and the pass itself: hashing by conversation also gathers equal (role, text).
    rows = rows.repartition("conv_id").withColumn("_seen", F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1)
    fault = F.when(bare == "", "blank").when(F.col("_seen"), "duplicate").when(~F.right(bare, F.lit(1)).isin(*STOPS), "truncated").otherwise("")
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("t"), "role", "text", "gone", F.when(~F.col("gone"), fault).alias("fault"), "turn", "_seen", F.col("conv_id").alias("_c"))
    rows = rows.sortWithinPartitions(F.col("_c").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "_seen").select("conv_id", "t", "role", "text", "gone", "fault")

    def run(frames):
        stream = None
        for frame in frames:
            done = []
            for conv, turn, role, text, dropped, fault in zip(*(frame[c].tolist() for c in ("conv_id", "t", "role", "text", "gone", "fault")), strict=True):
                if stream is None or conv != stream.conv:
                    if stream is not None:
                        done.append(stream.row())
                    stream = _Stream(conv)
                if not dropped:
                    stream.add(turn, role, text, fault)
            yield pd.DataFrame(done, columns=RESULT)
        if stream is not None:
            yield pd.DataFrame([stream.row()], columns=RESULT)

    schema = "conv_id string, " + ", ".join(f"{n} {'string' if n in ('audit', 'repaired_sha256') else 'long'}" for n in RESULT[1:])
    return rows.mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast("long"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) modulo 20, nulls read as one space: 0 marks the row as dropped, 1 empties its text,
    2 takes ``.!?`` out, 3 repeats it, 4 sets its role to user. Columns: conv_id, turn, role, text, dropped."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")), "utf-8")) % 20
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("dropped"), F.explode(times).alias("_time")).drop("_time")
