"""Frames of a stream to time-stamped messages: the batch rules of ``operators.frames`` carried over triggers.

State per boat: the clock (last trusted time, leading source, readings per source), the present file, and the
multi-frame messages of it that are still open. A boat's files come in path order, so the state never goes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fairlead.operators.frames import DAY_US, FAST_PACKET_PGNS, SYSTEM_TIME
from fairlead.streaming.ordered import InOrder, use_state_store

MESSAGES = "boat_id int, file_no bigint, seq bigint, source int, destination int, priority int, pgn int, time_us bigint, data binary"
#: Bytes of a file whose frames are put in order at once (``seq`` counts bytes).
SLICE_BYTES = 1 << 20
#: Messages that are given out at once; files are often far smaller.
OUT_ROWS = 1 << 15


def clock_us(data: bytes) -> int | None:
    """The time a System Time message tells, if it tells one."""
    if len(data) < 8:
        return None
    days, ticks = int.from_bytes(data[2:4], "little"), int.from_bytes(data[4:8], "little")
    return None if days == 0xFFFF or ticks == 0xFFFFFFFF else days * DAY_US + ticks * 100


class Assembly:
    """The multi-frame messages of one file that have begun: (source, pgn) -> sequence, length, next index, bytes."""

    def __init__(self, open_: dict[tuple[int, int], tuple[int, int, int, bytes]] | None = None):
        self.open = open_ or {}

    def add(self, source: int, pgn: int, data: bytes) -> bytes | None:
        """The whole message, if this frame completes it."""
        if len(data) < 2:
            return None
        key, index, sequence = (source, pgn), data[0] & 31, data[0] >> 5
        begun = self.open.pop(key, None)
        if index == 0:
            begun = sequence, data[1], 1, data[2:8]
        elif begun is None or begun[0] != sequence or begun[2] != index:
            return None
        else:
            begun = sequence, begun[1], index + 1, begun[3] + data[1:8]
        if len(begun[3]) >= begun[1]:
            return begun[3][: begun[1]]
        self.open[key] = begun
        return None


class Stamper(InOrder):
    def __init__(self):
        super().__init__(SLICE_BYTES)

    def open(self, handle) -> None:
        self.clock = handle.getValueState("clock", "last_us bigint, leader int, file_no bigint")
        self.readings = handle.getMapState("readings", "source int", "n bigint")
        self.begun = handle.getMapState("begun", "source int, pgn int", "sequence int, total int, next int, data binary")

    def load(self, key: tuple) -> None:
        self.last_us, self.leader, self.file_no = self.clock.get() if self.clock.exists() else (None, None, None)
        self.counts = {k[0]: v[0] for k, v in self.readings.iterator()}
        held = {tuple(k): (*v[:3], bytes(v[3])) for k, v in self.begun.iterator()}
        self.assembly, self.stored = Assembly(held), set(held)
        self.out, self.waiting = [], 0

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pgn, seq, source, file_no = (rows[c].to_numpy() for c in ("pgn", "seq", "source", "file_no"))
        data = rows["data"].to_numpy()
        ticks_seq, ticks_us = self._elect(seq, source, data, np.flatnonzero(pgn == SYSTEM_TIME))
        whole = self._assemble(file_no, source, pgn, data)
        # The last trusted time before each message, else the one carried over.
        at = np.searchsorted(ticks_seq, seq, "right") - 1
        timed = at >= 0
        time = np.where(timed, ticks_us[np.maximum(at, 0)] if len(ticks_us) else 0, self.last_us or 0)
        keep = (pgn != SYSTEM_TIME) & (timed | (self.last_us is not None)) & np.array([w is not None for w in whole], bool)
        if len(ticks_us):
            self.last_us = int(ticks_us[-1])
        n = int(keep.sum())
        if n:
            out = {c: rows[c].to_numpy()[keep] for c in ("boat_id", "file_no", "seq", "source", "destination", "priority", "pgn")}
            self.out.append(pd.DataFrame(out | {"time_us": time[keep], "data": [w for w, k in zip(whole, keep) if k]}))
            self.waiting += n
        if self.waiting >= OUT_ROWS:
            yield from self._given()

    def _given(self) -> Iterator[pd.DataFrame]:
        if self.out:
            yield pd.concat(self.out, ignore_index=True)
        self.out, self.waiting = [], 0

    def _elect(self, seq: np.ndarray, source: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The readings that set the time: those of the source that leads, which is the first to have strictly
        more readings than every other one."""
        ticks = []
        for i in at:
            us = clock_us(bytes(data[i]))
            if us is None:
                continue
            own = int(source[i])
            self.counts[own] = self.counts.get(own, 0) + 1
            if self.leader is None or self.counts[own] > self.counts.get(self.leader, 0):
                self.leader = own
            if own == self.leader:
                ticks.append((int(seq[i]), us))
        return np.array([t[0] for t in ticks], np.int64), np.array([t[1] for t in ticks], np.int64)

    def _assemble(self, file_no: np.ndarray, source: np.ndarray, pgn: np.ndarray, data: np.ndarray) -> list:
        """Each row's whole message: its own bytes, or None where a message is not complete with it."""
        whole = [bytes(d) for d in data]
        for i in np.flatnonzero(np.isin(pgn, FAST_PACKET_PGNS)):
            self._file(int(file_no[i]))
            whole[i] = self.assembly.add(int(source[i]), int(pgn[i]), whole[i])
        if len(file_no):
            self._file(int(file_no[-1]))
        return whole

    def _file(self, number: int) -> None:
        if number != self.file_no:
            self.file_no, self.assembly = number, Assembly()

    def save(self, key: tuple) -> Iterator[pd.DataFrame]:
        self.clock.update((self.last_us, self.leader, self.file_no))
        for source, n in self.counts.items():
            self.readings.updateValue((source,), (n,))
        for k in self.stored - set(self.assembly.open):
            self.begun.removeKey(k)
        for k, v in self.assembly.open.items():
            self.begun.updateValue(k, v)
        return self._given()


def stamped(frames: DataFrame) -> DataFrame:
    """Whole messages with their time, from a stream of frames of the ``ebl`` source (all files of a boat in
    order). ``operators.decode.decode_all`` makes series of them."""
    use_state_store(frames.sparkSession)
    columns = ["boat_id", "file_no", "seq", "source", "destination", "priority", "pgn", "data"]
    return frames.select(*columns).groupBy("boat_id").transformWithStateInPandas(Stamper(), MESSAGES, "Append", "None")
