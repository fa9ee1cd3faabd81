"""Online decoding of pulses as they come in, with state for each drive.

The same classes run over a stream (`applyInPandasWithState`) and over a finished table, which must agree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: First delay, pulses skipped after one too long, bits within which data must follow its header, ticks until
#: an idle motor stops and until a read gives up (50 million a second), and the sync pattern before a record.
FIRST_DELAY, SKIPPED, REACH = 100, 5, 700
IDLE_TICKS, READ_TICKS = 100_000_000, 200_000_000
TICKS_A_MS = 50_000
SYNC = bin(0x448944894489)[2:]


class Loop:
    """Integer loop: pulse lengths to types 2, 3 and 4, the number of half clocks."""

    def __init__(self, delay: int = FIRST_DELAY, skip: int = 1) -> None:
        self.delay, self.skip = delay, skip

    def feed(self, length: int) -> int:
        """Type of a pulse, or 0 if it is skipped."""
        d, kind, new = self.delay, 0, self.delay
        if self.skip:
            self.skip -= 1
        elif length < d // 4:
            pass
        elif length < d + d // 4:
            kind, new = 2, d - (d - length) // 2
        elif length < 2 * d - d // 4:
            kind, new = 3, d - (d - 2 * length // 4 - 2 * length // 8 + 2 * length // 32) // 2
        elif length < 3 * d:
            kind, new = 4, d - (d - length // 2) // 2
        else:
            self.skip = SKIPPED
        self.delay = max(d - d // 8, min(d + d // 8, new))
        return kind


class Sectors:
    """Bits to sectors. After a sync pattern come a record's bits, clock and data in turn; a header with a right checksum
    must be followed by data within REACH bits of sync search, or it is forgotten."""

    FIELDS = ("window", "mode", "bits", "header", "since")

    def __init__(self, state: dict | None = None) -> None:
        self.window, self.mode, self.bits, self.header, self.since = "", "sync", "", None, 0
        for k, v in (state or {}).items():
            setattr(self, k, v)

    def state(self) -> dict:
        return {k: getattr(self, k) for k in self.FIELDS}

    @staticmethod
    def crc_right(data: bytes) -> bool:
        import binascii

        # the three sync bytes are part of the checksum
        return binascii.crc_hqx(b"\xa1\xa1\xa1" + data, 0xFFFF) == 0

    def feed(self, bit: str) -> tuple[int, int, int, bool, bytes] | None:
        """track, head, sector, deleted and data once a sector is whole and right."""
        if self.header is not None:
            self.since += 1
        if self.mode == "sync":
            self.window = (self.window + bit)[-len(SYNC) :]
            if self.window == SYNC:
                self.mode, self.bits, self.window = "record", "", ""
            elif self.header is not None and self.since > REACH:
                self.header = None
            return None
        self.bits += bit
        if len(self.bits) % 16:
            return None
        data = int(self.bits[1::2], 2).to_bytes(len(self.bits) // 16, "big")
        if data[0] == 0xFE:
            if len(data) == 7:
                self.header = [data[1], data[2], data[3], 128 << min(data[4], 6)] if self.crc_right(data) else None
                self.mode, self.since = "sync", 0
        elif data[0] in (0xFB, 0xF8) and self.header is not None:
            if len(data) == self.header[3] + 3:
                (track, head, sector, _), self.header, self.mode = self.header, None, "sync"
                if self.crc_right(data):
                    return track, head, sector, data[0] == 0xF8, data[1:-2]
        else:
            self.mode = "sync"
        return None


class Drive:
    """All steps of one drive: ticks of pulses to lengths, types, bits and sectors."""

    def __init__(self, saved: str | None = None) -> None:
        s = json.loads(saved) if saved else {}
        self.last: int | None = s.get("last")
        self.loop = Loop(s.get("delay", FIRST_DELAY), s.get("skip", 1))
        self.sectors = Sectors(s.get("sectors"))

    def saved(self) -> str:
        return json.dumps({"last": self.last, "delay": self.loop.delay, "skip": self.loop.skip, "sectors": self.sectors.state()})

    def pulse(self, tick: int) -> tuple[int, int, list[tuple]]:
        """Length and type of the pulse, and the sectors that it completes."""
        length = tick - self.last if self.last is not None else 0
        self.last = tick
        kind = self.loop.feed(length) if length else 0
        found = [s for bit in ("1" + "0" * (kind - 1) if kind else "") if (s := self.sectors.feed(bit))]
        return length, kind, found


TYPES = "drive long, tick long, length long, kind int"
SECTORS = "drive long, track int, head int, sector int, deleted boolean, data binary"


def _typed(drive: int, state: Drive, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(drive, t, *state.pulse(int(t))[:2]) for t in sorted(pdf["tick"])]
    return pd.DataFrame(rows, columns=["drive", "tick", "length", "kind"])


def _found(drive: int, state: Drive, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(drive, *s) for t in sorted(pdf["tick"]) for s in state.pulse(int(t))[2]]
    return pd.DataFrame(rows, columns=["drive", "track", "head", "sector", "deleted", "data"])


def _stream(pulses: DataFrame, work, shape: str) -> DataFrame:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        drive = Drive(state.get[0] if state.exists else None)
        # a micro-batch of one drive is put in order as a whole
        pdf = pd.concat(list(batches))
        out = work(key[0], drive, pdf)
        state.update((drive.saved(),))
        yield out

    return pulses.groupBy("drive").applyInPandasWithState(step, shape, "saved string", "append", GroupStateTimeout.NoTimeout)


def _batch(pulses: DataFrame, work, shape: str) -> DataFrame:
    return pulses.groupBy("drive").applyInPandas(lambda key, pdf: work(key[0], Drive(), pdf), shape)


def pulse_types(pulses: DataFrame) -> DataFrame:
    """drive, tick, length, kind of pulses (drive, tick), streaming or not. Ticks must not go back between micro-batches."""
    return (_stream if pulses.isStreaming else _batch)(pulses.select("drive", "tick"), _typed, TYPES)


def online_sectors(pulses: DataFrame) -> DataFrame:
    """Sectors with right checksums as they are completed."""
    return (_stream if pulses.isStreaming else _batch)(pulses.select("drive", "tick"), _found, SECTORS)


COMMANDS = "drive long, tick long, motor boolean, reading boolean, timed_out boolean"


def _states(drive: int, saved: list, pdf: pd.DataFrame) -> pd.DataFrame:
    """saved: last tick, motor, tick at which a read began or None."""
    rows = []
    for tick, command in sorted(zip(pdf["tick"], pdf["command"], strict=True)):
        last, motor, began = saved
        late = began is not None and tick - began > READ_TICKS
        if late:
            began = None
        if began is None and last is not None and tick - last > IDLE_TICKS:
            motor = False
        if command in ("motor", "seek", "reset", "read"):
            motor = True
        if command == "read":
            began = tick
        elif command in ("done", "cancel", "reset"):
            began = None
        saved[:] = [int(tick), motor, None if began is None else int(began)]
        rows.append((drive, tick, motor, began is not None, late))
    return pd.DataFrame(rows, columns=["drive", "tick", "motor", "reading", "timed_out"])


def _expired(drive: int, saved: list) -> pd.DataFrame:
    """What a drive does by itself when no command comes: a read gives up, or else its motor stops."""
    last, motor, began = saved
    if began is not None:
        saved[2] = None
        row = (drive, began + READ_TICKS, motor, False, True)
    else:
        saved[1] = False
        row = (drive, last + IDLE_TICKS, False, False, False)
    return pd.DataFrame([row], columns=["drive", "tick", "motor", "reading", "timed_out"])


def drive_states(commands: DataFrame, timers: bool = False) -> DataFrame:
    """drive, tick, motor, reading, timed_out after each command (drive, tick, command). A motor that idles too long has
    stopped, and a read that takes too long has been cancelled, by the next command's tick. On a stream with `timers` the
    same happens to a drive that no command reaches, and is told in a row of its own; such a query runs until it is stopped."""
    rows = commands.select("drive", "tick", "command")
    if not rows.isStreaming:
        return rows.groupBy("drive").applyInPandas(lambda key, pdf: _states(key[0], [None, False, None], pdf), COMMANDS)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else [None, False, None]
        out = _expired(key[0], saved) if state.hasTimedOut else _states(key[0], saved, pd.concat(list(batches)))
        state.update((json.dumps(saved),))
        if timers and (saved[1] or saved[2] is not None):
            state.setTimeoutDuration((READ_TICKS if saved[2] is not None else IDLE_TICKS) // TICKS_A_MS)
        yield out

    return rows.groupBy("drive").applyInPandasWithState(step, COMMANDS, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout)


def as_pulses(events: DataFrame) -> DataFrame:
    """The test table's events as pulses: users are drives, ticks the running sum of 60 to 259 by value, in order of time."""
    from pyspark.sql import Window

    length = F.floor(F.col("value") * 100).cast("long") % 200 + 60
    tick = F.sum(length).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.select(F.col("user_id").alias("drive"), tick.alias("tick"))
