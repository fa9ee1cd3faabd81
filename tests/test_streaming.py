"""Streams must give what the same pulses give as a finished table."""

from __future__ import annotations

import time

import numpy as np

from pulsegrain.functions import mfm
from pulsegrain.streaming import online


def written(spark, tmp_path, rows, shape, parts):
    """Files with ascending ticks, one for each micro-batch."""
    for i, part in enumerate(np.array_split(np.arange(len(rows)), parts)):
        spark.createDataFrame([rows[j] for j in part], shape).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(spark, tmp_path, stream, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name)


def test_sectors_of_a_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    sectors = {i: rng.integers(0, 256, 128, dtype=np.uint8).tobytes() for i in (1, 2, 3)}
    delays = mfm.synthetic_track(6, 1, sectors, 100.0, deleted=(2,))
    rows = [(7, int(t)) for t in np.cumsum(np.concatenate([[0], delays]))]
    batch = spark.createDataFrame(rows, "drive long, tick long")
    want = sorted((r.sector, bytes(r.data), r.deleted) for r in online.online_sectors(batch).collect())
    assert want == [(i, d, i == 2) for i, d in sectors.items()]
    stream = written(spark, tmp_path, rows, "drive long, tick long", 3)
    got = run(spark, tmp_path, online.online_sectors(stream), "sectors_").collect()
    assert sorted((r.sector, bytes(r.data), r.deleted) for r in got) == want


def test_late_data_is_forgotten():
    record = lambda body: mfm.record_bits(mfm.with_crc(body))
    head, data = record(bytes([0xA1, 0xA1, 0xA1, 0xFE, 1, 0, 1, 0])), record(bytes([0xA1, 0xA1, 0xA1, 0xFB]) + bytes(128))
    for gap, found in ((20, 1), (60, 0)):
        machine = online.Sectors()
        bits = mfm.encode(bytes(12)) + head + mfm.encode(b"\x4e" * gap) + mfm.encode(bytes(12)) + data + "01" * 8
        assert sum(machine.feed(b) is not None for b in bits) == found
        assert online.Sectors(machine.state()).state() == machine.state()


def test_loop_limits():
    loop = online.Loop()
    assert loop.feed(100) == 0 and [loop.feed(x) for x in (100, 150, 200, 20)] == [2, 3, 4, 0]
    d = loop.delay
    assert loop.feed(10 * d) == 0 and loop.skip == 5 and [loop.feed(100) for _ in range(5)] == [0] * 5 and loop.feed(100) == 2
    loop = online.Loop(skip=0)
    loop.feed(124)
    assert loop.delay == 112


def test_timers():
    saved = [70, True, 50]
    first, second = (online._expired(3, saved).iloc[0].tolist() for _ in range(2))
    assert first == [3, 50 + online.READ_TICKS, True, False, True] and second == [3, 70 + online.IDLE_TICKS, False, False, False]
    assert saved == [70, False, None]


def test_a_silent_drive(spark, tmp_path):
    stream = online.drive_states(written(spark, tmp_path, [(1, 5, "read")], "drive long, tick long, command string", 1), timers=True)
    query = stream.writeStream.format("memory").queryName("silent_").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    for _ in range(60):
        rows = spark.table("silent_").orderBy("tick").collect()
        if len(rows) >= 3:
            break
        time.sleep(1)
    query.stop()
    assert [(r.tick, r.motor, r.reading, r.timed_out) for r in rows] == [(5, True, True, False), (5 + online.IDLE_TICKS, False, False, False), (5 + online.READ_TICKS, True, False, True)]


def test_drive_commands(spark, tmp_path):
    m = 1_000_000
    rows = [(1, 0, "read"), (1, 150 * m, "seek"), (1, 260 * m, "seek"), (1, 300 * m, "read"), (1, 310 * m, "done"), (1, 420 * m, "status"), (1, 421 * m, "motor")]
    want = [(0, True, True, False), (150 * m, True, True, False), (260 * m, True, False, True), (300 * m, True, True, False), (310 * m, True, False, False), (420 * m, False, False, False), (421 * m, True, False, False)]
    shape = "drive long, tick long, command string"
    got = online.drive_states(spark.createDataFrame(rows, shape)).orderBy("tick").collect()
    assert [(r.tick, r.motor, r.reading, r.timed_out) for r in got] == want
    stream = run(spark, tmp_path, online.drive_states(written(spark, tmp_path, rows, shape, 2)), "states_").orderBy("tick").collect()
    assert [(r.tick, r.motor, r.reading, r.timed_out) for r in stream] == want
