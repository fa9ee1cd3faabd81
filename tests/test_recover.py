"""Whole recordings, from files to sectors."""

from __future__ import annotations

import sqlite3
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrain.functions import mfm
from pulsegrain.plans import recover
from pulsegrain.sources import images, recordings

#: Delays of one valid header, and what they hold.
PULSES = [int(x) for x in "23 22 23 22 22 22 23 22 23 22 22 22 23 22 22 22 23 22 22 22 22 22 23 22 23 22 23 22 23 22 23 22 23 22 22 22 23 22 23 22 23 22 23 22 23 22 23 22 23 22 23 22 23 22 23 34 47 34 47 34 22 46 36 45 35 21 47 34 47 34 23 22 23 22 23 22 23 34 23 22 22 22 35 34 23 22 23 22 22 22 23 34 35 22 23 34 47 21 35 22 23 22 23 34 47 22 47 21 35 22 22 35 22 34 35 46 47 34".split()]
HEADER = "A1A1A1FE04010B02D865"


def long_form(spark, records: list[tuple[int, int, int, int, np.ndarray]]):
    rows = [(i, n, t, s, p, int(d)) for i, n, t, s, delays in records for p, d in enumerate(delays)]
    return spark.createDataFrame(rows, "image_id int, rec_no int, track int, side int, pos long, delay int")


def test_needles():
    assert recover.needles() == {0: (2, [-1, 1, -1, -1, 1, -1, 1, -1, -1, 1, -1, 1, -1, -1]), 1: (2, [1, 1, -1, 1, -1, 1, 1, -1, 1, -1, 1, 1, -1, 1])}


def test_golden_header(spark):
    flux = long_form(spark, [(0, 0, 4, 1, PULSES)])
    (found,) = recover.find_records(flux).collect()
    assert (found.start, found.needle_id) == (55, 0) and found.clock == pytest.approx(22.81904761904762)
    (r,) = recover.decode_slices(recover.cut(flux, recover.find_records(flux))).collect()
    assert bytes(r.data).hex().upper().startswith(HEADER) and set(bytes(r.errors)[3:10]) == {0} and all(bytes(r.errors)[:3])


def sample(n: int = 5, size: int = 512, seed: int = 1) -> dict[int, bytes]:
    rng = np.random.default_rng(seed)
    return {i: rng.integers(0, 256, size, dtype=np.uint8).tobytes() for i in range(1, n + 1)}


def test_clean_track_and_merge(spark):
    a, b = sample(5), sample(3, 256, 2)
    damaged = mfm.synthetic_track(3, 0, a).copy()
    damaged[1500:1600] = 23
    flux = long_form(spark, [(0, 0, 3, 0, damaged), (1, 0, 3, 0, mfm.synthetic_track(3, 0, a, deleted=(2,))), (1, 1, 4, 1, mfm.synthetic_track(4, 1, b, 30.0))])
    got, marks = recover.recover(spark, flux, ())
    rows = {(r.track, r.head, r.sector): r for r in got.collect()}
    assert {k: bytes(r.data) for k, r in rows.items()} == {**{(3, 0, i): d for i, d in a.items()}, **{(4, 1, i): d for i, d in b.items()}}
    assert rows[3, 0, 5].image_id == 0 and sum(r.image_id == 1 for r in rows.values()) >= 4
    assert recover.summary(marks).first().n_failed >= 1
    grid = images.dense_sectors(spark, got)
    assert grid.count() == 80 * 2 * 18 and grid.where("octet_length(data) <> 512 OR octet_length(mask) <> 512").count() == 0
    assert grid.where(F.hex(F.substring("mask", 1, 1)) == "FF").count() == 8
    lost = {(r.track, r.head): r.missing for r in images.missing_report(spark, got).collect()}
    assert lost[3, 0] == list(range(6, 19)) and lost[0, 0] is None and len(lost) == 160


def test_long_preambles_and_corrupted_marks(spark):
    delays = mfm.synthetic_track(3, 0, sample(2, 128))
    flux = long_form(spark, [(0, 0, 3, 0, delays)])
    found = recover.preambles(flux).orderBy("start").collect()
    places = [r.start for r in recover.find_records(flux).orderBy("start").collect()]
    # two headers and two data records, each with its sync bytes before the mark, and bands that keep apart
    assert len(found) == len(places) == 4 and all(r.needle_id == 0 and [c for c in r.centers] == sorted(r.centers) and len(r.centers) == 3 for r in found)
    bands = "".join(str(min(2, max(0, round(d / 11.5) - 2))) for d in delays)
    rows = spark.createDataFrame([(1, bands), (2, "0" * 500)], "id int, bands string")
    marks = recover.corrupted_marks(rows, "id", "bands", 0, 0, 0).collect()
    assert {r.id for r in marks} == {1} and len(marks) == 4
    assert len(recover.corrupted_marks(spark.createDataFrame([(1, bands[: marks[0].start + 20] + ("1" if bands[marks[0].start + 20] != "1" else "2") + bands[marks[0].start + 21 :])], "id int, bands string"), "id", "bands", 1, 0, 0).collect()) >= 4


def test_slices_and_bytes_as_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 0, "OK", b"ab", b"\x00\x01"), (1, 1, 0, "BAD", b"c", None), (2, 2, 1, "OK", None, b"")], "n int, track int, side int, status string, data binary, errors binary")
    for _ in range(2):  # a second run takes the first's place
        images.write_slices(rows, str(tmp_path / "slices"))
    back = spark.read.parquet(str(tmp_path / "slices"))
    assert back.count() == 3 and {p.name for p in (tmp_path / "slices").glob("track=1/side=0/*")} == {"status=OK", "status=BAD"}
    images.write_stream_of_bytes(rows, ["n"], str(tmp_path / "all"))
    assert (tmp_path / "all.dat").read_bytes() == b"abc" and (tmp_path / "all.err").read_bytes() == b"\x00\x01"


def test_image_files(spark, tmp_path):
    sectors = spark.createDataFrame([(0, 0, 1, b"ab"), (0, 1, 2, b"xyz!")], "track int, head int, sector int, data binary")
    images.write_image(spark, sectors, str(tmp_path / "out"), tracks=1, per_track=2, size=4)
    assert (tmp_path / "out.img").read_bytes() == b"ab\0\0" + bytes(8) + b"xyz!"
    assert (tmp_path / "out.mask").read_bytes() == b"\xff\xff\0\0" + bytes(8) + b"\xff" * 4


def test_sweep_follows_a_warped_track(spark):
    a = sample(4)
    flat = mfm.synthetic_track(9, 0, a)
    warp = 1 + 0.12 * np.sin(np.arange(len(flat)) / 500)
    flux = long_form(spark, [(0, 0, 9, 0, np.floor(flat * warp + 0.5))])
    plain = {r.sector for r in recover.recover(spark, flux, ())[0].collect()}
    swept, marks = recover.recover(spark, flux, (0.02, 0.05, 0.1, 0.2))
    found = {r.sector: bytes(r.data) for r in swept.collect()}
    assert found == a and len(plain) < len(found)
    assert recover.summary(marks).first().expected_false > 0


def test_codec():
    rng = np.random.default_rng(3)
    delays = rng.integers(1, 300, 500)
    assert (mfm.unpack_delays(mfm.pack_delays(delays)) == delays).all()
    assert mfm.unpack_delays(bytes([5, 63, 63, 4, 0, 9, 63])).tolist() == [130, 0, 9, 63]
    assert mfm.unpack_delays(bytes([63, 63])).tolist() == [] == mfm.unpack_delays(b"").tolist()
    with pytest.raises(ValueError):
        mfm.inflate(b"", 2)
    text = bytes(rng.integers(0, 256, 400, dtype=np.uint8))
    bits = np.frombuffer(mfm.encode(text, 0).encode(), np.uint8) - 48
    data, errors, at = mfm.decode(bits)
    assert data == text and not any(errors) and at[1] == 16


def test_files(spark, tmp_path):
    raw = mfm.pack_delays(np.array(PULSES))
    db = sqlite3.connect(tmp_path / "a.flux")
    with db:
        db.execute("CREATE TABLE zdata (track INTEGER, side INTEGER, data BLOB, compression INTEGER, PRIMARY KEY (track, side))")
        db.executemany("INSERT INTO zdata VALUES (?, ?, ?, ?)", [(4, 1, raw, 0), (5, 0, zlib.compress(raw), 1)])
    db.close()
    (tmp_path / "b.flux").write_bytes(recordings.protobuf_recording([(4, 1, raw), (4, 1, raw[:40]), (7, 0, raw)]))
    got = recordings.read_recordings(spark, [str(tmp_path / "a.flux"), str(tmp_path / "b.flux")])
    assert sorted((r.image_id, r.rec_no, r.track, r.side) for r in got.collect()) == [(0, 0, 4, 1), (0, 1, 5, 0), (1, 0, 4, 1), (1, 1, 4, 1), (1, 2, 7, 0)]
    whole = recordings.flux(got).groupBy("image_id", "rec_no").agg(F.sort_array(F.collect_list(F.struct("pos", "delay"))).alias("p")).collect()
    assert all([x.delay for x in r.p] == PULSES[: len(r.p)] for r in whole) and sum(len(r.p) == len(PULSES) for r in whole) == 4
    assert recordings.read_recordings(spark, [str(tmp_path / "a.flux")], track=5).count() == 1
    spark.dataSource.register(recordings.RecordingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert [r.track for r in spark.read.format("recording_sqlite").load(str(tmp_path / "a.flux")).where("track = 4 AND side = 1").collect()] == [4]
    for _ in range(2):  # the second time the key is there already
        recordings.copy_recordings(spark, str(tmp_path / "a.flux"), str(tmp_path / "c.flux"), 4, 1)
    db = sqlite3.connect(tmp_path / "c.flux")
    assert db.execute("SELECT track, side, data, compression FROM zdata").fetchall() == [(4, 1, raw, 0)]
    assert db.execute("SELECT value FROM properties WHERE key = 'version'").fetchone() == ("3",)
    db.close()
    (tmp_path / "x.au").write_bytes(bytes([1, 127, 0, 0, 127, 127, 5, 127]))
    assert [r.delay for r in recordings.read_audio(spark, [str(tmp_path / "x.au")]).orderBy("pos").collect()] == [2, 0, 1]
