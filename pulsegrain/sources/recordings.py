"""Recordings of media: SQLite and protobuf files, audio, and their writers.

Files come as whole binary values from Spark's own reader, so that any store that Spark reads will do, and are taken apart
in Arrow functions: one file, one task. A row is a recording of one track side: image_id, rec_no, track, side, data,
compression. `image_id` is the place of the file in the sorted list of files.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions.mfm import inflate, unpack_delays

BLOBS = "image_id int, rec_no int, track int, side int, data binary, compression int"
#: First bytes of an SQLite file; field numbers of the protobuf messages; the audio byte that is a pulse.
SQLITE_HEAD, PULSE = b"SQLite format 3\x00", 0x7F
FIELD_TRACK, FIELD_NO, FIELD_HEAD, FIELD_FLUX = 3, 1, 2, 3


def files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """image_id and content of each file, numbered in order of their paths. Only paths are put in order."""
    found = spark.read.format("binaryFile").load(list(paths))
    names = found.select("path").withColumn("image_id", F.row_number().over(Window.orderBy("path")) - 1)
    return found.select("path", "content").join(F.broadcast(names) if names.limit(100_001).count() <= 100_000 else names, "path")


def sqlite_records(content: bytes, track: int | None = None, side: int | None = None) -> list[tuple]:
    """track, side, data, compression of an SQLite recording; the choice of track and side is made by SQLite."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        asked = [(c, v) for c, v in (("track", track), ("side", side)) if v is not None]
        where = " AND ".join(f"{c} = ?" for c, _ in asked)
        return db.execute(f"SELECT track, side, data, compression FROM zdata{' WHERE ' + where if where else ''} ORDER BY track, side", [v for _, v in asked]).fetchall()
    finally:
        db.close()


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: varints, fixed-width numbers as bytes, and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else -1)
            if n < 0 or at + n > len(data):
                raise ValueError("not a protobuf recording")
            yield key >> 3, data[at : at + n]
            at += n


def protobuf_records(content: bytes) -> list[tuple]:
    """A record for each flux value of each track, uncompressed."""
    out = []
    for number, track in fields(content):
        if number == FIELD_TRACK:
            got = list(fields(track))
            no, head = (next((v for n, v in got if n == f), 0) for f in (FIELD_NO, FIELD_HEAD))
            out += [(no, head, v, 0) for n, v in got if n == FIELD_FLUX]
    return out


def protobuf_recording(records: Sequence[tuple[int, int, bytes]]) -> bytes:
    """A protobuf file of (track, head, flux): for tests and copies."""

    def varint(v: int) -> bytes:
        out = bytearray()
        while v >= 0x80:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        return bytes([*out, v])

    sized = lambda n, b: varint(n << 3 | 2) + varint(len(b)) + b
    plain = lambda n, v: varint(n << 3) + varint(v)
    body = b"".join(sized(FIELD_TRACK, plain(FIELD_NO, t) + plain(FIELD_HEAD, h) + sized(FIELD_FLUX, flux)) for t, h, flux in records)
    return plain(1, 0x466C7578) + body


def read_recordings(spark: SparkSession, paths: Sequence[str], track: int | None = None, side: int | None = None) -> DataFrame:
    """All recordings of the files, of either kind, told by their first bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, content in zip(batch["image_id"], batch["content"], strict=True):
                content = bytes(content)
                rows = sqlite_records(content, track, side) if content.startswith(SQLITE_HEAD) else protobuf_records(content)
                kept = [(image, n, *r) for n, r in enumerate(rows) if (track is None or r[0] == track) and (side is None or r[1] == side)]
                yield pd.DataFrame(kept, columns=["image_id", "rec_no", "track", "side", "data", "compression"])

    return files(spark, paths).select("image_id", "content").mapInPandas(run, BLOBS)


@F.pandas_udf(ArrayType(IntegerType()))
def delays(data: pd.Series, compression: pd.Series) -> pd.Series:
    """Delays of a recording's bytes; an unknown compression is an error."""
    return pd.Series([unpack_delays(inflate(bytes(d), int(c))).astype(np.int32) if d is not None else None for d, c in zip(data, compression, strict=True)])


def flux(blobs: DataFrame) -> DataFrame:
    """image_id, rec_no, track, side, pos, delay: the long form of recordings."""
    return blobs.select("image_id", "rec_no", "track", "side", F.posexplode(delays("data", "compression")).alias("pos", "delay")).withColumn("pos", F.col("pos").cast("long"))


def read_audio(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """image_id, pos, delay: samples between successive pulses of raw audio, header included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, content in zip(batch["image_id"], batch["content"], strict=True):
                at = np.flatnonzero(np.frombuffer(bytes(content), np.uint8) == PULSE)
                yield pd.DataFrame({"image_id": np.int32(image), "pos": np.arange(max(0, len(at) - 1)), "delay": (np.diff(at) - 1).astype(np.int32)})

    return files(spark, paths).select("image_id", "content").mapInPandas(run, "image_id int, pos long, delay int")


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("track",), ("side",)) and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = int(f.value)
            else:
                yield f

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            rows = sqlite_records(f.read(), self.wanted.get("track"), self.wanted.get("side"))
        for t, s, data, compression in rows:
            yield t, s, data, compression


class _Writer(DataSourceWriter):
    """Tasks leave their rows beside the target; commit puts them into one transaction, abort removes them. A row whose key is
    there already is left out and told in the log."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows):
        handle, name = tempfile.mkstemp(prefix=os.path.basename(self.path), suffix=".part", dir=os.path.dirname(os.path.abspath(self.path)))
        os.close(handle)
        db = sqlite3.connect(name)
        with db:
            db.execute("CREATE TABLE part (track INTEGER, side INTEGER, data BLOB, compression INTEGER)")
            db.executemany("INSERT INTO part VALUES (?, ?, ?, ?)", ((r["track"], r["side"], bytes(r["data"]), r["compression"]) for r in rows))
        db.close()
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages):
        db = sqlite3.connect(self.path)
        with db:
            # fixed values: the tables of the file format
            db.execute("CREATE TABLE IF NOT EXISTS zdata (track INTEGER, side INTEGER, data BLOB, compression INTEGER, PRIMARY KEY (track, side))")
            db.execute("CREATE TABLE IF NOT EXISTS properties (key TEXT UNIQUE NOT NULL PRIMARY KEY, value TEXT)")
            db.execute("INSERT OR IGNORE INTO properties VALUES ('version', '3')")
            for m in messages:
                part = sqlite3.connect(m.name)
                for row in part.execute("SELECT track, side, data, compression FROM part"):
                    if not db.execute("INSERT OR IGNORE INTO zdata VALUES (?, ?, ?, ?)", row).rowcount:
                        print(f"track {row[0]} side {row[1]} is there already")
                part.close()
        db.close()
        self.abort(messages)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)


class RecordingSource(DataSource):
    """`recording_sqlite`: an SQLite recording in a folder that driver and executors share, with track and side pushed into
    SQLite (where spark.sql.python.filterPushdown.enabled is set) and a writer that adds rows in one transaction."""

    @classmethod
    def name(cls) -> str:
        return "recording_sqlite"

    def schema(self) -> str:
        return "track int, side int, data binary, compression int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def copy_recordings(spark: SparkSession, source: str, target: str, track: int, side: int) -> None:
    """Copies the recordings of a track side unchanged from one SQLite file to another."""
    spark.dataSource.register(RecordingSource)
    rows = read_recordings(spark, [source], track, side).select("track", "side", "data", "compression")
    rows.write.format("recording_sqlite").mode("append").save(target)
