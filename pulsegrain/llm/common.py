"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of a join is broadcast only when its measured size is at most this; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Spark's setting of rows in an Arrow batch, and what the operators make of its default.
ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names; a folder of its own only where that is unset and all run on one
    machine, as in tests. ValueError on a cluster without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("checkpoints"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and cut from its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the folder of checkpoints: for what is larger than a few columns."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`df.mapInArrow`, with the session's Arrow batches cut to BATCH_ROWS where they are at Spark's default of 10000: texts are
    long, and a batch is in memory several times, in the JVM and in the worker."""
    conf = df.sparkSession.conf
    if conf.get(ROWS) == "10000":
        conf.set(ROWS, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df` with a broadcast hint if its counted rows fit BROADCAST_BYTES, else unchanged. Counts `df`: pass it checkpointed."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def pieces(ends: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def joined(data: np.ndarray, ends: np.ndarray, a: int, b: int, gap: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Rows a to b as one buffer, a `gap` byte before each row and one at the end; second, where each row's first byte stands."""
    view = memoryview(data)
    sep = bytes([gap])
    buf = np.frombuffer(sep + sep.join([view[ends[i] : ends[i + 1]] for i in range(a, b)]) + sep, np.uint8)
    return buf, ends[a:b] - ends[a] + 1 + np.arange(b - a)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def binaries(rows: np.ndarray) -> pa.Array:
    """A matrix's rows as binary values."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.dtype.itemsize * int(np.prod(rows.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and its rows' offsets in them; nothing is copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and offsets.size else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def long_rows(ends: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in portions of about `limit` bytes: numbers of the rows, where each part begins in its row, and the bounds of the
    parts in the data (one more than rows). A longer row comes in parts of its own that share `overlap` bytes with the next."""
    for a, b in pieces(ends, limit):
        size = int(ends[b] - ends[a])
        if b - a > 1 or size <= limit + overlap:
            yield np.arange(a, b), np.zeros(b - a, np.int64), ends[a : b + 1]
        else:
            for z in range(0, size - overlap, limit):
                yield np.array([a]), np.array([z]), ends[a] + np.array([z, min(size, z + limit + overlap)])


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 8 << 20) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no run of equal `keys` is cut; each table holds whole runs, several where they are short."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.nbytes for x in held) < limit:
            continue
        got = pa.Table.from_batches(held).combine_chunks()
        columns = [got[k].to_numpy() for k in keys]
        same = np.ones(got.num_rows, bool)
        for c in columns:
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield got.slice(0, cut)
        held = got.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Taken:
    """Stretches of a text that are taken: whether another one touches them, by halving."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start


def hinted(column: pa.Array, hint: str) -> list[tuple[int, str]]:
    """Number and text of the rows in which the pattern occurs: the others never become Python strings."""
    rows = np.flatnonzero(pc.match_substring_regex(column, hint).fill_null(False).to_numpy(zero_copy_only=False))
    return list(zip(rows.tolist(), column.take(pa.array(rows)).to_pylist(), strict=True))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
