"""From recordings to sectors: search, clocks, slices, decoding, pairing, retries over a sweep of loop gains, merging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mfm
from ..functions.checksums import big_endian, crc16_long
from ..functions.signal import clock_fit, decoded_status, mark_type, sector_size
from ..operators.merge import best_of, first_wins
from ..operators.search import band_matches, frames, near_matches, order_matches
from ..operators.sequence import compile_needle, zero_run_lengths
from ..operators.timeline import pair_latest

KEYS = ["image_id", "rec_no", "track", "side"]
#: A header counts for data that begins less than this many bytes later; sectors are this long where no header says so.
TOLERANCE, DEFAULT_LENGTH = 134, 512
#: Bits of zeros before a long sync mark, and the gains that are swept, coarse and fine.
LEAD = 56
COARSE = tuple(np.arange(0.005, 0.5, 0.1).round(3).tolist())
FINE = tuple(np.arange(0.5, 0.995, 0.005).round(3).tolist())


def needles() -> dict[int, tuple[int, list[int]]]:
    return {k: compile_needle(p.tolist()) for k, p in mfm.PREAMBLE.items()}


def bands_of_bits(bits: str) -> list[int]:
    """Bands of a bit string that begins and ends with a 1: zeros between ones, less one."""
    return [len(x) - 1 for x in bits.strip("0").split("1")[1:-1]]


def long_needles() -> dict[int, list[int]]:
    """Bands of either sync mark after seven bytes of zeros."""
    return {k: bands_of_bits("10" * LEAD + v * 3) for k, v in mfm.SYNC.items()}


def preambles(flux: DataFrame) -> DataFrame:
    """KEYS, start, needle_id, intervals, centers of both long sync marks, with the bands as each hit has them."""
    return band_matches(flux, KEYS, "pos", "delay", long_needles())


def corrupted_marks(bands: DataFrame, id_: str, text: str, substitutions: int, inserts: int, deletes: int) -> DataFrame:
    """id, start, end, edits of places in band strings that come near to a record's mark: the first sync mark and the five
    ones that all marks of records begin with."""
    needle = "".join(map(str, bands_of_bits("10" + mfm.SYNC[0] * 3 + mfm.encode(b"\xf8", 1)[:10])))
    return near_matches(bands, id_, text, needle, substitutions, inserts, deletes)


def find_records(flux: DataFrame) -> DataFrame:
    """KEYS, start, needle_id, clock: order matches of either sync mark whose delays fit a clock."""
    found = order_matches(flux, KEYS, "pos", "delay", needles())
    out = None
    for k, bits in mfm.PREAMBLE.items():
        runs = [(b, i == 0) for i, (b, _) in enumerate(zero_run_lengths(bits.tolist())[:-1])] + [(1, False)] * 4
        framed = frames(flux, KEYS, "pos", "delay", len(runs)).select(*KEYS, F.col("pos").alias("start"), "frame")
        fit = found.where(F.col("needle_id") == k).join(framed, [*KEYS, "start"]).withColumn("clock", clock_fit(F.col("frame"), runs)).where("clock IS NOT NULL")
        part = fit.select(*KEYS, "start", "needle_id", "clock")
        out = part if out is None else out.unionByName(part)
    return out


def cut(flux: DataFrame, records: DataFrame) -> DataFrame:
    """KEYS, start, needle_id, clock, delays: each record's delays up to the next record. What stands before the first is left
    out. Delays are labelled by the last start before them, so that nothing is joined by range."""
    marks = flux.join(records.withColumn("pos", F.col("start").cast("long")), [*KEYS, "pos"], "left")
    window = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("start").isNotNull(), F.struct("start", "needle_id", "clock")), ignorenulls=True).over(window)
    rows = marks.select(*KEYS, "pos", "delay", last.alias("m_")).where("m_ IS NOT NULL")
    grouped = rows.groupBy(*KEYS, "m_").agg(F.sort_array(F.collect_list(F.struct("pos", "delay"))).alias("p_"))
    return grouped.select(*KEYS, "m_.start", "m_.needle_id", "m_.clock", F.transform("p_", lambda x: x["delay"]).alias("delays"))


def decode_slices(slices: DataFrame) -> DataFrame:
    """`slices` with data (bytes from the sync mark on), errors (masks) and rmse. With a column alpha, the clock is tracked."""
    shape = "start long, data binary, errors binary, rmse double"
    keep = [c for c in slices.columns if c != "delays"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slices.select(*keep).schema), *shape.split(", ")[1:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            alphas = batch["alpha"] if "alpha" in batch else [None] * len(batch)
            for delays, clock, kind, alpha in zip(batch["delays"], batch["clock"], batch["needle_id"], alphas, strict=True):
                d = np.asarray(delays, np.int64)
                zeros, source, rmse = mfm.quantise(d, clock) if alpha is None else mfm.track(d, clock, alpha)
                bits, _ = mfm.expand(zeros, source)
                at = mfm.find_bits(bits, mfm.PREAMBLE[int(kind)])
                data, errors, _ = mfm.decode(bits[at:]) if at >= 0 else (b"", b"", None)
                out.append((data, errors, rmse))
            yield batch[keep].assign(**dict(zip(("data", "errors", "rmse"), map(list, zip(*out, strict=True)), strict=True))) if out else batch[keep].assign(data=None, errors=None, rmse=None)

    return slices.mapInPandas(run, schema)


def read_marks(decoded: DataFrame) -> DataFrame:
    """`decoded` with kind, header fields, and for data what the header before it says; crc_ok and status for all.

    Data belongs to the latest header that begins less than TOLERANCE bytes before it, whatever that header's checksum; its
    length is the header's, or DEFAULT_LENGTH."""
    data = F.col("data")
    window = Window.partitionBy(*KEYS).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = decoded.withColumn("kind", mark_type(data)).withColumn("byte_at", F.coalesce(F.sum(F.octet_length("data")).over(window), F.lit(0)).cast("long"))
    is_header = F.col("kind") == "IDAM"
    at = lambda i: F.when(is_header & (F.octet_length("data") >= 10), big_endian(data, i + 1, 1).cast("int"))
    rows = rows.withColumns({"h_track": at(4), "h_head": at(5), "h_sector": at(6), "h_length": sector_size(at(7))})
    carried = ["h_track", "h_head", "h_sector", "h_length"]
    paired = pair_latest(rows, KEYS, "byte_at", is_header, ~is_header, carried, TOLERANCE)
    heads = rows.where(is_header).withColumns({f"header_{c}": F.col(c) for c in ["byte_at", *carried]})
    every = heads.unionByName(paired)
    length = F.when(is_header, 8).otherwise(F.coalesce("header_h_length", F.lit(DEFAULT_LENGTH)) + 4)
    enough = F.when(F.col("kind") == "IAM", True).otherwise(F.octet_length("data") >= length + 2)
    every = every.withColumn("n_", length)
    right = crc16_long(F.when(enough, F.col("data").substr(F.lit(1), F.col("n_")))) == big_endian(data, F.col("n_") + 1, 2)
    return every.withColumn("crc_ok", F.when(enough & (F.col("kind") != "UNKNOWN"), right)).withColumn("status", decoded_status(F.col("kind"), F.col("crc_ok"), F.coalesce(enough | (F.col("kind") == "UNKNOWN"), F.lit(False)))).drop("n_")


def sectors(marks: DataFrame) -> DataFrame:
    """track, head, sector, data, deleted, image_id, start of the first valid data of each sector; its header must be valid too.
    Deleted data gives way to other data of the same sector."""
    heads = marks.where("kind = 'IDAM' AND crc_ok").select(*[F.col(k).alias(f"k_{k}") for k in KEYS], F.col("byte_at").alias("k_at"))
    good = marks.where("kind IN ('DAM', 'DDAM') AND crc_ok AND header_h_sector IS NOT NULL")
    good = good.join(heads, [F.col(k) == F.col(f"k_{k}") for k in KEYS] + [F.col("header_byte_at") == F.col("k_at")], "left_semi")
    rows = good.select(F.col("header_h_track").alias("track"), F.col("header_h_head").alias("head"), F.col("header_h_sector").alias("sector"), F.col("data").substr(F.lit(5), F.col("header_h_length")).alias("data"), (F.col("kind") == "DDAM").alias("deleted"), "image_id", "rec_no", "start")
    return first_wins([rows], ["track", "head", "sector"], ["deleted", "image_id", "rec_no", "start"]).drop("rec_no")


def retried(slices: DataFrame, marks: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Decoded slices in which those not right at first are replaced by the gain that reads best: right checksums first, then
    known marks, then the least gain. Each slice is tried with every gain; n_tries tells how many chances a wrong checksum had."""
    spark = slices.sparkSession
    bad = marks.where(F.col("status") != "DECODED_OK").select(*KEYS, "start", F.coalesce("header_h_length", F.lit(DEFAULT_LENGTH)).alias("length"))
    table = F.broadcast(spark.createDataFrame([(float(a),) for a in alphas], "alpha double"))
    tries = decode_slices(slices.join(bad, [*KEYS, "start"]).crossJoin(table))
    kind = mark_type(F.col("data"))
    n = F.when(kind == "IDAM", 8).otherwise(F.col("length") + 4)
    right = F.coalesce(crc16_long(F.col("data").substr(F.lit(1), n)) == big_endian(F.col("data"), n + 1, 2), F.lit(False)) & (kind != "UNKNOWN")
    rated = tries.withColumn("rank_", F.when(right, 0).when(kind != "UNKNOWN", 1).otherwise(2))
    best = best_of(rated, [*KEYS, "start"], ["rank_", "alpha"]).where("rank_ = 0").withColumn("n_tries", F.lit(len(alphas)))
    return best.select(*KEYS, "start", "needle_id", "clock", "data", "errors", "rmse", "alpha", "n_tries")


def recover(spark: SparkSession, flux: DataFrame, alphas: Sequence[float] = (*COARSE, *FINE)) -> tuple[DataFrame, DataFrame]:
    """Sectors and marks from flux (KEYS, pos, delay). Images are merged by the first that has a sector valid."""
    slices = cut(flux, find_records(flux)).persist()
    first = decode_slices(slices).withColumns({"alpha": F.lit(None).cast("double"), "n_tries": F.lit(0)}).persist()
    marks = read_marks(first)
    if alphas:
        again = retried(slices, marks, alphas)
        both = first_wins([again, first], [*KEYS, "start"])
        marks = read_marks(both)
    return sectors(marks), marks


def summary(marks: DataFrame) -> DataFrame:
    """Slices, failures, distinct valid headers, and chances taken on checksums, each at 1 in 65536 to be right by accident."""
    return marks.agg(F.count("*").alias("n_slices"), F.count_if(F.col("status") != "DECODED_OK").alias("n_failed"), F.count_distinct(F.when((F.col("kind") == "IDAM") & F.col("crc_ok"), F.struct("h_track", "h_head", "h_sector"))).alias("n_headers"), (F.sum("n_tries") / 65536).alias("expected_false"))
