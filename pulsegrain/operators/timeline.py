"""Slices of records: cutting at matches, splitting, pairing of headers with data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import nearest
from .merge import upsert
from .sequence import record


def slices(matches: DataFrame, totals: DataFrame, keys: Sequence[str], start: str, total: str, shortest: int = 50) -> DataFrame:
    """keys, slice_no, flux_begin, flux_end, status. Each match owns what follows up to the next; what precedes the first is a
    slice too, numbered 0, if there is any. A slice of fewer than `shortest` values is TRUNCATED, a match's other PREAMBLE_FOUND."""
    window = record(keys, start)
    own = matches.select(*keys, start).distinct().join(totals.select(*keys, total), list(keys))
    own = own.select(*keys, F.row_number().over(window).cast("long").alias("slice_no"), F.col(start).cast("long").alias("flux_begin"), F.lead(start, 1).over(window).alias("next_"), total)
    own = own.select(*keys, "slice_no", "flux_begin", F.coalesce("next_", total).cast("long").alias("flux_end"))
    first = own.groupBy(*keys).agg(F.min("flux_begin").alias("first_"))
    lead = totals.join(first, list(keys), "left").select(*keys, F.lit(0).cast("long").alias("slice_no"), F.lit(0).cast("long").alias("flux_begin"), F.coalesce("first_", total).cast("long").alias("flux_end")).where("flux_end > 0")
    every = lead.unionByName(own)
    status = F.when(F.col("flux_end") - F.col("flux_begin") < shortest, "TRUNCATED").when(F.col("slice_no") == 0, "UNKNOWN").otherwise("PREAMBLE_FOUND")
    return every.withColumn("status", status)


def split(df: DataFrame, begin: str, end: str, at: str, status: str, keep: str = "first") -> DataFrame:
    """Rows cut in two at `at`, where it lies inside; `part` is 0 for the head and 1 for the tail. keep says which part holds
    the status (first, last, neither); the other becomes UNKNOWN."""
    if keep not in ("first", "last", "neither"):
        raise ValueError("keep must be first, last or neither")
    inside = F.col(at).isNotNull() & (F.col(at) > F.col(begin)) & (F.col(at) < F.col(end))
    of = lambda p: F.col(status) if keep == p else F.lit("UNKNOWN")
    head = F.struct(F.lit(0).alias("part"), F.col(begin).alias("b"), F.col(at).cast(df.schema[end].dataType).alias("e"), of("first").alias("s"))
    tail = F.struct(F.lit(1).alias("part"), F.col(at).cast(df.schema[begin].dataType).alias("b"), F.col(end).alias("e"), of("last").alias("s"))
    whole = F.struct(F.lit(0).alias("part"), F.col(begin).alias("b"), F.col(end).alias("e"), F.col(status).alias("s"))
    rows = df.withColumn("p_", F.explode(F.when(inside, F.array(head, tail)).otherwise(F.array(whole))))
    return rows.withColumns({begin: F.col("p_.b"), end: F.col("p_.e"), status: F.col("p_.s"), "part": F.col("p_.part")}).drop("p_")


def slice_id(*columns: str) -> Column:
    """A number for a slice that depends on its record and place alone."""
    return F.xxhash64(*columns)


def rebase(array: Column) -> Column:
    """Array less its first value."""
    return F.transform(array, lambda x: x - F.get(array, F.lit(0)))


def joined_trains(a: Column, b: Column, gap: Column) -> Column:
    """Two bit arrays that follow each other (index gap 0 or 1), their common 1 at the seam taken once; an error otherwise."""
    seam = (F.element_at(a, -1) == 1) & (F.get(b, F.lit(0)) == 1)
    return F.when(~gap.between(0, 1), F.raise_error(F.lit("trains are not adjacent")).cast("array<int>")).otherwise(F.concat(a, F.when(seam, F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0)))).otherwise(b)))


def pair_latest(df: DataFrame, keys: Sequence[str], pos: str, is_header: Column, is_data: Column, carried: Sequence[str], tolerance: int) -> DataFrame:
    """Data rows with the latest header before them (its columns as header_<name>) if it lies less than `tolerance` back, else nulls."""
    window = record(keys, pos).rowsBetween(Window.unboundedPreceding, -1)
    header = F.last(F.when(is_header, F.struct(*dict.fromkeys([pos, *carried]))), ignorenulls=True).over(window)
    rows = df.withColumn("h_", header).where(is_data)
    near = F.col(pos) - F.col(f"h_.{pos}") < tolerance
    return rows.withColumns({f"header_{c}": F.when(near, F.col(f"h_.{c}")) for c in dict.fromkeys([pos, *carried])}).drop("h_")


def pair_adjacent(df: DataFrame, keys: Sequence[str], pos: str, is_header: Column, is_data: Column, carried: Sequence[str]) -> DataFrame:
    """Data rows whose very predecessor is a header, with its columns as header_<name>."""
    window = record(keys, pos)
    before = F.lag(F.struct(is_header.alias("is_"), *dict.fromkeys([pos, *carried]))).over(window)
    rows = df.withColumn("h_", before).where(is_data & F.coalesce(F.col("h_.is_"), F.lit(False)))
    return rows.withColumns({f"header_{c}": F.col(f"h_.{c}") for c in dict.fromkeys([pos, *carried])}).drop("h_")


def stitched_bands(df: DataFrame, marks: DataFrame, keys: Sequence[str], pos: str, value: str, start: str, centers: str, fallback: Sequence[float]) -> DataFrame:
    """Each row with the band of its value among the centers of the last mark at or before it; before the first mark the
    fallback counts. Marks come by equality of places and are carried on by a window, so that nothing is joined by range."""
    placed = marks.select(*keys, F.col(start).alias(pos), F.col(centers).alias("c_"))
    rows = df.join(placed, [*keys, pos], "left")
    window = record(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c_", F.coalesce(F.last("c_", ignorenulls=True).over(window), F.array(*[F.lit(float(c)) for c in fallback])))
    return rows.withColumn("band", nearest(F.col(value), F.col("c_"))["band"]).drop("c_")


def upsert_headers(chunks: DataFrame, found: DataFrame, keys: Sequence[str], end: str, start: str, ok: str) -> DataFrame:
    """Chunks with headers found by other means: one takes the place of a chunk with the same end that is not valid, is left
    out beside a valid one, and is added where there is none. Order is by `start`."""
    return upsert(chunks, found, [*keys, end], ok).orderBy(*keys, start)
