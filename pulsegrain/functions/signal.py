"""Column expressions on intervals, clocks and record headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header types by the first three bytes and the fourth.
TYPES = (
    ("C2C2C2", ("FC", "FE"), "IAM"),
    ("A1A1A1", ("FC", "FD", "FE", "FF"), "IDAM"),
    ("A1A1A1", ("FA", "FB"), "DAM"),
    ("A1A1A1", ("F8", "F9"), "DDAM"),
)
SMALLEST, LARGEST_CODE = 128, 6


def half_clocks(delay: Column, clock: Column | float) -> Column:
    """Delay in halves of a clock, rounded half away from zero."""
    return F.round(F.lit(2.0) * delay / clock).cast("int")


def zeroes(delay: Column, clock: Column | float) -> Column:
    return F.greatest(F.lit(0), half_clocks(delay, clock) - 1)


def sector_size(code: Column) -> Column:
    """128 shifted by the size code, which counts up to 6."""
    return F.call_function("shiftleft", F.lit(SMALLEST), F.least(code.cast("int"), F.lit(LARGEST_CODE)))


def mark_type(header: Column) -> Column:
    """Type of a record by its first four bytes; UNKNOWN where none fits or the record is shorter."""
    h = F.hex(F.substring(header.cast("binary"), 1, 4))
    out = F.lit("UNKNOWN")
    for start, fourth, name in reversed(TYPES):
        out = F.when((F.substring(h, 1, 6) == start) & F.substring(h, 7, 2).isin(*fourth), name).otherwise(out)
    return out


def is_deleted(header: Column) -> Column:
    return mark_type(header) == "DDAM"


def byte_length(kind: Column, length: Column) -> Column:
    """Bytes of a whole record: IDAM 10, IAM 4, DAM and DDAM six and their data; null if unknown."""
    return F.when(kind == "IDAM", 10).when(kind == "IAM", 4).when(kind.isin("DAM", "DDAM"), length + 6)


def decoded_status(kind: Column, crc_ok: Column, long_enough: Column) -> Column:
    """DECODED_OK, DECODED_BAD or DECODED_UNKNOWN by the three-valued verdict, TRUNCATED for a record cut short."""
    ok = F.when(kind == "IAM", True).when(kind != "UNKNOWN", crc_ok)
    return F.when(~long_enough, "TRUNCATED").when(ok, "DECODED_OK").when(~ok, "DECODED_BAD").otherwise("DECODED_UNKNOWN")


def nearest(value: Column, centers: Sequence[float] | Column) -> Column:
    """Struct of distance, band (from 0) and residual of the nearest center; the lower one of two as near."""
    array = centers if isinstance(centers, Column) else F.array(*[F.lit(float(c)) for c in centers])
    return F.array_min(F.transform(array, lambda c, i: F.struct(F.abs(value - c).alias("distance"), i.alias("band"), (value - c).alias("residual"))))


def ranked_centers(value: Column, centers: Sequence[float] | Column) -> Column:
    """Bands by distance, the lower one first of two as near."""
    array = centers if isinstance(centers, Column) else F.array(*[F.lit(float(c)) for c in centers])
    ordered = F.array_sort(F.transform(array, lambda c, i: F.struct(F.abs(value - c).alias("distance"), i.alias("band"))))
    return F.transform(ordered, lambda x: x["band"])


def bands_of(value: Column, intervals: Column) -> Column:
    """Bands that a value may belong to: the one whose interval holds it, else those on either side."""
    inside = F.filter(F.transform(intervals, lambda x, i: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), i.alias("i"))), lambda x: (x["lo"] <= value) & (value <= x["hi"]))
    n = F.size(intervals)
    below = F.size(F.filter(intervals, lambda x: x["hi"] < value))
    return F.when(F.size(inside) > 0, F.transform(inside, lambda x: x["i"])).when(below == 0, F.array(F.lit(0))).when(below == n, F.array(n - 1)).otherwise(F.array(below - 1, below))


def interval_centers(intervals: Column, first_median: Column) -> Column:
    """Centers from sorted intervals: the first is its median, or more where the next interval asks for it; each further one
    mirrors the one before in the middle between its interval and the last."""
    second, one = F.get(intervals, F.lit(1)), F.get(intervals, F.lit(0))
    start = F.coalesce(F.greatest(first_median, second["lo"] + one["hi"] - second["hi"]), first_median).cast("double")
    rest = F.slice(intervals, 2, F.greatest(F.size(intervals) - 1, F.lit(0)))
    zero = F.struct(F.array(start).alias("out"), one["hi"].cast("double").alias("hi"))
    folded = F.aggregate(rest, zero, lambda acc, x: F.struct(F.concat(acc["out"], F.array(x["lo"] + acc["hi"] - F.element_at(acc["out"], -1))).alias("out"), x["hi"].cast("double").alias("hi")))
    return folded["out"]


def valid_centers(intervals: Column, centers: Column) -> Column:
    """Whether for each band after the first 2 hi[i-1] - c[i-1] < c[i] < 2 lo[i] - c[i-1]."""
    n = F.size(centers)
    of = lambda a, i: F.get(a, i)
    return F.when(n < 2, True).otherwise(
        F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (of(intervals, i - 1)["hi"] * 2 - of(centers, i - 1) < of(centers, i)) & (of(centers, i) < of(intervals, i)["lo"] * 2 - of(centers, i - 1)))
    )


def clock_fit(delays: Column, runs: Sequence[tuple[int, bool]]) -> Column:
    """Clock from delays that stand for known runs of zeros, each (run, at least); null without a fit.

    A run of b zeros means a delay from (2 b + 1) / 4 to (2 b + 3) / 4 of a clock, at-least runs bound the clock from above
    only. There is none if a longer run has a delay that is not longer, or if the bounds cross.
    """
    exact: dict[int, list[Column]] = {}
    for i, (b, at_least) in enumerate(runs):
        if not at_least:
            exact.setdefault(b, []).append(F.get(delays, F.lit(i)).cast("double"))
    least = {b: F.least(*v) if len(v) > 1 else v[0] for b, v in exact.items()}
    most = {b: F.greatest(*v) if len(v) > 1 else v[0] for b, v in exact.items()}
    order = sorted(exact)
    grows = F.lit(True)
    for a, b in zip(order, order[1:], strict=False):
        grows = grows & (least[b] > most[a])
    upper = [least[b] * 4 / (2 * b + 1) for b in order] + [F.get(delays, F.lit(i)).cast("double") * 4 / (2 * b + 1) for i, (b, at_least) in enumerate(runs) if at_least]
    lower = [most[b] * 4 / (2 * b + 3) for b in order]
    up, low = F.least(*upper) if len(upper) > 1 else upper[0], F.greatest(*lower) if len(lower) > 1 else lower[0]
    return F.when(grows & (low < up), low * 0.6 + up * 0.4)


def lp_distance(a: Column, b: Column, p: int) -> Column:
    """Lp distance of two arrays of numbers."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(float(p)))), F.lit(0.0), lambda s, x: s + x)
    return F.pow(total, F.lit(1.0 / p))


def lp_distance_fixed(a: Column, b: Column, p: int, unit: int = 1000) -> Column:
    """lp_distance in whole units: differences are cut to units, and so is the root."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.floor(F.abs(x.cast("double") - y.cast("double")) * unit).cast("double"), F.lit(float(p)))), F.lit(0.0), lambda s, x: s + x)
    return F.floor(F.pow(total, F.lit(1.0 / p)) + 1e-9).cast("long")


def stretched(value: Column, amount: float) -> Column:
    """Value made longer by a constant share, cut to whole ticks."""
    return F.floor(value * (1 + amount)).cast("int")


def warped(value: Column, place: Column, low: float, high: float, frequency: float) -> Column:
    """Value with a slow sine from `low` to `high` added, cut to whole ticks."""
    return F.floor(value + low + (F.sin(place * frequency) + 1) / 2 * (high - low)).cast("int")
