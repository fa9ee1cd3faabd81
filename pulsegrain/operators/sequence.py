"""Operators along ordered records. `keys` name a record, `pos` orders it; windows never leave a record."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.signal import half_clocks


def record(keys: Sequence[str], pos: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(pos)


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def ordinal(df: DataFrame, keys: Sequence[str], pos: str, value: str, padding: bool = True, out: str = "sign") -> DataFrame:
    """Sign of each value's difference from the one before. With padding the first row has 0; without, it goes."""
    sign = F.signum((F.col(value) - F.lag(value).over(record(keys, pos))).cast("double")).cast("int")
    rows = df.withColumn(out, F.coalesce(sign, F.lit(0)) if padding else sign)
    return rows if padding else rows.where(F.col(out).isNotNull())


def increases(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str = "increase") -> DataFrame:
    """Whether each value but the first is larger than the one before; equal ones are not."""
    return df.withColumn(out, F.col(value) > F.lag(value).over(record(keys, pos))).where(F.col(out).isNotNull())


def pulse_gaps(df: DataFrame, keys: Sequence[str], pos: str, is_pulse, out: str = "gap") -> DataFrame:
    """Rows that are pulses, after the first of a record, with how many rows stand between one and the one before."""
    rows = df.where(is_pulse)
    return rows.withColumn(out, F.col(pos) - F.lag(pos).over(record(keys, pos)) - 1).where(F.col(out).isNotNull())


def decode_delays(df: DataFrame, keys: Sequence[str], pos: str, byte: str, most: int = 63) -> DataFrame:
    """keys, pos and delay from bytes of which `most` means: add and go on. The first value of a record is dropped; so is
    what is left at the end if it is zero or nothing came before."""
    window = record(keys, pos)
    value = F.col(byte).bitwiseAND(F.lit(most))
    rows = df.withColumn("v_", value).withColumn("group_", F.coalesce(F.sum((F.col("v_") != most).cast("long")).over(_before(window)), F.lit(0)))
    sums = rows.groupBy(*keys, "group_").agg(F.sum("v_").cast("long").alias("delay"), F.bool_or(F.col("v_") != most).alias("whole_"))
    return sums.where((F.col("group_") > 0) & (F.col("whole_") | (F.col("delay") > 0))).select(*keys, (F.col("group_") - 1).alias("pos"), "delay")


def quantised(df: DataFrame, value: str, clock: float) -> DataFrame:
    """Rows with at least one zero, and how many (`zeroes`): half clocks less one. What is dropped is not carried on."""
    return df.withColumn("zeroes", F.greatest(F.lit(0), half_clocks(F.col(value), clock) - 1)).where("zeroes > 0")


def expand_bits(df: DataFrame, keys: Sequence[str], pos: str, zeroes: str = "zeroes") -> DataFrame:
    """keys, bit_pos, bit, flux_idx: a leading 1 for each record, then each row's zeros and a 1, with the row they come from."""
    start = F.coalesce(F.sum(F.col(zeroes) + 1).over(_before(record(keys, pos))), F.lit(0)) + 1
    rows = df.withColumn("start_", start).withColumn("i_", F.explode(F.sequence(F.lit(0), F.col(zeroes))))
    bits = rows.select(*keys, (F.col("start_") + F.col("i_")).alias("bit_pos"), (F.col("i_") == F.col(zeroes)).cast("int").alias("bit"), F.col(pos).alias("flux_idx"))
    lead = df.groupBy(*keys).agg(F.min(pos).alias("flux_idx")).select(*keys, F.lit(0).cast("long").alias("bit_pos"), F.lit(1).alias("bit"), "flux_idx")
    return lead.unionByName(bits)


def zero_runs(df: DataFrame, keys: Sequence[str], pos: str, bit: str) -> DataFrame:
    """keys, run_no, run_len, at_least: lengths of the runs of zeros between ones. The run before the first 1 and the one
    after the last are cut off by the record's ends, so that their lengths are bounds."""
    ones = F.coalesce(F.sum(bit).over(_before(record(keys, pos))), F.lit(0))
    rows = df.withColumn("run_no", ones)
    total = F.sum(bit).over(Window.partitionBy(*keys))
    rows = rows.withColumn("ones_", total)
    runs = rows.groupBy(*keys, "run_no", "ones_").agg(F.sum(1 - F.col(bit)).cast("long").alias("run_len"))
    return runs.select(*keys, "run_no", "run_len", ((F.col("run_no") == 0) | (F.col("run_no") == F.col("ones_"))).alias("at_least"))


def bands_from_bits(df: DataFrame, keys: Sequence[str], pos: str, bit: str, most: int = 3) -> DataFrame:
    """keys, pos and band: distance between ones, less two. A record must begin with a 1 and keep runs from 1 to `most`."""
    window = record(keys, pos)
    first = F.first(bit).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = df.withColumn("first_", first).withColumn("checked_", F.assert_true(F.col("first_") == 1, F.lit("a record must begin with a 1")))
    rows = rows.where((F.col(bit) == 1) & F.col("checked_").isNull()).withColumn("band", F.lead(pos).over(window) - F.col(pos) - 2)
    rows = rows.where("band IS NOT NULL").withColumn("checked_", F.assert_true(F.col("band").between(0, most - 1), F.lit("a run of zeros is out of range")))
    return rows.where("checked_ IS NULL").select(*keys, pos, "band")


def running_offsets(df: DataFrame, keys: Sequence[str], order: str, length: str, out: str = "begin") -> DataFrame:
    """Where each part begins if the parts of a record follow each other."""
    return df.withColumn(out, F.coalesce(F.sum(length).over(_before(record(keys, order))), F.lit(0)).cast("long"))


def bits_to_bytes(df: DataFrame, keys: Sequence[str], pos: str, bit: str, error: str | None = None) -> DataFrame:
    """keys, byte_pos, byte, err_mask: eight bits each, the first one highest; an incomplete last group is dropped."""
    place = F.element_at(F.array(*[F.lit(1 << (7 - i)) for i in range(8)]), (F.col(pos) % 8 + 1).cast("int"))
    mask = F.sum(F.col(error) * place) if error else F.lit(0)
    rows = df.groupBy(*keys, F.floor(F.col(pos) / 8).cast("long").alias("byte_pos")).agg(F.sum(F.col(bit) * place).cast("int").alias("byte"), mask.cast("int").alias("err_mask"), F.count("*").alias("n_"))
    return rows.where("n_ = 8").drop("n_")


def mfm_decode(df: DataFrame, keys: Sequence[str], pos: str, bit: str) -> DataFrame:
    """keys, bit_pos, bit, error from pairs of clock and data bits: the data bit is the pair's second. A clock bit is wrong
    unless it is set exactly between two zeros; in a record's first pair it is never held wrong. 11 is no pair: null. A last
    half pair is dropped."""
    pairs = df.groupBy(*keys, F.floor(F.col(pos) / 2).cast("long").alias("bit_pos")).agg(F.max(F.when(F.col(pos) % 2 == 0, F.col(bit))).alias("clock_"), F.max(F.when(F.col(pos) % 2 == 1, F.col(bit))).alias("data_"))
    pairs = pairs.where("data_ IS NOT NULL")
    before = F.lag("data_").over(record(keys, "bit_pos"))
    want = F.when((F.col("data_") == 0) & (before == 0), 1).otherwise(0)
    wrong = F.when(before.isNull() | (F.col("clock_") + F.col("data_") == 2), 0).otherwise((F.col("clock_") != want).cast("int"))
    return pairs.select(*keys, "bit_pos", F.when(F.col("clock_") + F.col("data_") < 2, F.col("data_")).cast("int").alias("bit"), wrong.alias("error"))


def mfm_encode(df: DataFrame, keys: Sequence[str], pos: str, bit: str) -> DataFrame:
    """keys, bit_pos, bit: two for each data bit, the clock bit set between two zeros only. A record's first bit has a 1 before it."""
    before = F.coalesce(F.lag(bit).over(record(keys, pos)), F.lit(1))
    rows = df.withColumn("clock_", ((F.col(bit) == 0) & (before == 0)).cast("int"))
    both = rows.withColumn("pair_", F.array(F.struct(F.lit(0).alias("i"), F.col("clock_").alias("b")), F.struct(F.lit(1).alias("i"), F.col(bit).cast("int").alias("b"))))
    return both.select(*keys, pos, F.inline("pair_")).select(*keys, (F.col(pos) * 2 + F.col("i")).alias("bit_pos"), F.col("b").alias("bit"))


def zero_run_lengths(bits: Iterable[int]) -> list[tuple[int, bool]]:
    """Runs of zeros of a fixed pattern, with whether each is only a lower bound: the first and the last are."""
    text = "".join(map(str, bits))
    parts = text.split("1")
    return [(len(p), i in (0, len(parts) - 1)) for i, p in enumerate(parts)]


def compile_needle(bits: Iterable[int]) -> tuple[int, list[int]]:
    """Offset and signs of the order pattern that a bit pattern leaves in delays. Bounds are left out at both ends, and the
    first run counts as one at least; ValueError for fewer than two ones or equal neighbours."""
    bits = list(bits)
    if sum(bits) < 2:
        raise ValueError("a pattern needs two ones at least")
    runs = zero_run_lengths(bits)
    exact = [i for i, (_, at_least) in enumerate(runs) if not at_least]
    # a trailing run without a zero says nothing; a leading one neither
    values = [runs[i][0] for i in exact]
    signs = [(b > a) - (b < a) for a, b in zip(values, values[1:], strict=False)]
    if 0 in signs:
        raise ValueError("neighbouring runs are equal, which leaves their order open")
    return exact[0] + 1, signs


def wildcard_needle(delays: Sequence[int]) -> tuple[int, list[bool]]:
    """How many leading differences are zero, and of the rest whether each increases; ValueError for a zero later on."""
    diffs = [b - a for a, b in zip(delays, delays[1:], strict=False)]
    wild = next((i for i, d in enumerate(diffs) if d), len(diffs))
    if 0 in diffs[wild:]:
        raise ValueError("equal delays inside of a pattern")
    return wild, [d > 0 for d in diffs[wild:]]
