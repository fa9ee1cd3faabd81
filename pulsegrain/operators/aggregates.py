"""Aggregations over records and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import half_clocks
from .sequence import ordinal, record


def quantisation_error(df: DataFrame, keys: Sequence[str], value: str, clock: float) -> DataFrame:
    """Root of the mean squared distance from the nearest half clock; every row counts."""
    e = F.col(value) - half_clocks(F.col(value), clock) * (clock / 2)
    return df.groupBy(*keys).agg(F.sqrt(F.sum(e * e) / F.count("*")).alias("rmse"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(value).alias("median"))


def midrange(df: DataFrame, keys: Sequence[str], value: str, trim: float) -> DataFrame:
    """Mean of the quantiles at trim and 1 - trim, interpolated."""
    return df.groupBy(*keys).agg(((F.percentile(value, trim) + F.percentile(value, 1 - trim)) / 2).alias("midrange"))


def estimated_period(df: DataFrame, keys: Sequence[str], pos: str, value: str, length: int, fewest: int, least: float) -> DataFrame:
    """keys and period: median over order snippets of `length` signs of the median distance between a snippet's places, of
    those with `fewest` places at least and a median above `least`."""
    coded = ordinal(df, keys, pos, value)
    window = record(keys, pos)
    snippet = F.concat_ws(",", *[F.lead("sign", i).over(window) for i in range(length)])
    rows = coded.withColumn("snippet_", snippet).withColumn("last_", F.lead("sign", length - 1).over(window)).where("last_ IS NOT NULL")
    gap = F.col(pos) - F.lag(pos).over(Window.partitionBy(*keys, "snippet_").orderBy(pos))
    medians = rows.withColumn("gap_", gap).groupBy(*keys, "snippet_").agg(F.count("*").alias("n_"), F.median("gap_").alias("m_")).where((F.col("n_") >= fewest) & (F.col("m_") > least))
    return medians.groupBy(*keys).agg(F.median("m_").alias("period"))


def coverage(df: DataFrame, keys: Sequence[str], begin: str, end: str, total: Column) -> DataFrame:
    """Share of a record that its parts cover."""
    return df.groupBy(*keys).agg((F.sum(F.col(end) - F.col(begin)) / total).alias("coverage"))


def band_intervals(df: DataFrame, keys: Sequence[str], band: str, value: str) -> DataFrame:
    """keys and intervals (lo, hi by band); null if a band's largest value reaches the next one's least."""
    bands = df.groupBy(*keys, band).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    window = Window.partitionBy(*keys).orderBy(band)
    bands = bands.withColumn("clash_", F.coalesce(F.col("hi") >= F.lead("lo").over(window), F.lit(False)))
    found = bands.groupBy(*keys).agg(F.bool_or("clash_").alias("clash_"), F.sort_array(F.collect_list(F.struct(band, "lo", "hi"))).alias("all_"))
    return found.select(*keys, F.when(~F.col("clash_"), F.transform("all_", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))).alias("intervals"))


def band_centers(df: DataFrame, keys: Sequence[str], band: str, value: str, trim: float | None = None) -> DataFrame:
    """Center and number of each band's values, which may come from several hits: the median, or the middle of the quantiles at
    `trim` and 1 - trim."""
    center = F.median(value) if trim is None else (F.percentile(value, trim) + F.percentile(value, 1 - trim)) / 2
    return df.groupBy(*keys, band).agg(center.alias("center"), F.count("*").alias("n"))


def valid_fraction(df: DataFrame, keys: Sequence[str], ok: str) -> DataFrame:
    """Counts of valid and invalid rows, and the valid share; rows without a verdict count in neither, and no rows give null."""
    good, bad = F.count_if(F.col(ok)), F.count_if(~F.col(ok))
    return df.groupBy(*keys).agg(good.alias("n_valid"), bad.alias("n_invalid"), F.try_divide(good, good + bad).alias("fraction"))


def first_valid(df: DataFrame, keys: Sequence[str], order: str, ok: str, field: str) -> DataFrame:
    return df.where(F.col(ok)).groupBy(*keys).agg(F.min_by(field, order).alias(field))


def weighted_cdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with running counts and sums. The histogram is made first; only distinct values are put in order."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    window = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(*keys, value, F.sum("n").over(window).alias("cum_count"), F.sum(F.col("n") * F.col(value)).over(window).alias("cum_sum"))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median from the histogram, the mean of the two middle values for an even count."""
    hist = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return hist.groupBy(*keys).agg(F.percentile(value, 0.5, F.col("n")).alias("median"))


def residual_sum(df: DataFrame, keys: Sequence[str], value: str, centers: Sequence[float]) -> DataFrame:
    least = F.least(*[F.abs(F.col(value) - float(c)) for c in centers])
    return df.groupBy(*keys).agg(F.sum(least).alias("residual_sum"))


def distinct_valid(df: DataFrame, keys: Sequence[str], ok: str, sector: str) -> DataFrame:
    """Distinct valid keys, distinct keys, failures, and the larger of the count of valid ones and their largest number."""
    valid = F.when(F.col(ok), F.struct(*keys, sector))
    return df.agg(
        F.count_distinct(valid).alias("n_ok"), F.count_distinct(F.struct(*keys, sector)).alias("n_keys"), F.count_if(~F.col(ok)).alias("n_failed"), F.greatest(F.count_distinct(valid), F.max(F.when(F.col(ok), F.col(sector)))).alias("n_sectors")
    )
