"""Results as files: a dense image with its mask, and slices as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import dense_grid

TRACKS, HEADS, SECTORS, SIZE = 80, 2, 18, 512


def dense_sectors(spark: SparkSession, sectors: DataFrame, tracks: int = TRACKS, heads: int = HEADS, per_track: int = SECTORS, size: int = SIZE, fixed: bool = True) -> DataFrame:
    """track, head, sector, data, mask for every place of the image in its order: as many tracks and sectors as the largest
    number asks for, and these many at least. Missing ones are zeros with mask 0. With `fixed` other lengths are cut or
    filled up to `size`; else they keep their own."""
    last = sectors.agg(F.max("track"), F.max("sector")).first()
    axis = lambda name, a, b: spark.range(a, b).select(F.col("id").cast("int").alias(name))
    axes = [axis("track", 0, max(tracks, (last[0] if last[0] is not None else -1) + 1)), axis("head", 0, heads), axis("sector", 1, max(per_track, last[1] or 0) + 1)]
    zeros = bytes(size)
    found = sectors.select("track", "head", "sector", "data").withColumn("mask", F.unhex(F.repeat(F.lit("FF"), F.octet_length("data"))))
    if fixed:
        fit = lambda c: F.substring(F.concat(c, F.lit(zeros)), 1, size)
        found = found.withColumns({"mask": fit(F.col("mask")), "data": fit(F.col("data"))})
    return dense_grid(axes, found, ["track", "head", "sector"], {"data": bytearray(zeros), "mask": bytearray(zeros)})


def write_image(spark: SparkSession, sectors: DataFrame, prefix: str, **shape) -> None:
    """<prefix>.img and <prefix>.mask on the driver, a partition of rows at a time."""
    rows = dense_sectors(spark, sectors, **shape).orderBy("track", "head", "sector")
    with open(f"{prefix}.img", "wb") as image, open(f"{prefix}.mask", "wb") as mask:
        for r in rows.toLocalIterator():
            image.write(bytes(r.data))
            mask.write(bytes(r.mask))


def missing_report(spark: SparkSession, sectors: DataFrame, tracks: int = TRACKS, heads: int = HEADS, per_track: int = SECTORS) -> DataFrame:
    """track, head, missing: sectors that a track side lacks, null where it has none at all."""
    have = sectors.select("track", "head", "sector").distinct()
    grid = spark.range(tracks).select(F.col("id").cast("int").alias("track")).crossJoin(spark.range(heads).select(F.col("id").cast("int").alias("head")))
    sides = grid.join(have.groupBy("track", "head").agg(F.collect_set("sector").alias("s")), ["track", "head"], "left")
    lost = F.filter(F.sequence(F.lit(1), F.lit(per_track)), lambda i: ~F.array_contains("s", i))
    return sides.select("track", "head", F.when(F.col("s").isNotNull(), lost).alias("missing")).where("missing IS NULL OR size(missing) > 0")


def write_slices(slices: DataFrame, path: str) -> None:
    """Slices with their bytes, masks, delays and bits, by track, side and status; a second run takes the first's place."""
    slices.write.mode("overwrite").partitionBy("track", "side", "status").parquet(path)


def write_stream_of_bytes(slices: DataFrame, order: list[str], prefix: str) -> None:
    """All bytes and all masks of slices, one after the other, in two files."""
    with open(f"{prefix}.dat", "wb") as data, open(f"{prefix}.err", "wb") as errors:
        for r in slices.orderBy(*order).select("data", "errors").toLocalIterator():
            data.write(bytes(r.data or b""))
            errors.write(bytes(r.errors or b""))
