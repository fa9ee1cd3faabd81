"""Views of the test tables as ordered signals, in Spark and as DuckDB text.

pulses: each user's events in order of time, with an interval of 10 to 59 ticks from the event's value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["user_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths() -> Column:
    return F.floor(F.col("value") * 100).cast("long")


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos, delay, event_id, event_type, raw (hundredths of the value), k (from the properties)."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", pos.alias("pos"), hundredths().alias("raw"), "event_id", "event_type", k.alias("k"))
    return rows.withColumn("delay", (F.col("raw") % 50 + 10).cast("int"))


PULSES = """pulses AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CAST(floor(value * 100) AS BIGINT) AS raw, CAST(10 + CAST(floor(value * 100) AS BIGINT) % 50 AS INT) AS delay, event_id, event_type,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos, bit: a 1, then each pulse's parity."""
    rows = pulses(spark, sf_dir).select("user_id", (F.col("pos") + 1).alias("pos"), (F.col("delay") % 2).alias("bit"))
    lead = rows.select("user_id").distinct().select("user_id", F.lit(0).cast("long").alias("pos"), F.lit(1).alias("bit"))
    return lead.unionByName(rows)


BITS = """bits AS (SELECT user_id, pos + 1 AS pos, delay % 2 AS bit FROM pulses UNION ALL SELECT DISTINCT user_id, 0, 1 FROM pulses)"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pulses with a band from 0 to 2 by thirds of the range of delays."""
    return pulses(spark, sf_dir).withColumn("band", F.least(F.lit(2), F.floor((F.col("delay") - 10) / 17).cast("int")))


BANDS = "bands AS (SELECT *, CAST(least(2, floor((delay - 10) / 17.0)) AS INT) AS band FROM pulses)"
