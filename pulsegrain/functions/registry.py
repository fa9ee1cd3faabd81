"""Names for SQL: functions on records, and a table function that searches needles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import mfm
from .checksums import crc16_long


@F.pandas_udf(BinaryType())
def inflate(data: pd.Series, compression: pd.Series) -> pd.Series:
    """Bytes of a recording, by how they are stored."""
    return pd.Series([None if d is None else mfm.inflate(bytes(d), int(c)) for d, c in zip(data, compression, strict=True)])


@F.pandas_udf(BinaryType())
def mfm_decode(bits: pd.Series) -> pd.Series:
    """Bytes of a string of 0 and 1, pairs of clock and data bits."""
    return bits.map(lambda b: None if b is None else mfm.decode(np.frombuffer(b.encode(), np.uint8) - 48)[0])


class MatchNeedles:
    """Places (from 0) of a needle in a text, overlapping ones too."""

    def eval(self, text: str, needle: str) -> Iterator[tuple[int]]:
        at = text.find(needle) if text and needle else -1
        while at >= 0:
            yield (at,)
            at = text.find(needle, at + 1)


def register(spark: SparkSession) -> None:
    """crc16, inflate, mfm_decode and the table function match_needles."""
    spark.udf.register("crc16", crc16_long)
    spark.udf.register("inflate", inflate)
    spark.udf.register("mfm_decode", mfm_decode)
    spark.udtf.register("match_needles", F.udtf(MatchNeedles, returnType="idx int"))
