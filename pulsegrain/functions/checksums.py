"""Order-sensitive byte folds: as expressions for short values, and as Arrow functions for long ones."""

from __future__ import annotations

import binascii

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Fixed values of CRC-16 (CCITT, not reflected) and of 32-bit FNV-1a.
CRC_START, CRC_POLYNOMIAL = 0xFFFF, 0x1021
FNV_START, FNV_PRIME = 2166136261, 16777619
WORD = 1 << 32


def byte_array(value: Column) -> Column:
    """Bytes of a binary or string column as integers 0 to 255."""
    h = F.hex(value)
    return F.transform(F.sequence(F.lit(1), F.octet_length(value)), lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def bytes_of(value: Column) -> Column:
    """byte_array, empty for an empty value (a sequence from 1 to 0 counts down)."""
    return F.when(F.octet_length(value) > 0, byte_array(value)).when(value.isNotNull(), F.array().cast("array<int>"))


def crc16(value: Column, start: int = CRC_START) -> Column:
    """CRC-16 by a table of the 256 remainders; null for null."""
    table = F.array(*[F.lit(remainder(i << 8)) for i in range(256)])
    return F.aggregate(bytes_of(value), F.lit(start), lambda crc, b: (crc.bitwiseAND(F.lit(0xFF)) * 256).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(b))))


def remainder(value: int) -> int:
    """What is left of a 16-bit value after eight steps of the division."""
    for _ in range(8):
        value = (value << 1 ^ CRC_POLYNOMIAL if value & 0x8000 else value << 1) & 0xFFFF
    return value


def crc16_bitwise(value: Column, start: int = CRC_START) -> Column:
    """CRC-16 bit by bit, for comparison with the table."""
    one = lambda c: F.when(c.bitwiseAND(F.lit(0x8000)) != 0, (c * 2).bitwiseXOR(F.lit(CRC_POLYNOMIAL))).otherwise(c * 2).bitwiseAND(F.lit(0xFFFF))
    return F.aggregate(bytes_of(value), F.lit(start), lambda crc, b: F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc.bitwiseXOR(b * 256), lambda c, _: one(c)))


@F.pandas_udf(IntegerType())
def crc16_long(value: pd.Series) -> pd.Series:
    """CRC-16 of binary values by the standard library, for long ones."""
    return value.map(lambda b: None if b is None else binascii.crc_hqx(bytes(b), CRC_START)).astype("Int32")


def fnv32(value: Column) -> Column:
    return F.aggregate(bytes_of(value), F.lit(FNV_START), lambda h, b: (h.bitwiseXOR(b.cast("long")) * FNV_PRIME) % WORD)


def poly_hash(value: Column, base: int = 33) -> Column:
    return F.aggregate(bytes_of(value), F.lit(0).cast("long"), lambda h, b: (h * base + b) % WORD)


def big_endian(value: Column, at: int | Column, n: int) -> Column:
    """The n bytes from `at` (1 is the first) as an unsigned number; fewer where the value ends, null where none is left."""
    return F.conv(F.hex(F.substring(value.cast("binary"), at, n) if isinstance(at, int) else value.cast("binary").substr(at, F.lit(n))), 16, 10).cast("long")
