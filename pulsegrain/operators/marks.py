"""Records on a track: headers and data, built and parsed as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checksums import big_endian, crc16
from ..functions.signal import sector_size

MARK = "A1A1A1"


def _byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def header_bytes(track: Column, head: Column, sector: Column, code: Column) -> Column:
    """The eight bytes of a header before its checksum."""
    return F.concat(F.unhex(F.lit(f"{MARK}FE")), _byte(track), _byte(head), _byte(sector), _byte(code))


def with_crc(raw: Column) -> Column:
    return F.concat(raw, F.unhex(F.lpad(F.hex(crc16(raw)), 4, "0")))


def index_bytes() -> Column:
    """An index record, which has no checksum."""
    return F.unhex(F.lit("C2C2C2FC"))


def data_bytes(data: Column, deleted: bool = False) -> Column:
    return F.concat(F.unhex(F.lit(f"{MARK}{'F8' if deleted else 'FB'}")), data)


def parse_header(raw: Column) -> Column:
    """Struct of track, head, sector, datalen, crc, crc_ok from a header's ten bytes; null from fewer."""
    at = lambda i: big_endian(raw, i + 1, 1).cast("int")
    crc = big_endian(raw, 9, 2).cast("int")
    fields = F.struct(at(4).alias("track"), at(5).alias("head"), at(6).alias("sector"), sector_size(at(7)).alias("datalen"), crc.alias("crc"), (crc16(F.substring(raw, 1, 8)) == crc).alias("crc_ok"))
    return F.when(F.octet_length(raw) >= 10, fields)


def parse_data(raw: Column, length: Column) -> Column:
    """Struct of data, crc, crc_ok, deleted from a data record of known length; null where it is cut short."""
    n = length.cast("int")
    crc = big_endian(raw, n + 5, 2).cast("int")
    data = raw.substr(F.lit(5), n)
    fields = F.struct(data.alias("data"), crc.alias("crc"), (crc16(raw.substr(F.lit(1), n + 4)) == crc).alias("crc_ok"), F.hex(F.substring(raw, 4, 1)).isin("F8", "F9").alias("deleted"))
    return F.when(F.octet_length(raw) >= n + 6, fields)


def parse_data_of_unknown_length(raw: Column, lengths: Sequence[int] = (1024, 512, 256, 128)) -> Column:
    """parse_data with the first length that gives a right checksum; null if none does."""
    tries = [parse_data(raw, F.lit(n)) for n in lengths]
    return F.coalesce(*[F.when(F.coalesce(t["crc_ok"], F.lit(False)), t) for t in tries])
