"""The bit code in numpy: pulses to bits to bytes and back, for Arrow functions over whole slices."""

from __future__ import annotations

import binascii
import zlib

import numpy as np

#: Sync words with a missing clock bit, three of which and the next 01 open a record.
SYNC = {0: "0100010010001001", 1: "0101001000100100"}
PREAMBLE = {k: np.frombuffer((v * 3 + "01").encode(), np.uint8) - 48 for k, v in SYNC.items()}
MARK_BYTE = {0: 0xA1, 1: 0xC2}
#: How a record is stored: 0 raw, 1 zlib; six bits count, 63 goes on.
RAW, ZLIB, GO_ON = 0, 1, 63


def inflate(data: bytes, compression: int) -> bytes:
    if compression == RAW:
        return data
    if compression == ZLIB:
        return zlib.decompress(data)
    raise ValueError(f"unknown compression {compression}")


def unpack_delays(data: bytes) -> np.ndarray:
    """Delays of a recording: bytes add up until one is less than 63; the first sum is dropped, a zero left at the end too."""
    v = (np.frombuffer(data, np.uint8) & GO_ON).astype(np.int64)
    ends = np.flatnonzero(v != GO_ON)
    if not len(ends):
        return np.zeros(0, np.int64)
    sums = np.diff(np.concatenate([[0], np.cumsum(v)[ends]]))[1:]
    rest = int(v[ends[-1] + 1 :].sum())
    return np.append(sums, rest) if rest else sums


def pack_delays(delays: np.ndarray) -> bytes:
    """The inverse, with a leading value to be dropped."""
    out = bytearray([1])
    for d in delays:
        out += bytes([GO_ON]) * (int(d) // GO_ON) + bytes([int(d) % GO_ON])
    return bytes(out)


def quantise(delays: np.ndarray, clock: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros before each 1, the delays they come from, and the root mean squared error over all delays."""
    h = np.floor(2 * delays / clock + 0.5).astype(np.int64)
    keep = np.flatnonzero(h > 1)
    error = float(np.sqrt(np.mean((delays - h * clock / 2) ** 2))) if len(delays) else 0.0
    return h[keep] - 1, keep, error


def track(delays: np.ndarray, clock: float, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
    """quantise with a loop that follows the clock: see folds.tracked."""
    start = half = clock / 2
    zeros, keep, squares = [], [], 0.0
    for i, d in enumerate(delays.tolist()):
        h = int(d / half + 0.5)
        if 1 <= h <= 4:
            squares += (d - h * half) ** 2
            half = max(0.75 * start, min(2.25 * start, half * (1 - alpha) + d / h * alpha))
            if h > 1:
                zeros.append(h - 1)
                keep.append(i)
    return np.array(zeros, np.int64), np.array(keep, np.int64), float(np.sqrt(squares / max(1, len(delays))))


def smoothed(delays: np.ndarray, clock: float, choices: tuple[int, ...] = (2, 3, 4, 5)) -> np.ndarray:
    """See folds.smoothest."""
    if not len(delays):
        return np.zeros(0)
    ideal = np.array(choices) * clock / 2
    errors = delays[:, None] - ideal
    cost, back = np.zeros(len(ideal)), np.zeros((len(delays), len(ideal)), np.int64)
    for i in range(1, len(delays)):
        steps = cost + (errors[i][:, None] - errors[i - 1]) ** 2
        back[i] = steps.argmin(1)
        cost = steps.min(1) + (0.01 * errors[i]) ** 2
    way = np.empty(len(delays), np.int64)
    way[-1] = cost.argmin()
    for i in range(len(delays) - 1, 0, -1):
        way[i - 1] = back[i, way[i]]
    return ideal[way]


def expand(zeros: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits from runs: a leading 1, then zeros and a 1 for each; and the delay each bit comes from."""
    bits = np.zeros(int(zeros.sum() + len(zeros)) + 1, np.uint8)
    bits[0] = 1
    bits[np.cumsum(zeros + 1)] = 1
    return bits, np.concatenate([source[:1], np.repeat(source, zeros + 1)]) if len(source) else np.zeros(1, np.int64)


def find_bits(bits: np.ndarray, pattern: np.ndarray) -> int:
    """First place of a pattern, or -1."""
    return bits.tobytes().find(pattern.astype(np.uint8).tobytes())


def decode(bits: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Bytes, masks of wrong clock bits, and the bit each byte begins at. Stops before a pair of two ones."""
    n = len(bits) // 2
    clock, data = bits[: 2 * n : 2], bits[1 : 2 * n : 2]
    bad = np.flatnonzero(clock & data)
    n = (int(bad[0]) if len(bad) else n) // 8 * 8
    clock, data = clock[:n].astype(bool), data[:n].astype(bool)
    wrong = np.zeros(n, bool)
    wrong[1:] = clock[1:] != ~(data[1:] | data[:-1])
    return np.packbits(data).tobytes(), np.packbits(wrong).tobytes(), np.arange(0, 2 * n, 16)


def encode(data: bytes, before: int = 0) -> str:
    """Bit pairs of bytes after a data bit `before`."""
    out, last = [], before
    for byte in data:
        for i in range(7, -1, -1):
            bit = byte >> i & 1
            out.append("01" if bit else "00" if last else "10")
            last = bit
    return "".join(out)


def with_crc(raw: bytes) -> bytes:
    return raw + binascii.crc_hqx(raw, 0xFFFF).to_bytes(2, "big")


def record_bits(body: bytes, kind: int = 0) -> str:
    """Bits of a record: the sync words for its first three bytes, then the rest encoded; the checksum is included in `body`."""
    return SYNC[kind] * 3 + encode(body[3:], MARK_BYTE[kind] & 1)


def delays_of(bits: str, clock: float) -> np.ndarray:
    """Whole ticks between the ones of a bit string."""
    ones = np.flatnonzero(np.frombuffer(bits.encode(), np.uint8) == 49)
    places = np.floor(ones * clock / 2 + 0.5).astype(np.int64)
    return np.diff(places)


def synthetic_track(track_no: int, head: int, sectors: dict[int, bytes], clock: float = 23.0, deleted: tuple[int, ...] = ()) -> np.ndarray:
    """Delays of a track with a header and a data record for each sector, sync bytes and gaps between them."""
    bits, last = encode(b"\x4e" * 20), 0
    for number, data in sectors.items():
        code = (len(data) // 128).bit_length() - 1
        head_record = with_crc(bytes([0xA1, 0xA1, 0xA1, 0xFE, track_no, head, number, code]))
        data_record = with_crc(bytes([0xA1, 0xA1, 0xA1, 0xF8 if number in deleted else 0xFB]) + data)
        for record, gap in ((head_record, 22), (data_record, 54)):
            bits += encode(b"\x00" * 12, last) + record_bits(record) + encode(b"\x4e" * gap, record[-1] & 1)
            last = 0
    return delays_of(bits, clock)
