"""Loops that follow drifting bands along a record, one record after the other on a task."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .cluster import k_center, k_median


class Scale:
    """Centers that drift together: what they were at first, times a number that moves."""

    def __init__(self, centers: Sequence[float]) -> None:
        self.at_first, self.now = np.array(centers, float), 1.0

    def excess(self, values: np.ndarray) -> np.ndarray:
        """How much larger each value is than its nearest center, as a share of that."""
        own = self.at_first[np.abs(values[:, None] - self.now * self.at_first).argmin(1)]
        return values / (self.now * own) - 1

    def move(self, by: float) -> float:
        self.now *= 1 + by
        return self.now


def _banded(values: np.ndarray, centers: Sequence[float], scales: np.ndarray) -> np.ndarray:
    return np.abs(values[:, None] - scales[:, None] * np.array(centers, float)).argmin(1).astype(np.int32)


def delay_of(alpha: float) -> int:
    """Values that a lagged loop looks ahead."""
    return int((1 - alpha) / alpha)


def lagged(values: np.ndarray, centers: Sequence[float], alpha: float = 0.05) -> np.ndarray:
    """Bands by a scale that moves by alpha of each value's excess. A value's band is read off the scale as it stands
    (1 - alpha) / alpha values later, or at the end of the record."""
    scale = Scale(centers)
    after = np.array([scale.move(alpha * float(scale.excess(v)[0])) for v in values.reshape(-1, 1)])
    later = np.minimum(np.arange(len(values)) + delay_of(alpha), len(values) - 1)
    return _banded(values, centers, after[later])


def neighbourhood(values: np.ndarray, centers: Sequence[float], alpha: float = 0.05, reach: int = 15) -> np.ndarray:
    """Bands by a scale that moves by alpha of the median excess of the values around each one."""
    scale = Scale(centers)
    after = [scale.move(alpha * float(np.median(scale.excess(values[max(0, i - reach) : i + reach])))) for i in range(len(values))]
    return _banded(values, centers, np.array(after))


def centred(values: np.ndarray, centers: Sequence[float], alpha: float = 0.005, width: int = 55) -> np.ndarray:
    """Bands by a scale that moves by alpha of the mean excess in a window around each value. A value's excess is taken once,
    by the scale at which it enters the window."""
    scale, half, n = Scale(centers), width // 2, len(values)
    window: deque[float] = deque(scale.excess(values[:half]).tolist())
    total, after = sum(window), np.empty(n)
    for i in range(n):
        for v in values[i + half : i + half + 1]:
            window.append(float(scale.excess(np.array([v]))[0]))
            total += window[-1]
        after[i] = scale.move(alpha * total / len(window))
        if i >= half:
            total -= window.popleft()
    return _banded(values, centers, after)


def follow(df: DataFrame, keys: Sequence[str], pos: str, value: str, loop: Callable[..., np.ndarray], k: int = 3, centers: Sequence[float] | None = None, **options) -> DataFrame:
    """keys, pos, value and band by a loop that starts from the given centers, or else from each record's optimal k medians."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        x = pdf[value].to_numpy(float)
        v, n = np.unique(x, return_counts=True)
        return pdf.assign(band=loop(x, centers or k_median(v, n, k)[0], **options))

    rows = df.select(*keys, pos, value)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "band int"])
    return rows.groupBy(*keys).applyInPandas(solve, shape)


def fewest_errors(values: Sequence[float], intervals: Sequence[tuple[float, float]], errors: Callable[[tuple[int, ...]], int], right: Callable[[tuple[int, ...]], bool], most: int = 4096, trusted: int = 50) -> tuple[int, ...] | None:
    """Of the band sequences that known intervals leave open, the one with fewest code errors. A right checksum decides only
    among the first `trusted`: one in 65536 wrong tries has one by accident."""
    from .cluster import assignments

    best: tuple[int, tuple[int, ...]] | None = None
    for n, a in enumerate(assignments(values, intervals, most)):
        if n < trusted and right(a):
            return a
        e = errors(a)
        if best is None or e < best[0]:
            best = (e, a)
    return best[1] if best else None


def least_radius(values: np.ndarray, k: int, radii: Sequence[float], errors: Callable[[np.ndarray], int]) -> tuple[float, np.ndarray, int] | None:
    """Radius, bands and errors of the first radius whose k-center bands decode without errors, else of the one with fewest;
    the optimal k medians (radius 0) are tried first."""
    v, n = np.unique(values, return_counts=True)
    best: tuple[float, np.ndarray, int] | None = None
    for r in (0.0, *radii):
        centers = k_median(v, n, k)[0] if not r else k_center(v, n, k, r)[0]
        if not centers:
            continue
        bands = np.abs(values[:, None] - np.array(centers)).argmin(1)
        e = errors(bands)
        if best is None or e < best[2]:
            best = (r, bands, e)
        if not e:
            break
    return best


def header_needles(track: int, head: int, first: int, last: int, size_code: int) -> Iterator[tuple[int, bytes]]:
    """Sector number and whole header with checksum for each sector of a range, to be searched with errors."""
    from ..functions.mfm import with_crc

    for sector in range(first, last + 1):
        yield sector, with_crc(bytes([0xA1, 0xA1, 0xA1, 0xFE, track, head, sector, size_code]))
