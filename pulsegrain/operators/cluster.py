"""One-dimensional clustering. Values are collapsed to a histogram first, so that the search runs over distinct values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import record


def k_median(values: np.ndarray, weights: np.ndarray, k: int) -> tuple[list[float], float]:
    """Optimal centers (ascending) and the least sum of distances, by dynamic programming over sorted distinct values: a
    cluster is a stretch of them, and where the last one begins never goes back as more values are taken, which lets
    divide and conquer search each layer in n log n."""
    order = np.argsort(values, kind="stable")
    v, w = np.asarray(values, float)[order], np.asarray(weights, float)[order]
    n = len(v)
    k = min(k, n)
    count, total = np.concatenate([[0.0], np.cumsum(w)]), np.concatenate([[0.0], np.cumsum(v * w)])

    def middle(a: int, b: int) -> int:
        """Index of the lower weighted median of values a to b - 1."""
        return int(np.searchsorted(count, (count[a] + count[b]) / 2, side="left")) - 1

    def cost(a: int, b: int) -> float:
        m = max(a, min(b - 1, middle(a, b)))
        return v[m] * (count[m + 1] - count[a]) - (total[m + 1] - total[a]) + (total[b] - total[m + 1]) - v[m] * (count[b] - count[m + 1])

    best = [0.0] + [cost(0, b) for b in range(1, n + 1)]
    cuts = []
    for layer in range(1, k):
        new, at = [np.inf] * (n + 1), [0] * (n + 1)
        work = [(layer + 1, n, layer, n - 1)]
        while work:
            low, high, first, last = work.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            c, a = min((best[a] + cost(a, mid), a) for a in range(first, min(last, mid - 1) + 1))
            new[mid], at[mid] = c, a
            work += [(low, mid - 1, first, a), (mid + 1, high, a, last)]
        best = new
        cuts.append(at)
    centers, b = [], n
    for at in [*reversed(cuts), None]:
        a = at[b] if at else 0
        m = max(a, min(b - 1, middle(a, b)))
        # an even split lies between two values
        centers.append(float((v[m] + v[m + 1]) / 2) if m + 1 < b and count[m + 1] - count[a] == count[b] - count[m + 1] else float(v[m]))
        b = a
    return centers[::-1], float(best[n])


def k_center(values: np.ndarray, weights: np.ndarray, k: int, radius: float) -> tuple[list[float], float, int]:
    """Centers, largest distance and weight dropped, where values may be left out: the least of distance + dropped / 1000
    with no distance above `radius`. Clusters are stretches of distinct values, centered in their middle."""
    order = np.argsort(values, kind="stable")
    v, w = np.asarray(values, float)[order], np.asarray(weights, float)[order]
    n = len(v)
    # half gaps within the radius; a wider one can only pay if it takes in as much weight as it adds distance
    wide = np.searchsorted(v, v + 2 * radius + 1e-9, side="right")
    gaps = np.unique(np.concatenate([(v[i : wide[i]] - v[i]) / 2 for i in range(n)])) if n else ()
    count = np.concatenate([[0.0], np.cumsum(w)])
    best: tuple[float, float, list[float], float] | None = None
    for r in gaps:
        if best is not None and r >= best[0]:
            break
        reach = np.searchsorted(v, v + 2 * r + 1e-9, side="right")
        gain, pick = [np.zeros(n + 1)], []
        for _ in range(k):
            new, at = np.zeros(n + 1), [-1] * (n + 1)
            for i in range(n - 1, -1, -1):
                take = count[reach[i]] - count[i] + gain[-1][reach[i]]
                new[i], at[i] = (take, i) if take > new[i + 1] else (new[i + 1], at[i + 1])
            gain.append(new)
            pick.append(at)
        dropped = float(count[-1] - gain[-1][0])
        if best is None or r + dropped / 1000 < best[0] - 1e-12:
            centers, i = [], 0
            for at in reversed(pick):
                a = at[i] if i <= n else -1
                if a < 0:
                    break
                centers.append(float((v[a] + v[reach[a] - 1]) / 2))
                i = int(reach[a])
            best = (r + dropped / 1000, r, centers, dropped)
    if best is None:
        return [], 0.0, 0
    return best[2], float(best[1]), int(best[3])


def clusters(df: DataFrame, keys: Sequence[str], value: str, k: int, radius: float | None = None) -> DataFrame:
    """keys, centers, cost (and dropped with a radius): k-median, or k-center with outliers if a radius is given."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("n_"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[list(keys)].head(1).reset_index(drop=True)
        if radius is None:
            centers, cost = k_median(pdf["v_"].to_numpy(), pdf["n_"].to_numpy(), k)
            return head.assign(centers=[centers], cost=[cost])
        centers, cost, dropped = k_center(pdf["v_"].to_numpy(), pdf["n_"].to_numpy(), k, radius)
        return head.assign(centers=[centers], cost=[cost], dropped=[dropped])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in hist.select(*keys).schema]
    shape = ", ".join([*names, "centers array<double>", "cost double", *(["dropped long"] if radius is not None else [])])
    return (hist.groupBy(*keys) if keys else hist.withColumn("all_", F.lit(0)).groupBy("all_")).applyInPandas(solve, shape)


def densest_window(df: DataFrame, keys: Sequence[str], value: str, radius: float) -> DataFrame:
    """keys, start, n: the window of twice the radius that holds most values, the lowest of equals."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_"))
    window = Window.partitionBy(*keys).orderBy(value).rangeBetween(0, 2 * radius)
    rows = hist.withColumn("inside_", F.sum("n_").over(window))
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col("inside_"), (-F.col(value)).alias("low_"))).alias("b_")).select(*keys, (-F.col("b_.low_")).alias("start"), F.col("b_.inside_").alias("n"))


def moving_median(df: DataFrame, keys: Sequence[str], pos: str, value: str, reach: int) -> DataFrame:
    return df.withColumn("moving", F.expr(f"percentile(`{value}`, 0.5)").over(record(keys, pos).rowsBetween(-reach, reach)))


def moving_mean_residual(df: DataFrame, keys: Sequence[str], pos: str, residual: str, reach: int) -> DataFrame:
    return df.withColumn("moving", F.avg(residual).over(record(keys, pos).rowsBetween(-reach, reach)))


def local_k_median(values: np.ndarray, centers: Sequence[float], reach: int = 150, every: int = 801, fewest: int = 10) -> np.ndarray:
    """Centers at each value: one step of reassigning and taking lower medians in the window around it; a band of `fewest`
    values or less keeps its center, and every so many rows the centers are compared with the record's and the better kept.
    They start from the optimal medians of the first window, repaired by those of the record."""
    home = np.array(centers, float)
    first, n = np.unique(values[: reach + 1], return_counts=True)
    now = repaired(k_median(first, n, len(home))[0], home)
    out = np.empty((len(values), len(home)))
    for i in range(len(values)):
        near = values[max(0, i - reach) : i + reach + 1]
        if i and i % every == 0:
            fit = lambda c, near=near: np.abs(near[:, None] - c).min(1).sum()
            if fit(home) < fit(now):
                now = home.copy()
        band = np.abs(near[:, None] - now).argmin(1)
        for b in range(len(now)):
            mine = np.sort(near[band == b])
            if len(mine) > fewest:
                now[b] = mine[(len(mine) - 1) // 2]
        out[i] = now
    return out


def repaired(local: Sequence[float], home: Sequence[float]) -> np.ndarray:
    """Centers of a part of a record, one for each center of the whole: the nearest of those that are nearest to it, or itself
    where there is none."""
    here, out = np.array(local, float), np.array(home, float)
    gap = np.abs(here[:, None] - out)
    owner = gap.argmin(1)
    for g in set(owner.tolist()):
        mine = np.flatnonzero(owner == g)
        out[g] = here[mine[gap[mine, g].argmin()]]
    return out


def local_centers(df: DataFrame, keys: Sequence[str], pos: str, value: str, k: int = 3, reach: int = 150) -> DataFrame:
    """Each row with the centers around it (`centers`) and its own band, starting from the record's optimal k medians."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        x = pdf[value].to_numpy(float)
        v, n = np.unique(x, return_counts=True)
        c = local_k_median(x, k_median(v, n, k)[0], reach)
        return pdf.assign(centers=list(c), band=np.abs(x[:, None] - c).argmin(1).astype(np.int32))

    rows = df.select(*keys, pos, value)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "centers array<double>", "band int"])
    return rows.groupBy(*keys).applyInPandas(solve, shape)


def random_centers(intervals: Sequence[tuple[float, float]], seed: int, tries: int = 10000) -> list[float] | None:
    """A random set of centers that the intervals allow, or None after so many tries."""
    rng = np.random.default_rng(seed)
    for _ in range(tries):
        c = [rng.uniform(lo, hi) for lo, hi in intervals]
        if all(2 * intervals[i - 1][1] - c[i - 1] < c[i] < 2 * intervals[i][0] - c[i - 1] for i in range(1, len(c))):
            return c
    return None


def assignments(values: Sequence[float], intervals: Sequence[tuple[float, float]], most: int) -> Iterator[tuple[int, ...]]:
    """Band sequences for values between known intervals: each one outside takes either neighbour; at most `most` come out."""
    choices = []
    for x in values:
        inside = [i for i, (lo, hi) in enumerate(intervals) if lo <= x <= hi]
        below = sum(hi < x for _, hi in intervals)
        choices.append(inside or [b for b in (below - 1, below) if 0 <= b < len(intervals)])
    for n, c in enumerate(product(*choices)):
        if n >= most:
            return
        yield c
