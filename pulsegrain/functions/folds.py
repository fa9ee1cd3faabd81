"""Recurrences along one sequence, as folds over an array: each record's steps depend on the one before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from . import mfm


def tracked(delays: Column, half: Column | float, alpha: Column | float) -> Column:
    """Phase-locked loop. A delay counts h = round(delay / half) half clocks; 0 and more than 4 are skipped. The half clock
    moves by alpha towards delay / h, within three quarters to nine quarters of what it was at first.
    Struct: half (last), n_zeroes (sum of h - 1 over counted delays), squares (sum of squared errors), n (delays counted): only
    numbers are carried along, so that a record costs its length. tracked_zeroes gives the zeroes themselves."""
    start = (half if isinstance(half, Column) else F.lit(float(half))).cast("double")
    a = (alpha if isinstance(alpha, Column) else F.lit(float(alpha))).cast("double")

    def step(s: Column, d: Column) -> Column:
        h = F.round(d / s["half"]).cast("int")
        moved = F.greatest(start * 0.75, F.least(start * 2.25, s["half"] * (1 - a) + d / F.greatest(h, F.lit(1)) * a))
        error = d - h * s["half"]
        go = (h >= 1) & (h <= 4)
        return F.when(
            go,
            F.struct(moved.alias("half"), (s["n_zeroes"] + h - 1).alias("n_zeroes"), (s["squares"] + error * error).alias("squares"), (s["n"] + 1).alias("n")),
        ).otherwise(s)

    zero = F.struct(start.alias("half"), F.lit(0).cast("long").alias("n_zeroes"), F.lit(0.0).alias("squares"), F.lit(0).alias("n"))
    return F.aggregate(delays, zero, step)


def tracked_zeroes(delays: Column, clock: float, alpha: float) -> Column:
    """Zeroes of each delay that has any, by the loop of `tracked`, in an Arrow function over whole records."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(records: pd.Series) -> pd.Series:
        return records.map(lambda d: None if d is None else mfm.track(np.asarray(d, np.int64), clock, alpha)[0].astype(np.int32))

    return run(delays)


def smoothest(delays: Column, clock: float) -> Column:
    """The delays as the steps of smoothest_cost explain them, without their errors: half clocks times the clock's half. Each
    step keeps the best step before it for each of the four choices; the way back from the cheapest end is the answer."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(records: pd.Series) -> pd.Series:
        return records.map(lambda d: None if d is None else mfm.smoothed(np.asarray(d, float), clock))

    return run(delays)


def biased(delays: Column, clock: float, alpha: float) -> Column:
    """Loop with an additive bias: c = int(delay - bias), h = round(2 c / clock), and the bias moves by alpha towards the
    error of c. Struct: bias (last), n_zeroes."""

    def step(s: Column, d: Column) -> Column:
        c = (d - s["bias"]).cast("int")
        h = F.round(c * 2.0 / clock).cast("int")
        error = d - h * (clock / 2)
        return F.struct((s["bias"] * (1 - alpha) + error * alpha).alias("bias"), (s["n_zeroes"] + F.greatest(h - 1, F.lit(0))).alias("n_zeroes"))

    return F.aggregate(delays, F.struct(F.lit(0.0).alias("bias"), F.lit(0).cast("long").alias("n_zeroes")), step)


def smoothest_cost(delays: Column, clock: float) -> Column:
    """Root of the least cost of explaining delays as 2 to 5 half clocks plus an error e that changes slowly: each step costs
    (e - e before)^2 + (e / 100)^2, the first nothing but the latter's absence; four states are carried along."""
    choices = [2, 3, 4, 5]

    def step(s: Column, d: Column) -> Column:
        errors = [d - clock * p / 2 for p in choices]
        costs = []
        for e in errors:
            back = [F.get(s["cost"], F.lit(q)) + F.pow(e - F.get(s["error"], F.lit(q)), F.lit(2.0)) for q in range(len(choices))]
            costs.append(F.when(F.size(s["cost"]) == 0, F.lit(0.0)).otherwise(F.least(*back) + F.pow(e * 0.01, F.lit(2.0))))
        return F.struct(F.array(*costs).alias("cost"), F.array(*errors).alias("error"))

    none = F.array().cast("array<double>")
    end = F.aggregate(delays, F.struct(none.alias("cost"), none.alias("error")), step)
    return F.sqrt(F.array_min(end["cost"]))
