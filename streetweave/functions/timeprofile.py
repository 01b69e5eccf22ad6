"""Flows spread over the hours of a day by skew-normal profiles.

The integral of a profile over an hour is linear in the amount, so each hour's weight is one number worked
out on the driver, and a column is a sum of amounts times numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skewed_density(t: float, amount: float, loc: float, shape: float, skew: float) -> float:
    z = (t - loc) / shape
    return amount / (shape * math.sqrt(2 * math.pi)) * math.exp(-z * z / 2) * (1 + math.erf(skew * z / math.sqrt(2)))


def hour_weight(loc: float, shape: float, skew: float, hour: float, wrap: bool = False, steps: int = 256) -> float:
    """Integral of the unit profile over the hour around `hour`, and the same hour a day before and after with `wrap` (Simpson's rule)."""
    total = 0.0
    for shift in (0, 24, -24) if wrap else (0,):
        lo, h = hour + shift - 0.5, 1.0 / steps
        ys = [skewed_density(lo + i * h, 1.0, loc, shape, skew) for i in range(steps + 1)]
        total += h / 3 * (ys[0] + ys[-1] + 4 * sum(ys[1:-1:2]) + 2 * sum(ys[2:-1:2]))
    return total


def hour_weights(sets: Sequence[tuple[str, float, float, float]], spread: int = 1, start: int = 0, end: int = 24, wrap: bool = False) -> dict[int, dict[str, list[float]]]:
    """For each hour from `start` to `end` in steps of `spread`: the weights of each set's column."""
    out: dict[int, dict[str, list[float]]] = {}
    for k, hour in enumerate(range(start, end, spread)):
        for column, loc, shape, skew in sets:
            out.setdefault(k * spread, {}).setdefault(column, []).append(hour_weight(loc, shape, skew, hour, wrap))
    return out


def spread_hours(df: DataFrame, sets: Sequence[tuple[str, float, float, float]], spread: int = 1, prefix: str = "HrTrf_", start: int = 0, end: int = 24, wrap: bool = False) -> DataFrame:
    """`df` with a column for each hour. sets: (amount column, location, shape, skew)."""
    columns = {}
    for hour, weights in hour_weights(sets, spread, start, end, wrap).items():
        terms = [F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, ws in weights.items() for w in ws]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        columns[f"{prefix}{hour}"] = total
    return df.withColumns(columns)
